"""Attaching candidates to anchors by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.functions.text import anchor_by_words, step_id, whole_word


def looks_like_person(label: Column, description: Column) -> Column:
    return label.rlike(K.PERSON_TITLE) | label.rlike(whole_word(K.PERSON_ROLE)) | (label.rlike(K.PERSON_NAME) & F.coalesce(description, F.lit("")).rlike(whole_word(K.PERSON_ROLE)))


def looks_like_document(label: Column, description: Column) -> Column:
    return ~label.rlike(K.STEP_LABEL) & F.concat_ws(" ", label, description).rlike(whole_word(K.DOCUMENT_WORDS))


def preferred_anchor(hint: Column, hypernym: Column, text: Column) -> Column:
    """The hint, else the hypernym, else the anchor that the words name."""
    return F.coalesce(hint, hypernym, anchor_by_words(text))


def propose(candidates: DataFrame, backbone: tuple[str, ...] = K.ANCHORS) -> DataFrame:
    """A proposal for each candidate without any model: reuse the backbone, specialize an anchor, or reject."""
    anchor = preferred_anchor(F.col("hint"), F.col("hypernym"), F.concat_ws(" ", "label", "description"))
    known = F.col("label").isin(*backbone)
    return candidates.select(
        "*",
        F.when(known, "reuse_backbone").when(anchor.isNotNull(), "vertical_specialize").otherwise("reject").alias("route"),
        F.when(~known, anchor).alias("parent_anchor"),
        F.when(known, 1.0).when(anchor.isNotNull(), 0.5).otherwise(0.0).alias("confidence"),
        F.when(~known & anchor.isNull(), "cannot_anchor_backbone").alias("reject_reason"),
    )


def decide(proposals: DataFrame, routes: tuple[str, ...] = ("reuse_backbone", "vertical_specialize", "reject"), free_growth: bool = False, backbone: tuple[str, ...] = K.ANCHORS) -> DataFrame:
    """The rules' verdict on proposals, first match wins: route, parent_anchor, admit, reject_reason, confidence.

    backbone: the labels that are nodes from the start and that others may specialize, curated ones included.
    """
    label, parent = F.col("label"), F.trim(F.coalesce("parent_anchor", F.lit("")))
    own = label.isin(*backbone)
    special = F.col("route") == "vertical_specialize"
    reason = (
        F.when(own, None)
        .when(~F.col("route").isin(*routes), "route_not_allowed")
        .when(looks_like_person(label, F.col("description")), "person_name")
        .when(looks_like_document(label, F.col("description")), "document_title")
        .when(F.trim(label).rlike(K.PLACEHOLDER), "low_graph_value")
        .when(F.col("route") == "reuse_backbone", "backbone_label_mismatch")
        .when(special & (parent == "") & F.lit(not free_growth), "invalid_backbone_parent")
        .when(special & (parent != "") & ~parent.isin(*backbone), "invalid_backbone_parent")
        .when(special, None)
        .when(F.col("route") == "reject", F.coalesce("reject_reason", F.lit("low_graph_value")))
        .otherwise("route_not_allowed")
    )
    out = proposals.withColumn("reject_reason", reason)
    admit = F.col("reject_reason").isNull()
    return out.withColumn("route", F.when(own, "reuse_backbone").when(admit, F.col("route")).otherwise("reject")).withColumn("parent_anchor", F.when(admit & ~own & (parent != ""), parent)).withColumn("admit", admit).withColumn("confidence", F.when(own, 1.0).otherwise(F.col("confidence")))


def admitted_schema(decisions: DataFrame) -> DataFrame:
    """What a domain adds to the backbone: admitted specializations, sorted by domain and label."""
    return decisions.where(F.col("admit") & (F.col("route") == "vertical_specialize") & step_id(F.col("label")).isNull()).select("domain_id", "label", "parent_anchor", "description", "evidence_ids").orderBy("domain_id", "label")
