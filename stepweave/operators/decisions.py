"""Attachment decisions from retrieved anchors and hints, without a model, and repair of those a model gives.

Candidates have candidate_id, label, hint, hint_candidates, families and top_anchor (null: none retrieved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave import constants as K

_MODEL_FAMILIES = ("propagation", "communication")


def usable_hint() -> Column:
    """The hint if it is a base type, else the first base type among the hint candidates."""
    listed = F.filter("hint_candidates", lambda h: h.isin(*K.BASE_ANCHORS))
    return F.coalesce(F.when(F.col("hint").isin(*K.BASE_ANCHORS), F.col("hint")), F.get(listed, F.lit(0)))


def _has(*families: str) -> Column:
    return F.arrays_overlap("_families", F.array(*map(F.lit, families)))


def fitted(anchor: Column) -> Column:
    """A proposed anchor as hints and the families of the candidate's relations allow it; null if nothing fits."""
    hint = usable_hint()
    proposed = F.when(anchor.isNull() | (anchor == "Task"), hint).otherwise(anchor)

    def fits(a: Column) -> Column:
        return F.forall("_families", lambda f: F.coalesce(*(F.when(f == name, a.isin(*allowed)) for name, allowed in K.FAMILY_ANCHORS.items()), F.lit(True)))

    spread = _has(*_MODEL_FAMILIES) & ~_has("task_dependency")
    return F.when(proposed.isNull() | (F.size("_families") == 0) | fits(proposed), proposed).when(spread | fits(hint), hint)


def _ready(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("_families", F.array_distinct(F.coalesce("families", F.array().cast("array<string>"))))


def top1_decisions(candidates: DataFrame, free_growth: bool = False, least: float = 0.0, backbone: tuple[str, ...] = K.ANCHORS) -> DataFrame:
    """candidates with route, parent_anchor, confidence, justification, reject_reason: by the best anchor, else the hint.

    least raises the confidence of specializations; 0.6 gives the deterministic strategy.
    """
    out = _ready(candidates).withColumn("_best", F.when(F.col("top_anchor").isNotNull() | usable_hint().isNotNull(), fitted(F.col("top_anchor")))).withColumn("_hinted", fitted(F.lit(None).cast("string")))
    known, parent = F.col("label").isin(*backbone), F.coalesce("_best", "_hinted")
    kept = parent.isNotNull() | F.lit(free_growth)
    sure = F.when(F.col("_best").isNotNull(), 0.55).when(F.col("_hinted").isNotNull(), 0.5).otherwise(0.25)
    why = F.when(F.col("_best").isNotNull(), "embedding top-1 anchor").when(F.col("_hinted").isNotNull(), "preprocessing semantic type hint").otherwise("no anchor available")
    return out.select(
        *candidates.columns,
        F.when(known, "reuse_backbone").when(kept, "vertical_specialize").otherwise("reject").alias("route"),
        F.when(~known, parent).alias("parent_anchor"),
        F.when(known, 1.0).when(kept, F.greatest(sure, F.lit(least))).otherwise(sure).alias("confidence"),
        F.when(known, "already in frozen backbone").when(kept & F.lit(least > 0), "deterministic anchor routing").otherwise(why).alias("justification"),
        F.when(~known & ~kept, "cannot_anchor_backbone").alias("reject_reason"),
    )


def priors(candidates: DataFrame, backbone: tuple[str, ...] = K.ANCHORS) -> DataFrame:
    """What a model is told of each candidate: the anchors found, the route they speak for and how strongly."""
    out = _ready(candidates).withColumn("retrieved", fitted(F.col("top_anchor"))).withColumn("hinted", fitted(F.lit(None).cast("string"))).withColumn("recommended_anchor", F.coalesce("retrieved", "hinted"))
    agree = F.coalesce(F.col("retrieved") == F.col("hinted"), F.lit(False))
    found = F.col("recommended_anchor").isNotNull()
    return out.select(
        *candidates.columns, "retrieved", "hinted", "recommended_anchor",
        F.when(F.col("label").isin(*backbone), "reuse_backbone").when(found, "vertical_specialize").otherwise("reject").alias("recommended_route"),
        agree.alias("agreement"),
        F.when(agree | F.coalesce(F.col("top_anchor") == usable_hint(), F.lit(False)), "high").when(found, "medium").otherwise("low").alias("strength"),
    )


def complete(candidates: DataFrame, decided: DataFrame, backbone: tuple[str, ...] = K.ANCHORS) -> DataFrame:
    """A decision for each candidate: a model's (candidate_id, route, parent_anchor, reject_reason, confidence), or a rejection where it gave none.

    Decisions on unknown ids are dropped. Reuse of the backbone by a label that is not in it becomes
    specialization of its own, the retrieved or the hinted anchor, the first that fits, else a rejection.
    """
    given = decided.select("candidate_id", "route", "parent_anchor", "reject_reason", "confidence", F.lit(True).alias("_given")).dropDuplicates(["candidate_id"])
    both = _ready(candidates).join(given, "candidate_id", "left")
    own = F.when(F.col("parent_anchor").isin(*backbone), F.col("parent_anchor"))
    wrong = (F.col("route") == "reuse_backbone") & ~F.col("label").isin(*backbone)
    both = both.withColumn("_anchor", F.when(wrong, F.coalesce(fitted(own), fitted(F.col("top_anchor")), fitted(F.lit(None).cast("string"))))).withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
    lost = F.col("_wrong") & F.col("_anchor").isNull()
    return both.select(
        *candidates.columns,
        F.when(F.col("_given").isNull() | lost, "reject").when(F.col("_wrong"), "vertical_specialize").otherwise(F.col("route")).alias("route"),
        F.when(F.col("_wrong"), F.col("_anchor")).otherwise(F.col("parent_anchor")).alias("parent_anchor"),
        F.when(F.col("_given").isNull(), "llm_no_decision").when(lost, "cannot_anchor_backbone").when(~F.col("_wrong"), F.col("reject_reason")).alias("reject_reason"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
