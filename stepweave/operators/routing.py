"""Ranking anchors for candidates by vector similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.constants import BASE_ANCHORS, FAMILY_WEIGHTS
from stepweave.functions.text import text_hash
from stepweave.operators import vector_search

MOST_ANCHORS = 1000


def few(anchors: DataFrame, most: int = MOST_ANCHORS) -> DataFrame:
    """The anchors, marked for broadcast: a fixed vocabulary, whose size is checked first."""
    if anchors.limit(most + 1).count() > most:
        raise ValueError(f"over {most} anchors; anchors are a fixed vocabulary, not data")
    return F.broadcast(anchors)


def rank_anchors(candidates: DataFrame, anchors: DataFrame, top: int = 3, digits: int = 5, ranked_by: int = vector_search.DIGITS) -> DataFrame:
    """candidate_id, anchor, score, rank: the `top` most similar anchors of each candidate; ties in the anchors' order.

    candidates (candidate_id, vector) stream by the anchors (anchor, position, anchor_vector), which travel in blocks
    of bounded size, however many there are; scores are rounded to `digits` when they are ranked. ranked_by: the digits
    within which scores are a tie.
    """
    found = vector_search.nearest_of_few(candidates, "candidate_id", "vector", vector_search.sound(anchors, "position", "anchor_vector"), top, ranked_by)
    named = found.join(anchors.select(F.col("position").cast("long").alias("id"), "anchor"), "id")
    return named.select("candidate_id", "anchor", F.round("score", digits).alias("score"), "rank")


def relation_bonus(anchor: Column, families: Column) -> Column:
    """The sum of the families' weights for an anchor, within 0.20 either way."""
    table = F.create_map(*(x for f, w in FAMILY_WEIGHTS.items() for a, v in w.items() for x in (F.lit(f"{f}/{a}"), F.lit(v))))
    total = F.aggregate(F.coalesce(families, F.array().cast("array<string>")), F.lit(0.0), lambda t, f: t + F.coalesce(table[F.concat(f, F.lit("/"), anchor)], F.lit(0.0)))
    return F.greatest(F.lit(-0.2), F.least(F.lit(0.2), total))


def rerank_adjustment(anchor: Column, hint: Column, hint_candidates: Column, hypernym: Column, families: Column) -> Column:
    """What context adds to a similarity: hints, hypernym and relations."""
    by_hint = (
        F.when(hint == anchor, 0.20)
        .when(F.coalesce(F.array_contains(hint_candidates, anchor), F.lit(False)), 0.12)
        .when(hint.isNotNull() & anchor.isin(*BASE_ANCHORS) & hint.isin(*BASE_ANCHORS), -0.15)
        .otherwise(0.0)
    )
    return by_hint + F.when(hypernym == anchor, 0.25).otherwise(0.0) + relation_bonus(anchor, families)


def baseline_text(label: Column, description: Column) -> Column:
    return F.trim(F.concat(label, F.lit(": "), F.coalesce(description, F.lit(""))))


def contextual_text(c: DataFrame) -> Column:
    """What a candidate (label, description, evidence_texts, families, hint, hint_candidates, hypernym) is embedded as."""
    listed = lambda name: F.array_join(F.coalesce(c[name], F.array().cast("array<string>")), ", ")
    texts = F.array_join(F.filter(F.slice(F.coalesce(c["evidence_texts"], F.array().cast("array<string>")), 1, 2), lambda t: t != ""), " ")
    told = lambda name, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{name}: "), text))
    return F.concat_ws(
        " | ", baseline_text(c["label"], c["description"]), told("evidence", texts), told("relations", listed("families")), told("semantic hint", c["hint"]),
        told("semantic hint candidates", listed("hint_candidates")), told("shared hypernym", c["hypernym"]),
    )


def prototype_texts(anchor: Column, description: Column) -> Column:
    """The three texts by which an anchor is compared in context."""
    return F.array(
        F.concat(anchor, F.lit(": "), description),
        F.concat(anchor, F.lit(" industrial ontology concept. Typical terms: "), description),
        F.concat(F.lit("Route candidates here when their function, relation context, and semantic evidence indicate "), anchor, F.lit(".")),
    )


def empty_rankings(candidates: DataFrame) -> DataFrame:
    """The result of routing that is switched off: no anchor for any candidate."""
    return candidates.limit(0).select("candidate_id", F.lit("").alias("anchor"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def _similarities(held):
    """For each candidate, 0.75 of the greatest cosine to each anchor's prototypes and 0.25 of their mean, in the anchors' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototypes = [vector_search.unit(np.array(p, np.float64).reshape(len(p), -1)) for p in held.value]
        for batch in batches:
            near = np.zeros((batch.num_rows, len(prototypes)))
            for rows, vectors in vector_search.matrices(batch.column(batch.num_columns - 1).fill_null([])):
                for k, p in enumerate(prototypes):
                    if vectors.shape[1] == p.shape[1]:
                        cosines = vectors @ p.T
                        near[rows, k] = 0.75 * cosines.max(1) + 0.25 * cosines.mean(1)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), len(prototypes)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*batch.schema.names[:-1], "near"])

    return run


def rerank_anchors(candidates: DataFrame, anchors: DataFrame, top: int = 3, digits: int = 5, ranked_by: int = vector_search.DIGITS) -> DataFrame:
    """candidate_id, anchor, score, rank: 0.75 of the best prototype's similarity, 0.25 of their mean, and what context adds.

    candidates: candidate_id, vector, hint, hint_candidates, hypernym, families; anchors: anchor, position and
    prototypes (vectors), a fixed vocabulary. The anchors travel to the candidates, which are not shuffled; ties, within
    ranked_by digits, go by position, and scores are rounded to `digits` when they are ranked. A candidate without a vector has similarity 0 to all.
    """
    few(anchors)
    known = anchors.select("anchor", "position", F.transform("prototypes", lambda p: p.cast("array<double>")).alias("prototypes")).orderBy("position").collect()
    if not known:
        return empty_rankings(candidates)
    held = candidates.sparkSession.sparkContext.broadcast([r["prototypes"] for r in known])
    kept = ("candidate_id", "hint", "hint_candidates", "hypernym", "families")
    asking = candidates.select(*kept, F.col("vector").cast("array<double>").alias("vector"))
    kinds = ", ".join(f"{c} {asking.schema[c].dataType.simpleString()}" for c in kept)
    near = asking.mapInArrow(_similarities(held), f"{kinds}, near array<double>")

    def score(name: str, k: int) -> Column:
        more = rerank_adjustment(F.lit(name), F.col("hint"), F.col("hint_candidates"), F.col("hypernym"), F.col("families"))
        return F.struct((-F.round(F.get("near", F.lit(k)) + more, ranked_by)).alias("s"), F.lit(k).alias("p"), F.lit(name).alias("anchor"))

    every = F.array(*(score(r["anchor"], k) for k, r in enumerate(known)))
    flat = near.select("candidate_id", F.posexplode(F.slice(F.sort_array(every), 1, top)).alias("pos", "x"))
    return flat.select("candidate_id", F.col("x.anchor").alias("anchor"), F.round(-F.col("x.s"), digits).alias("score"), (F.col("pos") + 1).alias("rank"))


MODES = ("baseline", "contextual_rerank")


def routed(candidates: DataFrame, backbone: DataFrame, embedded: Callable[[DataFrame], DataFrame], mode: str = "baseline", top: int = 3) -> DataFrame:
    """candidates with retrieved (the `top` anchors in order: anchor, score, rank) and top_anchor (the first).

    candidates: candidate_id and what the texts are made of; backbone: label, description, place. embedded gets a column of
    texts (text) and returns text_hash and vector of the distinct ones; it is called once, for candidates and anchors together.
    """
    if mode not in MODES:
        raise ValueError(f"unknown routing mode: {mode}")
    own = baseline_text(F.col("label"), F.col("description")) if mode == "baseline" else contextual_text(candidates)
    asking = candidates.withColumn("_text", own).withColumn("_hash", text_hash(own))
    told = F.array(baseline_text(F.col("label"), F.col("description"))) if mode == "baseline" else prototype_texts(F.col("label"), F.col("description"))
    prototypes = backbone.select(F.col("label").alias("anchor"), F.col("place").alias("position"), F.posexplode(told).alias("nth", "text"))
    vectors = embedded(asking.select(F.col("_text").alias("text")).unionByName(prototypes.select("text")))
    vectors = vectors.select(F.col("text_hash").alias("_of"), "vector")
    ready = asking.join(vectors, F.col("_hash") == F.col("_of"), "left")
    placed = prototypes.join(vectors, text_hash(F.col("text")) == F.col("_of"))
    if mode == "baseline":
        found = rank_anchors(ready.select("candidate_id", "vector"), placed.select("anchor", "position", F.col("vector").alias("anchor_vector")), top)
    else:
        listed = placed.groupBy("anchor", "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "vector"))), lambda x: x["vector"]).alias("prototypes"))  # three an anchor
        found = rerank_anchors(ready.select("candidate_id", "vector", "hint", "hint_candidates", "hypernym", "families"), listed, top)
    best = found.groupBy(F.col("candidate_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "anchor", "score"))).alias("retrieved"))  # `top` a candidate
    return candidates.join(best, F.col("candidate_id") == F.col("_id"), "left").withColumn("top_anchor", F.get("retrieved", F.lit(0))["anchor"]).drop("_id")


def rank_by_prototypes(scores: DataFrame, top: int = 3, digits: int = 5) -> DataFrame:
    """From scores (candidate_id, anchor, position, similarity, adjustment), one per prototype: 0.75 of the best, 0.25 of the mean, and the adjustment."""
    joined = scores.groupBy("candidate_id", "anchor", "position").agg(F.round(0.75 * F.max("similarity") + 0.25 * F.avg("similarity") + F.first("adjustment"), digits).alias("score"))
    order = Window.partitionBy("candidate_id").orderBy(F.desc("score"), "position")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("candidate_id", "anchor", "score", "rank")
