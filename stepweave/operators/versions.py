"""The graph as it was after any record, from one table: versions of objects, each with the interval in which it holds.

Rows that give an object (observations) are counted by object and record first, so that what follows
grows with records and not with mentions. A version begins with each record that gives the object anew and
ends with the next; its counts are running sums in the order of records (ordering.ranked), its end comes by a join
with the next version's number. No window and no list holds all of an object's rows. Evidence is kept long, a row
for each object and evidence at its first place; arrays of it are made at sinks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.operators import ordering


def _same(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def first_places(rows: DataFrame, keys: list[str], at: str = "record_idx") -> DataFrame:
    """keys, evidence_id, first_idx, first_at, mentions: a row per object and evidence; rows without evidence are left out.

    rows have keys, record_idx, evidence_id and `at`, the place that orders them.
    """
    return rows.where("evidence_id IS NOT NULL").groupBy(*keys, "evidence_id").agg(F.min("record_idx").alias("first_idx"), F.min(at).alias("first_at"), F.count("*").alias("mentions"))


def with_provenance(table: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """table with provenance: the evidence of each object in the order of its first places; for sinks, whose form is one row an object."""
    listed = places.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "evidence_id"))), lambda x: x["evidence_id"]).alias("provenance"))
    joined = table.join(listed, _same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys]), "left")
    return joined.select(*table.columns, F.coalesce("provenance", F.array().cast("array<string>")).alias("provenance"))


def versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version (from 1), from_idx, to_idx (null: still holds), evidence_id, mentions, evidence_count.

    rows: keys, record_idx, evidence_id, one per mention; a row without evidence_id is no mention, but begins a version (what is there
    from the start has one at 0). evidence_id is what the version adds, null where the object had it already; mentions and
    evidence_count are those up to to_idx. A record has one evidence_id; of several the first by name is added.
    """
    per = rows.groupBy(*keys, "record_idx").agg(F.count("evidence_id").alias("_m"), F.min("evidence_id").alias("evidence_id"))
    first = rows.where("evidence_id IS NOT NULL").groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("evidence_id").alias("_e")).agg(F.min("record_idx").alias("_first"))
    marked = per.join(first, _same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys]) & (F.col("evidence_id") == F.col("_e")), "left")
    new = F.coalesce(F.col("_first") == F.col("record_idx"), F.lit(False))
    slim = marked.select(*keys, "record_idx", "_m", F.when(new, F.col("evidence_id")).alias("evidence_id"))
    numbered = ordering.ranked(slim, keys, ["record_idx"], "version", {"mentions": F.col("_m"), "evidence_count": F.col("evidence_id").isNotNull().cast("int")})
    following = numbered.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("version") - 1).alias("_v"), F.col("record_idx").alias("to_idx"))
    joined = numbered.join(following, _same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys]) & (F.col("version") == F.col("_v")), "left")
    return joined.select(*keys, "version", F.col("record_idx").alias("from_idx"), "to_idx", "evidence_id", "mentions", "evidence_count")


def with_values(held: DataFrame, objects: DataFrame, keys: list[str], known: list[str] = ()) -> DataFrame:
    """versions() with the objects' values; a `known` one holds from the record in its column `<name>_from` on and is null before."""
    others = [c for c in objects.columns if c not in keys and c not in held.columns and c not in known and c not in [f"{k}_from" for k in known]]
    right = objects.select(*(F.col(k).alias(f"_{k}") for k in keys), *others, *(F.struct(F.col(c).alias("v"), F.col(f"{c}_from").alias("at")).alias(f"_known_{c}") for c in known))
    joined = held.join(right, _same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys]))
    return joined.select(*held.columns, *others, *(F.when(F.col(f"_known_{c}.at") <= F.col("from_idx"), F.col(f"_known_{c}.v")).alias(c) for c in known))


def state(held: DataFrame, idx: int | Column, keys: list[str]) -> DataFrame:
    """The objects as they were after record idx (one number for all domains), with mentions, evidence_count and provenance up to it."""
    idx = F.lit(idx) if isinstance(idx, int) else idx
    upto = held.where(F.col("from_idx") <= idx)
    alive = upto.where(F.col("to_idx").isNull() | (F.col("to_idx") > idx)).drop("evidence_id")
    places = upto.where("evidence_id IS NOT NULL").select(*keys, "evidence_id", F.col("from_idx").alias("first_at"))
    return with_provenance(alive, places, keys)
