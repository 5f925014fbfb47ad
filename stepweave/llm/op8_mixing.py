"""Mixing sources to target weights (operator 8).

Documents get hash-random keys; each source is cut into ranges of the key, sized by its row
count, so that a sort and prefix sums run range by range whatever a source's share of all rows;
sums of the ranges before it give each range its start. The mix takes whole epochs of a source
and, of the last one, the documents up to the exact budget (the one that crosses it in part).

Edge cases: a null text has size 0, a null source is a source of its own (last in order), equal
keys are ordered by id and size, repeated rows count one by one, an empty table gives no rows,
and a source without words has target 0. Columns other than the three named may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.op2_quality import words_of
from stepweave.llm.shared import free_name, materialize

RANGE_ROWS = 2000


def source_targets(totals: DataFrame, epochs: int = 3) -> DataFrame:
    """totals (source, source_size, source_rows) with weight and target.

    Weights 1, 2, 3 repeat over the sources in order of code points, null last. A source stops at
    `epochs` times its size; going up by size for weight, it is capped if its share of what the
    capped ones before it leave is above that. A row per source: one sort of the sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long")).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.select("*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("_words"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weight"))
    capped = left.withColumn("capped", F.col("cap") * F.col("_weight") < F.col("_words") * F.col("weight"))
    free = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    shared = (F.col("weight") * free).cast("double") / weight.cast("double")
    return capped.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared)).select("source", "source_size", "source_rows", "weight", "target")


def mix_sources(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", epochs: int = 3) -> DataFrame:
    """id_col, source, size, source_size, target, epochs (whole copies), part (words of one more copy) and taken, a row per document; texts are not moved."""
    sized = documents.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), _key(F.col(id_col)).alias("key"))
    sized = materialize(sized, "mixing")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = materialize(source_targets(totals, epochs).withColumnRenamed("source", "_source"), "targets")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / RANGE_ROWS)).cast("long")
    dealt = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges, 32))
    sums = dealt.groupBy(F.col("source").alias("_source"), F.col("range").alias("_range")).agg(F.sum("size").alias("_sum"))
    starts = sums.select("_source", "_range", F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).withColumn("before", F.col("before") + F.col("_start"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("before")
    taken = placed.withColumn("epochs", full).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def take_mix(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", epochs: int = 3) -> DataFrame:
    """The documents of the mix, all columns as they are, and mix_size, mix_target, mix_epochs, mix_part and mix_taken of each.

    Texts are not moved: each source's last epoch ends at one key, and a row per source tells every
    document where. Repeated rows of the document at the cut share its last part equally, rounded down.
    Documents of which nothing is taken are left out. Existing columns of these names are replaced.
    """
    mixed = mix_sources(documents, id_col, text, source, epochs)
    mixed = materialize(mixed.select(F.col(source).alias("s"), _key(F.col(id_col)).alias("key"), F.col(id_col).alias("id"), "size", "target", "epochs", "part"), "mix")
    at = F.struct("key", "id", "size")
    sources = mixed.groupBy(F.col("s").alias("of")).agg(F.first("target").alias("target"), F.first("epochs").alias("epochs"), F.max(F.when(F.col("part") > 0, at)).alias("cut"))
    sources = materialize(sources, "sources")
    at_cut = F.col("s").eqNullSafe(F.col("of")) & at.eqNullSafe(F.col("cut"))
    last = mixed.join(sources.select("of", "cut"), at_cut).groupBy(F.col("s").alias("s")).agg(F.floor(F.sum("part") / F.count("*")).cast("long").alias("last"))
    cuts = sources.join(last, F.col("of").eqNullSafe(F.col("s")), "left")
    cuts = materialize(cuts.select(F.struct(F.col("of").alias("s"), "target", "epochs", "cut", F.coalesce("last", F.lit(0).cast("long")).alias("last")).alias("c")), "cuts")
    whole = free_name(documents, "c")
    cuts = cuts.withColumnRenamed("c", whole)
    c = lambda name: F.col(f"{whole}.{name}")
    size = F.size(words_of(F.col(text))).cast("long")
    own = F.struct(_key(F.col(id_col)).alias("key"), F.col(id_col).alias("id"), size.alias("size"))
    # Nulls of the id come first, as in a sort.
    part = F.when(c("cut").isNull() | (size == 0), 0).when(own.eqNullSafe(c("cut")), c("last")).when(own < c("cut"), size).otherwise(0)
    joined = documents.join(cuts, F.col(source).eqNullSafe(c("s")))
    new = {"mix_size": size, "mix_target": c("target"), "mix_epochs": c("epochs"), "mix_part": part.cast("long")}
    out = joined.select(*(x for x in documents.columns if x.lower() not in (*new, "mix_taken")), *(v.alias(k) for k, v in new.items()))
    return out.withColumn("mix_taken", F.col("mix_epochs") * F.col("mix_size") + F.col("mix_part")).where("mix_taken > 0")


def _key(id_col):
    """The hash-random key of a document."""
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM totals),
left_over AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS words, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * weights < words * weight AS capped FROM left_over),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE) / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM marked),
placed AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken, source FROM placed
"""
