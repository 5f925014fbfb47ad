"""What filters remove in every order (operator 13): a trie of permutations over survivors.

Documents are measured once; a slim table holds, for each, its part, its labels and whether it fails
each filter. From it the trie of orders is walked depth first: a node's survivors are those of the node
above less what one more filter removes, persisted while the walk is below it. Nodes reached by other
orders of the same filters have the same survivors, so each of the 2**n sets is visited once and its
counts are remembered (written to a table); every edge counts what it really removes from the survivors.
The n! orders are then read off the counted edges, and a filter's sum over all orders is one over their rows.

Duplicates: the first id of each text is found by a digest (sha-256) of the text, counted before the
shuffle; only digests of two documents or more are joined back, a join that adaptive execution splits where a text is very common.

Edge cases: a null text is empty, and equal to other empty ones; a null source is the part '';
a null id is smaller than none and larger than none; labels of an id that occur more than once count if any is 1; repeated rows count one by one
(a copy of the same id is no smaller id); an empty table has no parts and gives no rows. Columns of other names are left alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.op2_quality import let, words_of
from stepweave.llm.shared import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "#$%&*|"


def fixed_filters(text: str = "text") -> dict[str, Column]:
    """The four filters that see one text: too few words, too few distinct ones, too many capitals, marks."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = let(words_of(F.col(text)), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("distinct")))
    without = lambda chars: F.char_length(F.translate(whole, chars, ""))
    return {
        "A": let(words, lambda w: F.struct((w["n"] < 200).alias("A"), (100 * w["distinct"] < 50 * w["n"]).alias("B"))),
        "C": 100 * (F.char_length(whole) - without(UPPER)) > 2 * F.char_length(whole),
        "D": without(MARKS) < F.char_length(whole),
    }


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good and toxic: a row per document."""
    made = fixed_filters()
    whole = F.coalesce(F.col("text"), F.lit(""))
    measured = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), made["A"].alias("w"), made["C"].alias("C"), made["D"].alias("D"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    measured = materialize(measured.select("id", "part", "w.A", "w.B", "C", "D", "digest"), "measured")
    first = measured.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    marked = measured.join(first, F.col("digest") == F.col("of"), "left").withColumn("E", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without an id, however many, have no labels and take no part in the join.
    kept = ("part", "A", "B", "C", "D", "E")
    with_id = marked.where(F.col("id").isNotNull()).join(known, F.col("id") == F.col("labelled"), "left")
    with_id = with_id.select(*kept, *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    return with_id.unionByName(marked.where(F.col("id").isNull()).select(*kept, F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def edge_counts(fails: DataFrame, filters: str = "ABCDE", part: str = "part") -> DataFrame:
    """state (the filters before, in alphabetical order), filter, part, survivors, removed, good_lost, toxic_lost for every edge of the trie.

    Parts without survivors have no row. fails has a boolean column for each filter, and good and toxic.
    """
    counted: dict[str, DataFrame] = {}

    def count(survivors: DataFrame, state: str) -> DataFrame:
        left = [f for f in filters if f not in state]
        number = lambda c: F.sum(c.cast("long"))
        edges = F.array(*(F.struct(F.lit(f).alias("filter"), number(F.col(f)).alias("removed"), number(F.col(f) & F.col("good")).alias("good_lost"), number(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in left))
        per = survivors.groupBy(part).agg(F.count("*").alias("survivors"), edges.alias("edges"))
        return materialize(per.select(F.lit(state).alias("state"), part, "survivors", F.inline("edges")), "edges")

    def walk(survivors: DataFrame, state: str) -> None:
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted[state] = count(survivors, state)
            for f in filters:
                below = "".join(sorted((*state, f)))
                # The last filter's edge is counted from above: nothing follows it.
                if f not in state and below not in counted and len(below) < len(filters):
                    walk(survivors.where(~F.col(f)), below)
        finally:
            survivors.unpersist()

    walk(fails, "")
    out = None
    for table in counted.values():
        out = table if out is None else out.unionByName(table)
    return out


def orders(spark, filters: str = "ABCDE") -> DataFrame:
    """filter_order, step, filter and state of every step of every order: n! times n rows, made from the filters' names."""
    rows = [("".join(p), k + 1, p[k], "".join(sorted(p[:k]))) for p in permutations(filters) for k in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, state string")


def filter_audit(fails: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = fails.sparkSession
    edges = materialize(edge_counts(fails, filters), "trie")
    alone = lambda f: "".join(x for x in filters if x != f)
    last = F.col("state") == F.element_at(F.create_map(*(F.lit(x) for f in filters for x in (f, alone(f)))), F.col("filter"))
    # An order's step depends on the set before it alone, of which s!(n-1-s)! orders have the same.
    factorial = [1]
    for k in range(1, len(filters) + 1):
        factorial.append(factorial[-1] * k)
    weight = F.element_at(F.array(*(F.lit(factorial[s] * factorial[len(filters) - 1 - s]) for s in range(len(filters)))), F.length("state") + 1)
    totals = edges.groupBy(F.col("part").alias("of"), F.col("filter").alias("by")).agg(
        F.sum(F.when(F.col("state") == "", F.col("removed")).otherwise(0)).alias("fails"), F.sum(F.when(last, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley")
    )
    steps = F.broadcast(orders(spark, filters))  # n! * n rows whatever the data
    parts = totals.join(steps, F.col("by") == F.col("filter"))
    e = edges.select(F.col("part").alias("epart"), F.col("state").alias("estate"), F.col("filter").alias("efilter"), "survivors", "removed", "good_lost", "toxic_lost")
    joined = parts.join(e, (F.col("of") == F.col("epart")) & (F.col("state") == F.col("estate")) & (F.col("filter") == F.col("efilter")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = number(F.col("removed"))
    return joined.select(
        F.col("of").alias("part"), "filter_order", "step", number(F.col("survivors") - F.col("removed")).alias("kept"), removed.alias("removed"), (F.col("fails") - removed).cast("long").alias("redundant"), number(F.col("unique_fails")).alias("unique_fails"), number(F.col("good_lost")).alias("good_lost"), number(F.col("toxic_lost")).alias("toxic_lost"), number(F.col("shapley")).alias("shapley")
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(failures(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = r"""
WITH known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < docs.doc_id, false)] AS f
  FROM docs JOIN firsts USING (t) LEFT JOIN known ON known.doc_id = docs.doc_id),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
perms AS (SELECT row_number() OVER () AS p, [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT p, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, s.k AS step, o[s.k] AS f, o[1 : s.k - 1] AS before FROM perms, l s),
kinds AS (SELECT part, good, toxic, f, count(*) AS n FROM flags GROUP BY ALL),
judged AS (SELECT part, filter_order, step, s.f AS own, n, good, toxic, k.f[s.f] AS fails, len(list_filter(before, lambda x: k.f[x])) > 0 AS gone, len(list_filter(k.f, lambda x: x)) = 1 AS single FROM kinds k, steps s),
counted AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
  coalesce(sum(n) FILTER (single AND fails), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""
