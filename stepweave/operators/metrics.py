"""Evaluation against gold labels and counts across domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.text import evaluation_label
from stepweave.operators import containment


def gold_evaluation(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per domain: gold, matched, correct, wrong, missing and extra labels, coverage and accuracy.

    gold and predicted: domain_id, label, parent_anchor, one row per label.
    """
    g, p = gold.select("domain_id", "label", F.col("parent_anchor").alias("want"), F.lit(1).alias("g")), predicted.select("domain_id", "label", F.col("parent_anchor").alias("got"), F.lit(1).alias("p"))
    both = g.join(p, ["domain_id", "label"], "full")
    matched = F.col("g").isNotNull() & F.col("p").isNotNull()
    right = matched & F.col("want").eqNullSafe(F.col("got"))
    out = both.groupBy("domain_id").agg(F.count("g").alias("gold"), F.count_if(matched).alias("matched"), F.count_if(right).alias("correct"), F.count_if(matched & ~F.col("want").eqNullSafe(F.col("got"))).alias("wrong"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return out.withColumn("coverage", share("matched", "gold")).withColumn("accuracy", share("correct", "matched"))


def shared_labels(rows: DataFrame, label: str, domain: str, value: str) -> DataFrame:
    """label, domains, values, consistent: labels of two domains at least, and whether they agree on the value."""
    out = rows.groupBy(label).agg(F.count_distinct(domain).alias("domains"), F.count_distinct(value).alias("distinct_values"))
    return out.where("domains > 1").withColumn("consistent", F.col("distinct_values") <= 1)


def drift_rate(held: DataFrame) -> DataFrame:
    """The share of assertions that supersede another."""
    return held.agg(F.round(F.avg(F.col("supersedes").isNotNull().cast("double")), 4).alias("drift_rate"), F.count("*").alias("assertions"))


def gold_of_documents(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """The gold rows (source_doc) of the documents of some evidence (evidence_id): ids alike, alike in evaluation form without blanks, or one within the other.

    Both sides are joined as distinct ids, and only ids that no equal one settles are searched for in each other, through an
    index of q-grams. An empty id lies within all others.
    """
    plain = lambda c: F.replace(evaluation_label(F.col(c)), F.lit(" "), F.lit(""))
    docs = gold.select("source_doc").distinct().withColumn("_doc", plain("source_doc"))
    ids = evidence.select(plain("evidence_id").alias("_id")).where("_id IS NOT NULL").distinct()
    same = docs.join(ids.withColumnRenamed("_id", "_doc"), "_doc", "left_semi")
    rest = docs.join(same.select("source_doc"), "source_doc", "left_anti")
    docs_left, other = rest.where("_doc <> ''").select("_doc"), ids.where("_id <> ''")
    inside = containment.lies_within(docs_left.distinct().withColumnRenamed("_doc", "p"), other.withColumnRenamed("_id", "w")).withColumnRenamed("p", "_doc")
    around = containment.contains_any(docs_left.distinct().withColumnRenamed("_doc", "w"), other.withColumnRenamed("_id", "p")).withColumnRenamed("w", "_doc")
    settled = inside.unionByName(around).unionByName(rest.where("_doc = ''").select("_doc")).distinct()
    if not ids.where("_id = ''").isEmpty():
        settled = rest.select("_doc").distinct()
    if ids.isEmpty():
        settled = settled.limit(0)
    within = rest.join(settled, "_doc", "left_semi").select(same.columns)
    return gold.join(same.union(within.select(same.columns)).select("source_doc"), "source_doc", "left_semi").select(*gold.columns)
