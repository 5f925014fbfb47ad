"""Five stages from raw documents to a weighted mix; each is written as Parquet and read by the next.

Repeated rows of one id and text stay or go together; rows without an id are judged one by one like others,
but of near-duplicate ones those with an id stay, the smallest first, and else one of them. Empty tables give empty tables. Columns besides
doc_id, text, source and n_chars may have any name.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import shared
from stepweave.llm.op2_quality import passing_documents
from stepweave.llm.op5_pii import redact_pii
from stepweave.llm.op6_decontamination import decontaminate
from stepweave.llm.op8_mixing import take_mix
from stepweave.llm.op9_minhash import near_duplicates


class _Spent(threading.local):
    """Tables of the stage before in this thread: its result is written when the next stage begins."""

    tables: tuple[DataFrame, ...] = ()


_spent = _Spent()


def _stage(work):
    """A stage that deletes what the one before it has left, and leaves its own tables to the next."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.release(*_spent.tables)
        since = shared.mark()
        out = work(spark, docs, sf_dir)
        _spent.tables = tuple(shared.tables_since(since))
        return out

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict let pass."""
    return passing_documents(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates.

    Every id stands for itself, and each row without one gets a key of its own, above all ids, so that no such
    row decides on others. Only those rows are written for this.
    """
    key = shared.free_name(docs, "near_key")
    top = docs.agg(F.max("doc_id")).first()[0]
    own = F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1)
    without = shared.materialize(docs.where("doc_id IS NULL").withColumn(key, own), "without_id")
    keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.col("doc_id").cast("long")).unionByName(without)
    kept = near_duplicates(keyed, key).where("kept").select(F.col(key).alias(f"{key}_kept")).distinct()
    return keyed.join(kept, F.col(key) == F.col(f"{key}_kept"), "left_semi").drop(key)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars set to the new length."""
    out = redact_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their texts, and how much of each it takes: mix_size, mix_target, mix_epochs, mix_part, mix_taken."""
    return take_mix(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: The semi-Markov field of the fourth stage has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. What its stages have written goes as soon as it is read, but for the last one's input, which the result reads."""
    folder = f"{shared.scratch_dir(spark)}/stepweave-pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            schema = docs.schema
            docs.write.parquet(f"{folder}/{k}")
            if k:
                shared.delete(spark, f"{folder}/{k - 1}")
            docs = spark.read.schema(schema).parquet(f"{folder}/{k}")
    return docs
