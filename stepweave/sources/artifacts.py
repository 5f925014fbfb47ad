"""What a run leaves behind: a folder of tables by variant and domain, summaries, records by domain, vectors.

Tables are written by the executors; only summaries of a row per domain pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import audits, graph, versions
from stepweave.operators.assembly import EDGE_KEYS, NODE_KEYS, Graph
from stepweave.sources.writers import graphml, write_json_lines

SUMMARIES = ("graph_summary", "construction_summary", "data_flow", "attachment_audit", "relation_audit", "node_distributions")

#: What the rows of a run's tables are ordered by, within their domain.
ORDERS = {
    "nodes": ("label",), "edges": ("edge_id",), "triples": ("record_idx", "seq"), "snapshots": ("record_idx",), "node_versions": ("label", "from_idx"), "edge_versions": ("edge_id", "from_idx"),
    "candidates": ("label",), "assertions": ("object_id", "transaction_time"), "events": ("event_id",),
}


def write_summary(df: DataFrame, path: str) -> None:
    """A small table as one file of JSON lines in a folder; what was there is replaced when the new file is whole."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def summaries(made: Graph, units: DataFrame, judged: DataFrame) -> dict[str, DataFrame]:
    """All summaries of a run by name; units and judged as evidence.evidence_units() and audits.judged_candidates() give them."""
    domains = units.select("domain_id").unionByName(made.snapshots.select("domain_id")).distinct()
    return {
        "graph_summary": audits.graph_summary(domains, made.node_rows, made.edge_rows, made.triples, made.snapshots),
        "construction_summary": audits.construction_summary(domains, judged, made.node_rows, made.edge_rows, made.triples, made.snapshots),
        "data_flow": audits.data_flow(domains, units, judged, made.node_rows, made.edge_rows, made.triples),
        "attachment_audit": audits.attachment_audit(judged),
        "relation_audit": graph.relation_audit(made.triples),
        "node_distributions": audits.node_distributions(made.node_rows),
    }


def export_run(made: Graph, units: DataFrame, judged: DataFrame, backbone: DataFrame, path: str, variant: str, detailed: bool = False) -> None:
    """A run's folder: path/variant/{summaries, graph, graphml, backbone}.

    Nodes, edges, triples and snapshots are Parquet by domain, GraphML is a folder per domain, whose files
    one after the other by name are the document, sorted and written by many tasks; with
    detailed the judged candidates, assertions and events are written too. Evidence stands in node_versions and
    edge_versions, a row for each record that gave an object; only GraphML lists all of it in the object's own row.
    """
    root = f"{path}/{variant}"
    for name, df in summaries(made, units, judged).items():
        write_summary(df, f"{root}/summaries/{name}")
    write_summary(backbone, f"{root}/backbone")
    tables = {"nodes": made.node_rows, "edges": made.edge_rows, "triples": made.triples, "snapshots": made.snapshots, "node_versions": made.node_versions, "edge_versions": made.edge_versions}
    if detailed:
        tables |= {"candidates": judged, "assertions": made.assertions, "events": made.events}
    parts = int(backbone.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, df in tables.items():
        # In order of the domain's keys: files hold ranges of them, so that readers of few keys skip most.
        by = ["domain_id", *ORDERS[name]]
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("domain_id").parquet(f"{root}/graph/{name}")
    for row in made.snapshots.select("domain_id").distinct().toLocalIterator():
        graphml(made.nodes, made.edges, row["domain_id"]).select("value").write.mode("overwrite").text(f"{root}/graphml/{row['domain_id']}")


def load_snapshot(spark: SparkSession, path: str, variant: str, domain: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a domain had them after a snapshot, with the values and the evidence known by then; KeyError where there is none of that name."""
    table = lambda name: spark.read.parquet(f"{path}/{variant}/graph/{name}").where(F.col("domain_id") == domain)
    at = table("snapshots").where(F.col("snapshot_id") == snapshot_id).select("record_idx").first()
    if at is None:
        raise KeyError(snapshot_id)
    return versions.state(table("node_versions"), at["record_idx"], NODE_KEYS), versions.state(table("edge_versions"), at["record_idx"], EDGE_KEYS)


def benchmark_summary(spark: SparkSession, path: str, variants: list[str]) -> DataFrame:
    """The construction summaries of some variants of a run, with variant_id."""
    out = None
    schema = "domain_id string, " + ", ".join(f"{c} long" for c in _CONSTRUCTION)
    for variant in variants:
        text = spark.read.schema(schema).json(f"{path}/{variant}/summaries/construction_summary").withColumn("variant_id", F.lit(variant))
        out = text if out is None else out.unionByName(text)
    if out is None:
        raise ValueError("no variants")
    return out


_CONSTRUCTION = (
    "candidate_count", "accepted_adapter_candidate_count", "accepted_backbone_reuse_count", "rejected_candidate_count", "adapter_concept_count", "node_count", "edge_count", "candidate_triple_count",
    "accepted_triple_count", "rejected_triple_count", "snapshot_count",
)


def write_records(records: DataFrame, path: str) -> None:
    """Add records to a table of JSON lines by domain; records of ids that it holds already are left out, so a repeated run adds nothing."""
    spark = records.sparkSession
    if _table_exists(spark, path):
        held = spark.read.schema("evidence_id string, domain_id string").json(path).select("domain_id", "evidence_id")
        records = records.join(held, ["domain_id", "evidence_id"], "left_anti").select(*records.columns)
    records.write.mode("append").partitionBy("domain_id").json(path)


def _table_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def load_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """text_hash and vector of a model's cached texts, one row a text; empty where nothing was saved yet."""
    if not _table_exists(spark, path):
        return spark.createDataFrame([], "text_hash string, vector array<double>")
    own = spark.read.parquet(path).where(F.col("model") == model)
    return own.groupBy("text_hash").agg(F.min_by("vector", "added_at").alias("vector"))


def save_vectors(new: DataFrame, path: str, model: str) -> None:
    """Add vectors (text_hash, text, vector) of a model to the cache, those that it lacks."""
    held = load_vectors(new.sparkSession, path, model).select("text_hash")
    added = new.dropDuplicates(["text_hash"]).join(held, "text_hash", "left_anti")
    rows = added.select("text_hash", "text", F.col("vector").cast("array<double>").alias("vector"), F.current_timestamp().alias("added_at"), F.lit(model).alias("model"))
    rows.write.mode("append").partitionBy("model").parquet(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """The raw answers of a model (raw_response among the columns) as JSON lines."""
    write_json_lines(answers.where("raw_response IS NOT NULL"), path)
