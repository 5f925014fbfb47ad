"""The graph of records that arrive: each micro-batch adds partial states, which merge to what one run over all records gives.

A record has a place (time, position, id) instead of a number, so a late one moves no other. A batch
writes, under its own id, its relations, the first places of its nodes, judged triples and partial edges: the first
row, the first known values with their places, and counts, all of which merge by minimum and sum; evidence
is kept long. Where a late record gives a node an earlier place, the records from that place on that name it are judged again, and what
that admits is added. A batch that runs again after a failure writes the same folders anew and reads only batches
before it, so nothing counts twice. Numbers of records are given when tables are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.operators import assembly, evidence, graph, ordering, versions
from stepweave.session import ensure_checkpoint_dir
from stepweave.sources.readers import parsed_lines

PLACE = ["domain_id", "record_idx"]
_FIRST, _KNOWN = assembly._EDGE, assembly._EDGE_KNOWN


def place() -> Column:
    """A record's place as text that sorts like (timestamp, input_pos, evidence_id)."""
    number = F.lpad(F.coalesce("input_pos", F.lit(0)).cast("string"), 20, "0")
    return F.concat_ws("\0", F.coalesce("timestamp", F.lit("")), number, "evidence_id")


def partial_edges(rows: DataFrame) -> DataFrame:
    """States of edges from their observations: first (the first row's values), a first known value of each kind, mentions."""
    known = [F.min(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v")))).alias(c) for c in _KNOWN]
    return rows.groupBy(*assembly.EDGE_KEYS).agg(F.min(F.struct("at", *_FIRST)).alias("first"), *known, F.count("*").alias("mentions"))


def merged(states: DataFrame) -> DataFrame:
    """States of the same edges from any number of batches as one."""
    return states.groupBy(*assembly.EDGE_KEYS).agg(F.min("first").alias("first"), *(F.min(c).alias(c) for c in _KNOWN), F.sum("mentions").alias("mentions"))


class GraphStream:
    """Tables below a path that all executors share, grown by add(); decisions as assembly.assemble() takes them, for every label that will come."""

    def __init__(self, spark: SparkSession, path: str, decisions: DataFrame, anchors: tuple[str, ...] = K.ANCHORS, families: tuple[str, ...] = tuple(K.TYPE_CONSTRAINTS), rules: DataFrame | None = None):
        ensure_checkpoint_dir(spark)
        self.spark, self.path, self.decisions, self.anchors, self.families, self.rules = spark, path, decisions, anchors, families, rules

    # --- tables by batch

    def _exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def batches(self) -> list[int]:
        """The batches that are written whole."""
        return sorted(r["batch"] for r in self.spark.read.schema("batch int, n long").parquet(f"{self.path}/done").collect()) if self._exists("done") else []

    def _read(self, name: str, before: int | None = None) -> DataFrame | None:
        kept = [b for b in self.batches() if before is None or b < before]
        if not kept:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/batch={b}" for b in kept))

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        folder = f"{self.path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    # --- growing

    def add(self, records: DataFrame, batch: int) -> None:
        """Take in records (labels canonical) as batch number `batch`; the same batch again replaces itself. A record whose id a domain has already is left out."""
        if batch in self.batches():
            return
        records = records.drop("record_idx").dropDuplicates(["domain_id", "evidence_id"]).withColumn("record_idx", place())
        known = self._read("records", batch)
        if known is not None:
            records = records.join(known.select("domain_id", "evidence_id"), ["domain_id", "evidence_id"], "left_anti")
        records = records.checkpoint()
        self._write(records.select(*PLACE, "evidence_id", "timestamp"), "records", batch)
        made, anchored, observed = assembly.graph_nodes(records, self.decisions, self.anchors)
        made = self._write(made, "nodes", batch)
        self._write(versions.first_places(observed, assembly.NODE_KEYS, "at"), "node_evidence", batch)
        stream = self._write(assembly.relation_stream(records), "relations", batch)
        supports = self._write(assembly.step_supports(records), "supports", batch)
        old = self._read("nodes", batch)
        nodes = self._merged_nodes(made if old is None else old.drop("batch").unionByName(made)).checkpoint()
        judged, again = stream, None
        if old is not None:
            again = self._touched(nodes, self._merged_nodes(old.drop("batch")), batch)
            again = again.checkpoint()
            judged = stream.unionByName(again)
            supports = supports.unionByName(self._read("supports", batch).drop("batch"))
        typed = nodes.select("domain_id", "label", "layer", assembly.semantic_type(nodes).alias("parent_anchor"), "first_record_idx", "step_action")
        triples = assembly.shown_triples(graph.judge_relations(judged, typed, supports, self.decisions, self.families, self.rules))
        triples = self._write(triples, "triples", batch)
        fresh = triples
        if again is not None:
            before = self._read("triples", batch).where("status = 'accepted'").select(*PLACE, "seq").distinct()
            fresh = triples.join(before, [*PLACE, "seq"], "left_anti").select(*triples.columns)
        rows = assembly.edge_observations(fresh, anchored).checkpoint()
        self._write(partial_edges(rows), "edges", batch)
        self._write(versions.first_places(rows, assembly.EDGE_KEYS, "at"), "edge_evidence", batch)
        # The batch is there from here on.
        self.spark.createDataFrame([(batch, 1)], "batch int, n long").coalesce(1).write.mode("append").parquet(f"{self.path}/done")

    @staticmethod
    def _merged_nodes(rows: DataFrame) -> DataFrame:
        """One row a node: that of its first place; a step's action is the last one's."""
        others = [c for c in rows.columns if c not in assembly.NODE_KEYS]
        one = rows.groupBy(*assembly.NODE_KEYS).agg(F.min_by(F.struct(*others), "first_record_idx").alias("s"), F.max_by("step_action", "first_record_idx").alias("_action"))
        return one.select(*assembly.NODE_KEYS, *(f"s.{c}" for c in others if c != "step_action"), F.col("_action").alias("step_action")).select(*rows.columns)

    def _touched(self, nodes: DataFrame, before: DataFrame, batch: int) -> DataFrame:
        """The relations of earlier records that name, at or after its new first place, a node that is new or earlier than it was."""
        was = before.select(*(F.col(k).alias(f"_{k}") for k in assembly.NODE_KEYS), F.col("first_record_idx").alias("_was"))
        moved = nodes.join(was, (F.col("domain_id") == F.col("_domain_id")) & (F.col("label") == F.col("_label")), "left")
        moved = moved.where(F.col("_was").isNull() | (F.col("first_record_idx") < F.col("_was"))).select(F.col("domain_id").alias("_d"), F.col("label").alias("_l"), F.col("first_record_idx").alias("_from"))
        relations = self._read("relations", batch).drop("batch")
        named = relations.select(*PLACE, "head", "tail")
        hit = None
        for end in ("head", "tail"):
            own = named.join(moved, (F.col("domain_id") == F.col("_d")) & (F.col(end) == F.col("_l")) & (F.col("record_idx") >= F.col("_from")), "left_semi").select(*PLACE)
            hit = own if hit is None else hit.unionByName(own)
        # Whole records: what is several in one hangs on all its relations.
        return relations.join(hit.distinct(), PLACE, "left_semi").select(*relations.columns)

    def start(self, lines: DataFrame, checkpoint: str, prepared: Callable[[DataFrame], DataFrame] = evidence.canonical, **options: str):
        """A streaming query that takes in a stream of JSON lines (value): a StreamingQuery. Batches that the checkpoint repeats are replaced or left out."""

        def take(batch: DataFrame, number: int) -> None:
            told = parsed_lines(batch.select("value", F.lit("").alias("file"), F.lit(0).cast("long").alias("input_pos")))
            self.add(prepared(told), number)

        writer = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).options(**options)
        return writer

    # --- reading

    def numbers(self) -> DataFrame:
        """domain_id, place, evidence_id, timestamp, record_idx of all records."""
        told = self._read("records").drop("batch").withColumnRenamed("record_idx", "place")
        return ordering.ranked(told, ["domain_id"], ["place"], "record_idx").withColumn("record_idx", F.col("record_idx").cast("int"))

    def _numbered(self, df: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
        """df with the places in a column replaced by numbers of records; what is there from the start has 0."""
        own = numbers.select(F.col("domain_id").alias("_d"), F.col("place").alias("_p"), F.col("record_idx").alias("_n"))
        joined = df.join(own, (F.col("domain_id") == F.col("_d")) & (F.col(column) == F.col("_p")), "left")
        return joined.withColumn(column, F.coalesce("_n", F.lit(0))).drop("_d", "_p", "_n")

    def nodes(self) -> DataFrame:
        """All nodes, as assembly.assemble() gives them, with their evidence."""
        rows = self._merged_nodes(self._read("nodes").drop("batch")).drop("step_action")
        places = self._read("node_evidence").groupBy(*assembly.NODE_KEYS, "evidence_id").agg(F.min("first_at").alias("first_at"))
        return versions.with_provenance(self._numbered(rows, "first_record_idx", self.numbers()), places, assembly.NODE_KEYS)

    def edges(self) -> DataFrame:
        """All edges, as assembly.assemble() gives them, with their evidence."""
        states = merged(self._read("edges").drop("batch"))
        flat = states.select(*assembly.EDGE_KEYS, *(F.col(f"first.{c}").alias(c) for c in _FIRST), *(F.col(f"{c}.v").alias(c) for c in _KNOWN), "mentions")
        named = F.concat_ws("::", "domain_id", F.lit("edge"), "head", "label", "tail").alias("edge_id")
        flat = flat.select(named, *(F.col(c).alias({"timestamp": "valid_from", "record_idx": "first_record_idx"}.get(c, c)) for c in flat.columns))
        places = self._read("edge_evidence").groupBy(*assembly.EDGE_KEYS, "evidence_id").agg(F.min("first_at").alias("first_at"))
        return versions.with_provenance(self._numbered(flat, "first_record_idx", self.numbers()), places, assembly.EDGE_KEYS)

    def triples(self) -> DataFrame:
        """All judged relations, each as it was judged last."""
        rows = self._read("triples")
        others = [c for c in rows.columns if c not in (*PLACE, "seq", "batch")]
        last = rows.groupBy(*PLACE, "seq").agg(F.max_by(F.struct(*others), "batch").alias("s")).select(*PLACE, "seq", "s.*")
        return self._numbered(last, "record_idx", self.numbers()).select(*(c for c in rows.columns if c != "batch"))
