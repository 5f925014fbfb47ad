"""Bi-temporal assertions, snapshots and lifecycle events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.constants import FAR_FUTURE, LIFECYCLE_EVENTS
from stepweave.operators import ordering
from stepweave.session import ensure_checkpoint_dir


def assertions(facts: DataFrame) -> DataFrame:
    """facts (object_id, fact_id, at) as intervals: each fact supersedes the one before it and ends it."""
    order = Window.partitionBy("object_id").orderBy("at", "fact_id")
    return facts.select("*", F.lag("fact_id").over(order).alias("supersedes"), F.col("at").alias("valid_from"), F.lead("at").over(order).alias("valid_to"))


def as_of(snapshots: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (probe_id, object_id, at) the last snapshot (object_id, created_at, seq, ...) up to then.

    Both sides are merged into one ordered stream per object, and each probe takes the last
    snapshot before it: one shuffle, no row pairs. Probes without a snapshot have null.
    """
    held = snapshots.select("object_id", F.col("created_at").alias("t"), F.lit(0).alias("kind"), "seq", F.lit(None).cast("long").alias("probe_id"), F.struct("snapshot_id", "created_at").alias("s"))
    asked = probes.select("object_id", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "probe_id", F.lit(None).cast(held.schema["s"].dataType).alias("s"))
    order = Window.partitionBy("object_id").orderBy("t", "kind", "seq", "probe_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = held.unionByName(asked).withColumn("s", F.last("s", ignorenulls=True).over(order))
    return found.where("kind = 1").select("probe_id", "object_id", F.col("t").alias("at"), "s.snapshot_id", "s.created_at")


def snapshot(rows: DataFrame, idx: int) -> DataFrame:
    """The graph as it stood after record idx."""
    return rows.where(F.col("first_record_idx") <= idx)


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and change: added, removed, or modified where the value differs."""
    b, a = before.select(F.col(key).alias("k"), F.col(value).alias("old"), F.lit(1).alias("was")), after.select(F.col(key).alias("k"), F.col(value).alias("new"), F.lit(1).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return b.join(a, "k", "full").select(F.col("k").alias(key), change.alias("change")).where("change IS NOT NULL")


def lifecycle_events(facts: DataFrame) -> DataFrame:
    """object_id, fact_id, at, event of facts (object_id, fact_id, at, label, supersedes).

    Creation of an object by its first fact, an update by each that supersedes another, and what edge labels stand for, in any case.
    """
    order = Window.partitionBy("object_id").orderBy("at", "fact_id")
    numbered = facts.withColumn("n", F.row_number().over(order))
    made = F.array(F.when(F.col("n") == 1, "creation"), F.when(F.col("supersedes").isNotNull(), "update"), F.try_element_at(_events(), F.lower("label")))
    return numbered.select("object_id", "fact_id", "at", F.explode(F.array_compact(made)).alias("event"))


def _events():
    return F.create_map(*(F.lit(x) for pair in LIFECYCLE_EVENTS.items() for x in pair))


def snapshot_id(domain, record_idx):
    return F.concat(domain, F.lit("-snapshot-"), F.when(record_idx < 1000, F.lpad(record_idx.cast("string"), 3, "0")).otherwise(record_idx.cast("string")))


def graph_assertions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An assertion for each node and edge at the record that first gave it; the backbone is not asserted."""
    parts = [nodes.where("first_record_idx > 0").select("domain_id", F.col("node_id").alias("object_id"), F.lit("schema").alias("object_type"), "first_record_idx", "valid_from")]
    parts.append(edges.select("domain_id", F.col("edge_id").alias("object_id"), F.lit("triple").alias("object_type"), "first_record_idx", "valid_from"))
    flat = parts[0].unionByName(parts[1]).withColumn("snapshot_id", snapshot_id(F.col("domain_id"), F.col("first_record_idx")))
    named = flat.withColumn("assertion_id", F.concat_ws("::", "snapshot_id", "object_type", "object_id"))
    order = Window.partitionBy("domain_id", "object_id").orderBy("first_record_idx")
    return named.select(
        "domain_id", "assertion_id", "object_type", "object_id", F.col("valid_from").alias("valid_time_start"), F.lead("valid_from").over(order).alias("valid_time_end"), F.col("valid_from").alias("transaction_time"),
        F.lag("assertion_id").over(order).alias("supersedes"), "snapshot_id",
    )


def graph_events(held: DataFrame, edges: DataFrame) -> DataFrame:
    """Lifecycle events of assertions and edges: event_id, domain_id, event_type, object_id, timestamp, description.

    They are numbered in each domain: those of assertions by time, then those of edges.
    """
    first = F.row_number().over(Window.partitionBy("domain_id", "object_id").orderBy("transaction_time", "assertion_id"))
    both = F.array(
        F.when(F.col("_n") == 1, F.struct(F.lit("creation").alias("event_type"), F.concat(F.lit("First observation of "), F.col("object_id")).alias("description"))),
        F.when(F.col("supersedes").isNotNull(), F.struct(F.lit("update").alias("event_type"), F.concat("object_id", F.lit(" supersedes "), "supersedes").alias("description"))),
    )
    asserted = held.withColumn("_n", first).select("domain_id", "object_id", F.col("transaction_time").alias("timestamp"), F.lit(0).alias("part"), F.posexplode(F.array_compact(both)).alias("k", "e"))
    of_edges = edges.select(
        "domain_id", F.col("head").alias("object_id"), F.coalesce("valid_from", F.lit("")).alias("timestamp"), F.lit(1).alias("part"), F.lit(0).alias("k"),
        F.struct(F.try_element_at(_events(), F.lower("label")).alias("event_type"), F.concat("head", F.lit(" --"), "label", F.lit("--> "), "tail").alias("description")).alias("e"),
    ).where("e.event_type IS NOT NULL")
    numbered = ordering.ranked(asserted.unionByName(of_edges), ["domain_id"], ["part", "timestamp", "object_id", "k", F.col("e.description")])
    number = F.when(F.col("n") < 10000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string"))
    return numbered.select(F.concat("domain_id", F.lit("::lifecycle::"), number).alias("event_id"), "domain_id", "e.event_type", "object_id", "timestamp", "e.description")


def timeline(events: DataFrame, object_id: str) -> DataFrame:
    """The events of one object in order of time."""
    return events.where(F.col("object_id") == object_id).orderBy("timestamp", "event_id")


def history(held: DataFrame, object_id: str) -> DataFrame:
    """All assertions of one object in order of transaction time."""
    return held.where(F.col("object_id") == object_id).orderBy("transaction_time", "assertion_id")


def ingest(manifests: DataFrame, path: str) -> None:
    """Append snapshot manifests to a table; ingest_seq (the table's last, then by domain and record) fixes their order.

    A snapshot that the table has already keeps its place and its first manifest.
    """
    spark = manifests.sparkSession
    held = _table(spark, path)
    last = 0
    if held is not None:
        last = held.agg(F.coalesce(F.max("ingest_seq"), F.lit(0))).first()[0]
        manifests = manifests.join(held.select("snapshot_id"), "snapshot_id", "left_anti").select(*manifests.columns)
    numbered = ordering.ranked(manifests, [], ["domain_id", "record_idx"], "ingest_seq")
    numbered.withColumn("ingest_seq", F.lit(last) + F.col("ingest_seq")).write.mode("append").parquet(path)


def _table(spark, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(path) if there else None


def at_time(manifests: DataFrame, time: str) -> DataFrame:
    """The snapshot of each domain that was the last one by created_at, and of equal ones by ingest_seq, up to a time; __empty__ where there is none."""
    found = manifests.groupBy("domain_id").agg(F.max_by(F.when(F.col("created_at") <= time, F.struct("snapshot_id", "record_idx")), F.when(F.col("created_at") <= time, F.struct("created_at", "ingest_seq"))).alias("s"))
    return found.select("domain_id", F.coalesce("s.snapshot_id", F.lit("__empty__")).alias("snapshot_id"), F.coalesce("s.record_idx", F.lit(0)).alias("record_idx"))


def rollback(manifests: DataFrame, records: DataFrame, snapshot: str) -> DataFrame:
    """The records that a snapshot was made of: assemble() gives its graph again. An unknown snapshot is a KeyError."""
    found = manifests.where(F.col("snapshot_id") == snapshot).select("domain_id", "record_idx").first()
    if found is None:
        raise KeyError(f"snapshot not found: {snapshot}")
    return records.where((F.col("domain_id") == found["domain_id"]) & (F.col("record_idx") <= found["record_idx"]))


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes (node_id, label, parent_anchor) of two snapshots: added, removed, or of another label or anchor."""
    state = lambda df: df.withColumn("_state", F.struct("label", "parent_anchor"))
    return diff(state(before), state(after), "node_id", "_state")


def conflicts(states: DataFrame) -> DataFrame:
    """Neighbouring snapshots of a node with different parents: node_id, seq, old_parent, new_parent."""
    order = Window.partitionBy("node_id").orderBy("seq")
    old = F.lag("parent_anchor").over(order)
    seen = states.withColumn("old_parent", old).withColumn("n", F.row_number().over(order))
    return seen.where((F.col("n") > 1) & ~F.col("old_parent").eqNullSafe(F.col("parent_anchor"))).select("node_id", "seq", "old_parent", F.col("parent_anchor").alias("new_parent"))


def consistency(held: DataFrame) -> DataFrame:
    """Per object: neighbouring intervals that overlap, and transaction times that run backwards."""
    by_time, by_id = Window.partitionBy("object_id").orderBy("start", "end"), Window.partitionBy("object_id").orderBy("assertion_id")
    cut = held.withColumn("start", F.coalesce("valid_from", F.lit(""))).withColumn("end", F.coalesce("valid_to", F.lit(FAR_FUTURE)))
    marked = cut.withColumn("overlap", F.col("end") > F.lead("start").over(by_time)).withColumn("back", F.col("transaction_time") > F.lead("transaction_time").over(by_id))
    return marked.groupBy("object_id").agg(F.count_if("overlap").alias("overlaps"), F.count_if("back").alias("backward"))


def supersede_roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """links (id, supersedes): root of each chain, or null for a cycle, by doubling pointers.

    After k rounds a pointer has gone 2**k steps: rounds end when all chains have met their roots, or
    when 2**k is more than the number of links, by when whatever has not is on a cycle or leads to one.
    """
    ensure_checkpoint_dir(links.sparkSession)
    roots = F.col("supersedes").isNull()
    at = links.select("id", F.coalesce("supersedes", F.col("id")).alias("to"), roots.alias("done"))
    most, gone = links.count(), 1
    for _ in range(rounds):
        if gone > most:
            break
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("done").alias("met"))
        # A link to an id that there is not leads nowhere: it is a root of its own.
        step = at.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("next"), (F.col("done") | F.coalesce("met", F.lit(True))).alias("done"))
        at = step.withColumnRenamed("next", "to").checkpoint()
        gone *= 2
        if at.where("NOT done").isEmpty():
            break
    known = links.where(roots).select(F.col("id").alias("to"), F.lit(True).alias("is_root"))
    return at.join(known, "to", "left").select("id", F.when(F.col("is_root"), F.col("to")).alias("root"))


def temporal_metrics(held: DataFrame, snapshots: DataFrame, cyclic: DataFrame, events: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the share of the five checks that pass, coverage of gold events, whether counts only grow, and drift.

    held is consistency()'s input with supersedes; snapshots has domain_id, snapshot_id, parent_snapshot_id, created_at,
    node_count, edge_count; cyclic is supersede_roots()'s result;
    events and gold have object_id and event. Every input may be empty.
    """
    per_object = consistency(held).agg(F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"), F.coalesce(F.sum("backward"), F.lit(0)).alias("backward"))
    cycles = cyclic.agg(F.count_if(F.col("root").isNull()).alias("cycles"))
    parents = snapshots.where("parent_snapshot_id <> ''").select(F.col("parent_snapshot_id").alias("snapshot_id"))
    orphans = parents.join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti").agg(F.count("*").alias("orphans"))
    order = Window.partitionBy("domain_id").orderBy("created_at", "snapshot_id")
    before = snapshots.select((F.lag("node_count").over(order) > F.col("node_count")).alias("n"), (F.lag("edge_count").over(order) > F.col("edge_count")).alias("e"))
    shrunk = before.agg((F.count_if("n") + F.count_if("e")).alias("shrunk"))
    wanted = gold.select("object_id", "event").distinct()
    covered = wanted.join(events.select("object_id", "event").distinct().withColumn("hit", F.lit(1)), ["object_id", "event"], "left").agg(F.coalesce(F.round(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("event_coverage"))
    drift = held.agg(F.coalesce(F.round(F.avg(F.col("supersedes").isNotNull().cast("double")), 4), F.lit(0.0)).alias("drift_rate"))
    out = per_object
    for one in (cycles, orphans, shrunk, covered, drift):
        out = out.join(one)
    passed = sum(((F.col(c) == 0).cast("int") for c in ("backward", "cycles", "orphans", "shrunk")), (F.col("overlaps") == 0).cast("int"))
    return out.withColumn("score", F.round(passed / 5, 4)).withColumn("monotonic", (F.col("shrunk") == 0).cast("double"))
