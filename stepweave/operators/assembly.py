"""From evidence records and decisions to the graph: nodes, relation stream, triples, edges, snapshots, assertions.

All parts are joins and groupings over the records' rows; the record's place in its domain stands for
time, so what the graph was after a record is what the records up to it give.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.functions import display
from stepweave.functions.text import step_id
from stepweave.operators import evidence, extraction, graph, ordering, temporal, versions
from stepweave.session import ensure_checkpoint_dir

RECORD = ("domain_id", "evidence_id", "record_idx", "timestamp")
_ORIGINS = ("workflow", "step", "document")


NODE_KEYS, EDGE_KEYS = ["domain_id", "label"], ["domain_id", "head", "label", "tail"]


@dataclass
class Graph:
    """The tables of all domains' graphs.

    Rows of node_rows and edge_rows are bounded: their evidence is in node_observed and edge_observed, a row a mention. What lists or
    orders all of it (nodes and edges with provenance, versions, events) is made when asked for.
    """

    node_rows: DataFrame
    edge_rows: DataFrame
    triples: DataFrame
    snapshots: DataFrame
    assertions: DataFrame
    node_observed: DataFrame
    edge_observed: DataFrame

    @cached_property
    def nodes(self) -> DataFrame:
        """The nodes with their evidence listed in order."""
        return versions.with_provenance(self.node_rows, versions.first_places(self.node_observed, NODE_KEYS, "at"), NODE_KEYS)

    @cached_property
    def edges(self) -> DataFrame:
        """The edges with their evidence listed in order."""
        own = self.edge_rows.drop(*(f"{c}_from" for c in _EDGE_KNOWN))
        return versions.with_provenance(own, versions.first_places(self.edge_observed, EDGE_KEYS, "at"), EDGE_KEYS)

    @cached_property
    def node_versions(self) -> DataFrame:
        """Every node in every interval of records in which it stood unchanged."""
        base = self.node_rows.where("first_record_idx = 0").select(*NODE_KEYS, F.lit(0).cast("int").alias("record_idx"), F.lit(None).cast("string").alias("evidence_id"))
        rows = self.node_observed.select(*NODE_KEYS, F.col("record_idx").cast("int").alias("record_idx"), "evidence_id").unionByName(base)
        return versions.with_values(versions.versions(rows, NODE_KEYS), self.node_rows, NODE_KEYS).checkpoint()

    @cached_property
    def edge_versions(self) -> DataFrame:
        """The same of edges: steps, source, mechanism and evidence label are null until a record gave them."""
        return versions.with_values(versions.versions(self.edge_observed, EDGE_KEYS), self.edge_rows, EDGE_KEYS, list(_EDGE_KNOWN)).checkpoint()

    @cached_property
    def events(self) -> DataFrame:
        return temporal.graph_events(self.assertions, self.edge_rows)

    def as_of(self, idx: int) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as they were after record idx, their evidence and values those known by then."""
        return versions.state(self.node_versions, idx, NODE_KEYS), versions.state(self.edge_versions, idx, EDGE_KEYS)


def _steps(records: DataFrame) -> DataFrame:
    return records.select(*RECORD, F.posexplode("step_records").alias("step_pos", "step"))


def _rows(steps: DataFrame, field: str, origin: str, kind: int, **columns: Column) -> DataFrame:
    """A row per entry x of a child array of the steps, in the form of the relation stream."""
    flat = steps.select(*RECORD, "step_pos", "step.step_id", F.posexplode(field).alias("pos", "x"))
    return _relation(flat, origin, kind, columns)


def _relation(flat: DataFrame, origin: str, kind: int, columns: dict[str, Column]) -> DataFrame:
    names = ("label", "family", "head", "tail", "source_field", "head_step", "tail_step", "mechanism", "evidence_label")
    given = [columns.get(n, F.lit(None)).cast("string").alias(n) for n in names]
    return flat.select(*RECORD, F.lit(origin).alias("origin"), F.lit(_ORIGINS.index(origin)).alias("origin_pos"), "step_pos", F.lit(kind).alias("kind"), "pos", *given)


def relation_stream(records: DataFrame) -> DataFrame:
    """All relations of the records in one form, numbered (seq, from 1) in each record.

    First each step's sequence and actions; then its structural edges (or, without any, its structural
    mentions), diagnostics and state transitions; then the document's relations, repeated ones once.
    Relations that cross steps are marked so, with the steps at their ends.
    """
    steps, x = _steps(records), F.col("x")
    own = F.col("step_id")
    follows = F.array_compact(F.array(F.when(F.coalesce("step.sequence_next", F.lit("")) != "", F.col("step.sequence_next"))))
    mentioned = F.filter("step.relation_mentions", lambda r: r["family"] == "structural")
    listed = F.when(F.size(F.coalesce("step.structural_edges", F.array())) > 0, F.col("step.structural_edges")).otherwise(mentioned)
    how = F.when(x["mechanism"] == "propagation", "propagation").otherwise("communication")
    parts = [
        _rows(steps.withColumn("f", follows), "f", "workflow", 0, label=F.lit("triggers"), family=F.lit("task_dependency"), head=own, tail=x, source_field=F.lit("sequence_next"), head_step=own, tail_step=x),
        _rows(steps, "step.step_actions", "workflow", 1, label=x["action_type"], family=F.lit("task_dependency"), head=own, tail=x["target_label"], source_field=F.lit("step_actions"), head_step=own),
        _rows(steps.withColumn("f", listed), "f", "step", 0, label=x["label"], family=F.lit("structural"), head=x["head"], tail=x["tail"], source_field=F.lit("structural_edges"), head_step=own, tail_step=own),
        _rows(
            steps, "step.diagnostic_edges", "step", 1, label=F.when(how == "propagation", "causes").otherwise("indicates"), family=how, head=x["evidence_label"], tail=x["indicated_label"],
            source_field=F.lit("diagnostic_edges"), head_step=own, tail_step=own, mechanism=how, evidence_label=x["evidence_label"],
        ),
        _rows(
            steps, "step.state_transitions", "step", 2, label=F.lit("transitionsTo"), family=F.lit("lifecycle"), head=x["from_state"], tail=x["to_state"], source_field=F.lit("state_transitions"),
            head_step=F.coalesce(F.when(x["trigger_step"] != "", x["trigger_step"]), own), tail_step=own, evidence_label=x["evidence_label"],
        ),
    ]
    told = records.select(*RECORD, F.lit(0).alias("step_pos"), F.posexplode("document_relation_mentions").alias("pos", "x"))
    repeated = Window.partitionBy(*RECORD[:3], "x.label", "x.family", "x.head", "x.tail").orderBy("pos")
    told = told.withColumn("n", F.row_number().over(repeated)).where("n = 1")
    parts.append(_relation(told, "document", 0, {"label": x["label"], "family": x["family"], "head": x["head"], "tail": x["tail"], "source_field": F.lit("document_relation_mentions")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    crossing = records.select("evidence_id", F.posexplode("cross_step_relations").alias("pos", "c")).select("evidence_id", "pos", "c.*")
    out = extraction.annotate_cross_steps(out, crossing)
    order = Window.partitionBy(*RECORD[:3]).orderBy("origin_pos", F.when(F.col("origin") == "workflow", F.col("step_pos")).otherwise(F.col("step_pos")), "kind", "pos")
    return out.withColumn("seq", F.row_number().over(order)).drop("origin_pos", "step_pos", "kind", "pos")


def step_supports(records: DataFrame) -> DataFrame:
    """domain_id, evidence_id, label, steps: the steps of a record whose concepts or relations name a label."""
    steps = _steps(records).select(*RECORD, F.coalesce(step_id(F.col("step.step_id")), F.col("step.step_id")).alias("step_id"), "step")
    none = F.array().cast("array<string>")
    concepts = F.coalesce(F.transform("step.concept_mentions", lambda m: m["label"]), none)
    ends = F.coalesce(F.flatten(F.transform("step.relation_mentions", lambda r: F.array(r["head"], r["tail"]))), none)
    ends = F.filter(ends, lambda e: step_id(e).isNull())
    named = steps.select("domain_id", "evidence_id", "step_id", F.explode(F.concat(concepts, ends)).alias("label"))
    return named.where("label <> '' AND step_id <> ''").groupBy("domain_id", "evidence_id", "label").agg(F.sort_array(F.collect_set("step_id")).alias("steps"))


def graph_nodes(records: DataFrame, decisions: DataFrame, anchors: tuple[str, ...] = K.ANCHORS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes; the rows (domain_id, label, parent_anchor, evidence_id, at) of admitted concepts that are not of the backbone; and those that give nodes.

    Of a node that several mentions or steps give, the first one's wording holds.
    """
    at = F.struct("record_idx", "origin", "step_pos", "pos")
    m = evidence.mentions(records).where("NOT (origin = 1 AND pos = 0)")
    admitted = decisions.where("admit").select("domain_id", "label", F.col("parent_anchor").alias("anchor"))
    m = m.join(admitted, ["domain_id", "label"]).withColumn("at", at)
    own = ~F.col("label").isin(*anchors)
    seen = m.groupBy("domain_id", "label").agg(
        F.min_by(F.coalesce(F.when(F.col("surface_form") != "", F.col("surface_form")), F.col("label")), "at").alias("surface_form"),
        F.min_by("hypernym", "at").alias("shared_hypernym"), F.min_by("timestamp", "at").alias("valid_from"), F.min("record_idx").alias("first_record_idx"),
        F.first("anchor").alias("parent_anchor"),
    )
    none = lambda kind="string": F.lit(None).cast(kind)
    name = lambda label: F.concat_ws("::", "domain_id", F.lit("node"), label).alias("node_id")
    concepts = seen.where(own).select(
        "domain_id", "label", name("label"), F.col("label").alias("display_label"), F.lit("adapter_concept").alias("node_type"), F.lit("semantic").alias("layer"), "parent_anchor", "surface_form",
        none().alias("step_id"), none("int").alias("order_index"), none().alias("step_phase"), "shared_hypernym", "valid_from", "first_record_idx", none().alias("step_action"),
    )
    kind = records.schema["record_idx"].dataType.simpleString()
    backbone = graph.backbone_nodes(records.select("domain_id").distinct(), anchors, F.lit("") if kind == "string" else F.lit(0).cast(kind))
    backbone = backbone.select(
        "domain_id", "label", "node_id", F.col("label").alias("display_label"), F.lit("backbone_concept").alias("node_type"), "layer", none().alias("parent_anchor"), F.col("label").alias("surface_form"),
        none().alias("step_id"), none("int").alias("order_index"), none().alias("step_phase"), none().alias("shared_hypernym"),
        none().alias("valid_from"), "first_record_idx", none().alias("step_action"),
    )
    step, label = F.col("step"), F.concat_ws(":", "evidence_id", "step.step_id")
    told = display.step_summary(display.step_source(step))
    flat = _steps(records).select(
        *RECORD, "step_pos", label.alias("label"), display.step_label(step).alias("display_label"), F.col("step.task.surface_form").alias("surface_form"), F.col("step.step_id").alias("step_id"),
        graph.order_index(F.col("step.step_id"), F.col("step_pos") + 1).alias("order_index"), F.col("step.step_phase").alias("step_phase"), display.step_action(F.col("step.step_phase"), told).alias("step_action"),
    )
    order = F.struct("record_idx", "step_pos")
    first = F.struct("display_label", "surface_form", "step_id", "order_index", "step_phase", "timestamp", "record_idx", "step_action")
    steps = flat.groupBy("domain_id", "label").agg(F.min_by(first, order).alias("s"), F.max_by("step_action", order).alias("action"))
    steps = steps.select(
        "domain_id", "label", name("label"), "s.display_label", F.lit("workflow_step").alias("node_type"), F.lit("workflow").alias("layer"), none().alias("parent_anchor"), "s.surface_form", "s.step_id",
        "s.order_index", "s.step_phase", none().alias("shared_hypernym"), F.col("s.timestamp").alias("valid_from"), F.col("s.record_idx").alias("first_record_idx"), F.col("action").alias("step_action"),
    )
    place = F.struct("record_idx", F.lit(1).alias("origin"), "step_pos", F.lit(0).alias("pos"))
    observed = m.select("domain_id", "label", "record_idx", "evidence_id", "at").unionByName(flat.select("domain_id", "label", "record_idx", "evidence_id", place.alias("at")))
    anchored = m.where(own & F.col("anchor").isNotNull()).select("domain_id", "label", F.col("anchor").alias("parent_anchor"), "evidence_id", "record_idx", "timestamp", "at")
    return backbone.unionByName(concepts).unionByName(steps), anchored, observed


def semantic_type(nodes: DataFrame) -> Column:
    """The type that constraints see: a backbone concept's label, Task for steps, else the anchor."""
    return F.when(F.col("node_type") == "backbone_concept", F.col("label")).when(F.col("node_type") == "workflow_step", "Task").otherwise(F.col("parent_anchor"))


_EDGE = ("family", "layer", "workflow_kind", "display_label", "salience", "display_admitted", "hidden", "timestamp", "record_idx")
_EDGE_KNOWN = ("head_step", "tail_step", "source_field", "mechanism", "evidence_label")


def edge_observations(triples: DataFrame, anchored: DataFrame) -> DataFrame:
    """The rows that give edges: accepted relations and, for each anchored concept, is_a to its anchor; `at` is a row's place."""
    family = F.when(F.col("workflow_kind") == "action_object", "action_object").otherwise(F.col("family"))
    place = lambda part, *more: F.struct("record_idx", F.lit(part).alias("part"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in zip("abc", more, strict=True)))
    zero = F.lit(0)
    rows = triples.where("status = 'accepted'").withColumn("family", family).withColumn("at", place(1, F.col("seq"), zero, zero))
    rows = rows.select("domain_id", "head", "label", "tail", "evidence_id", "at", *_EDGE, *_EDGE_KNOWN)
    none = F.lit(None).cast("string")
    is_a = anchored.select(
        "domain_id", F.col("label").alias("head"), F.lit("is_a").alias("label"), F.col("parent_anchor").alias("tail"), "evidence_id", place(0, F.col("at.origin"), F.col("at.step_pos"), F.col("at.pos")).alias("at"), F.lit("is_a").alias("family"), F.lit("semantic").alias("layer"),
        none.alias("workflow_kind"), F.lit("is_a").alias("display_label"), F.lit("medium").alias("salience"), F.lit(True).alias("display_admitted"), none.alias("hidden"), "timestamp", "record_idx",
        none.alias("head_step"), none.alias("tail_step"), F.lit("attachment_decision").alias("source_field"), none.alias("mechanism"), none.alias("evidence_label"),
    )
    return rows.unionByName(is_a)


def merged_edges(rows: DataFrame) -> DataFrame:
    """One edge per domain, head, label and tail of edge_observations().

    The first row's values hold, and of steps, source, mechanism and evidence label the first there is, with the record that gave it (`<name>_from`).
    """
    since = [F.min_by("record_idx", F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"{c}_from") for c in _EDGE_KNOWN]
    merged = graph.upsert_edges(rows, list(_EDGE), list(_EDGE_KNOWN), seq="at", more=tuple(since))
    named = F.concat_ws("::", "domain_id", F.lit("edge"), "head", "label", "tail").alias("edge_id")
    return merged.select(named, *(F.col(c).alias({"timestamp": "valid_from", "record_idx": "first_record_idx"}.get(c, c)) for c in merged.columns if c != "first_seq"))


def graph_edges(triples: DataFrame, anchored: DataFrame) -> DataFrame:
    """The edges with their evidence listed in order."""
    rows = edge_observations(triples, anchored)
    own = merged_edges(rows).drop(*(f"{c}_from" for c in _EDGE_KNOWN))
    return versions.with_provenance(own, versions.first_places(rows, EDGE_KEYS, "at"), EDGE_KEYS)


def snapshot_manifests(records: DataFrame, nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> DataFrame:
    """A row per record: the snapshot after it, its parent, and how many nodes, edges, accepted triples and records it holds."""
    counted = None
    for df, name in ((nodes, "node_count"), (edges, "edge_count"), (triples.where("status = 'accepted'").withColumnRenamed("record_idx", "first_record_idx"), "accepted_triple_count")):
        own = df.groupBy("domain_id", F.col("first_record_idx").alias("record_idx")).agg(F.count("*").alias(name))
        counted = own if counted is None else counted.join(own, ["domain_id", "record_idx"], "full")
    base = nodes.where("first_record_idx = 0").groupBy("domain_id").agg(F.count("*").alias("_base"))
    at = records.select("domain_id", "record_idx", "evidence_id", F.col("timestamp").alias("created_at")).join(counted, ["domain_id", "record_idx"], "left").join(base, "domain_id", "left")
    names = ("node_count", "edge_count", "accepted_triple_count")
    summed = ordering.ranked(at, ["domain_id"], ["record_idx"], "_n", {f"_{c}": F.col(c) for c in names})
    snapshot = temporal.snapshot_id(F.col("domain_id"), F.col("record_idx"))
    parent = F.when(F.col("_n") > 1, temporal.snapshot_id(F.col("domain_id"), F.col("record_idx") - 1))
    return summed.select(
        "domain_id", "record_idx", snapshot.alias("snapshot_id"), parent.alias("parent_snapshot_id"), "created_at", "evidence_id",
        (F.col("_node_count") + F.coalesce("_base", F.lit(0))).alias("node_count"), F.col("_edge_count").alias("edge_count"), F.col("_accepted_triple_count").alias("accepted_triple_count"), F.col("record_idx").alias("evidence_count"),
    )


def shown_triples(judged: DataFrame) -> DataFrame:
    """Judged relations with what of them is displayed, and a confidence."""
    shown = display.relation_display(*(F.col(c) for c in ("status", "workflow_kind", "family", "label", "head_action", "tail", "tail_type")))
    judged = judged.withColumn("shown", shown)
    return judged.select(
        *(c for c in judged.columns if c not in ("shown", "head_action")), F.col("shown.display").alias("display_label"), F.col("shown.salience").alias("salience"),
        F.col("shown.admitted").alias("display_admitted"), F.col("shown.hidden").alias("hidden"), F.when(F.col("status") == "accepted", 1.0).otherwise(0.0).alias("confidence"),
    )


def assemble(records: DataFrame, decisions: DataFrame, anchors: tuple[str, ...] = K.ANCHORS, families: tuple[str, ...] = tuple(K.TYPE_CONSTRAINTS), rules: DataFrame | None = None) -> Graph:
    """The graph of records (in order, labels canonical: evidence.canonical, evidence.order_records) under decisions.

    decisions: domain_id, label, admit, parent_anchor, reject_reason, one per label. anchors: the backbone's labels, nodes
    of every domain; families and rules as graph.judge_relations() takes them. To see the graph
    as it was after a record, give the records up to it. Nodes, triples and edges are read several
    times, so they are checkpointed in the session's shared folder.
    """
    ensure_checkpoint_dir(records.sparkSession)
    nodes, anchored, observed = graph_nodes(records, decisions, anchors)
    nodes = nodes.checkpoint()
    typed = nodes.select("domain_id", "label", "layer", semantic_type(nodes).alias("parent_anchor"), "first_record_idx", "step_action")
    judged = graph.judge_relations(relation_stream(records), typed, step_supports(records), decisions, families, rules)
    triples = shown_triples(judged)
    triples = triples.checkpoint()
    given = edge_observations(triples, anchored)
    edges = merged_edges(given).checkpoint()
    snapshots = snapshot_manifests(records, nodes, edges, triples)
    held = temporal.graph_assertions(nodes, edges)
    return Graph(nodes.drop("step_action"), edges, triples, snapshots, held, observed, given.select(*EDGE_KEYS, "record_idx", "evidence_id", "at"))
