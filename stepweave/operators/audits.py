"""Counts of what a run took in, decided and built, a row per domain; each is one grouping of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave import constants as K

_ADAPTER = "vertical_specialize"
_REUSE = "reuse_backbone"


def judged_candidates(candidates: DataFrame, decisions: DataFrame, backbone: DataFrame) -> DataFrame:
    """Each candidate (domain_id, label) with its decision (admit, route, reject_reason) and what became of it.

    outcome is adapter, reuse or rejected; a candidate that no decision names fails. backbone has the labels (label).
    """
    own = backbone.select("label", F.lit(True).alias("_own")).distinct()
    out = candidates.join(decisions.withColumn("_decided", F.lit(True)), ["domain_id", "label"], "left").join(own, "label", "left")
    missing = F.raise_error(F.concat(F.lit("no decision on "), F.concat_ws("::", "domain_id", "label")))
    admitted = F.when(F.col("_decided").isNull(), missing.cast("boolean")).otherwise(F.coalesce("admit", F.lit(False)))
    outcome = F.when(~admitted, "rejected").when(F.col("route") == _REUSE, "reuse").otherwise("adapter")
    return out.select("*", outcome.alias("outcome"), F.coalesce("_own", F.lit(False)).alias("is_backbone_label")).drop("_decided", "_own")


def attachment_audit(judged: DataFrame) -> DataFrame:
    """domain_id, outcome, reject_reason, n of judged_candidates(); a rejected one without a reason is unspecified."""
    reason = F.when(F.col("outcome") == "rejected", F.coalesce(F.when(F.col("reject_reason") != "", F.col("reject_reason")), F.lit("unspecified")))
    return judged.groupBy("domain_id", "outcome", reason.alias("reject_reason")).agg(F.count("*").alias("n"))


def candidate_counts(judged: DataFrame) -> DataFrame:
    """domain_id, candidate_count, accepted_adapter_candidate_count, accepted_backbone_reuse_count, rejected_candidate_count."""
    of = lambda kind: F.count_if(F.col("outcome") == kind)
    return judged.groupBy("domain_id").agg(
        F.count("*").alias("candidate_count"), of("adapter").alias("accepted_adapter_candidate_count"), of("reuse").alias("accepted_backbone_reuse_count"), of("rejected").alias("rejected_candidate_count"),
    )


def _layer(kind: str) -> Column:
    return F.count_if(F.col("layer") == kind)


def node_counts(nodes: DataFrame) -> DataFrame:
    """domain_id, node_count, workflow_step_node_count, semantic_node_count, hypernym_coverage of the semantic nodes (4 digits)."""
    named = F.count_if((F.col("layer") == "semantic") & (F.coalesce("shared_hypernym", F.lit("")) != ""))
    return nodes.groupBy("domain_id").agg(
        F.count("*").alias("node_count"), _layer("workflow").alias("workflow_step_node_count"), _layer("semantic").alias("semantic_node_count"),
        F.round(F.when(_layer("semantic") > 0, named / _layer("semantic")).otherwise(0.0), 4).alias("hypernym_coverage"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    """domain_id, edge_count, workflow_edge_count, semantic_edge_count, readable_edge_count."""
    shown = F.count_if(F.coalesce("display_admitted", F.lit(False)))
    return edges.groupBy("domain_id").agg(F.count("*").alias("edge_count"), _layer("workflow").alias("workflow_edge_count"), _layer("semantic").alias("semantic_edge_count"), shown.alias("readable_edge_count"))


def triple_counts(triples: DataFrame) -> DataFrame:
    """domain_id, candidate_triple_count, accepted_triple_count, rejected_triple_count, type_rejected_triple_count."""
    of = lambda kind: F.count_if(F.col("status") == kind)
    return triples.groupBy("domain_id").agg(
        F.count("*").alias("candidate_triple_count"), of("accepted").alias("accepted_triple_count"), of("rejected").alias("rejected_triple_count"), of("rejected_type").alias("type_rejected_triple_count"),
    )


def _by_domain(domains: DataFrame, *counted: DataFrame) -> DataFrame:
    """All domains with their counts, 0 where a table has no row of one."""
    out = domains.select("domain_id").distinct()
    for part in counted:
        out = out.join(part, "domain_id", "left")
    return out.fillna(0)


def graph_summary(domains: DataFrame, nodes: DataFrame, edges: DataFrame, triples: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A row per domain: counts of its graph by layer, by status and of what is readable, and hypernym_coverage."""
    from stepweave.operators.graph import readable

    seen = readable(nodes, edges)[0].groupBy("domain_id").agg(F.count("*").alias("readable_node_count"))
    states = snapshots.groupBy("domain_id").agg(F.count("*").alias("snapshot_count"))
    return _by_domain(domains, node_counts(nodes), edge_counts(edges), seen, triple_counts(triples), states)


def node_distributions(nodes: DataFrame) -> DataFrame:
    """domain_id, property (shared_hypernym of semantic nodes, step_phase of steps), value, n; empty ones are not counted."""
    parts = F.array(
        F.struct(F.lit("shared_hypernym").alias("property"), F.when(F.col("layer") == "semantic", F.col("shared_hypernym")).alias("value")),
        F.struct(F.lit("step_phase").alias("property"), F.when(F.col("layer") == "workflow", F.col("step_phase")).alias("value")),
    )
    flat = nodes.select("domain_id", F.explode(parts).alias("p")).select("domain_id", "p.*").where("value <> ''")
    return flat.groupBy("domain_id", "property", "value").agg(F.count("*").alias("n"))


def type_reject_examples(triples: DataFrame, most: int = 10) -> DataFrame:
    """The first rejections by type of each domain, for people to look at: domain_id, triple_id, head, tail, family."""
    from pyspark.sql import Window

    order = Window.partitionBy("domain_id").orderBy("record_idx", "seq")
    first = triples.where("status = 'rejected_type'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return first.select("domain_id", "triple_id", "head", "tail", "family")


def construction_summary(domains: DataFrame, judged: DataFrame, nodes: DataFrame, edges: DataFrame, triples: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A row per domain from candidates to snapshots; every triple that was not accepted counts as rejected."""
    adapters = nodes.where("node_type = 'adapter_concept'").groupBy("domain_id").agg(F.count("*").alias("adapter_concept_count"))
    graph = graph_summary(domains, nodes, edges, triples, snapshots)
    rejected = (F.col("candidate_triple_count") - F.col("accepted_triple_count")).alias("rejected_triple_count")
    graph = graph.select("domain_id", "node_count", "edge_count", "candidate_triple_count", "accepted_triple_count", rejected, "snapshot_count")
    return _by_domain(domains, candidate_counts(judged), adapters, graph)


def data_flow(domains: DataFrame, units: DataFrame, judged: DataFrame, nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> DataFrame:
    """A row per domain: how many rows each step of a run left, from evidence units to edges."""
    taken = units.groupBy("domain_id").agg(F.count("*").alias("evidence_unit_count"))
    admitted = F.count_if(F.col("outcome") != "rejected").alias("admitted_candidate_count")
    schema = judged.groupBy("domain_id").agg(F.count("*").alias("schema_candidate_count"), admitted, F.count_if(F.col("outcome") == "rejected").alias("rejected_candidate_count"))
    adapters = nodes.where("node_type = 'adapter_concept'").groupBy("domain_id").agg(F.count("*").alias("adapter_concept_count"))
    of_nodes = node_counts(nodes).drop("hypernym_coverage").withColumnRenamed("node_count", "graph_node_count")
    of_edges = edge_counts(edges).drop("readable_edge_count").withColumnRenamed("edge_count", "graph_edge_count")
    return _by_domain(domains, taken, schema, adapters, of_nodes, of_edges, triple_counts(triples))


def document_counts(documents: DataFrame) -> DataFrame:
    """domain_id, doc_type, n, and with doc_type null all of a domain's."""
    rolled = documents.groupingSets([["domain_id", "doc_type"], ["domain_id"]], "domain_id", "doc_type")
    return rolled.agg(F.count("*").alias("n")).select("domain_id", "doc_type", "n")


def build_backbone(supplements: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """label, description, origin (seed or curated), domain_id, pos, place (in all, from 0): the seed concepts, then each new label of the supplements once.

    supplements: domain_pos, domain_id, pos, label, description. Of a label that several domains give, the first one's description holds.
    """
    spark = supplements.sparkSession
    own = {name: name for name in K.ANCHORS} if seeds is None else seeds
    schema = "label string, description string, origin string, domain_id string, pos int"
    first = spark.createDataFrame([(name, text, "seed", None, n) for n, (name, text) in enumerate(own.items())], schema)
    place = F.struct("domain_pos", "pos")
    told = supplements.groupBy("label").agg(F.min_by(F.struct("description", "domain_id", "pos", "domain_pos"), place).alias("s"))
    told = told.select("label", "s.description", F.lit("curated").alias("origin"), "s.domain_id", F.col("s.pos").cast("int").alias("pos"), F.col("s.domain_pos").alias("_d"))
    both = first.withColumn("_d", F.lit(-1)).unionByName(told.join(first.select("label"), "label", "left_anti").select(*first.columns, "_d"))
    # A row a concept of the settings' files.
    return both.withColumn("place", F.row_number().over(Window.orderBy("_d", "pos")) - 1).drop("_d")
