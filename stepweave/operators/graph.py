"""Assembling the two-layer graph as joins and ordered CASEs over the relation stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.functions.text import order_index, step_token, whole_word


def structural_reason(head: Column, tail: Column, head_type: Column, tail_type: Column) -> Column:
    return (
        F.when(head.rlike(whole_word(K.CONTEXTUAL_HEAD)), "structural_contextual_head")
        .when(~F.coalesce(head_type.isin(*K.STRUCTURAL_ANCHORS), F.lit(False)) | ~F.coalesce(tail_type.isin(*K.STRUCTURAL_ANCHORS), F.lit(False)), "structural_requires_stable_components")
        .when(tail.rlike(whole_word(K.LOW_VALUE_TAIL)), "structural_low_value_tail")
    )


def communication_reason(label: Column, head: Column, tail: Column) -> Column:
    flat, end = F.trim(tail), F.lower(F.trim(tail))
    return F.when(
        F.lower(label) == "indicates",
        F.when(flat.rlike(K.GENERIC_TARGET), "communication_generic_target")
        .when(head.rlike(whole_word(K.RESULT_HEAD)) & end.isin(*K.LOW_VALUE_ENDPOINTS), "communication_verification_bundle")
        .when((end == "bracket side load") & ~head.rlike(whole_word(K.SIDE_LOAD_OBSERVATION)), "communication_generic_side_load_target"),
    )


def lifecycle_reason(label: Column, head: Column, tail: Column) -> Column:
    low = F.lower(F.trim(head)).isin(*K.LOW_VALUE_ENDPOINTS) | F.lower(F.trim(tail)).isin(*K.LOW_VALUE_ENDPOINTS)
    return F.when((label == "transitionsTo") & low, "lifecycle_verification_only")


def filter_reason(family: Column, label: Column, head: Column, tail: Column, head_type: Column, tail_type: Column) -> Column:
    """Why a relation between known nodes is dropped; null if it is not."""
    return F.when(family == "structural", structural_reason(head, tail, head_type, tail_type)).when(family == "communication", communication_reason(label, head, tail)).when(family == "lifecycle", lifecycle_reason(label, head, tail))


def type_reason(family: Column, head_type: Column, tail_type: Column) -> Column:
    """Which type constraint a relation breaks; null for none. A missing type is Unknown."""
    out = F.format_string("family '%s' not defined in constraints", F.coalesce(family, F.lit("")))
    for name, ends in K.TYPE_CONSTRAINTS.items():
        broken = F.lit(None).cast("string")
        for end, value, allowed in (("tail", tail_type, ends[1]), ("head", head_type, ends[0])):
            known = F.coalesce(value, F.lit("Unknown"))
            told = F.concat(F.lit(f"{end} type '"), known, F.lit(f"' not allowed for family '{name}' (allowed: {list(allowed)})"))
            broken = F.when(~known.isin(*allowed), told).otherwise(broken)
        out = F.when(family == name, broken).otherwise(out)
    return out


#: Rules travel with each task's relations up to so many; beyond, they are joined by a shuffle.
MOST_RULES = 100_000


def constraint_rules(spark, rules: dict[str | None, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]]) -> DataFrame:
    """domain_id (null: every domain that has none of its own), family, head_types, tail_types from rules of domains, each as sources.manuals.read_constraints() gives them."""
    rows = [(domain, family, list(heads), list(tails)) for domain, own in rules.items() for family, (heads, tails) in own.items()]
    return spark.createDataFrame(rows, "domain_id string, family string, head_types array<string>, tail_types array<string>")


def with_constraints(relations: DataFrame, rules: DataFrame) -> DataFrame:
    """relations (domain_id, family) with _rule: the head_types and tail_types of their domain's rule for their family, null without one.

    A domain that has rules of its own has no others.
    """
    own = rules.where("domain_id IS NOT NULL").select(F.col("domain_id").alias("_rd")).distinct()
    both = rules.select(F.col("domain_id").alias("_rule_domain"), F.col("family").alias("_rule_family"), F.struct("head_types", "tail_types").alias("_rule"))
    if rules.limit(MOST_RULES + 1).count() <= MOST_RULES:
        own, both = F.broadcast(own), F.broadcast(both)
    placed = relations.join(own, F.col("domain_id") == F.col("_rd"), "left")
    joined = placed.join(both, F.col("_rd").eqNullSafe(F.col("_rule_domain")) & (F.col("family") == F.col("_rule_family")), "left")
    return joined.drop("_rd", "_rule_domain", "_rule_family")


def rule_reason(family: Column, head_type: Column, tail_type: Column, rule: Column) -> Column:
    """type_reason() by a rule that stands in a column."""
    out = F.lit(None).cast("string")
    for end, value in (("tail", tail_type), ("head", head_type)):
        known, allowed = F.coalesce(value, F.lit("Unknown")), F.coalesce(rule[f"{end}_types"], F.array().cast("array<string>"))
        listed = F.when(F.size(allowed) > 0, F.concat(F.lit("['"), F.array_join(allowed, "', '"), F.lit("']"))).otherwise("[]")
        told = F.concat(F.lit(f"{end} type '"), known, F.lit("' not allowed for family '"), family, F.lit("' (allowed: "), listed, F.lit(")"))
        out = F.when(~F.array_contains(allowed, known), told).otherwise(out)
    return F.when(rule.isNull(), F.format_string("family '%s' not defined in constraints", F.coalesce(family, F.lit("")))).otherwise(out)


def split_by_types(edges: DataFrame) -> DataFrame:
    """edges with invalid_reason (null: valid)."""
    return edges.withColumn("invalid_reason", type_reason(F.col("family"), F.col("head_type"), F.col("tail_type")))


def type_statistics(split: DataFrame, examples: int = 10) -> DataFrame:
    """One row for split_by_types()' result: total, valid, invalid, invalid_rate, invalid_by_family and the first examples by edge_id."""
    bad = F.col("invalid_reason").isNotNull()
    by_family = split.where(bad).groupBy("family").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("family", F.lit("")), "n")))).alias("invalid_by_family"))
    first = split.where(bad).orderBy("edge_id").limit(examples).agg(F.sort_array(F.collect_list(F.struct("edge_id", "family", "head", "tail", F.col("invalid_reason").alias("reason")))).alias("invalid_examples"))
    counted = split.agg(F.count("*").alias("total_edges"), F.count_if(~bad).alias("valid_edges"), F.count_if(bad).alias("invalid_edges"))
    rate = F.coalesce(F.round(F.col("invalid_edges") / F.nullif(F.col("total_edges"), F.lit(0)), 4), F.lit(0.0))
    return counted.withColumn("invalid_rate", rate).join(by_family).join(first)


def concept_nodes(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """A node per admitted label and domain: first mention's wording, first record, all evidence in order."""
    from stepweave.operators.evidence import ordered_distinct

    at = F.struct("record_idx", "origin", "step_pos", "pos")
    admitted = decisions.where("admit").select("domain_id", "label", "parent_anchor", "route")
    joined = mentions.join(admitted, ["domain_id", "label"])
    nodes = joined.groupBy("domain_id", "label", "parent_anchor", "route").agg(
        F.min_by("surface_form", at).alias("surface_form"), F.min_by("hypernym", at).alias("shared_hypernym"), F.min("record_idx").alias("first_record_idx"), F.min_by("timestamp", at).alias("valid_from"), ordered_distinct(F.col("evidence_id"), at).alias("provenance")
    )
    return nodes.withColumn("node_id", F.concat_ws("::", "domain_id", F.lit("node"), "label")).withColumn("layer", F.lit("semantic"))


def workflow_nodes(steps: DataFrame) -> DataFrame:
    """A node per step, named by its record and step."""
    label = F.concat_ws(":", "evidence_id", "step.step_id")
    return steps.select("domain_id", label.alias("label"), F.concat_ws("::", "domain_id", F.lit("node"), label).alias("node_id"), F.lit("workflow").alias("layer"), F.lit("Task").alias("parent_anchor"), order_index(F.col("step.step_id"), F.col("step_pos") + 1).alias("order_index"), F.col("step.step_phase").alias("step_phase"), F.col("record_idx").alias("first_record_idx"), F.col("timestamp").alias("valid_from"))


def backbone_nodes(domains: DataFrame, backbone: tuple[str, ...] = K.ANCHORS, start: Column | None = None) -> DataFrame:
    """The backbone's labels as nodes of every domain, there from before its first record (start: 0, or the least place where records have places)."""
    anchors = F.explode(F.array(*(F.lit(a) for a in backbone)))
    return domains.select("domain_id", anchors.alias("label")).select("domain_id", "label", F.concat_ws("::", "domain_id", F.lit("node"), "label").alias("node_id"), F.lit("semantic").alias("layer"), F.col("label").alias("parent_anchor"), (F.lit(0) if start is None else start).alias("first_record_idx"))


def resolve_endpoint(evidence: Column, label: Column) -> Column:
    """A step's own name inside its record; other labels as they are."""
    return F.coalesce(F.concat(evidence, F.lit(":"), step_token(label)), label)


def judge_relations(
    stream: DataFrame, nodes: DataFrame, supports: DataFrame | None = None, decisions: DataFrame | None = None, families: tuple[str, ...] = tuple(K.TYPE_CONSTRAINTS), rules: DataFrame | None = None
) -> DataFrame:
    """The relation stream with ends resolved, layer, workflow_kind, status and reject_reason: the first reason that applies.

    stream: domain_id, evidence_id, record_idx, seq, origin (workflow, step or document), label, family, head, tail,
    and what else shall be kept. nodes: domain_id, label, layer, parent_anchor, first_record_idx and, if there is one,
    step_action; a node counts from its first record on. supports: domain_id, evidence_id, label, steps (the steps that
    name a label), for relations of whole documents. decisions: domain_id, label, reject_reason, for the ends that are no nodes. families: those that a run takes. rules: type constraints as
    constraint_rules() gives them; without, the fixed ones; an empty table constrains nothing.
    """
    s = stream
    for name in ("head", "tail"):
        s = s.withColumn(f"{name}_token", step_token(F.col(name)).isNotNull()).withColumn(name, resolve_endpoint(F.col("evidence_id"), F.col(name)))
    action = "step_action" if "step_action" in nodes.columns else F.lit(None).cast("string")
    for name in ("head", "tail"):
        end = nodes.select(
            F.col("domain_id").alias("_d"), F.col("label").alias("_l"), F.col("layer").alias(f"{name}_layer"), F.col("parent_anchor").alias(f"{name}_type"), F.col("first_record_idx").alias("_from"),
            (F.col(action) if isinstance(action, str) else action).alias(f"{name}_action"),
        )
        s = s.join(end, (F.col("domain_id") == F.col("_d")) & (F.col(name) == F.col("_l")) & (F.col("_from") <= F.col("record_idx")), "left").drop("_d", "_l", "_from")
    for name in ("head", "tail"):
        if supports is not None:
            own = supports.select("domain_id", "evidence_id", F.col("label").alias(name), F.col("steps").alias(f"{name}_steps"))
            s = s.join(own, ["domain_id", "evidence_id", name], "left")
        if decisions is not None:
            own = decisions.select("domain_id", F.col("label").alias(name), F.col("reject_reason").alias(f"{name}_reason"), F.concat_ws("::", "domain_id", "label").alias(f"{name}_ref"))
            s = s.join(own, ["domain_id", name], "left")
        else:
            s = s.withColumn(f"{name}_reason", F.lit(None).cast("string")).withColumn(f"{name}_ref", F.lit(None).cast("string"))
    ungrounded, single = F.lit(False), F.lit(False)
    if supports is not None:
        ungrounded = F.col("head_steps").isNull() | F.col("tail_steps").isNull()
        single = F.size(F.array_union("head_steps", "tail_steps")) == 1
    key = Window.partitionBy("domain_id", "evidence_id", "origin", "head", "label", "family")
    s = s.withColumn("several", F.min("tail").over(key) != F.max("tail").over(key)).withColumn("ungrounded", ungrounded).withColumn("single", single)

    family, of_document = F.col("family"), F.col("origin") == "document"
    task, structural, diagnostic = family == "task_dependency", family == "structural", family.isin("communication", "propagation")
    local = of_document & (diagnostic | (family == "lifecycle"))
    head_in, tail_in = F.col("head_layer").isNotNull(), F.col("tail_layer").isNotNull()
    semantic = F.coalesce((F.col("head_layer") == "semantic") & (F.col("tail_layer") == "semantic"), F.lit(False))
    tokens = F.col("head_token") | (head_in & tail_in & (F.col("head_layer") == "workflow"))
    missing = lambda name, there: F.when(~there, F.concat(F.lit(f"{name}:"), F.coalesce(f"{name}_reason", F.lit("not_in_graph"))))
    dropped = filter_reason(family, F.col("label"), F.col("head"), F.col("tail"), F.col("head_type"), F.col("tail_type"))
    typed = type_reason(family, F.col("head_type"), F.col("tail_type"))
    if rules is not None:
        free = rules.isEmpty()
        s = s if free else with_constraints(s, rules)
        typed = F.lit(None).cast("string") if free else rule_reason(family, F.col("head_type"), F.col("tail_type"), F.col("_rule"))
    reason = (
        F.when(~F.coalesce(family.isin(*families), F.lit(False)), "invalid_relation_family")
        .when(of_document & diagnostic & F.col("several"), "multi_target_diagnostic_hypothesis")
        .when(structural & (F.col("head") == F.col("tail")), "structural_self_loop")
        .when(structural & F.col("head").rlike(whole_word(K.CONTEXTUAL_HEAD)), "structural_contextual_head")
        .when(task & ~tokens & head_in & tail_in & (F.col("tail_layer") == "workflow"), "semantic_to_workflow_not_allowed")
        .when(task & ~tokens & head_in & tail_in, "task_dependency_requires_workflow_head")
        .when(task & ~(head_in & tail_in), F.concat_ws(";", missing("head", head_in), missing("tail", tail_in)))
        .when(~task & ~semantic, "semantic_relation_requires_semantic_nodes")
        .when(local & F.col("ungrounded"), "document_semantic_requires_step_grounding")
        .when(local & F.col("single"), "single_step_diagnostic_hypothesis")
        .otherwise(F.coalesce(dropped, F.concat(F.lit("type_constraint:"), typed)))
    )
    sequence = (F.col("head_token") & F.col("tail_token")) | F.coalesce(F.col("tail_layer") == "workflow", F.lit(False))
    judged = s.withColumn("reject_reason", reason).withColumn("workflow_kind", F.when(task & tokens, F.when(sequence, "sequence").otherwise("action_object")))
    judged = judged.withColumn("layer", F.when(F.col("workflow_kind").isNotNull(), "workflow").otherwise("semantic"))
    status = F.when(F.col("reject_reason").isNull(), "accepted").when(F.col("reject_reason").startswith("type_constraint:"), "rejected_type").otherwise("rejected")
    refs = F.array(F.coalesce("head_ref", "head"), F.coalesce("tail_ref", "tail"))
    triple = F.concat_ws("::", "domain_id", F.lit("triple"), "evidence_id", F.col("seq").cast("string"))
    return judged.select(*stream.columns, "layer", "workflow_kind", status.alias("status"), "reject_reason", triple.alias("triple_id"), refs.alias("attachment_refs"), "head_action", "head_type", "tail_type")


def upsert_edges(accepted: DataFrame, first: list[str], first_known: list[str] = (), seq: str = "seq", keys: tuple[str, ...] = ("domain_id", "head", "label", "tail"), more: tuple[Column, ...] = ()) -> DataFrame:
    """One edge per key: `first` from its first row, `first_known` from the first row that has a value, the row count, and `more` aggregates."""
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first_known]
    return accepted.groupBy(*keys).agg(*(F.min_by(c, seq).alias(c) for c in first), *known, F.count("*").alias("mentions"), F.min(seq).alias("first_seq"), *more)


def readable(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Displayed edges and the nodes that touch them."""
    shown = edges.where("display_admitted")
    ends = shown.select("domain_id", F.col("head").alias("label")).union(shown.select("domain_id", "tail"))
    return nodes.join(ends, ["domain_id", "label"], "left_semi"), shown


def relation_audit(triples: DataFrame) -> DataFrame:
    """Counts of a domain's triples by each of eight of their properties: domain_id, property, value, n; nulls are not counted."""
    hidden = F.when(~F.coalesce("display_admitted", F.lit(False)), F.coalesce("hidden", F.lit("not_displayed")))
    kinds = {"status": "status", "family": "family", "graph_layer": "layer", "workflow_kind": "workflow_kind", "reject_reason": "reject_reason", "display_action": "display_label", "edge_salience": "salience"}
    told = F.explode(F.array(*(F.struct(F.lit(k).alias("property"), F.col(c).alias("value")) for k, c in kinds.items()), F.struct(F.lit("hidden_display").alias("property"), hidden.alias("value"))))
    flat = triples.select("domain_id", told.alias("p")).select("domain_id", "p.*").where("value IS NOT NULL")
    return flat.groupBy("domain_id", "property", "value").agg(F.count("*").alias("n"))


def reject_audit(triples: DataFrame) -> DataFrame:
    """Counts by domain, by reason, and of both at once, in one pass."""
    counted = triples.groupingSets([["domain_id"], ["reject_reason"], ["domain_id", "reject_reason"]], "domain_id", "reject_reason")
    return counted.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
