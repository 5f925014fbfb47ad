"""From evidence records to mentions, relations and concept candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import canonical_label, hint_candidates, hypernym, normalize_space, step_id, type_hint
from stepweave.operators import ordering


def order_records(records: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Records with record_idx (1 up), by domain in the order of the timestamp text, then of the input.

    domains (domain_id, source_types) keeps the records of a domain's own source types. Only the three keys are
    sorted, by ranges; the records themselves wait in the folder of checkpoints and get their numbers by a join.
    """
    if domains is not None:
        records = records.join(domains, "domain_id").where(F.array_contains("source_types", F.col("source_type"))).drop("source_types")
    numbered = ordering.ranked(records, ["domain_id"], ["timestamp", "input_pos", "evidence_id"], "record_idx")
    return numbered.withColumn("record_idx", F.col("record_idx").cast("int"))


def canonical(records: DataFrame) -> DataFrame:
    """The records with every label in canonical form: of mentions, relations, actions, edges, diagnostics and transitions."""
    schema = {f.name: f.dataType for f in records.schema}
    names = {
        "concept_mentions": ("label",), "relation_mentions": ("head", "tail"), "step_actions": ("target_label",), "structural_edges": ("head", "tail"),
        "diagnostic_edges": ("evidence_label", "indicated_label"), "state_transitions": ("from_state", "to_state", "evidence_label"),
    }

    def relabelled(x: Column, kind, labels: tuple[str, ...]) -> Column:
        made = F.struct(*((canonical_label(x[f.name]) if f.name in labels else x[f.name]).alias(f.name) for f in kind.fields))
        return F.when(x.isNotNull(), made)

    def listed(column: Column, kind, labels: tuple[str, ...]) -> Column:
        return F.transform(column, lambda x: relabelled(x, kind.elementType, labels))

    step_kind = schema["step_records"].elementType

    def step(s: Column) -> Column:
        made = []
        for f in step_kind.fields:
            own = s[f.name]
            own = relabelled(own, f.dataType, ("label",)) if f.name == "task" else listed(own, f.dataType, names[f.name]) if f.name in names else own
            made.append(own.alias(f.name))
        return F.struct(*made)

    out = records.withColumn("step_records", F.transform("step_records", step))
    for name, labels in (("document_concept_mentions", ("label",)), ("document_relation_mentions", ("head", "tail")), ("cross_step_relations", ("head", "tail"))):
        out = out.withColumn(name, listed(F.col(name), schema[name], labels))
    return out


def evidence_units(records: DataFrame) -> DataFrame:
    """A row per record in its domain's order: ids, text with single blanks, time, and the locator domain/source_type/position from 0."""
    where = F.concat_ws("/", "domain_id", "source_type", (F.col("record_idx") - 1).cast("string"))
    return records.select("evidence_id", "domain_id", "role", "source_type", where.alias("locator"), normalize_space(F.col("raw_text")).alias("text"), "timestamp")


def steps(records: DataFrame) -> DataFrame:
    """One row per step, with its position and the step that follows."""
    flat = records.select("domain_id", "evidence_id", "record_idx", "timestamp", F.posexplode("step_records").alias("step_pos", "step"))
    follow = Window.partitionBy("domain_id", "evidence_id").orderBy("step_pos")
    return flat.withColumn("next_step", F.coalesce(F.col("step.sequence_next"), F.lead("step.step_id").over(follow)))


def mentions(records: DataFrame) -> DataFrame:
    """All concept mentions, labels in canonical form, in order: of the document, then of each step its task and its concepts."""
    key = ("domain_id", "evidence_id", "record_idx", "timestamp")
    of_document = records.select(*key, F.lit(0).alias("origin"), F.lit(0).alias("step_pos"), F.lit(None).cast("string").alias("step_id"), F.posexplode("document_concept_mentions").alias("pos", "m"))
    flat = records.select(*key, F.posexplode("step_records").alias("step_pos", "step"))
    of_steps = flat.select(*key, F.lit(1).alias("origin"), "step_pos", F.col("step.step_id").alias("step_id"), F.posexplode(F.concat(F.array("step.task"), F.coalesce("step.concept_mentions", F.array().cast(flat.schema["step"].dataType["concept_mentions"].dataType)))).alias("pos", "m"))
    both = of_document.unionByName(of_steps).where("m IS NOT NULL")
    return both.select(*key, "origin", "step_pos", "step_id", "pos", canonical_label(F.col("m.label")).alias("label"), "m.description", "m.node_worthy", "m.surface_form", type_hint(F.col("m.semantic_type_hint")).alias("hint"), hypernym(F.col("m.shared_hypernym")).alias("hypernym"))


def ordered_distinct(value: Column, order: Column) -> Column:
    """Distinct values in the order of their first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"]))


def majority(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first")
    return counted.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, F.col(value).alias(name))


def dominant(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The value of most rows of each group if it is alone in that, else null; and all values with that count, sorted."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    top = counted.withColumn("_top", F.max("_n").over(Window.partitionBy(*keys))).where("_n = _top")
    listed = top.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(f"{name}_candidates"))
    return listed.withColumn(name, F.when(F.size(f"{name}_candidates") == 1, F.col(f"{name}_candidates")[0]))


def candidates(mentioned: DataFrame, relations: DataFrame) -> DataFrame:
    """Concept candidates of node-worthy mentions, with what relations (domain_id, head, tail, family) say of their labels.

    Step names are no candidates. Without a hint of their own, labels get the types their words hint at.
    """
    keys, order = ["domain_id", "label"], ["record_idx", "origin", "step_pos", "pos"]
    worthy = mentioned.where(F.col("node_worthy") & step_id(F.col("label")).isNull() & (F.col("label") != ""))
    at = F.struct(*order)
    # A label's mentions in one record come together first, so that what is listed is records and wordings.
    worded = F.coalesce(F.when(F.col("surface_form") != "", F.col("surface_form")), F.col("label"))
    worthy = worthy.withColumn("wording", worded)
    parts = worthy.groupBy(*keys, "evidence_id", "wording", "step_id").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    base = parts.groupBy(*keys).agg(
        ordered_distinct(F.col("evidence_id"), F.col("at")).alias("evidence_ids"),
        ordered_distinct(F.col("wording"), F.col("at")).alias("evidence_texts"),
        F.sort_array(F.collect_set("step_id")).alias("step_ids"),
        F.sum("n").alias("support_count"),
    )
    ends = relations.select("domain_id", F.col("head").alias("label"), "family", F.lit(1).alias("h"), F.lit(0).alias("t")).union(relations.select("domain_id", "tail", "family", F.lit(0), F.lit(1)))
    part = ends.groupBy(*keys).agg(F.count("*").alias("relation_count"), F.sum("h").alias("head_count"), F.sum("t").alias("tail_count"), F.sort_array(F.collect_set("family")).alias("families"))
    out = base.join(majority(worthy, keys, "description", order, "description"), keys, "left").join(dominant(worthy, keys, "hint", "hint"), keys, "left").join(dominant(worthy, keys, "hypernym", "hypernym"), keys, "left").join(part, keys, "left")
    words = F.concat_ws(" ", "label", "description")
    listed = F.when(F.col("hint_candidates").isNull(), hint_candidates(words)).otherwise(F.col("hint_candidates"))
    return out.withColumn("hint_candidates", listed).withColumn("candidate_id", F.concat_ws("::", "domain_id", "label")).fillna(0, ["relation_count", "head_count", "tail_count"])
