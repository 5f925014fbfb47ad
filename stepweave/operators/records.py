"""Whole evidence records from documents and what was extracted of them.

Every step is a join or a grouping on doc_id and a label or step id; the arrays of a record are put
together at the end, one document's rows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions import procedures
from stepweave.functions.text import hypernym, let, step_id, step_phase, type_hint
from stepweave.operators import extraction
from stepweave.session import ensure_checkpoint_dir
from stepweave.sources.readers import MENTION, RELATION, STEP

_PLAIN_MENTION = ("label", "kind", "description", "node_worthy", "surface_form", "semantic_type_hint", "shared_hypernym")


@dataclass
class Extracted:
    """What was extracted: each frame has doc_id and pos, the place in the document's list."""

    #: label, description, surface_form, node_worthy, hint, hypernym
    concepts: DataFrame
    #: label, family, head, tail
    relations: DataFrame
    #: from_state, to_state, trigger_step, evidence_label
    transitions: DataFrame
    #: evidence_label, indicated_label, mechanism
    diagnostics: DataFrame


def document_steps(documents: DataFrame) -> DataFrame:
    """doc_id, step_id, step_pos, text, sequence_next of each step table; of a repeated id the first place and the last text hold."""
    rows = documents.select("doc_id", F.posexplode(procedures.step_rows(F.col("content"))).alias("pos", "s"))
    steps = rows.groupBy("doc_id", F.col("s.step_id").alias("step_id")).agg(F.min("pos").alias("step_pos"), F.max_by("s.text", "pos").alias("text"))
    return steps.withColumn("sequence_next", F.lead("step_id").over(Window.partitionBy("doc_id").orderBy("step_pos")))


def _renamed(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """rows with a label column in the document's own form: without placing words, and by its alias."""
    plain = rows.withColumn(column, procedures.document_label(F.col(column)))
    named = plain.join(aliases.select("doc_id", F.col("label").alias(column), "alias_of"), ["doc_id", column], "left")
    return named.select(*(F.coalesce("alias_of", column).alias(c) if c == column else F.col(c) for c in rows.columns))


def document_relations(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """The relations under canonical labels, their ends renamed and step ids plain; those without label or ends go."""
    entry = procedures.relation_entry(F.struct("label", "family", "head", "tail"))
    out = relations.select("doc_id", "pos", entry.alias("r")).where("r IS NOT NULL").select("doc_id", "pos", "r.*")
    for end in ("head", "tail"):
        out = _renamed(out, end, aliases).withColumn(end, procedures.endpoint(F.col(end)))
    ordered = (F.col("label") == "triggers") & step_id(F.col("head")).isNotNull() & step_id(F.col("tail")).isNotNull()
    return out.withColumn("family", F.when(ordered, "task_dependency").otherwise(F.col("family")))


def _distinct(relations: DataFrame, keys: list[str]) -> DataFrame:
    return relations.groupBy(*keys, "label", "family", "head", "tail").agg(F.min("pos").alias("pos"))


def _listed(rows: DataFrame, keys: list[str], name: str, fields: list[Column], order: list[Column]) -> DataFrame:
    """rows as one array of structs of fields per key, in an order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*fields).alias("x"))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda e: e["x"]).alias(name))


def _mention_fields() -> dict[str, Column]:
    return {"kind": F.lit(None).cast("string"), "semantic_type_hint": F.col("hint"), "shared_hypernym": F.col("hypernym")}


def _mention_order(by: str) -> list[Column]:
    return [F.lower("label").alias("a"), F.col("pos").alias("b")] if by == "label" else [F.col("pos").alias("a"), F.col("label").alias("b")]


def _mentions(rows: DataFrame, keys: list[str], name: str, by: str) -> DataFrame:
    """Mentions by label, letters' case aside (by: label), or as they came (by: pos)."""
    return _listed(rows.withColumns(_mention_fields()), keys, name, [F.col(c) for c in _PLAIN_MENTION], _mention_order(by))


def _concepts(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """The concepts with their labels renamed and their wording filled; those without a label go."""
    own = F.trim("label")
    rows = found.where(own != "").select(
        "doc_id", "pos", own.alias("label"), F.coalesce(F.trim("description"), F.lit("")).alias("description"),
        F.coalesce(F.when(F.trim("surface_form") != "", F.trim("surface_form")), own).alias("surface_form"),
        F.coalesce("node_worthy", F.lit(True)).alias("node_worthy"), type_hint(F.col("hint")).alias("hint"), hypernym(F.col("hypernym")).alias("hypernym"),
    )
    return _renamed(rows, "label", aliases)


def compose_records(documents: DataFrame, found: Extracted) -> DataFrame:
    """Evidence records, in the form that sources.readers gives, of documents (doc_id, domain_id, role, doc_type, timestamp, content).

    Relations go to the step at their head, else at their tail; their other ends become concepts of that
    step. Other concepts go to the one step whose text names them, else to the document. Relations that
    no step owns are mended and, where they are of use, kept as the document's. A document without a
    step table keeps all of its concepts and relations for itself. Documents without extractions
    give records without mentions; extractions of unknown documents are left out. Steps, concepts
    and relations are read several times, so they are checkpointed in the session's shared folder.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    doc = ["doc_id"]
    steps = document_steps(documents).checkpoint()
    tabled = steps.select("doc_id").distinct()
    labels = found.concepts.select("doc_id", "label", type_hint(F.col("hint")).alias("hint"), "pos")
    for end in ("head", "tail"):
        labels = labels.unionByName(found.relations.select("doc_id", F.col(end).alias("label"), F.lit(None).cast("string").alias("hint"), F.lit(None).cast("int").alias("pos")))
    alias = extraction.aliases(labels).checkpoint()
    concepts, relations = _concepts(found.concepts, alias), document_relations(found.relations, alias)

    plain = concepts.join(tabled, doc, "left_anti")
    is_step = steps.select("doc_id", F.col("step_id").alias("_step"))
    catalog = concepts.join(tabled, doc, "left_semi").withColumn("_step", step_id(F.col("label"))).join(is_step, ["doc_id", "_step"], "left_anti").drop("_step")
    catalog = extraction.merge_mentions(catalog, ("doc_id", "label")).withColumn("description", F.coalesce("description", F.lit(""))).checkpoint()

    owners = relations.withColumns({"_h": step_id(F.col("head")), "_t": step_id(F.col("tail"))})
    for end in ("_h", "_t"):
        known = steps.select("doc_id", F.col("step_id").alias(end), F.col("step_id").alias(f"{end}_known"))
        owners = owners.join(known, ["doc_id", end], "left")
    owners = owners.withColumn("step_id", F.coalesce("_h_known", "_t_known")).select("doc_id", "pos", "label", "family", "head", "tail", "step_id").checkpoint()
    owned = owners.where("step_id IS NOT NULL")

    free = owners.where("step_id IS NULL").drop("step_id")
    loose, some = free.join(tabled, doc, "left_semi"), not free.isEmpty()
    if some:  # else no relation is to be mended, kept or marked, and concepts need not be looked through for it
        loose = extraction.mend_indicates(extraction.mend_structural(loose, catalog), catalog)
        loose = loose.where(procedures.keeps_document_relation(F.col("family"), F.col("head"), F.col("tail")))
    of_documents = loose.unionByName(free.join(tabled, doc, "left_anti"))

    ends = owned.select("doc_id", "step_id", F.explode(F.array_distinct(F.array("head", "tail"))).alias("label"), "pos").where(step_id(F.col("label")).isNull())
    ends = ends.groupBy("doc_id", "step_id", "label").agg(F.min("pos").alias("_at"))
    rest = catalog.join(ends.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")
    told = extraction.surface_steps(rest, steps)
    at = ends.unionByName(told.select("doc_id", "step_id", "label", F.lit(None).cast("int").alias("_at")))
    placed = at.join(catalog, ["doc_id", "label"], "full").select(
        "doc_id", "step_id", "label", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("surface_form", "label").alias("surface_form"), "hint", "hypernym",
        F.coalesce("node_worthy", F.lit(True)).alias("node_worthy"), F.coalesce("_at", "pos").alias("pos"),
    ).checkpoint()
    at_step, of_document = placed.where("step_id IS NOT NULL"), placed.where("step_id IS NULL")

    made = _step_arrays(steps, owned, at_step, found)
    mentioned = _mentions(of_document, doc, "_by_label", "label").join(_mentions(plain, doc, "_as_given", "pos"), doc, "full")
    mentioned = mentioned.select("doc_id", F.coalesce("_by_label", "_as_given").alias("document_concept_mentions"))
    out = documents.join(made, doc, "left").join(mentioned, doc, "left")
    if some:
        crossing = extraction.cross_steps(loose, at_step.join(steps.select("doc_id", "step_id", "step_pos"), ["doc_id", "step_id"]))
        fields = [F.col(c) for c in ("label", "family", "head", "tail")]
        kept = _listed(_distinct(of_documents, doc), doc, "document_relation_mentions", fields, [F.col("pos")])
        crossed = _listed(crossing, doc, "cross_step_relations", [*fields, F.col("head_step"), F.col("tail_step")], [F.col("pos")])
        out = out.join(kept, doc, "left").join(crossed, doc, "left")
    else:
        out = out.withColumns({c: F.lit(None) for c in ("document_relation_mentions", "cross_step_relations")})
    none = lambda c, kind: F.coalesce(F.col(c).cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>")).alias(c)
    mention = MENTION.replace(",parent_gold:string,gold_parent:string", "")
    step = STEP.replace(MENTION, mention)
    return out.select(
        F.col("doc_id").alias("evidence_id"), "domain_id", "role", F.col("doc_type").alias("source_type"), "timestamp", F.col("content").alias("raw_text"),
        none("step_records", step), none("document_concept_mentions", mention), none("document_relation_mentions", RELATION), procedures.procedure_meta(F.col("content")).alias("procedure_meta"),
        none("cross_step_relations", "struct<label:string,family:string,head:string,tail:string,head_step:string,tail_step:string>"),
    )


def _first_of_each(entries: Column) -> Column:
    """The distinct x of entries (x, pos), each at its first pos, in order."""
    first = let(F.sort_array(entries), lambda v: F.filter(v, lambda e, i: (i == 0) | ~e["x"].eqNullSafe(F.get(v, i - 1)["x"])))
    return F.transform(F.sort_array(F.transform(first, lambda e: F.struct(e["pos"].alias("at"), e["x"].alias("x")))), lambda e: e["x"])


def _step_arrays(steps: DataFrame, owned: DataFrame, at_step: DataFrame, found: Extracted) -> DataFrame:
    """doc_id, step_records: each step with its mentions, relations, actions, structural edges, transitions and diagnostics.

    The steps and all their parts are dealt by document once, then grouped by step and by document.
    """
    key, pos = ["doc_id", "step_id"], [F.col("pos")]
    ends = {end: step_id(F.col(end)) for end in ("head", "tail")}
    name = lambda c, new: F.col(c).alias(new)
    none = F.lit(None).cast("string")

    filled = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    given = found.transitions.select("doc_id", "pos", text("from_state"), text("to_state"), filled("trigger_step"), filled("evidence_label"))
    given = extraction.place_transitions(given, steps).withColumn("step_id", F.col("trigger_step"))
    more = found.diagnostics.select("doc_id", "pos", text("evidence_label"), text("indicated_label"), filled("mechanism"))
    more = extraction.place_diagnostics(more, at_step)

    def part(when: Column | None, order: list[Column], fields: list[Column]) -> Column:
        made = F.struct(F.struct(*order).alias("at"), F.struct(*fields).alias("x"))
        return made if when is None else F.when(when, made)

    relation = [F.col(c) for c in ("label", "family", "head", "tail")]
    acts = (F.col("family") == "task_dependency") & (ends["head"] == F.col("step_id")) & ends["tail"].isNull()
    states = (F.col("family") == "lifecycle") & F.col("label").isin("transitionsTo", "hasState")
    state = ("from_state", "to_state", "trigger_step", "evidence_label")
    sign = ("evidence_label", "indicated_label", "mechanism")
    nth = lambda n: [F.lit(n).alias("part"), *pos]
    parts = (
        steps.select(*key, F.struct("step_pos", "text", "sequence_next").alias("_step")),
        at_step.withColumns(_mention_fields()).select(*key, part(None, _mention_order("label"), [F.col(c) for c in _PLAIN_MENTION]).alias("concept_mentions")),
        owned.select(
            *key, F.struct(F.struct(*relation).alias("x"), "pos").alias("_relations"), part(acts, pos, [name("label", "action_type"), name("tail", "target_label")]).alias("step_actions"), part(F.col("family") == "structural", pos, relation).alias("structural_edges"),
            part(states, nth(0), [name("head", "from_state"), name("tail", "to_state"), name("step_id", "trigger_step"), none.alias("evidence_label")]).alias("state_transitions"),
            part(F.col("family").isin("communication", "propagation"), nth(0), [name("head", "evidence_label"), name("tail", "indicated_label"), name("family", "mechanism")]).alias("diagnostic_edges"),
        ),
        given.select(*key, part(None, nth(1), [F.col(c) for c in state]).alias("state_transitions")),
        more.select(*key, part(None, nth(1), [F.col(c) for c in sign]).alias("diagnostic_edges")),
    )
    rows = parts[0]
    for one in parts[1:]:
        rows = rows.unionByName(one, allowMissingColumns=True)
    kinds = ("concept_mentions", "step_actions", "structural_edges", "state_transitions", "diagnostic_edges")
    listed = [F.transform(F.sort_array(F.collect_list(c)), lambda e: e["x"]).alias(c) for c in kinds]
    out = rows.repartition("doc_id").groupBy(*key).agg(F.collect_list("_step").alias("_own"), F.collect_list("_relations").alias("_relations"), *listed).withColumn("_own", F.get("_own", F.lit(0)))
    out = out.where("_own IS NOT NULL").select(*key, "_own.*", "_relations", *kinds)
    follows = F.struct(F.lit("triggers").alias("label"), F.lit("task_dependency").alias("family"), F.col("step_id").alias("head"), F.col("sequence_next").alias("tail"))
    follows = F.when(F.col("sequence_next").isNotNull(), F.struct(follows.alias("x"), F.lit(2_000_000_000).alias("pos")))
    out = out.withColumn("relation_mentions", _first_of_each(F.concat("_relations", F.array_compact(F.array(follows)))))
    task = {"label": F.col("step_id"), "kind": none, "description": F.lit(""), "node_worthy": F.lit(True), "surface_form": F.col("text"), "semantic_type_hint": none, "shared_hypernym": none}
    fields = [
        F.col("step_id"), F.struct(*(v.alias(k) for k, v in task.items())).alias("task"), F.col("concept_mentions"), F.col("relation_mentions"), step_phase(F.col("text")).alias("step_phase"),
        F.substring(F.trim(F.substring_index("text", ".", 1)), 1, 72).alias("step_summary"), F.col("text").alias("surface_form"), F.col("step_actions"), F.col("structural_edges"), F.col("state_transitions"),
        F.col("diagnostic_edges"), F.col("sequence_next"),
    ]
    return _listed(out, ["doc_id"], "step_records", fields, [F.col("step_pos")])
