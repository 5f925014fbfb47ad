"""Sources: evidence records, markdown procedures, gold files; all with schemas given, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MENTION = "struct<label:string,kind:string,description:string,node_worthy:boolean,surface_form:string,semantic_type_hint:string,parent_gold:string,gold_parent:string,shared_hypernym:string>"
RELATION = "struct<label:string,family:string,head:string,tail:string>"
STEP = (
    f"struct<step_id:string,task:{MENTION},concept_mentions:array<{MENTION}>,relation_mentions:array<{RELATION}>,step_phase:string,step_summary:string,surface_form:string,"
    f"step_actions:array<struct<action_type:string,target_label:string>>,structural_edges:array<{RELATION}>,state_transitions:array<struct<from_state:string,to_state:string,trigger_step:string,evidence_label:string>>,"
    "diagnostic_edges:array<struct<evidence_label:string,indicated_label:string,mechanism:string>>,sequence_next:string>"
)
RECORD = (
    f"struct<evidence_id:string,domain_id:string,role:string,source_type:string,timestamp:string,raw_text:string,step_records:array<{STEP}>,document_concept_mentions:array<{MENTION}>,document_relation_mentions:array<{RELATION}>,"
    f"concept_mentions:array<{MENTION}>,relation_mentions:array<{RELATION}>,procedure_meta:struct<asset_name:string,procedure_type:string,primary_fault_type:string>,"
    "cross_step_relations:array<struct<label:string,family:string,head:string,tail:string,head_step:string,tail_step:string>>>"
)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence records of JSON files in any of four forms: {samples}, {evidence_records}, a record, or a list of records.

    Older records keep their mentions at the top; those become the document's. Other forms fail, and
    so does a file of several records one after the other: read_evidence_lines() reads a record a line.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("t"), F.col("_metadata.file_path").alias("file"))
    text = text.withColumn("t", F.when(F.col("t").rlike(r"(?s)^\s*\{.*\}\s*\n\s*\{\s*\""), F.raise_error(F.concat(F.lit("several records in "), "file"))).otherwise(F.col("t")))
    whole = F.from_json("t", f"struct<samples:array<{RECORD}>,evidence_records:array<{RECORD}>,evidence_id:string>")
    listed = F.when(F.ltrim("t").startswith("["), F.from_json("t", f"array<{RECORD}>")).when(whole["samples"].isNotNull(), whole["samples"]).when(whole["evidence_records"].isNotNull(), whole["evidence_records"]).when(whole["evidence_id"].isNotNull(), F.array(F.from_json("t", RECORD))).otherwise(F.raise_error(F.concat(F.lit("no evidence records in "), "file")))
    return upgraded(text.select("file", F.posexplode(listed).alias("input_pos", "r")).select("file", "input_pos", "r.*"))


def read_evidence_lines(spark: SparkSession, path: str) -> DataFrame:
    """Evidence records of JSON-lines files, one a line; blank lines and a byte order mark are skipped, a line that is no record fails."""
    return parsed_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("input_pos")))


def parsed_lines(text: DataFrame) -> DataFrame:
    """The records of lines (value, file, input_pos)."""
    text = text.select(F.regexp_replace("value", "^\ufeff", "").alias("t"), "file", "input_pos").where("trim(t) <> ''")
    r = F.from_json("t", RECORD)
    checked = F.when(r["evidence_id"].isNull(), F.raise_error(F.concat(F.lit("no evidence record in a line of "), "file"))).otherwise(r)
    return upgraded(text.select("file", "input_pos", checked.alias("r")).select("file", "input_pos", "r.*"))


def upgraded(flat: DataFrame) -> DataFrame:
    """Records of any version in the present form."""
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    hinted = lambda c: F.transform(c, lambda m: m.withField("semantic_type_hint", F.coalesce(m["semantic_type_hint"], m["parent_gold"], m["gold_parent"])).withField("node_worthy", F.coalesce(m["node_worthy"], F.lit(True))).dropFields("parent_gold", "gold_parent"))
    old = F.col("step_records").isNull()
    out = flat.withColumn("document_concept_mentions", hinted(empty(F.when(old, F.coalesce("document_concept_mentions", "concept_mentions")).otherwise(F.col("document_concept_mentions")), MENTION)))
    out = out.withColumn("document_relation_mentions", empty(F.when(old, F.coalesce("document_relation_mentions", "relation_mentions")).otherwise(F.col("document_relation_mentions")), RELATION))
    task = lambda s: hinted(F.array(s["task"]))[0]
    steps = F.transform(empty(F.col("step_records"), STEP), lambda s: s.withField("task", F.when(s["task"].isNotNull(), task(s))).withField("concept_mentions", hinted(empty(s["concept_mentions"], MENTION))))
    return out.withColumn("step_records", steps).drop("concept_mentions", "relation_mentions")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, title, content and the rows of the step table (step_id, text) of markdown procedures, in their order."""
    from stepweave.functions.text import title

    text = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True)
    flat = text.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("content"))
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = F.regexp_extract_all("content", F.lit(r"(?m)^\|\s*(T\d+)\s*\|\s*(.*?)\s*\|\s*$"), 1)
    bodies = F.regexp_extract_all("content", F.lit(r"(?m)^\|\s*(T\d+)\s*\|\s*(.*?)\s*\|\s*$"), 2)
    return flat.select("path", title(F.col("content"), name).alias("title"), "content", F.arrays_zip(rows.alias("step_id"), bodies.alias("text")).alias("steps"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """domain_id, source_doc, label, parent_anchor, accept of gold attachment files; accept is true unless given."""
    schema = "domain string, source_doc string, gold_attachments array<struct<label:string,surface_form:string,parent_anchor:string,accept:boolean,rationale:string>>"
    flat = spark.read.schema(schema).option("multiLine", True).json(path)
    return flat.select(F.col("domain").alias("domain_id"), "source_doc", F.explode("gold_attachments").alias("g")).select("domain_id", "source_doc", "g.label", "g.parent_anchor", F.coalesce("g.accept", F.lit(True)).alias("accept"))
