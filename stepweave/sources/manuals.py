"""Sources of a run beside its records: folders of manuals by domain, constraints, concepts and prompts.

Manuals are read by Spark; the small files (constraints, concepts, prompts) through Spark as well, so
that any store that it reaches will do.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import procedures
from stepweave.functions.text import title
from stepweave.settings import SettingsError

#: The folders that may hold a domain's manuals; of other domains the one of their name.
DOMAIN_FOLDERS = {
    "battery": ("battery", "battery_om_manual_en"),
    "cnc": ("cnc", "cnc_om_manual_en"),
    "nev": ("nev", "nev_om_manual_en", "ev_om_manual_en"),
}


def parsed_documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """file, folder, doc_id (the file's name), title, content, metadata (a map) and timestamp of markdown files; unordered.

    Without a date in its text a document gets the time at which it is read.
    """
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    flat = text.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("content"))
    content, name = F.col("content"), F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    return flat.select(
        "file", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("folder"), name.alias("doc_id"), title(content, name).alias("title"), "content",
        procedures.front_matter(content).alias("metadata"), procedures.document_time(content, F.current_timestamp()).alias("timestamp"),
    )


def read_domains(spark: SparkSession, root: str, domains: list[str], role: str = "target", pattern: str = "*.md") -> DataFrame:
    """The manuals of some domains, each in a folder below root: parsed_documents() with domain_id, role and doc_type.

    A domain without a folder has no rows, one whose files lie in two folders fails, and so does the job at a
    file that neither its name nor its content shows to be a manual.
    """
    names = [(d, folder) for d in domains for folder in DOMAIN_FOLDERS.get(d, (d,))]
    known = spark.createDataFrame(names, "domain_id string, folder string")
    found = parsed_documents(spark, root, pattern).join(F.broadcast(known), "folder")
    twice = found.groupBy("domain_id").agg(F.array_sort(F.collect_set("folder")).alias("folders")).where("size(folders) > 1").first()
    if twice:
        raise SettingsError(f"{twice['domain_id']}: manuals in more than one folder: {', '.join(twice['folders'])}")
    of_file = F.regexp_extract("file", r"([^/]+)$", 1)
    odd = F.raise_error(F.concat(F.lit("no manual: "), "file")).cast("string")
    kind = F.when(procedures.is_manual(of_file, F.col("content")), "om_manual").otherwise(odd)
    return found.withColumns({"role": F.lit(role), "doc_type": kind})


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt template, whole."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise SettingsError(f"{path}: not one file")
    return rows[0]["value"].removeprefix("﻿")


def _json(spark: SparkSession, path: str) -> Any:
    try:
        return json.loads(read_prompt(spark, path))
    except json.JSONDecodeError as e:
        raise SettingsError(f"{path}: {e}") from e


def read_constraints(spark: SparkSession, path: str) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """family: (types of heads, types of tails) of a constraint file, in the form of constants.TYPE_CONSTRAINTS; remarks are left out."""
    told = _json(spark, path)
    if not isinstance(told, dict):
        raise SettingsError(f"{path}: not a mapping")
    rules = {k: v for k, v in told.items() if not k.startswith(("_", "$")) and k != "description"}
    return {k: (tuple(v.get("allowed_head_types", ())), tuple(v.get("allowed_tail_types", ()))) for k, v in rules.items()}


def read_concepts(spark: SparkSession, path: str) -> dict[str, str]:
    """label: description of a file of concepts: a mapping, or a list of labels or of label and description; either may stand under "concepts"."""
    told = _json(spark, path)
    told = told.get("concepts", told) if isinstance(told, dict) else told
    if isinstance(told, dict):
        pairs = list(told.items())
    elif isinstance(told, list):
        pairs = [(x, x) if isinstance(x, str) else (x.get("label"), x.get("description") or x.get("label")) if isinstance(x, dict) else (None, None) for x in told]
    else:
        raise SettingsError(f"{path}: neither a mapping nor a list")
    out = {}
    for n, (name, text) in enumerate(pairs, 1):
        if not (isinstance(name, str) and name.strip() and isinstance(text, str) and text.strip()):
            raise SettingsError(f"{path}: entry {n} has no label or no description")
        out[name.strip()] = text.strip()
    return out


def supplements(spark: SparkSession, paths: dict[str, str | None]) -> DataFrame:
    """The concepts that the domains (in the order given, each with its file or None) add, as audits.build_backbone() takes them."""
    rows = [(k, domain, n, *x) for k, (domain, path) in enumerate(paths.items()) if path for n, x in enumerate(read_concepts(spark, path).items())]
    return spark.createDataFrame(rows, "domain_pos int, domain_id string, pos int, label string, description string")


def evidence_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct evidence_id of evidence files of any form."""
    from stepweave.sources.readers import read_evidence

    return read_evidence(spark, path).where("evidence_id IS NOT NULL").select("evidence_id").distinct()
