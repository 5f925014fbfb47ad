"""Procedure texts and extracted relations: Columns that clean, date and describe them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave import constants as K
from stepweave.functions.text import relation_key, step_id, whole_word

MOST_CHARS = 20000


def normalize_content(content: Column, most: int = MOST_CHARS) -> Column:
    """Without byte order mark, runs of blank lines, fenced code and tags; all headings of one level; cut to what a model reads."""
    out = F.regexp_replace(content, "^﻿+", "")
    for pattern, plain in ((r"\n{3,}", "\n\n"), (r"(?s)```.*?```", ""), (r"<[^>]+>", ""), (r"(?m)^#{2,6}\s+", "# "), (r"^\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, plain)
    return F.substring(out, 1, most)


def step_rows(content: Column) -> Column:
    """The (step_id, text) rows of the step table, one array entry per line of that form."""
    lines = F.filter(F.transform(F.split(content, r"\r\n|\r|\n"), F.trim), lambda x: x.rlike(r"(?i)^\|\s*T\d+\s*\|.*\|$"))
    part = lambda x, k: F.regexp_extract(x, r"(?i)^\|\s*(T\d+)\s*\|\s*(.*?)\s*\|$", k)
    return F.transform(lines, lambda x: F.struct(F.upper(part(x, 1)).alias("step_id"), part(x, 2).alias("text")))


def endpoint(label: Column) -> Column:
    """A step's id, or the label without blanks around it."""
    return F.coalesce(step_id(label), F.trim(label))


def document_label(label: Column) -> Column:
    """A label without words that only place it, and without `vehicle` before a name."""
    flat = F.trim(F.regexp_replace(F.trim(label), r"(?i)^(nearby|adjacent)\s+", ""))
    rest = F.trim(F.regexp_replace(flat, r"(?i)^vehicle ", ""))
    return F.when(step_id(label).isNotNull(), F.trim(label)).when(F.lower(flat).startswith("vehicle ") & rest.rlike(r"\p{Lu}"), rest).otherwise(flat)


def relation_entry(r: Column) -> Column:
    """An extracted relation (label, family, head, tail) under its canonical label and a family that goes with it, passives turned round; null without label or ends."""
    label, head, tail = F.trim(r["label"]), F.trim(r["head"]), F.trim(r["tail"])
    family = F.coalesce(F.when(F.trim(r["family"]) != "", F.trim(r["family"])), F.lit("structural"))
    table = lambda k: F.create_map(*(F.lit(x) for key, v in K.RELATION_LABELS.items() for x in (key, v[k])))
    key = relation_key(label)
    known, usual, turned = F.try_element_at(table(0), key), F.try_element_at(table(1), key), key.isin(*K.PASSIVE_LABELS)
    own = F.when((known == "triggers") & (family == "propagation"), family).otherwise(F.coalesce(usual, family))
    out = F.struct(F.coalesce(known, label).alias("label"), own.alias("family"), F.when(turned, tail).otherwise(head).alias("head"), F.when(turned, head).otherwise(tail).alias("tail"))
    return F.when((label != "") & (head != "") & (tail != ""), out)


def keeps_document_relation(family: Column, head: Column, tail: Column) -> Column:
    """False for structural relations from a context or to a small part."""
    return (family != "structural") | ~(head.rlike(whole_word(K.DOCUMENT_HEAD)) | tail.rlike(whole_word(K.DOCUMENT_TAIL)))


def procedure_meta(content: Column) -> Column:
    """asset_name, procedure_type, primary_fault_type by the first of five lines that names one; null if none is named."""
    lines = F.transform(F.slice(F.split(F.regexp_replace(content, r"^\s+|\s+\z", ""), r"\r\n|\r|\n"), 1, 5), F.lower)
    first = lambda found: F.get(F.filter(F.transform(lines, found), lambda x: x.isNotNull() & (x != "")), F.lit(0))

    def kind(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(K.PROCEDURE_TYPES):
            out = F.when(line.rlike(words), name).otherwise(out)
        return out

    asset = F.initcap(first(lambda x: F.regexp_extract(x, f"({K.ASSET_NAMES})", 1)))
    fault = first(lambda x: F.regexp_extract(x, rf"\b({K.FAULT_TYPES})\b", 1))
    told = F.struct(asset.alias("asset_name"), first(kind).alias("procedure_type"), fault.alias("primary_fault_type"))
    return F.when(F.coalesce(asset, first(kind), fault).isNotNull(), told)


def document_time(content: Column, ingested: Column) -> Column:
    """The first date of a text in ISO form and UTC, by the most exact form that is a date; else the time of ingestion."""
    day = lambda pattern, form: F.try_to_timestamp(F.regexp_extract(content, pattern, 1), F.lit(form))
    exact = F.regexp_extract(content, r"\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\b", 1)
    zone = F.regexp_extract(content, r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b", 0)
    at = F.coalesce(F.when(exact != "", zone.try_cast("timestamp")), day(r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-MM-dd"), day(r"\b(\d{4}/\d{2}/\d{2})\b", "yyyy/MM/dd"), day(r"\b(\d{2}-\d{2}-\d{4})\b", "dd-MM-yyyy"), ingested)
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def front_matter(content: Column) -> Column:
    """The keys and values between --- lines at the start, as a map; empty without. Of repeated keys the last counts."""
    lines = F.filter(F.split(F.regexp_extract(content, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1), "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), '^"+|"+$', ""), "^'+|'+$", "").alias("v")))
    last = F.filter(pairs, lambda p: F.size(F.filter(pairs, lambda q: q["k"] == p["k"])) == 1)
    unique = F.when(F.size(last) == F.size(pairs), pairs).otherwise(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))
    return F.map_from_entries(unique)


def is_manual(file_name: Column, content: Column) -> Column:
    """Whether a file is a procedure manual, by its name or else by its content."""
    return file_name.rlike(K.MANUAL_FILE) | content.rlike(K.MANUAL_CONTENT)
