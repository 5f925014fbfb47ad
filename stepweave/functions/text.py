"""Scalar functions on labels and texts: Column to Column, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave import constants as K

#: All white space of Unicode and the four separators of ASCII.
BLANKS = r"[ \t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def whole_word(words: str) -> str:
    """A pattern for any of the words, bounded by ASCII word characters on neither side."""
    return rf"(?i)(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


def normalize_space(text: Column) -> Column:
    """Runs of white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def step_id(label: Column) -> Column:
    """T and digits at the start of a label, upper-cased; null without."""
    found = F.upper(F.regexp_extract(F.trim(label), r"(?i)^(T\d+)(?![A-Za-z0-9_])", 1))
    return F.when(found != "", found)


def step_token(label: Column) -> Column:
    """A step's name inside a relation: an upper-case T, blanks, digits, then a blank or the end; null without."""
    found = F.regexp_extract(F.trim(label), r"^T\s*(\d+)(?=\s|$)", 1)
    return F.when(found != "", F.concat(F.lit("T"), found))


def order_index(label: Column, position: Column) -> Column:
    return F.coalesce(F.regexp_extract(label, r"^T(\d+)$", 1).try_cast("int"), position)


def relation_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: an expression used in many places grows with each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def singular(label: Column) -> Column:
    """The last word in the singular; the whole label is lower-cased where that changes it. Step ids and names with numbers stay."""
    irregular = F.create_map(*(F.lit(x) for pair in K.IRREGULAR_PLURALS.items() for x in pair))

    def ending(v: Column) -> Column:
        last, size = v["last"], F.length(v["last"])
        stem = lambda cut: F.substring(last, F.lit(1), size - cut)
        return (
            F.when(irregular[last].isNotNull(), irregular[last])
            .when((size > 4) & last.endswith("ies"), F.concat(stem(3), F.lit("y")))
            .when((size > 2) & last.endswith("es"), stem(2))
            .when((size > 2) & last.endswith("s") & ~last.endswith("ss") & ~last.endswith("us") & ~last.endswith("is"), stem(1))
        )

    low = F.lower(label)
    kept = (label == "") | step_id(label).isNotNull() | label.rlike(r"[A-Z]+-\d+") | low.isin(*K.KEPT_PLURALS)
    parts = F.struct(F.regexp_extract(F.trim(low), r"([^ \t\n\x0B\f\r]*)$", 1).alias("last"), F.regexp_replace(F.trim(low), r"[^ \t\n\x0B\f\r]*$", "").alias("before"))
    changed = let(parts, lambda v: F.concat(v["before"], ending(v)))
    return F.when(kept, label).otherwise(F.coalesce(changed, label))


def canonical_label(label: Column) -> Column:
    """The form under which mentions of one concept meet."""

    def form(flat: Column) -> Column:
        base = F.trim(F.regexp_extract(flat, r"(?i)^(.+?)\s+stable$", 1))
        return (
            F.when((flat == "") | step_id(flat).isNotNull(), flat)
            .when(F.lower(flat) == "service-disconnect", F.lit("service disconnect"))
            .when(flat.rlike(r"(?i)^(?:orange\s+)?handle\s+sits\s+proud$"), F.lit("handle proud"))
            .when(flat.rlike(r"(?i)^handle\s+flush(?:ness)?(?:\s+with\b.*)?$"), F.lit("handle flushness"))
            .otherwise(let(F.when((base != "") & F.lower(base).rlike("status|path|permissive"), base).otherwise(flat), singular))
        )

    return let(normalize_space(label), form)


def type_hint(value: Column) -> Column:
    """One of the five base types, whatever its case; null otherwise."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*(t.lower() for t in K.BASE_ANCHORS)), F.initcap(low))


def hypernym(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*(t.lower() for t in K.HYPERNYMS)), F.initcap(low))


def hint_candidates(text: Column) -> Column:
    """All base types whose words occur in the text, in the order Fault, Signal, State, Component, Asset."""
    return F.array_compact(F.array(*(F.when(text.rlike(whole_word(words)), name) for name, words in K.HINT_WORDS)))


def step_phase(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(K.PHASES):
        out = F.when(text.rlike(whole_word(words)), name).otherwise(out)
    return out


def anchor_by_words(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(K.ANCHOR_WORDS):
        out = F.when(text.rlike(whole_word(words)), name).otherwise(out)
    return out


def text_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256: the key of cached embeddings."""
    return F.substring(F.sha2(text, 256), 1, 16)


def title(content: Column, fallback: Column) -> Column:
    found = F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(fallback)


def evaluation_label(label: Column) -> Column:
    """Lower-cased words, each in the singular: the form in which gold labels are compared."""
    return F.array_join(F.transform(F.split(F.lower(normalize_space(label)), " "), singular), " ")
