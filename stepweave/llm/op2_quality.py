"""Quality rules judged by host (operator 2), in DataFrame functions only.

Every document is measured, and the failures of each rule are summed by host. For each rule an
empirical beta prior is fitted to the hosts' rates (method of moments, less the variance that drawing
documents alone gives; hosts of two documents or more), every host's rate is shrunk towards it, and a host fails the rule where its
shrunk rate lies over the prior's mean by SPREADS of the prior's standard deviation. The verdicts are
joined back: a document of a host that fails a rule is rejected if it fails that rule itself, so at
such hosts rules bind that elsewhere only count. Where hosts do not differ by more than chance, or
there are fewer than four, no host fails.

Edge cases: a null text counts as empty (it fails the base rule), a null host is a host of its
own, repeated rows are judged one by one, an empty table gives no rows, and columns of other
names are left alone (internal names start with ``_q_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import SPACES, WORD, materialize

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text; none for a null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES + "+"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words lie in a window of `size` words that the text has twice or more.

    Windows are sorted with their positions, so equal ones are neighbours: n log n, and exact.
    """

    def windows(ws: Column) -> Column:
        made = F.transform(ws, lambda w, i: F.struct(F.concat_ws(" ", w, *(F.get(ws, i + k) for k in range(1, size))).alias("w"), i.alias("i")))
        return F.sort_array(F.slice(made, 1, F.greatest(F.size(ws) - (size - 1), F.lit(0))))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["w"] == F.get(s, i + 1)["w"]) | ((i > 0) & (x["w"] == F.get(s, i - 1)["w"])))

    found = let(let(words, windows), twice)
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(*(x["i"] + k for k in range(size)))))))


def measures(text: str) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    made = let(
        words_of(F.col(text)),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated_words(ws).cast("long").alias("n_repeat_words")),
    )
    return [made.alias("_q"), F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")]


def measure(documents: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """documents, without the text unless asked for, and the five measures.

    The row number drawn beside them keeps the optimizer from computing a measure once per use.
    """
    kept = [c for c in documents.columns if keep_text or c != text]
    drawn = documents.select(*kept, *measures(text), F.monotonically_increasing_id().alias("_q_row"))
    return drawn.select(*kept, "_q.n_words", "_q.word_chars", "n_symbols", "n_dup_lines", "_q.n_repeat_words")


BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Rules whose failures are counted by host and bind where the host fails them.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "5 * n_dup_lines > n_words",
    "long_words": "word_chars > 12 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}
SPREADS = 1.5


def failures(rules: dict[str, str] = RULES) -> list[Column]:
    """A boolean column per rule, _q_fails_<rule>."""
    return [F.expr(rule).alias(f"_q_fails_{name}") for name, rule in rules.items()]


def beta_priors(hosts: DataFrame, rules: dict[str, str] = RULES) -> dict[str, tuple[float, float]]:
    """The mean and the variance, without that of drawing documents, of the hosts' rates of each rule; hosts: host_docs, failed_<rule>.

    Hosts of two documents or more are fitted. Drawing n documents at a rate p adds p(1-p)/n to the variance of rates, whose mean over
    hosts is (m(1-m) - s2) d with d the mean of 1/n: so s2 = (var - m(1-m) d) / (1 - d). Where there is no such host, both are 0.
    """
    rate = {r: F.col(f"failed_{r}") / F.col("host_docs") for r in rules}
    moments = [f(rate[r]).alias(f"{name}_{r}") for r in rules for name, f in (("mean", F.avg), ("var", F.var_pop))]
    found = hosts.where("host_docs >= 2").agg(F.avg(1 / F.col("host_docs")).alias("drawn"), *moments).first()
    drawn, out = found["drawn"] or 0.0, {}
    for r in rules:
        mean, var = found[f"mean_{r}"] or 0.0, found[f"var_{r}"] or 0.0
        out[r] = mean, (var - mean * (1 - mean) * drawn) / (1 - drawn)
    return out


def judge_hosts(flagged: DataFrame, host: str, rules: dict[str, str] = RULES, spreads: float = SPREADS) -> DataFrame:
    """_q_host, host_docs, and for each rule its shrunk rate and whether the host fails it: rate_<rule>, host_fails_<rule>.

    flagged has the host and failures(rules). A host of few documents keeps near the usual rate.
    The priors are one row, all that reaches the driver.
    """
    summed = [F.sum(F.col(f"_q_fails_{r}").cast("long")).alias(f"failed_{r}") for r in rules]
    hosts = flagged.groupBy(F.col(host).alias("_q_host")).agg(F.count("*").alias("host_docs"), *summed)
    rate = {r: F.col(f"failed_{r}") / F.col("host_docs") for r in rules}
    out = hosts.select("_q_host", "host_docs", *(f"failed_{r}" for r in rules))
    for r, (mean, own) in beta_priors(hosts, rules).items():
        mass = mean * (1 - mean) / own - 1 if own > 0 else 0.0
        if own <= 0 or mass <= 0:
            # Hosts differ by chance only, or so much that a host's own rate says all.
            shrunk, fails = rate[r], F.lit(own > 0) & (rate[r] > mean + spreads * max(own, 0.0) ** 0.5)
        else:
            shrunk = (F.col(f"failed_{r}") + F.lit(mean * mass)) / (F.col("host_docs") + F.lit(mass))
            fails = shrunk > F.lit(mean + spreads * own**0.5)
        out = out.withColumn(f"rate_{r}", shrunk).withColumn(f"host_fails_{r}", fails)
    return out.drop(*(f"failed_{r}" for r in rules))


def bound_by_host(rules: dict[str, str] = RULES) -> Column:
    """Whether a document fails a rule that its host fails."""
    return F.expr(" OR ".join(f"(host_fails_{r} AND _q_fails_{r})" for r in rules))


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", rules: dict[str, str] = RULES, spreads: float = SPREADS) -> DataFrame:
    """id_col, host, the five measures, base_failed, host_failed and kept, a row per document.

    base_failed: BASE holds; host_failed: the document fails a rule that its host fails; kept: neither.
    Hosts are joined back by a shuffle or, where Spark has measured them to be small, a broadcast.
    """
    measured = measure(documents.select(id_col, host, text), text)
    flagged = materialize(measured.select("*", *failures(rules)), "quality")
    hosts = judge_hosts(flagged, host, rules, spreads).select("_q_host", *(f"host_fails_{r}" for r in rules))
    judged = flagged.join(hosts, F.col(host).eqNullSafe(F.col("_q_host")), "left")
    judged = judged.withColumn("base_failed", F.expr(BASE)).withColumn("host_failed", bound_by_host(rules))
    return judged.select(*measured.columns, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


def passing_documents(documents: DataFrame, text: str = "text", host: str = "source", rules: dict[str, str] = RULES, spreads: float = SPREADS) -> DataFrame:
    """The documents kept by quality_rules(), all columns as they are.

    Texts are measured once and not shuffled: documents that pass the base rules are written beside
    the flags of all, the hosts read the flags alone, and their verdicts are joined to what was written.
    """
    measured = measure(documents.select(F.struct("*").alias("_q_all"), F.col(text).alias("_q_text"), F.col(host).alias("_q_source")), "_q_text")
    flags = measured.select("_q_all", "_q_source", F.expr(BASE).alias("_q_base"), *failures(rules))
    written = materialize(flags.withColumn("_q_all", F.when(~F.col("_q_base"), F.col("_q_all"))), "quality")
    hosts = judge_hosts(written, "_q_source", rules, spreads).select("_q_host", *(f"host_fails_{r}" for r in rules))
    hosts = materialize(hosts, "hosts")
    judged = written.where("NOT _q_base").join(hosts, F.col("_q_source").eqNullSafe(F.col("_q_host")), "left")
    return judged.where(~bound_by_host(rules)).select("_q_all.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("source").alias("host"), "host_failed")


#: The measures, as DuckDB reads them; {src} is a table with doc_id, source and text.
MEASURES_SQL = r"""
q_text AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM {src}),
q_words AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM q_text),
q_lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM q_text) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
q_windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM q_words WHERE len(w) >= 3)),
q_twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM q_windows) WHERE n > 1),
q_repeat AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM q_twice) GROUP BY rid),
measured AS (
  SELECT q_words.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM q_words LEFT JOIN q_lines USING (rid) LEFT JOIN q_repeat USING (rid))
"""


def _prior_sql(r: str) -> str:
    return f"coalesce(avg(f_{r} / n), 0) AS m_{r}, coalesce((var_pop(f_{r} / n) - avg(f_{r} / n) * (1 - avg(f_{r} / n)) * avg(1 / n)) / (1 - avg(1 / n)), 0) AS s_{r}"


def _verdict_sql(r: str) -> str:
    mass = f"(m_{r} * (1 - m_{r}) / s_{r} - 1)"
    rate = f"CASE WHEN {mass} > 0 THEN (f_{r} + m_{r} * {mass}) / (n + {mass}) ELSE f_{r} / n END"
    return f"CASE WHEN s_{r} > 0 THEN {rate} > m_{r} + {SPREADS} * sqrt(s_{r}) ELSE false END AS h_{r}"


#: After MEASURES_SQL: judged, with base_failed and host_failed of each document.
VERDICTS_SQL = (
    ", flagged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, "
    + ", ".join(f"{rule} AS d_{r}" for r, rule in RULES.items())
    + " FROM measured), hosts AS (SELECT source, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (d_{r}) AS f_{r}" for r in RULES)
    + " FROM flagged GROUP BY source), prior AS (SELECT "
    + ", ".join(map(_prior_sql, RULES))
    + " FROM hosts WHERE n >= 2), verdicts AS (SELECT source, "
    + ", ".join(map(_verdict_sql, RULES))
    + " FROM hosts, prior), judged AS (SELECT flagged.*, "
    + " OR ".join(f"(h_{r} AND d_{r})" for r in RULES)
    + " AS host_failed FROM flagged JOIN verdicts ON flagged.source IS NOT DISTINCT FROM verdicts.source)"
)

ORACLE = (
    "WITH " + MEASURES_SQL.format(src="documents") + VERDICTS_SQL
    + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, source AS host, host_failed FROM judged"
)
