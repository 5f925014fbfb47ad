"""URL filters: rules first, then segmented names under naive Bayes (operator 4).

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's;
the longest fitting rule decides. For the other urls, names that run words together are split by a
unigram Viterbi, and multinomial naive Bayes scores the words of host and path. It learns from
urls that rules decide: at most ROWS of each verdict, in the order of a hash of the id, and of each the
first CHARS characters of host and path; how often
each verdict occurs is counted over all pages. So are the words of paths and page texts, of which the
WORDS most frequent ones, ties by code point, are the segmenter's vocabulary (some 1 MB).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, CHARS, WORDS, LONGEST = 2000, 2000, 20_000, 20
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one; of equally long ones the first by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi over word counts; an unknown word of n letters scores as 10 / (total * 10 ** n)."""

    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values()))
        self.logs = {w: math.log(c / total) for w, c in counts.items()}
        self.base = math.log(10 / total)
        self.split = lru_cache(100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        """The best words of a name; ties go to the longer last word."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = -math.inf, end - 1
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                score = best[start] + self.logs.get(word, self.base - len(word) * math.log(10))
                if score > top:
                    top, at = score, start
            best.append(top), back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(out[::-1])


def tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    out = []
    for kind, text in (("h", host), ("p", path)):
        for part in re.findall(r"[^\W\d_]+|\d+", text.lower()):
            out += [f"{kind}:#"] if part[0].isdigit() else [f"{kind}:{w}" for w in segmenter.split(part)]
    return out


class Model:
    """Segmenter and naive Bayes weights; the weights' fit is bounded by its sample."""

    def __init__(self, sample: list[tuple[str, str, str]], counts: dict[str, int], verdicts: dict[str, int]):
        """sample: host, path, verdict; counts: of words; verdicts: how many pages the rules allow and block."""
        self.counts, self.segmenter = counts, Segmenter(counts)
        seen, docs = {"allow": Counter(), "block": Counter()}, Counter(verdicts)
        for host, path, verdict in sample:
            seen[verdict].update(tokens(host, path, self.segmenter))
        self.vocabulary = len(seen["allow"] | seen["block"]) + 1
        self.weights = {t: self.log(seen["block"], t) - self.log(seen["allow"], t) for t in sorted(seen["allow"] | seen["block"])}
        self.prior = math.log((docs["block"] + 1) / (docs["allow"] + 1))
        self.fitted = docs["block"] > 0 and docs["allow"] > 0

    def log(self, counts: Counter, token: str) -> float:
        return math.log((counts[token] + 1) / (counts.total() + self.vocabulary))

    def score(self, host: str, path: str) -> float:
        """Log odds of a block; 0 where there was nothing to learn from."""
        return self.prior + sum(self.weights.get(t, 0.0) for t in tokens(host, path, self.segmenter)) if self.fitted else 0.0


def _word_counter(most: int = 200_000):
    """mapInArrow function: (path, page text) to (word, count), counted over about `most` distinct words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for path, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.update(re.findall(r"[^\W\d_]{1,20}", f"{path} {page}".lower()))
                if len(words) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
                    words = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    return run


def _scorer(model_parts: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.__new__(Model)
        counts, model.weights, model.prior, model.fitted = model_parts
        model.segmenter = Segmenter(counts)
        score = lru_cache(100_000)(model.score)
        for batch in batches:
            odds = [score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], names=[*batch.schema.names, "log_odds"])

    return run


def filter_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", rules: tuple = RULES, rows: int = ROWS) -> DataFrame:
    """id_col, host, path, rule, verdict, log_odds: a row per page.

    Urls without a rule are blocked at log odds over 0. A null url, or one without ://, has an
    empty host and path, no rule, and the verdict of the prior. Without both verdicts among the
    pages nothing is learned and the rest is allowed. An empty table gives no rows; repeated rows
    are judged one by one, and equal urls alike. Columns other than the three named may have any name.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    cut = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumn("verdict", verdict).where("verdict IS NOT NULL")
    verdicts = {r["verdict"]: r["count"] for r in ruled.groupBy("verdict").count().collect()}
    order = (F.xxhash64("id"), "id", "host", "path")
    taken = [tuple(r) for v in sorted(verdicts) for r in ruled.where(F.col("verdict") == v).orderBy(*order).limit(rows).select(F.substring("host", 1, CHARS), F.substring("path", 1, CHARS), "verdict").collect()]
    # Without both verdicts no url is scored, and no words are needed.
    counted = pages.select(path.alias("path"), F.coalesce(F.col(page), F.lit("")).alias("page")).mapInArrow(_word_counter(), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(WORDS).collect() if len(verdicts) == 2 else []
    model = Model(taken, {r["word"]: r["n"] for r in top}, verdicts)
    parts = (model.counts, model.weights, model.prior, model.fitted)
    scored = cut.withColumn("rule", rule).withColumn("ruled", verdict).select("id", "host", "path", "rule", "ruled")
    scored = scored.mapInArrow(_scorer(parts), "id long, host string, path string, rule string, ruled string, log_odds double")
    judged = F.coalesce("ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), "log_odds")


def op4_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
