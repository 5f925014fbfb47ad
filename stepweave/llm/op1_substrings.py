"""Substring dedup by content-defined chunks (operator 1).

A gear hash rolls over a text's bytes: each byte shifts the hash left by one and adds the byte's
random word, so its low BITS bits depend on the last BITS bytes only. A chunk ends where these bits
are largest among LEAST bytes to either side. So a cut depends on the BITS + LEAST bytes before
and the LEAST after it and on nothing else: two texts are cut alike inside a passage they share,
from its 36th byte to its 17th last, whatever stands around it. In text of a short period the
largest value comes back with each period; such cuts are thinned to LEAST bytes, which gives equal
chunks wherever the thinning begins. Chunks are of some 33 bytes.

Duplicates are pairs of neighbouring chunks: a pair's digest covers both, and a pair that two
documents or more hold is shared. Shared pairs that follow each other by a chunk join to a run, so a
run goes on only where the same two chunks stand side by side elsewhere: two short lines that each
repeat in other documents, but not one after the other, are two runs. Runs of at least RUN_WORDS words
are passages. A repeated passage loses some 36 and 17 bytes and part of a chunk at either end, about
14 words of it in all, so one of over 50 words stays above RUN_WORDS unless its words are of two or
three letters throughout; a run is never longer than what is repeated, so a shared line of a dozen
words stays below. Digests have 64 bits: of n chunks about n * n / 2**65 pairs agree by chance, and
a passage takes several in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.shared import blocks, materialize, mix

BITS, LEAST, MOST, RUN_WORDS = 20, 16, 256, 24


def gear_table() -> np.ndarray:
    return np.random.default_rng(101).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling the span six times (64 bytes)."""
    h = table[data]
    for k in range(6):
        span = 1 << k
        h[span:] = h[span:] + (h[:-span] << np.uint64(span)) if len(h) > span else h[span:]
    return h


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    """The largest of values[i : i + width] for each i, by doubling the span."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out, span = np.maximum(out[:-step], out[step:]), span + step
    return out


def cut_points(hashes: np.ndarray, offsets: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """The ends of each text's chunks: where the low bits are largest among `least` bytes to either side, `most` bytes at the latest."""
    rows = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    where = np.arange(len(hashes)) + rows * least
    padded = np.full(len(hashes) + len(offsets) * least, -1, np.int32)
    padded[where] = (hashes & np.uint64((1 << bits) - 1)).astype(np.int32)
    marks = np.flatnonzero(padded[where] == sliding_max(padded, 2 * least + 1)[where - least]) + 1
    bounds = np.searchsorted(marks, offsets)
    out = []
    for r in range(len(offsets) - 1):
        at, end, ends = int(offsets[r]), int(offsets[r + 1]), []
        for m in marks[bounds[r] : bounds[r + 1]].tolist():
            while m - at > most:
                at += most
                ends.append(at)
            if m - at >= least:
                ends.append(m)
                at = m
        while end - at > most:
            at += most
            ends.append(at)
        if at < end:
            ends.append(end)
        out.append(ends)
    return out


def chunk_pairs(bits: int, least: int, most: int):
    """mapInArrow function: (row, id, text) to a row per pair of neighbouring chunks.

    rid, doc, lo, hi (bytes), words_lo, words_hi (words begun before either) and d, the pair's digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, space = gear_table(), np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            for at, to, data, offsets in blocks(batch.column(2)):
                # A text's first bytes must not see the text before it: its first 63 are hashed anew.
                hashes = gear_hashes(data, table)
                for r in range(len(offsets) - 1):
                    head = data[offsets[r] : min(offsets[r] + 63, offsets[r + 1])]
                    hashes[offsets[r] : offsets[r] + len(head)] = gear_hashes(head, table)
                ends = cut_points(hashes, offsets, bits, least, most)
                counts = np.array([len(e) for e in ends])
                stop = np.array([e for x in ends for e in x], np.int64)
                if len(stop) < 2:
                    continue
                own = np.repeat(np.arange(len(counts)), counts)
                start = np.concatenate([[0], stop[:-1]])
                first = np.concatenate([[True], own[1:] != own[:-1]])
                start[first] = offsets[:-1][own[first]]
                begun = ~space[data]
                begun[1:] &= space[data[:-1]]
                starts = offsets[:-1][(offsets[:-1] < len(data))]
                begun[starts] = ~space[data[starts]]
                words = np.concatenate([[0], np.cumsum(begun)])
                raw = data.tobytes()
                digest = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.uint64)
                pair = np.flatnonzero(~first[1:])
                row, lo, hi = own[pair], start[pair], stop[pair + 1]
                base = offsets[:-1][row]
                both = mix(digest[pair] * np.uint64(0x9E3779B97F4A7C15) + digest[pair + 1])
                counted = (words[x] - words[base] for x in (lo, hi))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[at:to][row]),
                        ids.slice(at, to - at).take(pa.array(row)),
                        *(pa.array(x.astype(np.int32)) for x in (lo - base, hi - base, *counted)),
                        pa.array(both.view(np.int64)),
                    ],
                    names=["rid", "doc", "lo", "hi", "words_lo", "words_hi", "d"],
                )

    return run


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS, least: int = LEAST, most: int = MOST, run_words: int = RUN_WORDS) -> DataFrame:
    """id_col, first_doc, lo, hi, n_words, n_chunks, first: a row per stretch of a repeated passage of each document.

    A passage is a run of shared pairs of chunks of run_words words; it is cut into stretches where
    chunks that this document is the first to hold meet chunks that a smaller id holds too. `first`
    marks the former, which a dedup keeps. lo and hi are UTF-8 byte offsets of whole chunks, n_words
    and n_chunks count the stretch. first_doc is the smallest id among the documents that hold the
    stretch's first pair. A passage repeated in one document alone is none. Null and empty texts
    have no chunks, a text of one chunk has no pair; a row with a null id counts as no other document;
    repeated rows of one id are one document. An empty table gives no rows. Only the id and the
    text are read, so other columns may have any name.
    """
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    schema = "rid long, doc long, lo int, hi int, words_lo int, words_hi int, d long"
    pairs = materialize(docs.mapInArrow(chunk_pairs(bits, least, most), schema), "pairs")
    shared = pairs.groupBy("d").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc <> last_doc").drop("last_doc")
    # Written, so that the join's two sides are plain exchanges and adaptive execution can split a common pair's task.
    shared = materialize(shared, "shared")
    held = pairs.join(shared, "d").drop("d").withColumn("own", F.coalesce(F.col("first_doc") == F.col("doc"), F.lit(False)))

    order = Window.partitionBy("rid").orderBy("lo")
    follows = F.coalesce(F.lag("hi").over(order) > F.col("lo"), F.lit(False))
    precedes = F.coalesce(F.lead("lo").over(order) < F.col("hi"), F.lit(False))
    before = F.when(follows, F.lag(F.struct("own", "hi", "words_hi")).over(order))
    after = F.when(precedes, F.lead(F.struct("own", "lo", "words_lo")).over(order))
    marked = held.withColumn("before", before).withColumn("after", after)
    # A chunk of both an own and a foreign pair is held before: it belongs to the foreign stretch.
    cut_before = F.col("own") & F.coalesce(~F.col("before.own"), F.lit(False))
    cut_after = F.col("own") & F.coalesce(~F.col("after.own"), F.lit(False))
    apart = F.col("before").isNull().cast("long")
    turned = F.coalesce((F.col("before.own") != F.col("own")).cast("long"), F.lit(1))
    edges = marked.select(
        "rid", "doc", "first_doc", "own",
        F.col("lo").alias("at"),
        F.when(cut_before, F.col("before.hi")).otherwise(F.col("lo")).alias("lo"),
        F.when(cut_after, F.col("after.lo")).otherwise(F.col("hi")).alias("hi"),
        F.when(cut_before, F.col("before.words_hi")).otherwise(F.col("words_lo")).alias("words_lo"),
        F.when(cut_after, F.col("after.words_lo")).otherwise(F.col("words_hi")).alias("words_hi"),
        (cut_before.cast("long") + cut_after.cast("long")).alias("cuts"),
        apart.alias("apart"), turned.alias("turned"),
    )
    numbered = Window.partitionBy("rid").orderBy("at")
    runs = edges.withColumn("run", F.sum("apart").over(numbered)).withColumn("stretch", F.sum("turned").over(numbered))
    stretches = runs.groupBy("rid", "run", "stretch").agg(
        F.first("doc").alias(id_col),
        F.min_by("first_doc", "at").alias("first_doc"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        (F.max("words_hi") - F.min("words_lo")).cast("long").alias("n_words"),
        (F.count("*") + 1 - F.sum("cuts")).alias("n_chunks"),
        F.first("own").alias("first"),
    )
    whole = F.sum("n_words").over(Window.partitionBy("rid", "run"))
    kept = stretches.withColumn("whole", whole).where((F.col("whole") >= run_words) & (F.col("lo") < F.col("hi")))
    return kept.select(id_col, "first_doc", "lo", "hi", "n_words", "n_chunks", "first")


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
