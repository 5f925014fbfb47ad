"""Benchmark decontamination by SimHash windows (operator 6).

Every run of words of a document that is as long as an item is a window of that item's size; a
document shorter than the item is one window, as far as its length alone lets it be similar. A
window's fingerprint is a 128-bit SimHash of its lower-cased five-word shingles. Fingerprints are cut
into BLOCKS blocks; two within RADIUS bits are within RADIUS // BLOCKS in one block at least, so an
item whose blocks all differ in more is out of reach, and only the items that a block lets through
are compared whole. Windows within RADIUS are then confirmed by exact weighted similarity: sums of
the smaller over sums of the larger shingle counts. Windows of similarity 0.75 differ in 22 bits on
average; over 40 has a chance below 1e-4.

The width of a block is what makes the index select: of unrelated pairs, two blocks of 64 bits let
0.4 % through, four of 32 bits 10 %, eight of 16 bits 59 %, and RADIUS + 1 blocks that must agree
whole 99 %. So there are two, and their values are compared by population counts, item by item.

A window with no shingle of any item has similarity 0 with all of them, so fingerprints are only
made where a window touches a known shingle; that loses nothing.

Items are sent out in groups of about ITEMS rows and ITEM_BYTES bytes, a scan of the documents for
each group; the index of a group is built once, on the driver. A task holds PAIRS pairs of a window
and an item at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import WordHasher, blocks, mix

BITS, RADIUS, BLOCKS, SHINGLE, PERCENT = 128, 40, 2, 5, 75
ITEMS, ITEM_BYTES, PAIRS, WINDOWS = 20_000, 16 << 20, 1 << 20, 4096


def simhash_signs(shingles: np.ndarray) -> np.ndarray:
    """Per shingle, its 128 bits as -1 or 1."""
    two = np.stack([shingles, mix(shingles ^ np.uint64(0xA0761D6478BD642F))], 1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def running_sums(shingles: np.ndarray) -> np.ndarray:
    """Sums of the signs of all shingles before each place, from which any window's fingerprint follows."""
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(simhash_signs(shingles), 0, dtype=np.int32, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, length: int) -> np.ndarray:
    """The SimHash of every run of `length` shingles, as BLOCKS numbers of 64 bits."""
    return np.packbits(sums[length:] > sums[:-length], axis=1).view(np.uint64)


def near_pairs(marks: np.ndarray, held: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs of fingerprints within the radius, slice by slice.

    By the pigeonhole, each of these differs in at most radius // BLOCKS bits in one block; pairs
    that no block lets through are not looked at whole.
    """
    step = max(1, PAIRS // max(1, len(held)))
    for at in range(0, len(marks), step):
        some = marks[at : at + step]
        passed = np.zeros((len(some), len(held)), bool)
        for k in range(BLOCKS):
            passed |= np.bitwise_count(some[:, None, k] ^ held[None, :, k]) <= radius // BLOCKS
        w, i = np.nonzero(passed)
        near = np.bitwise_count(some[w] ^ held[i]).sum(1) <= radius
        yield w[near] + at, i[near]


def weighted_similarity(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sum of the smaller and sum of the larger counts of two bags of shingles."""
    (a, n), (b, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low, len(x) + len(y) - low


class Items:
    """A group of benchmark items: shingles, fingerprints by length, and a filter of known shingles."""

    def __init__(self, rows: list[tuple[int, str]], radius: int, percent: int):
        self.hasher, self.radius, self.percent = WordHasher(), radius, percent
        texts = pa.array([t for _, t in rows], pa.string())
        self.ids, self.bags = [], []
        for at, _, data, offsets in blocks(texts):
            starts, ends, first = self.hasher.bounds(data, offsets)
            shingles, cut = self.hasher.shingles(self.hasher(data, starts, ends), first, SHINGLE)
            for r in range(len(offsets) - 1):
                if first[r + 1] - first[r]:
                    self.ids.append(rows[at + r][0]), self.bags.append(shingles[cut[r] : cut[r + 1]])
        self.known = np.unique(np.concatenate(self.bags)) if self.bags else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.known & np.uint64((1 << 22) - 1)] = True
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(b) for b in self.bags])
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            self.by_length[int(n)] = own, np.concatenate([fingerprints(running_sums(self.bags[i]), int(n)) for i in own])

    def touched(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of known shingles."""
        maybe = np.flatnonzero(self.filter[shingles & np.uint64((1 << 22) - 1)])
        return maybe[np.isin(shingles[maybe], self.known)] if len(maybe) else maybe

    def match(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, shingles, similarity) of a text's best window for each item it contains."""
        hits = self.touched(shingles)
        if not len(hits):
            return
        best: dict[int, tuple[float, int, int]] = {}
        sizes = {n: min(n, len(shingles)) for n in self.by_length if 100 * min(n, len(shingles)) >= self.percent * n}
        if not sizes:
            return
        for lo, hi in self.spans(hits, max(sizes.values()), len(shingles)):
            for at in range(lo, hi, WINDOWS):
                to = min(hi, at + WINDOWS)
                sums = running_sums(shingles[at : to + max(sizes.values()) - 1])
                for n, size in sizes.items():
                    own, held = self.by_length[n]
                    # Of the places of this slice, those where a window of this size can begin.
                    marks = fingerprints(sums[: max(0, min(to - at, len(shingles) - size + 1 - at)) + size], size)
                    for w, i in near_pairs(marks, held, self.radius):
                        for start, k in zip((w + at).tolist(), own[i].tolist(), strict=True):
                            low, high = weighted_similarity(shingles[start : start + size], self.bags[k])
                            if 100 * low >= self.percent * high and (low / high, -start) > best.get(k, (0.0, 0, 0))[:2]:
                                best[k] = low / high, -start, size
        for i, (similarity, start, n) in sorted(best.items()):
            yield self.ids[i], -start, n, similarity

    @staticmethod
    def spans(hits: np.ndarray, n: int, total: int) -> list[tuple[int, int]]:
        """Runs [lo, hi) of starts of windows of up to n shingles that touch a hit, merged."""
        out: list[list[int]] = []
        for h in hits.tolist():
            lo, hi = max(0, h - n + 1), min(total, h + 1)
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return [(a, b) for a, b in out]


def _scanner(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for at, _, data, offsets in blocks(batch.column(1)):
                starts, ends, first = items.hasher.bounds(data, offsets)
                shingles, cut = items.hasher.shingles(items.hasher(data, starts, ends), first, SHINGLE)
                hits = items.touched(shingles)
                for r in np.unique(np.searchsorted(cut, hits, "right") - 1):
                    for item, start, n, similarity in items.match(shingles[cut[r] : cut[r + 1]]):
                        out.append((ids[at + int(r)].as_py(), item, start, min(n + SHINGLE - 1, int(first[r + 1] - first[r])), similarity))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def find_benchmark(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, percent: int = PERCENT, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each item in each document that has one.

    Null and wordless texts and items match nothing; an item under five words is one shingle and
    is found in a text that consists of it; repeated rows give rows of their own; ties go to the
    first window. An empty benchmark or table gives no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind, found = "doc_id long, item_id long, first_word long, n_words long, similarity double", None
    for rows in item_groups(benchmark, items):
        some = docs.mapInArrow(_scanner(Items(rows, radius, percent)), kind)
        found = some if found is None else found.union(some)
    return found


def _cleaner(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, _, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                starts, ends, first = items.hasher.bounds(data, offsets)
                shingles, cut = items.hasher.shingles(items.hasher(data, starts, ends), first, SHINGLE)
                for r in np.unique(np.searchsorted(cut, items.touched(shingles), "right") - 1):
                    keep[at + r] = next(items.match(shingles[cut[r] : cut[r + 1]]), None) is None
            yield batch.filter(pa.array(keep))

    return run


def item_groups(benchmark: DataFrame, items: int = ITEMS, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in groups of about `items` rows and `most` bytes, the larger number of groups; one item at least."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // items), -(-size["bytes"] // most))
    for part in range(parts):
        own = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").toLocalIterator()]


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", radius: int = RADIUS, percent: int = PERCENT, items: int = ITEMS) -> DataFrame:
    """The documents without a window of any benchmark item, columns as they are, of any names; no shuffle.

    Documents of a null, empty or wordless text stay; repeated rows stay or go together; an empty
    benchmark takes nothing away and an empty table gives no rows.
    """
    columns, left = documents.columns, documents
    for rows in item_groups(benchmark, items):
        moved = left.select(*(c for c in columns if c != text), text)
        left = moved.mapInArrow(_cleaner(Items(rows, radius, percent)), moved.schema)
    return left.select(*columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
