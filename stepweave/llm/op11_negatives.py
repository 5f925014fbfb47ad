"""Hard negatives by blocked matrix products (operator 11).

Vectors become whole numbers, so inner products in float64 are exact while their bound stays below
2**53 (beyond it they are taken with Python's integers). Anchors are packed by tasks into blocks of
BLOCK_ROWS at most; groups of blocks, of GROUP_MB at most, are broadcast one after the other, and for each
the tasks multiply their candidates, BATCH at a time, by all blocks of the group. The first pass keeps
for each anchor its first positives, only against candidates of its own label; partial lists of tasks
merge by rank. The second gives each positive its window of scores and keeps the first negatives in it,
again as partial lists that merge. A task holds one batch of scores and the lists of one group.

Edge cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part; vectors of different lengths
are never compared; equal scores go by id; repeated rows are rows of their own, but a row of the anchor's own id is never
its positive or negative; scores beyond 64 bits stop at their ends; an anchor without positives, or a positive without negatives, gives no row; an
empty table gives none. Columns other than the three named may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.shared import materialize

BLOCK_ROWS, GROUP_MB, BATCH, EXACT = 1024, 32, 512, float(2**53)
LOWEST = np.iinfo(np.int64).min


def usable_vectors(rows: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """id, label, v (whole numbers as doubles) of the rows that take part."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(sound)


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors times 256, rounded down) for each length of vectors in an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    flat, starts = np.floor(256 * np.asarray(column.flatten(), np.float64)), np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        out.append((own, flat[starts[own][:, None] + np.arange(size)]))
    return out


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of all rows of a with all of b; exact. largest: of |a|."""
    if a.shape[1] * largest * float(np.abs(b).max(initial=0)) < EXACT:
        return a @ b.T
    whole = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.clip(whole, LOWEST, 2**63 - 1).astype(np.int64)


class Best:
    """The first k (score down, id up) of each of n lists, merged from parts as they come."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.used = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.least = np.full(n, LOWEST)  # a score below it can't enter

    def offer(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        full = self.used[lists] == self.k
        last = np.where(full, self.ids[lists, self.k - 1], 0)
        enter = ~full | (scores > self.least[lists]) | ((scores == self.least[lists]) & (ids < last))
        lists, scores, ids = lists[enter], scores[enter], ids[enter]
        if not len(lists):
            return
        touched = np.unique(lists)
        held = np.repeat(touched, self.used[touched])
        place = np.arange(len(held)) - np.repeat(np.cumsum(self.used[touched]) - self.used[touched], self.used[touched])
        lists, scores, ids = np.concatenate([held, lists]), np.concatenate([self.scores[held, place], scores]), np.concatenate([self.ids[held, place], ids])
        order = np.lexsort((ids, -scores.astype(np.float64), lists)) if np.abs(scores).max() < EXACT else np.array(sorted(range(len(ids)), key=lambda i: (lists[i], -int(scores[i]), ids[i])))
        lists, scores, ids = lists[order], scores[order], ids[order]
        first = np.searchsorted(lists, touched)
        rank = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        kept = rank < self.k
        self.scores[lists[kept], rank[kept]], self.ids[lists[kept], rank[kept]] = scores[kept], ids[kept]
        self.used[touched] = np.minimum(np.diff(np.append(first, len(lists))), self.k)
        self.least[touched] = np.where(self.used[touched] == self.k, self.scores[touched, self.k - 1], LOWEST)


# --- anchors in blocks

PACKED = "block long, n long, dim int, ids binary, labels binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK_ROWS anchors of one length; numbered by task, so that a task run again gives the same numbers."""
    made, waiting = TaskContext.get().partitionId() << 32, {}

    def packed(dim: int, rows: list) -> pa.RecordBatch:
        nonlocal made
        ids, labels, vectors = (np.concatenate(x) for x in zip(*rows, strict=True))
        made += 1
        return pa.RecordBatch.from_pylist([{"block": made, "n": len(ids), "dim": dim, "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": vectors.tobytes()}], pa.schema([("block", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]))

    for batch in batches:
        ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for own, vectors in matrix(batch.column(2)):
            dim = vectors.shape[1]
            room = max(1, min(BLOCK_ROWS, int(GROUP_MB * 2**20) // (8 * max(dim, 1))))
            rows = waiting.setdefault(dim, [])
            for k in range(0, len(own), room):
                rows.append((ids[own[k : k + room]], labels[own[k : k + room]], vectors[k : k + room]))
                have = sum(len(x[0]) for x in rows)
                if have >= room:
                    whole = [np.concatenate(x) for x in zip(*rows, strict=True)]
                    yield packed(dim, [[x[:room] for x in whole]])
                    rows[:] = [[x[room:] for x in whole]] if have > room else []
    for dim, rows in waiting.items():
        if rows:
            yield packed(dim, rows)


class Block:
    """A block of anchors, unpacked in a task; the windows of its positives in the second pass."""

    def __init__(self, row):
        self.number, self.dim = row["block"], row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), self.dim)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.by_label = {int(label): np.flatnonzero(self.labels == label) for label in np.unique(self.labels)}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for own, vectors in matrix(batch.column(2)):
            for k in range(0, len(own), BATCH):
                part = own[k : k + BATCH]
                yield ids[part], labels[part], vectors[k : k + BATCH]


def _listed(best: list[Best], blocks: list[Block], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The lists as rows: block, place (of the anchor), positive (0 where width is 1), score, id."""
    for top, block in zip(best, blocks, strict=True):
        lists = np.repeat(np.arange(len(top.used)), top.used)
        place = np.arange(len(lists)) - np.repeat(np.cumsum(top.used) - top.used, top.used)
        columns = [np.full(len(lists), block.number), lists // width, lists % width, top.scores[lists, place], top.ids[lists, place]]
        if len(lists):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


FOUND = "block long, place long, nth long, score long, id long"
NAMES = ["block", "place", "nth", "score", "id"]


def _positives(group, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(r) for r in group.value]
        best = [Best(len(b.ids), k) for b in blocks]
        for ids, labels, vectors in _candidates(batches):
            for block, top in zip(blocks, best, strict=True):
                if block.dim != vectors.shape[1]:
                    continue
                for label in np.unique(labels):
                    rows = block.by_label.get(int(label))
                    if rows is None:
                        continue
                    own = np.flatnonzero(labels == label)
                    scores = products(block.vectors[rows], vectors[own], block.largest)
                    i, j = np.nonzero((scores >= top.least[rows][:, None]) & (block.ids[rows][:, None] != ids[own][None, :]))
                    top.offer(rows[i], scores[i, j].astype(np.int64), ids[own[j]])
        yield from _listed(best, blocks, 1, NAMES)

    return run


def _negatives(group, wanted, k: int, width: int, low: int, high: int):
    """wanted: by block, the scores of each anchor's positives, (n, width), and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, best, windows = [Block(r) for r in group.value], [], []
        for block in blocks:
            scores, used = wanted.value[block.number]
            there = np.arange(width)[None, :] < used[:, None]
            exact = scores.astype(object)
            lower = np.where(there, np.array([[-(-low * int(x) // 100) for x in row] for row in exact], np.int64).reshape(scores.shape), 2**62)
            upper = np.where(there, np.array([[high * int(x) // 100 for x in row] for row in exact], np.int64).reshape(scores.shape), -(2**62))
            windows.append((lower, upper, upper.max(1)))
            best.append(Best(scores.size, k))
        for ids, labels, vectors in _candidates(batches):
            for block, top, (lower, upper, most) in zip(blocks, best, windows, strict=True):
                if block.dim != vectors.shape[1]:
                    continue
                scores = products(block.vectors, vectors, block.largest)
                least = np.maximum(lower, top.least.reshape(lower.shape)).min(1)
                i, j = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]) & (block.labels[:, None] != labels[None, :]) & (block.ids[:, None] != ids[None, :]))
                found = scores[i, j].astype(np.int64)
                for nth in range(width):
                    fits = (found >= lower[i, nth]) & (found <= upper[i, nth])
                    top.offer(i[fits] * width + nth, found[fits], ids[j[fits]])
        yield from _listed(best, blocks, width, NAMES)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each list over all tasks; each task gives k rows of a list at most."""
    order = Window.partitionBy("block", "place", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the rows of anchors against all rows.

    A positive is one of the first `positives` rows of the anchor's label and of another id; its negatives are the first
    `negatives` rows of other labels whose scores are from low % to high % of its own.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    packed = materialize(usable_vectors(anchors, id_col, vector, label).mapInArrow(_pack, PACKED), "anchors")
    candidates = usable_vectors(rows, id_col, vector, label)
    # A row for each block of anchors, without its vectors, plans the groups.
    groups, size = [[]], 0
    for block, n, dim in packed.select("block", "n", "dim").orderBy("block").toLocalIterator():
        mb = n * (dim * 8 + 16 + 8 * 4 * positives * (1 + negatives)) / 2**20
        if groups[-1] and size + mb > GROUP_MB:
            groups.append([])
            size = 0
        groups[-1].append(block)
        size += mb
    out = None
    for group in filter(None, groups):
        blocks = spark.sparkContext.broadcast(packed.where(F.col("block").isin(group)).collect())
        sizes = {r["block"]: r["n"] for r in blocks.value}
        first = materialize(_first(candidates.mapInArrow(_positives(blocks, positives), FOUND), positives).select("block", "place", (F.col("rank") - 1).cast("long").alias("nth"), "score", "id"), "positives")
        wanted = {b: (np.zeros((n, positives), np.int64), np.zeros(n, np.int64)) for b, n in sizes.items()}
        table = first.select("block", "place", "nth", "score").toArrow()  # of one group's anchors
        b, place, nth, score = (np.asarray(table.column(c)) for c in range(4))
        for own in np.unique(b):
            at = b == own
            scores, used = wanted[int(own)]
            scores[place[at], nth[at]] = score[at]
            np.add.at(used, place[at], 1)
        windows = spark.sparkContext.broadcast(wanted)
        second = _first(candidates.mapInArrow(_negatives(blocks, windows, negatives, positives, low, high), FOUND), negatives)
        ids = spark.createDataFrame(pa.table({"block": np.repeat(list(sizes), list(sizes.values())), "place": np.concatenate([np.arange(n) for n in sizes.values()]), "anchor_id": np.concatenate([np.frombuffer(r["ids"], np.int64) for r in blocks.value])}))
        pairs = first.select("block", "place", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = second.select("block", "place", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["block", "place", "nth"]).join(ids, ["block", "place"])
        done = materialize(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        out = done if out is None else out.unionByName(done)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if out is None else out


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0), label=label)


ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) QUALIFY row_number() OVER w <= 3
"""
