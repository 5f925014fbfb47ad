"""Nearest vectors by cosine: exactly, by blocked matrix products, or through an inverted file of centroids.

One side is packed by tasks into blocks; groups of blocks, GROUP_MB at most, are broadcast one after
the other, and tasks multiply the rows of the other side by them as they stream by. Where the broadcast side asks,
a task keeps the best of each of its queries and the tasks' lists are merged by rank; where the streaming side
asks, its rows are answered at once. The inverted file has every vector, in the list of its nearest
centroid; a query meets the lists of the centroids nearest to it alone, and all products are exact.

Rows with a null id, a null vector or a null or non-finite component take no part; vectors of different lengths are never compared;
a vector without length has cosine 0 to all; equal scores (to DIGITS places, beyond which sums in another order differ) go by id; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.session import ensure_checkpoint_dir

BLOCK_ROWS, GROUP_MB, BATCH, DIGITS = 1024, 32, 1024, 12
#: The sample that centroids are fitted on has so many vectors at most, and so many for each list.
SAMPLE_ROWS, SAMPLE_PER_LIST, MOST_LISTS = 131_072, 64, 4096


def sound(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return kept.where("id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those without length stay so."""
    largest = np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    scaled = np.divide(vectors, largest, out=np.zeros_like(vectors), where=largest > 0)  # squares of the largest and least doubles stay finite
    size = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return np.divide(scaled, size, out=scaled, where=size > 0)


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors of length 1) for each length of vectors in an Arrow list column."""
    sizes = np.asarray(column.value_lengths())
    flat, starts = np.asarray(column.flatten(), np.float64), np.concatenate([[0], np.cumsum(sizes)])
    own = {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}
    return [(rows, unit(flat[starts[rows][:, None] + np.arange(s)])) for s, rows in own.items()]


def best_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of entries (row, score, id) the first k of each row by score down and id up, in order, and their ranks from 0."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    _, first, counts = np.unique(rows, return_index=True, return_counts=True)
    rank = np.arange(len(rows)) - np.repeat(first, counts)
    kept = rank < k
    return rows[kept], scores[kept], ids[kept], rank[kept]


# --- the broadcast side

_PACKED = "block long, n long, dim int, ids binary, vectors binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length, numbered by task: a task run again gives the same numbers."""
    number, waiting = TaskContext.get().partitionId() << 32, {}
    for batch in _and_end(batches):
        for rows, vectors in matrices(batch.column(1)) if batch is not None else ():
            waiting.setdefault(vectors.shape[1], []).append((np.asarray(batch.column(0))[rows], vectors))
        for dim, parts in waiting.items():
            room = max(1, min(BLOCK_ROWS, int(GROUP_MB * 2**20) // (8 * max(dim, 1))))
            ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros((0, dim)))
            upto = len(ids) if batch is None else len(ids) - len(ids) % room
            for k in range(0, upto, room):
                number += 1
                own = slice(k, min(k + room, upto))
                yield pa.RecordBatch.from_pylist([{"block": number, "n": own.stop - own.start, "dim": dim, "ids": ids[own].tobytes(), "vectors": vectors[own].tobytes()}], _PACKED_ARROW)
            waiting[dim] = [(ids[upto:], vectors[upto:])] if upto < len(ids) else []


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _groups(rows: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The rows in groups of blocks (dim, ids, vectors); the driver holds one group at a time, of GROUP_MB or one block."""
    ensure_checkpoint_dir(rows.sparkSession)
    packed = rows.mapInArrow(_pack, _PACKED).checkpoint()
    planned: list[list[int]] = [[]]
    size = 0.0
    for block, n, dim in packed.select("block", "n", "dim").orderBy("block").toLocalIterator():
        mb = n * (dim + 8) * 8 / 2**20
        if planned[-1] and size + mb > GROUP_MB:
            planned.append([])
            size = 0.0
        planned[-1].append(block)
        size += mb
    for group in filter(None, planned):
        found = packed.where(F.col("block").isin(group)).orderBy("block").collect()
        yield [(r["dim"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(r["n"], r["dim"])) for r in found]


_FOUND = "place long, score double, id long"


def _nearest_to_broadcast(held, k: int, probing=None):
    """A task's best for the queries of a group. probing: for each block, by list, the places of the queries that meet it; None: all meet all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = held.value
        starts = np.cumsum([0, *(len(b[1]) for b in blocks)])
        scores, ids, used = np.zeros((starts[-1], k)), np.zeros((starts[-1], k), np.int64), np.zeros(starts[-1], np.int64)
        least = np.full(starts[-1], -np.inf)

        def offer(places: np.ndarray, found: np.ndarray, others: np.ndarray) -> None:
            i, j = np.nonzero(found >= least[places][:, None])
            if not len(i):
                return
            touched = places[np.unique(i)]
            have = np.repeat(touched, used[touched])
            rank = np.arange(len(have)) - np.repeat(np.cumsum(used[touched]) - used[touched], used[touched])
            p, s, o, r = best_of(np.concatenate([have, places[i]]), np.concatenate([scores[have, rank], found[i, j]]), np.concatenate([ids[have, rank], others[j]]), k)
            scores[p, r], ids[p, r] = s, o
            used[touched] = np.bincount(p, minlength=len(used))[touched]
            least[touched] = np.where(used[touched] == k, scores[touched, k - 1], -np.inf)

        for batch in batches:
            names = np.asarray(batch.column(0))
            lists = np.asarray(batch.column(2)) if probing else None
            for rows, vectors in matrices(batch.column(1)):
                for at in range(0, len(rows), BATCH):
                    own, part = rows[at : at + BATCH], vectors[at : at + BATCH]
                    for b, (dim, _, asking) in enumerate(blocks):
                        if dim != part.shape[1]:
                            continue
                        if probing is None:
                            offer(np.arange(starts[b], starts[b + 1]), np.round(asking @ part.T, DIGITS), names[own])
                            continue
                        for one in np.unique(lists[own]):
                            meets = probing.value[b].get(int(one))
                            if meets is not None:
                                there = lists[own] == one
                                offer(starts[b] + meets, np.round(asking[meets] @ part[there].T, DIGITS), names[own[there]])
        places = np.repeat(np.arange(starts[-1]), used)
        rank = np.arange(len(places)) - np.repeat(np.cumsum(used) - used, used)
        if len(places):
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(scores[places, rank]), pa.array(ids[places, rank])], names=["place", "score", "id"])

    return run


def _answered(queries: DataFrame, vectors: DataFrame, k: int, probed=None) -> DataFrame:
    """query_id, id, score, rank. probed: a function of a group's blocks that gives the lists each query meets."""
    spark = queries.sparkSession
    out = None
    for group in _groups(queries):
        sent = spark.sparkContext.broadcast(group)
        own, meets = vectors, None
        if probed:
            by_list, lists = probed(group)
            meets = spark.sparkContext.broadcast(by_list)
            if len(lists) <= 1000:  # else nearly all of the file is wanted
                own = own.where(F.col("list").isin(lists))
        found = own.mapInArrow(_nearest_to_broadcast(sent, k, meets), _FOUND)
        best = Window.partitionBy("place").orderBy(F.desc("score"), "id")
        first = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = np.concatenate([b[1] for b in group])
        named = spark.createDataFrame(pa.table({"at": np.arange(len(names)), "query_id": names}))
        done = first.join(F.broadcast(named), F.col("place") == F.col("at")).select("query_id", "id", "score", "rank").checkpoint()
        out = done if out is None else out.unionByName(done)
    return spark.createDataFrame([], "query_id long, id long, score double, rank int") if out is None else out


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """query_id, id, score, rank: for each query the k vectors of greatest cosine, all of them compared. The queries travel, in groups."""
    return _answered(sound(queries, id_col, vector), sound(vectors, id_col, vector), k)


def nearest_of_few(rows: DataFrame, key: str, vector: str, others: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """key, id, score, rank: for each of rows the k of others (id, v) of greatest cosine to so many digits. The others travel, in groups; rows are not shuffled for one group.

    Rows with a null vector or a null or non-finite component have no answers; key may be of any type and repeated.
    """
    kind = rows.schema[key].dataType.simpleString()
    asking = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    keyed, parts = asking, []
    groups = _groups(others)
    first = next(groups, None)
    second = next(groups, None)
    if second is not None:  # lists of several groups meet again by a row's number
        keyed = asking.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    row = "row" if second is not None else None
    for group in (g for g in (first, second, *groups) if g is not None):
        sent = rows.sparkSession.sparkContext.broadcast(group)
        schema = f"key {kind}, id long, score double, rank int" + (", row long" if row else "")
        parts.append(keyed.mapInArrow(_nearest_to_rows(sent, k, bool(row), digits), schema))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"key {kind}, id long, score double, rank int").withColumnRenamed("key", key)
    out = parts[0]
    if row:
        for part in parts[1:]:
            out = out.unionByName(part)
        best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
        out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select(F.col("key").alias(key), "id", "score", "rank")


def _nearest_to_rows(held, k: int, numbered: bool, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in matrices(batch.column(1)):
                fit = [b for b in held.value if b[0] == vectors.shape[1]]
                if not fit:
                    continue
                ids, others = np.concatenate([b[1] for b in fit]), np.concatenate([b[2] for b in fit])
                step = max(1, (1 << 21) // len(ids))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    scores = np.round(vectors[at : at + step] @ others.T, digits)
                    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(part), -np.inf)
                    i, j = np.nonzero(scores >= least[:, None])
                    p, s, o, r = best_of(i, scores[i, j], ids[j], k)
                    columns = [batch.column(0).take(pa.array(part[p])), pa.array(o), pa.array(s), pa.array((r + 1).astype(np.int32))]
                    names = ["key", "id", "score", "rank"]
                    if numbered:
                        columns, names = [*columns, batch.column(2).take(pa.array(part[p]))], [*names, "row"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


# --- the inverted file


@dataclass
class InvertedFile:
    """Centroids (bounded: MOST_LISTS of them), and the table list, id, v of all vectors, sorted by list."""

    centroids: np.ndarray
    table: DataFrame


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of length 1 by Lloyd's rounds over cosine; a centroid without vectors moves to the vector worst placed."""
    r = np.random.default_rng(seed)
    centers = sample[np.sort(r.choice(len(sample), lists, replace=False))]
    for _ in range(rounds):
        scores = sample @ centers.T
        own = scores.argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(scores.max(1), kind="stable")[: len(empty)]]
        centers = unit(sums)
    return centers


def build(vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "id", vector: str = "vector", seed: int = 0) -> InvertedFile:
    """Write all vectors (of the length that most of the sample have; others are not in the file) to path, sorted by list.

    lists: the square root of the number of vectors, MOST_LISTS at most, unless given. The centroids are fitted on
    min(SAMPLE_PER_LIST * lists, SAMPLE_ROWS) vectors, taken by a hash of their ids, the same in each run.
    """
    spark = vectors.sparkSession
    rows = sound(vectors, id_col, vector)
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
    wanted = min(SAMPLE_PER_LIST * lists, SAMPLE_ROWS)
    # Twice the share, cut to the bound by the order of the hash: a sample without a sort of all rows.
    sampled = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, 2 * wanted / max(n, 1)) * (1 << 30))).orderBy(F.xxhash64("id", "v")).limit(wanted)
    found = matrices(sampled.select("v").toArrow().column(0).combine_chunks()) if n else []
    sample = max((m for _, m in found), key=len, default=np.zeros((0, 0)))
    centroids = fit_centroids(sample, min(lists, len(sample)), seed=seed) if len(sample) else sample
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        for batch in batches:
            own = np.full(batch.num_rows, -1, np.int32)
            for rows_, m in matrices(batch.column(1)):
                if len(centers) and m.shape[1] == centers.shape[1]:
                    for at in range(0, len(rows_), BATCH):
                        own[rows_[at : at + BATCH]] = (m[at : at + BATCH] @ centers.T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["id", "v", "list"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.mapInArrow(assign, "id long, v array<double>, list int").where("list >= 0")
    # By list and id: a list of most vectors is dealt to many tasks.
    listed.repartitionByRange(parts, "list", "id").sortWithinPartitions("list", "id").write.mode("overwrite").parquet(path)
    return InvertedFile(centroids, spark.read.schema("id long, v array<double>, list int").parquet(path))


def _meets(index: InvertedFile, probes: int):
    def probed(group: list) -> tuple[list[dict[int, np.ndarray]], list[int]]:
        out, every = [], set()
        for dim, _, asking in group:
            by_list: dict[int, np.ndarray] = {}
            if len(index.centroids) and dim == index.centroids.shape[1]:
                n = min(probes, len(index.centroids))
                own = np.argsort(-(asking @ index.centroids.T), axis=1, kind="stable")[:, :n]
                for one in np.unique(own):
                    by_list[int(one)] = np.flatnonzero((own == one).any(1))
            every |= set(by_list)
            out.append(by_list)
        return out, sorted(every)

    return probed


def search(index: InvertedFile, queries: DataFrame, k: int = 10, probes: int = 8, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """query_id, id, score, rank: the k best of the lists of each query's `probes` nearest centroids; with as many as there are lists, nearest()."""
    return _answered(sound(queries, id_col, vector), index.table.select("id", "v", "list"), k, _meets(index, probes))


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of the wanted answers (query_id, id) that were found; 1 where none is wanted."""
    hits = wanted.select("query_id", "id").distinct().join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return 1.0 if hits is None else hits


def probes_for(index: InvertedFile, queries: DataFrame, k: int = 10, target: float = 0.95, most: int = 256, id_col: str = "id", vector: str = "vector") -> int:
    """The fewest probes with which a sample of queries (`most`, by a hash of their ids) finds the share `target` of their true nearest.

    Their answers are taken exactly, and the lists that hold them are looked up: the share found with n probes is that of
    answers whose list is among the n nearest of its query.
    """
    own = sound(queries, id_col, vector).orderBy(F.xxhash64("id", "v")).limit(most).checkpoint()
    wanted = _answered(own, index.table.select("id", "v"), k)
    placed = wanted.join(index.table.select("id", "list").distinct(), "id").select("query_id", "list").toPandas()  # most * k rows
    asked = {r["id"]: np.array(r["v"]) for r in own.collect()}
    ranks = []
    for query, rows in placed.groupby("query_id"):
        order = np.argsort(-(unit(asked[query][None, :]) @ index.centroids.T)[0], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        ranks += place[rows["list"]].tolist()
    return int(np.quantile(ranks, target, method="higher")) if ranks else 1
