"""What the operators share: scratch tables and vectorised word hashing.

A word is a run of code points outside ``\\x20`` and ``\\x09-\\x0D``. All of these are single
bytes in UTF-8, so words are cut and hashed on the bytes of an Arrow buffer, with no Python
string per word. Work is done in blocks of about ``BLOCK`` bytes (one text at least), which
bounds a worker's memory by the block and the longest text.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; without one a local session gets a temporary folder, and a cluster an error.

    On a cluster every executor would write to a disk of its own, and what others wrote would be missing.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="stepweave-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


class _Made(threading.local):
    """Tables made by materialize() in this thread and not yet released."""

    def __init__(self):
        self.tables: list[tuple[DataFrame, str]] = []


_made = _Made()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stepweave-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _made.tables.append((back, path))
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more; others are left alone."""
    for df in tables:
        for path in [p for x, p in _made.tables if x is df]:
            delete(df.sparkSession, path)
        _made.tables = [(x, p) for x, p in _made.tables if x is not df]


def mark() -> int:
    """How many tables of this thread there are now, for tables_since()."""
    return len(_made.tables)


def tables_since(at: int) -> list[DataFrame]:
    """The tables made since a mark() and not released: a result of this time may read them until it is written."""
    return [x for x, _ in _made.tables[at:]]


def release_all() -> None:
    """Delete all tables that this thread's operators have made, once their results are written."""
    release(*tables_since(0))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a block at once, from prefix sums of a polynomial modulo 2**64.

    Equal words have equal hashes; two different ones of n agree with a chance of about n * n / 2**65.
    """

    BASE, COMBINE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95

    def __init__(self, lower: bool = True):
        codes = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            codes[65:91] = codes[97:123]
        self.codes, self.space = codes, np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.zeros(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(self.BASE, -1, 2**64)
            n = max(n, BLOCK + 4096)
            self.up = np.multiply.accumulate(np.full(n, self.BASE, np.uint64))
            self.down = np.multiply.accumulate(np.full(n, inverse, np.uint64))

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each row (and the end) the index of its first word."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        inside = np.zeros(n + 2, bool)
        np.logical_not(self.space[data], out=inside[1:-1])
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])

    def shingles(self, words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of `size` words in order, and for each row (and the end) the index of its first.

        A row with fewer words, but one at least, has its whole sequence as its only shingle.
        """
        n, counts = len(words), np.diff(first)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
        padded, total = np.concatenate([words, np.zeros(size, np.uint64)]), np.zeros(n, np.uint64)
        for k in range(size):
            total = total * np.uint64(self.COMBINE) + padded[k : k + n]
        row = np.repeat(np.arange(len(counts)), counts)
        keep = np.arange(n) - first[row] + size <= counts[row]
        short = np.flatnonzero((counts > 0) & (counts < size))
        for r in short:
            own = np.uint64(counts[r])
            for w in words[first[r] : first[r + 1]]:
                own = np.uint64((int(own) * self.COMBINE + int(w)) & (2**64 - 1))
            total[first[r]], keep[first[r]] = own, True
        made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        return mix(total[keep]), np.concatenate([[0], np.cumsum(made)])
