"""Evidence of JSON files read by several tasks each, in byte ranges.

Whether a byte stands inside a string, and how deep, hangs on all before it. Tasks sum up their ranges
for both cases (the range begins inside a string or outside): whether its quotes flip the case, and how much
deeper it ends. From these sums, a row a range, the state at each range's start follows, and tasks then find the records that
begin in theirs; one that goes on beyond it is read on to its end. Memory is a range and the longest record.

Files are read through pyarrow's file systems (local paths, hdfs, object stores); for other addresses there is readers.read_evidence().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.settings import SettingsError
from stepweave.sources.readers import RECORD, upgraded

SPLIT = 64 << 20
LISTS = ("samples", "evidence_records")  # the first that a file has holds its records
_QUOTE, _BACK = ord('"'), ord("\\")
_DEEPER = np.zeros(256, np.int64)
_DEEPER[[ord("{"), ord("[")]] = 1
_DEEPER[[ord("}"), ord("]")]] = -1


def open_file(path: str):
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes are quotes that open or close a string; before: how many backslashes stand directly before the data."""
    found = data == _QUOTE
    at = np.flatnonzero(found)
    last = np.maximum.accumulate(np.where(data != _BACK, np.arange(len(data)), -1)) if len(data) else np.zeros(0, np.int64)
    earlier = np.where(at > 0, last[at - 1], -1)
    run = np.where(at > 0, at - 1 - earlier, 0) + np.where(earlier < 0, before, 0)
    found[at[run % 2 == 1]] = False
    return found


def backslashes(file, at: int) -> int:
    """How many backslashes stand directly before a place."""
    n = 0
    while at > 0:
        size = min(64, at)
        piece = file.read_at(size, at - size)
        own = len(piece) - len(piece.rstrip(b"\\"))
        n += own
        if own < size:
            break
        at -= size
    return n


class Range:
    """Bytes lo to hi of a file and what of them is structure, given the state at lo."""

    def __init__(self, file, lo: int, hi: int, inside: int = 0, depth: int = 0):
        self.data = np.frombuffer(file.read_at(hi - lo, lo), np.uint8)
        marks = quotes(self.data, backslashes(file, lo))
        upto = np.cumsum(marks)
        self.inside = (inside + upto - marks) % 2 == 1
        self.flips = int(upto[-1]) % 2 if len(upto) else 0
        self.deltas = _DEEPER[self.data]
        self.depth_after = depth + np.cumsum(np.where(self.inside, 0, self.deltas))
        self.depth_before = self.depth_after - np.where(self.inside, 0, self.deltas)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, lo, hi in frame[["file", "lo", "hi"]].itertuples(index=False):
            with open_file(path) as file:
                own = Range(file, lo, hi)
                rows.append((path, lo, hi, own.flips, int(own.deltas[~own.inside].sum()), int(own.deltas[own.inside].sum()), *(_begin(file) if lo == 0 else ("", 0))))
        yield pd.DataFrame(rows, columns=["file", "lo", "hi", "flips", "outside", "inner", "first", "begin"])


def _begin(file) -> tuple[str, int]:
    """The first character that is no blank or byte order mark, and its place."""
    head = file.read_at(min(4096, file.size()), 0)
    own = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    return own[:1].decode("latin1"), len(head) - len(own)


def _lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the lists that may hold records begin, and (with an empty key) where lists of that depth end, of files that are one object."""
    for frame in frames:
        rows = []
        for path, lo, hi, inside, depth in frame[["file", "lo", "hi", "inside", "depth"]].itertuples(index=False):
            with open_file(path) as file:
                own = Range(file, lo, hi, inside, depth)
                for at in lo + np.flatnonzero((own.data == ord("[")) & ~own.inside & (own.depth_before == 1)):
                    back = min(int(at), 4096)
                    key = re.search(rb'"(\w+)"\s*:\s*$', file.read_at(back, int(at) - back))
                    if key and key[1].decode() in LISTS:
                        rows.append((path, key[1].decode(), int(at)))
                rows += [(path, "", lo + int(k)) for k in np.flatnonzero((own.data == ord("]")) & ~own.inside & (own.depth_after == 1))]
        yield pd.DataFrame(rows, columns=["file", "key", "at"])


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records that begin in each range: objects at depth `level` between the list's start and its end."""
    for frame in frames:
        for path, lo, hi, inside, depth, level, begin, end in frame[["file", "lo", "hi", "inside", "depth", "level", "begin", "end"]].itertuples(index=False):
            rows = []
            with open_file(path) as file:
                size, own = file.size(), Range(file, lo, hi, inside, depth)
                free = ~own.inside
                place = lo + np.arange(len(own.data))
                starts = np.flatnonzero((own.data == ord("{")) & free & (own.depth_before == level) & (place >= begin) & (place < end))
                ends = np.flatnonzero((own.data == ord("}")) & free & (own.depth_after == level))
                for start in starts:
                    k = int(np.searchsorted(ends, start))
                    if k < len(ends):
                        text = own.data[start : ends[k] + 1].tobytes()
                    else:
                        text = own.data[start:].tobytes() + rest(file, hi, size, own, level)
                    rows.append((path, lo + int(start), text.decode("utf-8")))
            yield pd.DataFrame(rows, columns=["file", "input_pos", "t"])


def rest(file, at: int, size: int, own: Range, level: int, step: int = 1 << 20) -> bytes:
    """What follows a range up to the end of the record that is open at its end."""
    inside = (int(own.inside[-1]) + int(quotes(own.data[-1:], backslashes(file, at - 1))[0])) % 2
    depth, out = int(own.depth_after[-1]), []
    while at < size:
        more = Range(file, at, min(at + step, size), inside, depth)
        ends = np.flatnonzero((more.data == ord("}")) & ~more.inside & (more.depth_after == level))
        if len(ends):
            return b"".join([*out, more.data[: ends[0] + 1].tobytes()])
        out.append(more.data.tobytes())
        inside, depth, at = (inside + more.flips) % 2, int(more.depth_after[-1]), at + len(more.data)
    raise ValueError("a record without an end")


def read_evidence_split(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """readers.read_evidence() for large files: the same records in the same order, input_pos being the place of a record's first byte.

    A file whose brackets or quotes do not close fails, and so does one of several records one after the other.
    """
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    cut = found.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("lo"), "size")
    chunks = cut.select("file", "lo", F.least(F.col("lo") + split, F.col("size")).alias("hi"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = chunks.repartition(parts, "file", "lo").mapInPandas(_sums, "file string, lo long, hi long, flips int, outside long, inner long, first string, begin long")
    rows, states, first = sums.orderBy("file", "lo").collect(), [], {}  # a row a range
    for k, r in enumerate(rows):
        if r["lo"] == 0:
            inside, depth = 0, 0
            first[r["file"]] = (r["first"], r["begin"])
        states.append((r["file"], r["lo"], r["hi"], inside, depth))
        depth += r["inner"] if inside else r["outside"]
        inside = (inside + r["flips"]) % 2
        if (k + 1 == len(rows) or rows[k + 1]["lo"] == 0) and (inside or depth):
            raise SettingsError(f"{r['file']}: brackets or quotes do not close")
    odd = [f for f, (c, _) in first.items() if c not in ("{", "[")]
    if odd:
        raise SettingsError(f"{odd[0]}: neither an object nor a list")
    placed = spark.createDataFrame(states, "file string, lo long, hi long, inside int, depth long").repartition(parts, "file", "lo")
    whole = [f for f, (c, _) in first.items() if c == "{"]
    lists: dict[str, dict[str, int]] = {}
    closed: dict[str, list[int]] = {}
    if whole:
        for r in placed.where(F.col("file").isin(whole)).mapInPandas(_lists, "file string, key string, at long").orderBy("at").collect():  # a few a file
            if r["key"]:
                lists.setdefault(r["file"], {}).setdefault(r["key"], r["at"])
            else:
                closed.setdefault(r["file"], []).append(r["at"])
    levels = []
    for f, (c, begin) in first.items():
        own = lists.get(f, {})
        key = next((k for k in LISTS if k in own), None)
        levels.append((f, 1, begin, 2**62) if c == "[" else (f, 2, own[key], min(x for x in closed[f] if x > own[key])) if key else (f, 0, 0, 2**62))
    known = spark.createDataFrame(levels, "file string, level int, begin long, end long")
    text = placed.join(F.broadcast(known), "file").repartition(parts, "file", "lo").mapInPandas(_records, "file string, input_pos long, t string")
    single = [f for f, level, *_ in levels if level == 0]
    if single:
        several = text.where(F.col("file").isin(single)).groupBy("file").count().where("count > 1").first()
        if several:
            raise SettingsError(f"several records in {several['file']}")
    return upgraded(text.select("file", "input_pos", F.from_json("t", RECORD).alias("r")).select("file", "input_pos", "r.*"))
