"""Token ids in files of bit or byte planes (operator 12).

Documents are dealt out by ranges of their id and sorted, so that shard after shard they are in
ascending order (rows without an id first). A task encodes its documents as they come and writes
one file, named after its attempt; a table of the files that tasks finished is written when all are
done, so a lost or repeated task leaves no file that anything reads. A shard's first id has its place
from sums of the shards before it.

File: MAGIC, blocks, index, and at the end the index's place, length and crc32 and MAGIC again. A block has up to
BLOCK_IDS values; these are transposed into planes, of all first bytes, all second bytes and so on
(``byte``) or of single bits (``bit``), no more planes than the largest value needs, and each plane
is compressed by itself with zstandard. There are blocks of token ids, of document ids and of
documents' lengths; the index has kind, place, count, crc32 and the sizes of the planes of each.

Encoding: the byte-level pre-tokenizer begins a new word at a single blank between two characters that
are no white space, between an ASCII letter and a mark other than an apostrophe, and around a single line end
between text and a letter. Texts are cut there and each distinct piece is encoded by the library once;
pieces are known by two 64-bit hashes and remembered, up to MEMO of them, by a worker process.

Edge cases: a null text is empty and gives the end id only; strings of special tokens in a text are ordinary
text unless `specials` is set; equal document ids are in order of their texts; repeated rows are written one by one; an empty
table gives no rows; columns other than the two named may have any name.
"""

from __future__ import annotations

import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.llm.shared import WordHasher, blocks, materialize, mix, scratch_dir

MAGIC, BLOCK_IDS, MEMO, TEXT_BLOCK, LEVEL = b"SWPLANE1", 1 << 16, 1_500_000, 2 << 20, 3
TOKENS, NAMES, LENGTHS, ABSENT = range(4)
ENTRY, TAIL = "<BBBxIQI", "<QQI"

# --- planes


def to_planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of unsigned values, lowest first; as many as the largest needs."""
    values = np.ascontiguousarray(values, "<u8")
    top = int(values.max()).bit_length() if len(values) else 0
    if not bits:
        return list(map(np.ndarray.tobytes, np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, : (top + 7) // 8].T)))
    return [np.packbits((values >> np.uint64(k)) & np.uint64(1) != 0).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    out = np.zeros(n, "<u8")
    for k, plane in enumerate(planes):
        if bits:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype("<u8") << np.uint64(k)
        else:
            out.view(np.uint8).reshape(-1, 8)[:, k] = np.frombuffer(plane, np.uint8)
    return out


# --- files


class PlaneWriter:
    """Writes blocks of three kinds to a stream; holds one unfinished block of each."""

    def __init__(self, stream, bits: bool = False):
        self.stream, self.bits, self.at, self.index = stream, bits, 0, []
        self.waiting: dict[int, list[np.ndarray]] = {TOKENS: [], NAMES: [], LENGTHS: [], ABSENT: []}
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, kind: int, values: np.ndarray) -> None:
        waiting = self.waiting[kind]
        waiting.append(values)
        if sum(map(len, waiting)) >= BLOCK_IDS:
            flat = np.concatenate(waiting)
            whole = len(flat) - len(flat) % BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(kind, flat[k : k + BLOCK_IDS])
            self.waiting[kind] = [flat[whole:]]

    def _block(self, kind: int, values: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(values, self.bits)]
        body = b"".join(packed)
        self.index.append(struct.pack(ENTRY, kind, self.bits, len(packed), len(values), self.at, zlib.crc32(body)) + struct.pack(f"<{len(packed)}I", *map(len, packed)))
        self._put(body)

    def close(self) -> None:
        for kind, waiting in self.waiting.items():
            if any(map(len, waiting)):
                self._block(kind, np.concatenate(waiting))
        place, index = self.at, b"".join(self.index)
        self._put(index)
        self._put(struct.pack(TAIL, place, len(index), zlib.crc32(index)) + MAGIC)


class PlaneReader:
    """Reads the blocks of one kind in order, each checked against its crc32."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < 2 * len(MAGIC) + struct.calcsize(TAIL):
            raise ValueError("not a file of planes")
        end = struct.calcsize(TAIL)
        tail = source.read_at(end + len(MAGIC), size - end - len(MAGIC))
        place, length, check = struct.unpack(TAIL, tail[:end])
        whole = tail[end:] == MAGIC and place + length + end + len(MAGIC) == size
        index = source.read_at(length, place) if whole else b""
        if not whole or zlib.crc32(index) != check:
            raise ValueError("not a file of planes, or cut short")
        self.entries, at = [], 0
        while at < length:
            kind, bits, planes, n, offset, crc = struct.unpack_from(ENTRY, index, at)
            at += struct.calcsize(ENTRY)
            self.entries.append((kind, bool(bits), n, offset, crc, struct.unpack_from(f"<{planes}I", index, at)))
            at += 4 * planes

    def blocks(self, kind: int) -> Iterator[np.ndarray]:
        unzip = zstandard.ZstdDecompressor()
        for own, bits, n, offset, crc, sizes in self.entries:
            if own == kind:
                body = self.source.read_at(sum(sizes), offset)
                if zlib.crc32(body) != crc:
                    raise ValueError(f"block at {offset} is damaged")
                ends = np.cumsum((0, *sizes))
                yield from_planes([unzip.decompress(body[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], n, bits)


# --- encoding


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of all ranges one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


#: Last bytes and first bytes of characters that are, or might be, white space beyond ASCII.
WHITE_LAST = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
WHITE_FIRST = [0xC2, 0xE1, 0xE2, 0xE3]


class Encoder:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library; remembers the ids of pieces."""

    def __init__(self, path: str, specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        size = self.tokenizer.get_vocab_size()
        # Every character of a byte-level token stands for one byte; special tokens for themselves.
        self.width = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(size)], np.int64)
        self.hasher, self.second = WordHasher(lower=False), np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
        last, first = np.ones(256, bool), np.ones(256, bool)
        last[[*range(33), 127, *WHITE_LAST]] = False
        first[[*range(33), 127, *WHITE_FIRST]] = False
        self.last, self.first = last, first
        self.letter, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
        self.mark[[*b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids to the memory; the place of the first."""
        at = self.used
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of new pieces. Inner ones begin with a blank that parts them from what stands before, so many are encoded as one text."""
        places, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        own = np.flatnonzero(~inner)
        for k, made in zip(own, self.tokenizer.encode_batch_fast([data[starts[k] : ends[k]].tobytes().decode() for k in own], add_special_tokens=False), strict=True):
            places[k], sizes[k] = self._keep(np.array(made.ids, np.uint32)), len(made.ids)
        many, lengths = np.flatnonzero(inner), (ends - starts)[inner]
        cuts = np.cumsum(lengths) // 32_768
        for part in np.split(many, np.flatnonzero(np.diff(cuts)) + 1) if len(many) else []:
            text = data[ranges(starts[part], ends[part] - starts[part])].tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            reached, wanted = np.cumsum(self.width[ids]), np.cumsum(ends[part] - starts[part])
            upto = np.searchsorted(reached, wanted, "left") + 1
            if (reached[np.minimum(upto, len(reached)) - 1] != wanted).any():  # a special token's text, or a tokenizer that joins pieces
                for k in part:
                    ids = np.array(self.tokenizer.encode(data[starts[k] : ends[k]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                    places[k], sizes[k] = self._keep(ids), len(ids)
                continue
            before = np.concatenate([[0], upto[:-1]])
            places[part], sizes[part] = self._keep(ids) + before, upto - before
        return places, sizes

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, one after the other, and how many each has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[1 : n - 1] = (data[1:-1] == 32) & self.last[data[:-2]] & self.first[data[2:]]
        safe = cut.copy()
        line = data == 10
        cut[1:n] |= (self.letter[data[:-1]] & self.mark[data[1:]]) | (self.last[data[:-1]] & line[1:])
        cut[2:n] |= self.last[data[:-2]] & line[1:-1] & self.letter[data[2:]]
        for edge in (offsets - 1, offsets):  # a blank at a text's edge has no neighbour in it
            edge = edge[(edge >= 0) & (edge < n)]
            safe[edge] = False
        cut[offsets] = True
        places = np.flatnonzero(cut)
        starts, ends = places[:-1], places[1:]
        hashes = self.hasher(data, starts, ends)
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        starts_, ends_ = starts[one], ends[one]
        sizes_ = ends_ - starts_
        # The second hash, of the distinct pieces only: a sum of codes times a polynomial of the place.
        where = ranges(starts_, sizes_)
        place = mix(ranges(np.zeros(len(sizes_), np.int64), sizes_).astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(where) + 1, np.uint64)
        np.cumsum(mix(self.second[data[where]] * place), out=sums[1:])
        bounds = np.concatenate([[0], np.cumsum(sizes_)])
        checks = sums[bounds[1:]] - sums[bounds[:-1]] + sizes_.astype(np.uint64)
        if len(self.keys) > MEMO or self.used > 16 * MEMO:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = (self.keys[at[inside]] == keys[inside]) & (self.checks[at[inside]] == checks[inside])
        found, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        found[known], size[known] = self.starts[at[known]], self.sizes[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            inner = safe[starts_[new]] & (safe[ends_[new]])
            found[new], size[new] = self._learn(data, starts_[new], ends_[new], inner)
            self.keys, self.checks = np.insert(self.keys, at[new], keys[new]), np.insert(self.checks, at[new], checks[new])
            self.starts, self.sizes = np.insert(self.starts, at[new], found[new]), np.insert(self.sizes, at[new], size[new])
        ids = self.flat[ranges(found[which], size[which])]
        total = np.concatenate([[0], np.cumsum(size[which])])
        ends_of = total[np.searchsorted(starts, offsets)]
        return ids, np.diff(ends_of)


def encoder(path: str, specials: bool) -> Encoder:
    """This worker process's encoder: tasks that follow each other in it share what it remembers.

    A task brings its own copy of this module, so the encoder is kept in one of the process's own.
    """
    kept = sys.modules.setdefault("_stepweave_encoders", types.ModuleType("_stepweave_encoders")).__dict__
    if (path, specials) not in kept:
        kept[path, specials] = Encoder(path, specials)
    return kept[path, specials]


# --- jobs

SHARD = "shard long, path string, n_docs long, n_ids long"


def _write_shard(folder: str, path: str, end: int, bits: bool, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, docs, total = encoder(path, specials), TaskContext.get().partitionId(), 0, 0
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{shard:06d}-{uuid.uuid4().hex}.planes"
        writer = None
        try:
            for batch in batches:
                names = batch.column(0)
                for a, b, data, offsets in blocks(batch.column(1), TEXT_BLOCK):
                    if writer is None:
                        stream = files.open_output_stream(f"{root}/{name}")
                        writer = PlaneWriter(stream, bits)
                    ids, counts = encode(data, offsets)
                    places = np.cumsum(counts + 1) - 1
                    whole = np.full(len(ids) + len(counts), end, np.uint32)
                    others = np.ones(len(whole), bool)
                    others[places] = False
                    whole[others] = ids
                    own = names.slice(a, b - a)
                    writer.add(TOKENS, whole)
                    writer.add(LENGTHS, (counts + 1).astype(np.uint64))
                    writer.add(ABSENT, np.asarray(own.is_null()).astype(np.uint64))
                    writer.add(NAMES, np.asarray(own.fill_null(0)).astype(np.int64).view(np.uint64))
                    docs, total = docs + b - a, total + len(whole)
            if writer:
                writer.close()
        finally:
            if writer:
                stream.close()
        if writer:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "n_docs": docs, "n_ids": total}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_ids(documents: DataFrame, folder: str, tokenizer: str, end: int = 0, bits: bool = False, specials: bool = False, shards: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts, each with `end` after it, as files of planes in folder; the table of files: shard, path, n_docs, n_ids, start.

    start is the number of ids in the shards before. folder must be one that all executors share, by
    a path or an address that pyarrow's file systems know. shards: the session's shuffle partitions, unless given.
    """
    spark = documents.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The further keys part rows of one id, be they a third of the table, among shards.
    dealt = docs.repartitionByRange(shards, F.asc_nulls_first("id"), F.xxhash64("text"), F.rand(12)).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"), "text")
    made = materialize(dealt.mapInArrow(_write_shard(folder, tokenizer, end, bits, specials), SHARD), "shards")
    # Two levels of sums, so that no task orders more than some thousand of millions of files.
    grouped = made.withColumn("group", F.floor(F.col("shard") / 1000).cast("long"))
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("ids")).select(F.col("group").alias("_group"), (F.sum("ids").over(Window.orderBy("group")) - F.col("ids")).alias("_start"))
    within = F.sum("n_ids").over(Window.partitionBy("group").orderBy("shard")) - F.col("n_ids")
    return grouped.withColumn("_own", within).join(groups, F.col("group") == F.col("_group")).select("shard", "path", "n_docs", "n_ids", (F.col("_own") + F.col("_start")).alias("start"))


READ = "id long, start long, n_tokens long, ids_crc32 long"


def documents_of(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, its ids) in the file's order; a document's blocks are joined as they come."""
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as source:
        reader = PlaneReader(source)
        parts, rest = reader.blocks(TOKENS), np.zeros(0, "<u8")
        for names, sizes, absent in zip(reader.blocks(NAMES), reader.blocks(LENGTHS), reader.blocks(ABSENT), strict=True):
            for own, size, none in zip(names.view(np.int64).tolist(), sizes.tolist(), absent.tolist(), strict=True):
                pieces, have = [rest], len(rest)
                while have < size:
                    pieces.append(next(parts))
                    have += len(pieces[-1])
                flat = np.concatenate(pieces) if len(pieces) > 1 else rest
                rest = flat[size:]
                yield None if none else own, flat[:size].astype("<u4")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows):
        kinds = ("id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=list(kinds))

    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for own, ids in documents_of(path):
                rows.append((own, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)


def read_ids(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the table of files: id_col, start, n_tokens and ids_crc32 of each document, as read back from the files."""
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards.select("path", "start").repartition(n)
    return dealt.mapInArrow(_read_shards, READ).withColumnRenamed("id", id_col)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch_dir(spark)}/stepweave-ids/{uuid.uuid4().hex}"
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json")))
