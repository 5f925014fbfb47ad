"""Language identification by cross-parsing entropy (operator 3).

Labelled text of each language is turned into a suffix automaton. A text is parsed against it
into phrases, each the longest string that occurs in the language's text; phrases times the log
of that text's length, over the characters, is the cross-parsing entropy, and the language with
the least wins. Characters are lower-cased letters; all others count as a blank.

All blocks of 256 characters of a batch are parsed side by side, for all languages, by table
look-ups: each text is read whole, and a phrase ends where its block ends.

Every letter of the samples has a symbol of its own, whatever its code point: the NARROW most frequent
ones one symbol each, all others two, a first and a second one, so that tables stay narrow for
scripts of thousands of letters. A letter in no sample is one symbol that begins a phrase everywhere.

Fitted on a bounded sample: per language at most ROWS labelled documents, in the order of a hash
of the id, the first CHARS characters of each, as long as all fit into CHARS characters.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.shared import blocks

ROWS, CHARS, LANE, NARROW = 64, 24_000, 256, 96


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % by


def labelled_sample(documents: DataFrame, id_col: str, text: str, lang: str, rows: int = ROWS, chars: int = CHARS) -> dict[str, str]:
    """Language to its text, joined with blanks; at most rows * chars characters a language reach the driver.

    A row of an id and language stands for all of them, the one of the smallest text.
    """
    usable = documents.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & (F.char_length(text) > 0))
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.substring(text, 1, chars).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = [r[0] for r in usable.select("id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= rows).select("id").distinct().collect()]
    chosen = usable.where(F.col("id").isin(ids)).groupBy("lang", "id").agg(F.min("text").alias("text"))
    out: dict[str, str] = {}
    for name, body in chosen.orderBy("lang", F.xxhash64("id"), "id").select("lang", "text").collect() if ids else []:
        held = out.get(name, "")
        if len(held) + len(body) < chars:
            out[name] = f"{held} {body}" if held else body
        elif not held:
            out[name] = body
    return dict(sorted(out.items()))


class Parser:
    """Suffix automata of all languages in one table: entry (state, symbol) holds twice the next state's row, plus 1 where a phrase begins."""

    def __init__(self, texts: dict[str, str], narrow: int = NARROW):
        self.languages = list(texts)
        counts = Counter(c for t in texts.values() for x in t if x.isalpha() for c in x.lower()[:1])
        ranked = sorted(counts, key=lambda c: (-counts[c], c))
        single, wide = ranked[:narrow], ranked[narrow:]
        base = max(1, math.isqrt(max(0, len(wide) - 1)) + 1)
        #: 0: a letter in no sample; 1: any other character; 2: after a text's end; then single letters, first and second symbols.
        symbol = {c: (k + 3, 0) for k, c in enumerate(single)}
        symbol |= {c: (3 + len(single) + k // base, 3 + len(single) + base + k % base) for k, c in enumerate(wide)}
        self.width = 3 + len(single) + (2 * base if wide else 0)
        self.known, self.cases = symbol, {}
        tables, self.roots, self.logs, at = [], [], [], 0
        reads = [self.read(t)[0] for t in texts.values()]
        moves = [self.automaton(r) for r in reads]
        # Entries are twice an index, plus 1: beyond 31 bits of those the table needs wider numbers.
        self.kind = np.int32 if 2 * self.width * (sum(map(len, moves)) + 1) < 2**31 else np.int64
        for read, own in zip(reads, moves, strict=True):
            tables.append(self.table(own, at))
            self.roots.append(at * self.width)
            self.logs.append(np.log2(max(2, len(read))))
            at += len(own)
        self.entries = np.concatenate(tables).ravel() if tables else np.zeros(0, self.kind)

    def look_up(self, code: int) -> tuple[int, int, bool]:
        """First symbol, second symbol (0: none) and whether it is a letter, of a code point."""
        if code not in self.cases:
            c = chr(code)
            self.cases[code] = (*self.known.get(c.lower()[:1], (0, 0)), True) if c.isalpha() else (1, 0, False)
        return self.cases[code]

    def read(self, text: str) -> tuple[np.ndarray, bool]:
        """A text's symbols, and whether it has a letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), False
        top = int(codes.max()) + 1
        if top <= 0x3000:  # a table of code points is quicker than sorting them
            seen = np.flatnonzero(np.bincount(codes, minlength=top))
            at = np.zeros(top, np.int64)
            at[seen] = np.arange(len(seen))
            where = at[codes]
        else:
            seen, where = np.unique(codes, return_inverse=True)
        first, second, letter = (np.array(x) for x in zip(*(self.look_up(int(c)) for c in seen), strict=True))
        if not second.any():
            return first.astype(np.int32)[where], bool(letter.any())
        both = np.stack([first[where], second[where]], 1).ravel()
        return both[both.astype(bool) | (np.arange(len(both)) % 2 == 0)].astype(np.int32), bool(letter.any())

    @staticmethod
    def automaton(read: np.ndarray) -> list[dict[int, int]]:
        """Transitions of the suffix automaton, state 0 the start."""
        moves, link, length, last = [{}], [-1], [0], 0
        for c in read.tolist():
            here = len(moves)
            moves.append({}), length.append(length[last] + 1), link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = here
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[here] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q])), length.append(length[p] + 1), link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[here] = copy
            last = here
        return moves

    def table(self, moves: list[dict[int, int]], base: int) -> np.ndarray:
        begin = np.full(self.width, base, np.int64)
        for c, to in moves[0].items():
            begin[c] = base + to
        out = np.tile(begin * self.width * 2 + 1, (len(moves), 1))
        for s, own in enumerate(moves[1:], 1):
            for c, to in own.items():
                out[s, c] = (base + to) * self.width * 2
        out[:, 2] = (base + np.arange(len(moves))) * self.width * 2
        return out.astype(self.kind)

    def phrases(self, reads: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        lanes = [max(1, -(-len(r) // LANE)) for r in reads]
        padded = np.full(sum(lanes) * LANE, 2, np.int32)
        at = np.concatenate([[0], np.cumsum(lanes)])
        for k, r in enumerate(reads):
            padded[at[k] * LANE : at[k] * LANE + len(r)] = r
        columns = np.ascontiguousarray(padded.reshape(-1, LANE).T)
        state = np.repeat(np.array(self.roots, self.kind)[:, None], columns.shape[1], 1)
        count = np.zeros(state.shape, self.kind)
        for column in columns:
            state += column
            state = self.entries[state]
            count += state & 1
            state >>= 1
        return np.add.reduceat(count, at[:-1], 1).T

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; `und` and 0 without a letter. Equal entropies go to the first language by code point."""
        reads, known = zip(*map(self.read, texts), strict=True)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        entropy = self.phrases(list(reads)) * np.array(self.logs)
        best = entropy.argmin(1)
        least = np.sort(entropy, 1)
        score = least[:, 1] / np.maximum(least[:, 0] + least[:, 1], 1e-9) if len(self.languages) > 1 else np.ones(len(texts))
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]


def _judge(texts: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(texts)
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in blocks(batch.column(2)):
                raw = data.tobytes()
                own = parser.judge([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                names += own[0]
                scores += own[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(documents: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """id_col, held_out, lang_pred, score: a row per document.

    Learns from documents outside the held-out fold whose label is not null. score is the second
    entropy's share of the best two: 0.5 for a tie, 1 for a perfect parse. Null texts and texts
    without a letter are `und` with score 0; so is all without any labelled text. Languages of equal
    entropy: the first by code point. Repeated rows are judged one by one; an empty table gives no rows.
    Only the three named columns are read, so others may have any name.
    """
    fold = remainder(F.col(id_col), folds)
    texts = labelled_sample(documents.where(fold != 0), id_col, text, lang)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), (fold == 0).alias("held_out"), F.col(text).alias("text"))
    return docs.mapInArrow(_judge(texts), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language(spark, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
