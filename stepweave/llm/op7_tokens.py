"""Token counts of a unigram tokenizer without its tokens (operator 7).

An Aho-Corasick automaton over the vocabulary lists, at each character of a word, the pieces that
end there, longest first. Dynamic programming carries, to each character, the best score, the
number of pieces of the best path and whether it ends in an unknown run; no path is kept. Tie
rules are the tokenizer's: a path replaces another only if its score is greater, paths being
tried from the earliest start on, an unknown character scores 10 below the lowest piece and is
tried where no piece of that length exists, and neighbouring unknowns are one token. Words are
cut at the word mark before this, as the tokenizer does, so equal words have equal counts, and
counts are remembered for up to MEMO words of LONG characters at most a task; longer ones are counted
anew each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, MEMO, LONG, FOLDER = "▁", 400_000, 64, "/opt/tokenizers"


def load_vocabulary(path: str = f"{FOLDER}/piece_bpe_32k.model") -> list[tuple[str, float]]:
    """(piece, score) of a public vocabulary file, read on the driver: bounded by the file.

    The pieces are ordered by merge rank, which is no log probability: piece r of n scores as
    under Zipf's law, -log((r + 1) * (log(n) + 0.5772)). Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    total = math.log(max(2, len(pieces))) + 0.5772
    return [(p, -math.log((r + 1) * total)) for r, p in enumerate(pieces)]


class Counter(dict):
    """Word to its token count; a missing word is counted, and the memory emptied beyond MEMO words."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        self.empty = not vocabulary

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            return self.viterbi(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = n = self.viterbi(word)
        return n

    def viterbi(self, word: str) -> int:
        size = len(word)
        if not size:
            return 0
        if self.empty:
            return 1
        best, count, loose = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for end, (length, score) in self.automaton.iter(word):
            ends[end + 1].append((length, score))
        unknown = self.unknown
        for end in range(1, size + 1):
            top = None
            single = False
            for length, score in ends[end]:  # longest first: earliest start first
                value = score + best[end - length]
                single = single or length == 1
                if top is None or value > top:
                    top, start = value, end - length
                    fresh = True
            if not single:
                value = unknown + best[end - 1]
                if top is None or value > top:
                    top, start, fresh = value, end - 1, False
            best[end] = top
            if fresh:
                count[end], loose[end] = count[start] + 1, False
            else:
                count[end], loose[end] = count[start] + (not loose[start]), True
        return count[size]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text: blanks become word marks, each begins a word, and the first word gets one."""
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        return sum(map(self.__getitem__, [MARK + w for w in text.split(MARK)[1:]]))


def _counter(vocabulary: list[tuple[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            counts = [counter.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_tokens: a row per document.

    A null or empty text has 0 tokens; an empty table gives no rows; repeated
    rows are counted one by one; an empty vocabulary makes every word one unknown token. Columns other than these two may have any name.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return docs.mapInArrow(_counter(vocabulary), "id long, n_tokens long").withColumnRenamed("id", id_col)


def op7_tokens(spark, sf_dir: str, vocabulary: str = f"{FOLDER}/piece_bpe_32k.model") -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_vocabulary(vocabulary))
