r"""Language-model scores from causal self-attention over subword ids (operator 10).

Tokens are the lower-cased words of a text and one end. A word, with the blank before it, is spelled
by the subwords of a public byte-pair vocabulary (its first RANKS ones, a parameter), the longest
that fits at each place: its whole sequence of ids, whatever the word. The model scores it whole,

    log P(text) = sum over tokens of log P(first id | words before) + log P(word | first id)

The first part is a one-layer causal self-attention model, trained in numpy: a word goes in as the
mean of its ids' embeddings, and the first id of the next one comes out, by a class of ids in byte
order and a member of the class. The second is the word's share of all training words of that first
id, discounted by DISCOUNT a distinct word; what that leaves goes to the chain of the word's other
ids and its stop, each given the one before it, so a word never seen has a probability as any other.
unigram_score is the same without context: first ids by their share.

Long texts are read in windows of WINDOW words that overlap by WINDOW - STRIDE: a window scores
only words that no earlier one has scored, so each token is scored once with at least that much
context. All windows of a block of texts go through one batched, masked attention.

Word counts cover all training documents and are made and joined as distributed tables, keyed by
a 64-bit hash. Words above a count that at most HEAD of them reach (2 MB) travel with the model;
all other words of a text are looked up by a join.

The chain counts the ids of all training words, in the same pass as the words, and the model learns
from all training documents: each is a target once, in the round that its key falls to. A round's
documents are dealt to shards of about SHARD documents, or SHARD_WORDS words where that makes more
shards; each shard takes steps of its own from the same weights, which are then averaged by their
numbers of windows, ROUNDS times. Only where all documents are so few that a shard would take less
than STEPS steps, it reads its own several times.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.op3_language import remainder
from stepweave.llm.shared import WordHasher, blocks, materialize

FOLDER, RANKS, STRETCH = "/opt/tokenizers", 2048, 64
WIDTH, WINDOW, STRIDE, HEAD, TRUST, DISCOUNT = 16, 32, 24, 100_000, 10.0, 0.75
SHARD, SHARD_WORDS, ROUNDS, STEPS, BATCH = 2000, 1 << 20, 2, 60, 256
SCALE = WIDTH**-0.5
#: Bytes whose words are hashed side by side, and words that are spelled and scored so.
PIECE, SIDE = 1 << 18, 1 << 19
#: Windows that are read side by side, few enough to stay in the cache; a batch is the sum of its parts.
BATCH_PART = 128


def load_ranks(path: str = f"{FOLDER}/byte_bpe_multi_50k.tiktoken", ranks: int = RANKS) -> list[bytes]:
    """The first `ranks` subwords of a public byte-pair vocabulary, by rank, read on the driver; the bytes come first."""
    with open(path, "rb") as lines:
        table = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [table[k] for k in range(ranks)]


class Speller:
    """Words to subword ids, all words of a block side by side, by a table of the subwords' prefixes.

    No subword crosses a multiple of STRETCH bytes of a word, which bounds the steps for long words.
    """

    def __init__(self, ranks: list[bytes]):
        self.size, self.hasher = len(ranks), WordHasher()
        self.lower_table = bytes(k + 32 if 65 <= k < 91 else k for k in range(256))
        prefixes = {b"": 0}
        for piece in ranks:
            for k in range(1, len(piece) + 1):
                prefixes.setdefault(piece[:k], len(prefixes))
        #: Prefix and next byte to the longer prefix, 0 for none; prefix to the id it is, -1 for none.
        self.longer, self.id_of = np.zeros((len(prefixes), 256), np.int64), np.full(len(prefixes), -1, np.int32)
        for prefix, k in prefixes.items():
            if prefix:
                self.longer[prefixes[prefix[:-1]], prefix[-1]] = k
        for k, piece in enumerate(ranks):
            self.id_of[prefixes[piece]] = k
        self.blank = int(self.longer[0, 32])
        # Ids that can begin a word, in byte order, then the end of a text.
        self.begins = sorted((k for k, p in enumerate(ranks) if p[:1] == b" "), key=lambda k: ranks[k])
        self.first = np.full(self.size + 1, -1, np.int32)
        self.first[self.begins] = np.arange(len(self.begins))
        self.first[self.size] = self.end = len(self.begins)
        self.classes = self.members = int(np.ceil(np.sqrt(self.end + 1)))

    def lower(self, data: np.ndarray) -> np.ndarray:
        return np.frombuffer(data.tobytes().translate(self.lower_table), np.uint8)

    def longest(self, data: np.ndarray, at: np.ndarray, to: np.ndarray, prefix: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest subword from each place of lower-case bytes on, and where it ends; prefix and ids: what is read before that place."""
        end, table = at.copy(), self.longer.ravel()
        rows = np.flatnonzero(at < to)
        place, left, prefix = at.take(rows), (to - at).take(rows), prefix.take(rows)
        while len(rows):
            prefix = table.take(prefix * 256 + data.take(place))
            some = np.flatnonzero(prefix)
            rows, place, left, prefix = rows.take(some), place.take(some) + 1, left.take(some) - 1, prefix.take(some)
            found = self.id_of.take(prefix)
            some = np.flatnonzero(found >= 0)
            own = rows.take(some)
            ids[own], end[own] = found.take(some), place.take(some)
            some = np.flatnonzero(left)
            if len(some) < len(rows):
                rows, place, left, prefix = rows.take(some), place.take(some), left.take(some), prefix.take(some)
        return ids, end

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of all words of a block, and each text's first."""
        starts, ends, first = self.hasher.bounds(data, offsets)
        return self.hasher(data, starts, ends), starts, ends, first

    def first_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first subword of each word; the blank before a word is its first byte."""
        to = np.minimum(ends, starts + STRETCH)
        return self.longest(self.lower(data), starts, to, np.full(len(starts), self.blank), np.full(len(starts), self.id_of[self.blank]))[0]

    def spell(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        data = self.lower(data)
        parts = -(-(ends - starts) // STRETCH)
        word = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = starts[word] + nth * STRETCH
        to = np.minimum(at + STRETCH, ends[word])
        prefix = np.where(nth == 0, self.blank, 0)
        ids = np.where(nth == 0, self.id_of[self.blank], -1)
        rows, rounds, counts = np.arange(len(word)), [], np.zeros(len(word), np.int64)
        while len(rows):
            found, end = self.longest(data, at, to, prefix, ids)
            rounds.append((rows, found))
            counts[rows] += 1
            more = end < to
            rows, at, to = rows[more], end[more], to[more]
            prefix, ids = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for k, (rows, found) in enumerate(rounds):
            out[begin[rows] + k] = found
        return out, np.bincount(word, counts, len(starts)).astype(np.int64)


def means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray, most: int = 16) -> np.ndarray:
    """The mean of the table's rows at each word's ids: the words' first ids at once, then their second ones, ...; what words have beyond `most` is summed by segments."""
    begin, short = np.cumsum(counts) - counts, np.minimum(counts, most + 1).astype(np.int16)
    order = np.argsort(-short, kind="stable")
    at, reach = begin[order], np.bincount(short, minlength=most + 2)
    reach = len(counts) - np.cumsum(reach)  # How many words have more ids than k.
    total = table.take(ids[at], axis=0) if len(ids) else np.zeros((0, table.shape[1]), table.dtype)
    for k in range(1, most):
        if not reach[k]:
            break
        total[: reach[k]] += table.take(ids[at[: reach[k]] + k], axis=0)
    for r in range(reach[most]):
        word = order[r]
        total[r] += table[ids[begin[word] + most : begin[word] + counts[word]]].sum(0)
    out = np.empty_like(total)
    out[order] = total
    out /= counts[:, None].astype(table.dtype)
    return out


class Chain:
    """P(next id | id) inside words, from counts keyed id * (size + 1) + next; size stands for the stop."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, size: int, trust: float = TRUST):
        table = np.zeros(size * (size + 1))
        table[keys] = counts
        table = table.reshape(size, size + 1)
        overall = table.sum(0) + 1
        self.size = size
        self.logs = np.log((table + trust * overall / overall.sum()) / (table.sum(1, keepdims=True) + trust)).astype(np.float32)

    def rest(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(all ids of each word but its first, and the stop | its first)."""
        if not len(counts):
            return np.zeros(0)
        return np.exp(np.add.reduceat(self.logs[ids, follows(ids, counts, self.size)].astype(np.float64), np.cumsum(counts) - counts))


def follows(ids: np.ndarray, counts: np.ndarray, stop: int) -> np.ndarray:
    """The id after each id, the stop after the last of a word."""
    out = np.append(ids[1:], 0).astype(np.int64)
    out[np.cumsum(counts) - 1] = stop
    return out


class Shares:
    """P(word | first id) from all training words: n and v of each first id are its words and distinct words, the end's included."""

    def __init__(self, n: np.ndarray, v: np.ndarray):
        self.n, self.left = n, np.where(n > 0, DISCOUNT * v / np.maximum(n, 1), 1.0)

    def logs(self, first: np.ndarray, count: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log of each word's share; count: of the word, rest: the chain's probability."""
        return np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(self.n[first], 1) + self.left[first] * rest)

    def first_logs(self) -> np.ndarray:
        """Log of the share of each first id in all tokens."""
        return np.log((self.n + 1) / (self.n.sum() + len(self.n)))


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each row's exponentials, which are written over z, and its log; a row's largest value is taken off first where some value is far from 0."""
    top = z.max(1, keepdims=True) if z.size and (z.max() > 60 or z.min() < -60) else np.zeros((1, 1), z.dtype)
    if top.any():
        z -= top
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return total, np.log(total) + top[:, 0]


def softmax(z: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """The softmax of each row times the weight, written over z."""
    z *= (z.dtype.type(weight) / exponentials(z)[0])[:, None]
    return z


class Attention:
    """x = mean E[ids] + P[place]; h = x + softmax(x Wq (x Wk)' / sqrt(d), causal) x Wv Wo; class: softmax(h U + b); member: softmax(h M[class] + m[class])."""

    NAMES = ("E", "P", "Wq", "Wk", "Wv", "Wo", "U", "b", "M", "m")

    def __init__(self, size: int, classes: int, members: int, begins: np.ndarray, seed: int = 10):
        """begins: counts of the ids that begin a word, which the biases start from."""
        r, d = np.random.default_rng(seed), WIDTH
        self.classes, self.members = classes, members
        shapes = {"E": (size + 1, d), "P": (WINDOW, d), "Wq": (d, d), "Wk": (d, d), "Wv": (d, d), "Wo": (d, d), "U": (d, classes), "M": (classes, d, members)}
        scale = {"E": 0.3, "P": 0.1, "U": 0.1, "M": 0.1}
        self.w = {n: r.normal(0, scale.get(n, d**-0.5), s).astype(np.float32) for n, s in shapes.items()}
        counts = np.full(classes * members, 1e-9)
        counts[: len(begins)] = begins + 0.5
        counts = counts.reshape(classes, members)
        self.w["b"] = np.log(counts.sum(1) / counts.sum()).astype(np.float32)
        self.w["m"] = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.before = (self.mask == 0).astype(np.float32)

    def powers(self, q: np.ndarray, k: np.ndarray, skip: int = 0) -> np.ndarray:
        """Each row's weights before they are divided by their sum; q: scaled by SCALE, of a window's places from `skip` on."""
        s = q @ k.transpose(0, 2, 1)
        if s.size and max(s.max(), -s.min()) > 60:
            s += self.mask[skip:]
            s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s *= self.before[skip:]
        return s

    def attend(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        s = self.powers(q * q.dtype.type(SCALE), k)
        return s / s.sum(-1, keepdims=True)

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The rows of the targets in the order of their classes, their members in that order, and each class with its first and end there."""
        of_class = y // self.members
        order = np.argsort(of_class.astype(np.int16), kind="stable")
        bounds = np.searchsorted(of_class[order], np.arange(self.classes + 1))
        return order, y[order] % self.members, [(int(c), int(bounds[c]), int(bounds[c + 1])) for c in np.flatnonzero(np.diff(bounds))]

    def with_biases(self) -> tuple[np.ndarray, np.ndarray]:
        """U over b and each class's M over its m, for rows of h that end in a 1."""
        return np.concatenate([self.w["U"], self.w["b"][None]]), np.concatenate([self.w["M"], self.w["m"][:, None]], 1)

    def member_logits(self, h: np.ndarray, table: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """What the members of each row's class get; rows in the order of their classes, table: as with_biases() gives it."""
        z = np.empty((len(h), self.members), h.dtype)
        for c, a, b in spans:
            np.matmul(h[a:b], table[c], out=z[a:b])
        return z

    def head(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(y | h) of each row."""
        order, member, spans = self.by_class(y)
        rows, h, (to_class, to_member) = np.arange(len(y)), ones_after(h, order), self.with_biases()
        z, out = h @ to_class, np.zeros(len(y), h.dtype)
        own = z[rows, y[order] // self.members] - exponentials(z)[1]
        z = self.member_logits(h, to_member, spans)
        out[order] = own + z[rows, member] - exponentials(z)[1]
        return out

    def train(self, ids: np.ndarray, counts: np.ndarray, words: np.ndarray, targets: np.ndarray, texts: np.ndarray, epochs: int = 1, batch: int = BATCH, rate: float = 8e-3, seed: int = 11) -> Attention:
        """Adam on texts in windows side by side, so that each word is a target once an epoch.

        Distinct word k has counts[k] of the ids and the first id targets[k]; text t is words[texts[t] : texts[t + 1]].
        """
        where, real = windows_of(np.diff(texts) - 1, texts[:-1], WINDOW)
        if not len(where):
            return self
        x, y = words[np.where(real, where, 0)], np.where(real, targets[words[np.where(real, where + 1, 0)]], -1)
        starts = np.cumsum(counts) - counts
        r, step, flat = np.random.default_rng(seed), 0, flat_weights(self.w)
        m, v, at = np.zeros_like(flat), np.zeros_like(flat), 0
        for name in self.NAMES:
            shape = self.w[name].shape
            self.w[name] = flat[at : at + self.w[name].size].reshape(shape)
            at += self.w[name].size
        total = epochs * (-(-len(x) // batch))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(order), batch):
                step += 1
                some = order[at : at + batch]
                g, learned = np.zeros_like(flat), max(1, np.count_nonzero(y[some] >= 0))
                for part in (some[k : k + BATCH_PART] for k in range(0, len(some), BATCH_PART)):
                    own = x[part].ravel()
                    n = counts[own]
                    slopes = self.slopes(ids[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n, y[part])
                    g += flat_weights(slopes) * flat.dtype.type(np.count_nonzero(y[part] >= 0) / learned)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                now = rate * (1 - step / (total + 1)) / (1 - 0.9**step)
                flat -= now * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def slopes(self, flat: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss per word; flat: the ids of all words, n: of each word; a target of -1 counts for nothing."""
        w, flat2, d = self.w, lambda t: t.reshape(-1, t.shape[-1]), WIDTH
        e = means(w["E"], flat, n).reshape(*y.shape, d) + w["P"]
        scale = e.dtype.type(SCALE)
        to_all = np.concatenate([w["Wq"] * scale, w["Wk"], w["Wv"]], 1)
        # Queries, keys, and values with a 1, which sums up the weights.
        both = np.ones((*y.shape, 3 * d + 1), e.dtype)
        np.matmul(flat2(e), to_all, out=flat2(both)[:, :-1])
        q, k, v = both[:, :, :d], both[:, :, d : 2 * d], both[:, :, 2 * d :]
        s = self.powers(q, k)
        c = s @ v
        share = 1 / c[:, :, d:]
        c = c[:, :, :d] * share
        h = flat2(e) + flat2(c) @ w["Wo"]
        real = np.flatnonzero(y.ravel() >= 0)
        order, member, spans = self.by_class(y.ravel()[real])
        real = real[order]
        held, (to_class, to_member) = ones_after(h, real), self.with_biases()
        p = loss_slopes(held @ to_class, y.ravel()[real] // self.members)
        by_class, by_member = across(held, p), np.zeros_like(to_member)
        dheld = p @ w["U"].T
        p = loss_slopes(self.member_logits(held, to_member, spans), member)
        for of, first, end in spans:
            np.matmul(held[first:end].T, p[first:end], out=by_member[of])
            dheld[first:end] += p[first:end] @ w["M"][of].T
        g = {"U": by_class[:d], "b": by_class[d], "M": by_member[:, :d], "m": by_member[:, d]}
        dh = np.zeros_like(h)
        dh[real] = dheld
        g["Wo"] = across(flat2(c), dh)
        # A row's slopes weighed by its attention come to the product of its output and that output's slope.
        dv = np.empty((*y.shape, d + 1), h.dtype)
        dc = dv[:, :, :d]
        np.matmul(dh, w["Wo"].T, out=flat2(dv)[:, :d])
        dc *= share
        dv[:, :, d] = (flat2(dc * c) @ np.full(d, -1, h.dtype)).reshape(y.shape)
        ds = dv @ np.ascontiguousarray(v.transpose(0, 2, 1))
        ds *= s
        dall = np.empty((*y.shape, 3 * d), h.dtype)
        np.matmul(ds, k, out=dall[:, :, :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=dall[:, :, d : 2 * d])
        np.matmul(s.transpose(0, 2, 1), dc, out=dall[:, :, 2 * d :])
        g |= zip(("Wq", "Wk", "Wv"), np.split(across(flat2(e), flat2(dall)), 3, 1), strict=True)
        g["Wq"] = g["Wq"] * scale
        de = dh + flat2(dall) @ to_all.T
        g["P"] = de.reshape(e.shape).sum(0)
        de /= n[:, None].astype(h.dtype)
        g["E"] = sums_by(flat, de, np.repeat(np.arange(len(n)), n), len(w["E"]))
        return g


def sums_by(key: np.ndarray, table: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """For each key below size the sum of its rows of the table, which are laid side by side."""
    order = np.argsort(key.astype(np.int16 if size < 1 << 15 else np.int64), kind="stable")
    many = np.bincount(key, minlength=size)
    some = np.flatnonzero(many)
    out = np.zeros((size, table.shape[1]), table.dtype)
    if len(some):
        out[some] = np.add.reduceat(table.take(rows.take(order), axis=0), (np.cumsum(many) - many)[some], axis=0)
    return out


def across(a: np.ndarray, b: np.ndarray, some: int = 256) -> np.ndarray:
    """a' b, summed over `some` rows at a time, which stay in the cache."""
    whole = len(a) // some * some
    parts = a[:whole].reshape(-1, some, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, some, b.shape[1])
    return parts.sum(0) + a[whole:].T @ b[whole:]


def ones_after(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of h with a 1 after each."""
    out = np.ones((len(rows), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h.take(rows, axis=0)
    return out


def loss_slopes(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The slopes of the mean over the rows of -log softmax(z)[target], written over z."""
    weight = z.dtype.type(1 / max(1, len(z)))
    softmax(z, weight)
    z[np.arange(len(z)), target] -= weight
    return z


def windows_of(inputs: np.ndarray, begin: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows' words, texts of `inputs` words that are read beginning at `begin`, and which of these there are."""
    text, nth = windows_by_text(inputs, stride)
    inside = (nth * stride)[:, None] + np.arange(WINDOW)
    return begin[text][:, None] + inside, inside < inputs[text][:, None]


def windows_by_text(inputs: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window, and its number there."""
    count = np.where(inputs > WINDOW, 1 + -(-(inputs - WINDOW) // stride), (inputs > 0).astype(np.int64))
    text = np.repeat(np.arange(len(inputs)), count)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)


class Reader:
    """The model on the words of a block."""

    def __init__(self, speller: Speller, model: Attention):
        self.speller, self.model, w = speller, model, model.w
        #: From a word's or a place's embedding to itself, its query, its key and its value, side by side, and to a 1 that sums up the weights.
        self.to_all = np.concatenate([np.eye(WIDTH, dtype=np.float32), w["Wq"] * np.float32(SCALE), w["Wk"], w["Wv"], np.zeros((WIDTH, 1), np.float32)], 1)
        self.place = w["P"] @ self.to_all
        self.place[:, -1] = 1

    def log_probabilities(self, ids: np.ndarray, counts: np.ndarray, words: np.ndarray, texts: np.ndarray, some: int = BATCH_PART) -> np.ndarray:
        """Sum of log P of the first ids of each text's words after its first; all as in Attention.train(), each text led by the end."""
        model, w = self.model, self.model.w
        columns = means(w["E"], ids, counts) @ self.to_all
        first = self.speller.first[ids[np.cumsum(counts) - counts]][words]
        inputs = np.diff(texts) - 1
        text, nth = windows_by_text(inputs)
        place, total = np.arange(WINDOW), np.zeros(len(inputs))
        # A text's first window scores all of its words, each other one those that none before it has scored.
        for skip, windows in ((0, np.flatnonzero(nth == 0)), (WINDOW - STRIDE, np.flatnonzero(nth))):
            for at in range(0, len(windows), some):
                t, n = text[windows[at : at + some]], nth[windows[at : at + some]]
                inside = (n * STRIDE)[:, None] + place
                x = np.minimum(texts[t][:, None] + inside, len(words) - 1)
                both = columns.take(words[x], axis=0)
                both += self.place
                q, k, v = both[:, skip:, WIDTH : 2 * WIDTH], both[:, :, 2 * WIDTH : 3 * WIDTH], both[:, :, 3 * WIDTH :]
                c = model.powers(q, k, skip) @ v
                own = np.flatnonzero(inside[:, skip:] < inputs[t][:, None])
                c = c.reshape(-1, WIDTH + 1).take(own, axis=0)
                h = both[:, skip:, :WIDTH].reshape(-1, WIDTH).take(own, axis=0) + (c[:, :-1] / c[:, -1:]) @ w["Wo"]
                logs = model.head(h, first.take(x[:, skip:].ravel().take(own) + 1))
                total += np.bincount(t.repeat(WINDOW - skip).take(own), logs, len(total))
        return total


def with_ends(ids: np.ndarray, counts: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and numbers of ids of the words with an end before and after each text, and where each text begins."""
    texts = first + 2 * np.arange(len(first))
    more = np.ones(int(texts[-1]), np.int64)
    inner = np.ones(len(more), bool)
    inner[texts[:-1]] = inner[texts[1:] - 1] = False
    more[inner] = counts
    out = np.full(int(more.sum()), end, np.int32)
    out[np.repeat(inner, more)] = ids
    return out, more, texts


def distinct_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in the order in which they come, a place of each, and which of them each value is; by a hash table, where np.unique() would sort."""
    coded = pa.array(values).dictionary_encode()
    distinct, own = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
    at = np.zeros(len(distinct), np.int64)
    at[own] = np.arange(len(own))
    return distinct, at, own


class Words:
    """Words of many blocks, of which each distinct one is spelled once in all.

    size: how many words are held, or 16 bytes where these make more, so that blanks and long words are bounded too.
    """

    def __init__(self, speller: Speller):
        self.speller, self.held, self.size = speller, [], 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.held.append((data, *self.speller.words(data, offsets)))
        self.size += max(len(self.held[-1][1]), len(data) // 16)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, ids and numbers of ids of the distinct words, which of them each word is, and each text's first word; forgets them."""
        data, hashes = (np.concatenate([x[k] for x in self.held]) for k in range(2))
        begin = np.cumsum([0, *(len(x[0]) for x in self.held)])
        starts, ends = (np.concatenate([x[k] + b for x, b in zip(self.held, begin, strict=False)]) for k in (2, 3))
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[4]) for x in self.held]))])
        values, at, words = distinct_of(hashes)
        ids, counts = self.speller.spell(data, starts[at], ends[at])
        self.held, self.size = [], 0
        return values, ids, counts, words, first

    def take_texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, numbers of ids, words and beginnings of texts as Attention.train() takes them; the end is the last distinct word."""
        _, ids, counts, words, first = self.take()
        words, _, texts = with_ends(words, np.ones(len(words), np.int64), first, len(counts))
        return np.append(ids, self.speller.size), np.append(counts, 1), words, texts


def _counter(ranks: list[bytes], most: int = 2 * SHARD_WORDS):
    """mapInArrow function: (text) to (word hash, first id, count) and, with -1 for the first id, (key of an id pair, count), see Chain; counted over about `most` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(ranks)
        words = Words(speller)

        def flush() -> pa.RecordBatch:
            values, ids, counts, own, _ = words.take()
            times, begin = np.bincount(own, minlength=len(values)), np.cumsum(counts) - counts
            pairs = ids.astype(np.int64) * (speller.size + 1) + follows(ids, counts, speller.size)
            keys, _, at = distinct_of(pairs)
            pair_times = np.bincount(at, np.repeat(times, counts)).astype(np.int64)
            h, n = np.concatenate([values.view(np.int64), keys]), np.concatenate([times, pair_times])
            f = np.concatenate([speller.first[ids[begin]], np.full(len(keys), -1)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), pa.array(n)], names=["h", "f", "n"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), PIECE):
                words.add(data, offsets)
                if words.size >= most:
                    yield flush()
        if words.size:
            yield flush()

    return run


def _trainer(ranks: list[bytes], begins: np.ndarray, weights: dict, epochs: int, seed: int, most: int = 2 * SHARD_WORDS):
    """mapInArrow function: the texts of a shard to a row per weight (its place, its value times the shard's windows), and one of place -1 with their number.

    A shard of more than `most` words is learned part by part, one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(ranks)
        words, model, windows = Words(speller), Attention(speller.size, speller.classes, speller.members, begins), 0
        model.w = dict(weights)

        def learn() -> int:
            ids, counts, own, texts = words.take_texts()
            model.train(ids, counts, own, speller.first[ids[np.cumsum(counts) - counts]], texts, epochs=epochs, seed=seed)
            return len(windows_by_text(np.diff(texts) - 1, WINDOW)[0])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), PIECE):
                words.add(data, offsets)
                if words.size >= most:
                    windows += learn()
        if words.held:
            windows += learn()
        if windows:
            values = np.append(windows * flat_weights(model.w).astype(np.float64), float(windows))
            places = np.append(np.arange(len(values) - 1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(values)], names=["place", "value"])

    return run


def flat_weights(w: dict) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in Attention.NAMES])


def training_share(training: DataFrame, rows: int, id_col: str, text: str, words: int = 0) -> tuple[DataFrame, int]:
    """Text and key of all `rows` training documents, and the number of shards that they and their words make in all rounds."""
    keyed = training.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(id_col, text).alias("k"))
    return keyed, max(1, round(max(rows / SHARD, words / SHARD_WORDS)))


def trained(training: DataFrame, rows: int, begins: np.ndarray, counts: DataFrame, ranks: list[bytes], id_col: str, text: str) -> tuple[Attention, Chain]:
    """The model, in shards, and the chain of ids, from all `rows` training documents; begins: counts of all first ids, counts: as from _counter()."""
    words, speller = int(begins.sum()), Speller(ranks)
    keyed, shards = training_share(training, rows, id_col, text, words)
    found = counts.where("f < 0").select("h", "n").toArrow()
    chain = Chain(found.column(0).to_numpy(), found.column(1).to_numpy(), speller.size)
    shards = -(-shards // ROUNDS)
    windows = (words // WINDOW + rows) // ROUNDS + 1
    epochs = max(1, -(-STEPS * BATCH * shards // windows))
    model = Attention(speller.size, speller.classes, speller.members, begins)
    for r in range(ROUNDS):
        # Dealt by id and text, and in their order: the result does not hang on how the table lies in files.
        dealt = keyed.where(F.pmod("k", F.lit(ROUNDS)) == r).repartition(shards, "k").sortWithinPartitions("k").select("text")
        # Summed place by place on the executors: what reaches the driver is one set of weights, however many shards.
        weights = dealt.mapInArrow(_trainer(ranks, begins, model.w, epochs, 11 + r), "place int, value double")
        summed = weights.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        if not summed.num_rows:
            continue
        places = summed.column(0).to_numpy()
        values = summed.column(1).to_numpy()[np.argsort(places)]
        mean, at = values[1:] / values[0], 0
        for name in Attention.NAMES:
            old = model.w[name]
            model.w[name] = mean[at : at + old.size].astype(np.float32).reshape(old.shape)
            at += old.size
    return model, chain


def _scorer(ranks: list[bytes], model: Attention, chain: Chain, shares: Shares, head: np.ndarray, head_counts: np.ndarray, ends: int, total: int, distinct: int):
    """mapInArrow function: (row, id, held_out, text) to a row per text, with a list of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(ranks)
        words, reader, first_logs = Words(speller), Reader(speller, model), shares.first_logs()
        head_set, base_log = pa.array(head), np.log10((head_counts + 1) / (total + distinct + 1))
        names = ["rid", "doc", "held_out", "n_tokens", "n_known", "base", "score", "plain", "other"]
        for batch in batches:
            at, rids = 0, batch.column(0).to_numpy()
            for _, to, data, offsets in blocks(batch.column(3), PIECE):
                words.add(data, offsets)
                if words.size < SIDE and to < len(rids):
                    continue
                hashes, ids, counts, own, texts = words.take()
                first, rest = speller.first[ids[np.cumsum(counts) - counts]], chain.rest(ids, counts)
                n, row = to - at, np.repeat(np.arange(to - at), np.diff(texts))
                where = pc.index_in(pa.array(hashes), value_set=head_set).fill_null(-1).to_numpy()
                known = where >= 0
                # Logs of each distinct word: of its share, if it is known, and of its first id without context.
                in_base, in_own = np.zeros(len(hashes)), np.zeros(len(hashes))
                in_base[known] = base_log[where[known]]
                in_own[known] = shares.logs(first[known], head_counts[where[known]], rest[known])
                base = np.bincount(row, in_base[own], n) + np.log10((ends + 1) / (total + distinct + 1))
                share = np.bincount(row, in_own[own], n)
                plain = share + np.bincount(row, first_logs[first][own], n) + first_logs[speller.end]
                ended, _, begin = with_ends(own, np.ones(len(own), np.int64), texts, len(hashes))
                score = share + reader.log_probabilities(np.append(ids, speller.size), np.append(counts, 1), ended, begin)
                hits = np.bincount(row[known[own]], minlength=n) + (ends > 0)
                other = np.flatnonzero(~known[own])
                keys, _, which = distinct_of(row[other] * max(1, len(hashes)) + own[other])
                times = np.bincount(which, minlength=len(keys))
                at_row, other = keys // max(1, len(hashes)), keys % max(1, len(hashes))
                fields = {"h": hashes[other].view(np.int64), "f": first[other].astype(np.int32), "rest": rest[other], "times": times}
                # The pairs come text by text, as the words do.
                bounds = pa.array(np.searchsorted(at_row, np.arange(n + 1)).astype(np.int32))
                listed = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rids[at:to]), batch.column(1).slice(at, n), batch.column(2).slice(at, n), pa.array(np.diff(texts) + 1), pa.array(hits.astype(np.int64)),
                        *(pa.array(x) for x in (base, score / np.log(10), plain / np.log(10))), listed,
                    ],
                    names=names,
                )
                at = to

    return run


def frequent_words(counts: DataFrame, room: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of all words above a count that at most `room` words reach."""
    step = F.floor(F.log2("n") * 8)
    least = None
    for bound, v in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect():
        room -= v
        if room < 0:
            break
        least = bound
    rows = counts.where(step >= least).select("h", "n").toLocalIterator() if least is not None else []
    frequent = sorted((r["h"] & (2**64 - 1), r["n"]) for r in rows)
    return np.array([h for h, _ in frequent], np.uint64), np.array([n for _, n in frequent], np.float64)


def attention_scores(documents: DataFrame, ranks: list[bytes], id_col: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, unigram_score: a row per document.

    base_score sums log10((c + 1) / (N + V + 1)) over the tokens, c, N and V from the training
    documents (those outside the held-out fold). A null text is an end alone; repeated rows are
    scored one by one and counted one by one; a null id counts as an empty one for the fold; an
    empty table gives no rows. Without training documents all tokens are unknown. Only the id and
    the text are read, so other columns may have any name.
    """
    fold = remainder(F.col(id_col), folds)
    training = documents.where(fold != held)
    counted = training.select(F.col(text).alias("text")).mapInArrow(_counter(ranks), "h long, f int, n long")
    found = materialize(counted.groupBy("h", "f").agg(F.sum("n").alias("n")), "counts")
    counts = found.where("f >= 0")
    ends, begins = training.count(), Speller(ranks).end
    by_first = counts.groupBy("f").agg(F.count("*").alias("v"), F.sum("n").alias("n")).toArrow()
    f, v, n = (by_first.column(k).to_numpy() for k in range(3))
    n, v = np.bincount(f, n, begins + 1), np.bincount(f, v, begins + 1)
    n[begins], v[begins] = ends, ends > 0
    total, distinct, shares = int(n.sum()), int(v.sum()), Shares(n, v)
    model, chain = trained(training, ends, n, found, ranks, id_col, text)
    head, head_counts = frequent_words(counts)

    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc"), (fold == held).alias("held_out"), F.col(text).alias("text"))
    schema = "rid long, doc long, held_out boolean, n_tokens long, n_known long, base double, score double, plain double, other array<struct<h: long, f: int, rest: double, times: long>>"
    read = materialize(docs.mapInArrow(_scorer(ranks, model, chain, shares, head, head_counts, ends, total, distinct), schema), "scores")
    # The shares of words that did not travel, as in Shares.logs().
    of = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("f") + 1)
    other = read.select("rid", F.inline("other")).join(counts.select("h", "n"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / of(np.maximum(n, 1)) + of(shares.left) * F.col("rest")
    other = other.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_more"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(total + distinct + 1))).alias("base_more"),
        F.sum(F.col("times") * F.log10(share)).alias("score_more"),
    )
    out = read.drop("other").join(other, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        F.col("doc").alias(id_col), "held_out", "n_tokens", plus("n_known", "known_more").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "base_more").alias("base_score"), plus("score", "score_more").alias("score"), plus("plain", "score_more").alias("unigram_score"),
    )


def op10_attention(spark, sf_dir: str) -> DataFrame:
    return attention_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_ranks())
