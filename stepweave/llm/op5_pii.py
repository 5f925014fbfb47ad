r"""Personal data by a semi-Markov conditional random field (operator 5).

Exact patterns find the base spans (email, ip, card, phone). A semi-Markov CRF then reads the
fields that hold a digit or an @ and are not covered by base spans: every segment of up to
``MOST`` atoms is scored whole, by features of the span and what stands around it, for each
type, and dynamic programming over the atoms chooses boundaries and types together. Spans it
adds never overlap base ones. It finds what the patterns leave: national phone numbers, emails
written with `(at)`, keys and passwords (``secret``).

The CRF is fitted by maximum likelihood (forward-backward over segments) on fields made by
``examples()``, so the same weights serve any corpus; nothing is learned from the documents.

Null and empty texts have no spans; repeated rows are read one by one; an empty table gives no rows;
equal scores go to fewer segments; columns other than the id and the text may have any name. Texts are
read whole, in time linear in their length but for the fields, bounded by ``MOST`` atoms a segment.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import blocks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MOST = 12


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What stands around each @, run by run: a pattern begun at every character of a long run would read it again each time."""
    m = LOCAL.search(text)
    while m:
        domain = DOMAIN.match(text, m.end())
        if domain:
            yield m.start(), domain.end()
        m = LOCAL.search(text, (domain or m).end())


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by dots; of a longer chain each next four."""
    for chain in DOTTED.finditer(text):
        if chain[0].count(".") >= 3:
            at = chain.start()
            parts = chain[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                yield at, at + size
                at += size + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then by kind as listed."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    for a, b in dotted(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text[a:b].split(".")):
            found.append((a, b, "ip"))
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2]), s[1]))


HINT = re.compile(r"[0-9@]|\((?:at|dot)\)")
LEAD = re.compile(r"(?:[A-Za-z_]{2,20} ?[=:] ?)?[\"']?$")
TAIL = re.compile(r"[^\s\"']*[\"']?(?: [(]?[0-9][^\s\"']*)*(?:\s?\((?:at|dot)\)\s?[A-Za-z0-9.-]+)*")
ATOM = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")


def fields(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around a digit, an @ or an (at): the word, a name and = or : before it, and numbers after it."""
    end = 0
    for m in HINT.finditer(text):
        if m.start() < end:
            continue
        lo = m.start()
        if text[lo] == "(" and lo > end and text[lo - 1] == " ":
            lo -= 1
        while lo > end and not text[lo - 1].isspace() and text[lo - 1] not in "\"'":
            lo -= 1
        lead = LEAD.search(text, max(end, lo - 26), lo)
        lo = lead.start() if lead else lo
        end = TAIL.match(text, m.start()).end()
        end = max(end, m.end())
        yield lo, end


def segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Atoms of a field as (start, end), and its segments as (first atom, end atom)."""
    atoms = [(m.start(), m.end()) for m in ATOM.finditer(text, lo, hi)]
    out = []
    for i, (a, _) in enumerate(atoms):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i, min(i + MOST, len(atoms))):
            b = atoms[j][1]
            if text[b - 1].isalnum() and b - a >= 6 and any(c.isdigit() or c in "@(" for c in text[a:b]):
                out.append((i, j + 1))
    return atoms, out


NAMES = (
    "bias at paren_at dot plus eq colon quote space luhn hex mixed upper_run letters_only digits_only ends_tld has_local cut_before cut_after glued_before glued_after "
    "cue_phone cue_mail cue_secret cue_card d<7 d7-9 d10-11 d12-13 d14-19 d>19 len<12 len12-19 len20-32 len>32 groups1 groups2 groups3 groups4+ three_four money slash open_paren closed"
).split()
INDEX = {n: k for k, n in enumerate(NAMES)}


def features(text: str, a: int, b: int) -> list[int]:
    """Indices of the features of the span [a, b)."""
    s, on = text[a:b], ["bias"]
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    n, size = len(digits), len(s)
    before, after, lead = text[a - 1 : a], text[b : b + 1], text[max(0, a - 24) : a].lower()
    on += [name for name, yes in (
        ("at", "@" in s), ("paren_at", "(at)" in s), ("dot", "." in s), ("plus", "+" in s), ("eq", "=" in s), ("colon", ":" in s), ("quote", '"' in s or "'" in s), ("space", " " in s),
        ("luhn", 13 <= n <= 19 and luhn(digits)), ("hex", size >= 16 and bool(re.fullmatch("[0-9a-f]+", s)) and n < size), ("mixed", size >= 10 and s.isalnum() and 0 < n < size),
        ("upper_run", bool(re.fullmatch("[A-Z0-9]{16,}", s)) and 0 < n < size), ("letters_only", n == 0), ("digits_only", s.isdigit()), ("ends_tld", bool(re.search(r"\.[A-Za-z]{2,}$", s))), ("has_local", bool(re.match(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\))", s))),
        ("cut_before", before.isalnum()), ("cut_after", after.isalnum()), ("glued_before", before != "" and before in ".@-+_%/"), ("glued_after", bool(re.match(r"[.@_%/-][A-Za-z0-9]| ?\((?:at|dot)\)| [0-9]", text[b : b + 8]))),
        ("cue_phone", bool(re.search(r"(?:phone|tel|call|mobile|fax)\W{0,3}$", lead))), ("cue_mail", bool(re.search(r"(?:mail|contact)\W{0,3}$", lead))), ("cue_secret", bool(re.search(r"(?:password|passwd|token|secret|api_key|apikey|key)\W{0,4}$", lead))), ("cue_card", bool(re.search(r"(?:card|visa|credit)\W{0,3}$", lead))),
        ("three_four", bool(re.search(r"[0-9]{3}[ .-][0-9]{4}$", s))), ("money", before in "$€£%" and before != ""), ("slash", "/" in s), ("open_paren", s.count("(") != s.count(")")), ("closed", bool(re.match(r"\([0-9]{3}\)", s))),
    ) if yes]
    on.append("d<7" if n < 7 else "d7-9" if n < 10 else "d10-11" if n < 12 else "d12-13" if n < 14 else "d14-19" if n < 20 else "d>19")
    on.append("len<12" if size < 12 else "len12-19" if size < 20 else "len20-32" if size < 33 else "len>32")
    on.append(f"groups{len(groups)}" if len(groups) in (1, 2, 3) else "groups4+")
    return [INDEX[x] for x in on if x in INDEX]


def lattice(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    atoms, segs = segments(text, lo, hi)
    made = np.zeros((len(segs), len(NAMES)))
    for k, (i, j) in enumerate(segs):
        made[k, features(text, atoms[i][0], atoms[j - 1][1])] = 1
    return atoms, segs, made


def examples(count: int = 420, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made texts with their spans: fields of every type and fields that only look like one."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda a=3, b=9: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(a, b)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice(["", " ", "-"]).join((d[:4], d[4:8], d[8:12], d[12:]))

    def made() -> tuple[str, str, str]:
        kind = r.choice(["phone", "phone", "phone", "email", "email", "ip", "card", "secret", "secret", "secret", "", "", "", "", "", "", ""])
        if kind == "phone":
            return r.choice(["", "", "call ", "tel: ", "phone "]), r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"]), kind
        if kind == "email":
            return r.choice(["", "", "mail ", "contact: "]), r.choice([f"{word()}.{digits(2)}@{word()}.{r.choice(['com', 'org', 'net'])}", f"{word()}{digits(1)} (at) {word()}.{r.choice(['com', 'org', 'net'])}", f"{word()}(at){word()}{digits(1)}.{r.choice(['com', 'de'])}", f"{word()}@{word()}{digits(1)}.{word(2, 6)}.com"]), kind
        if kind == "ip":
            return "", ".".join(str(r.randint(1, 255)) for _ in range(4)), kind
        if kind == "card":
            return r.choice(["", "card ", "visa: "]), card(), kind
        if kind == "secret":
            return r.choice([("password=", hexa(r.choice([18, 16, 20]))), ('token = "', hexa(40)), ("", "AK" + upper(18)), ("api_key: ", hexa(32)), ("secret=", word(4, 8) + digits(4) + word(3, 5)), ("key=", upper(24))]) + (kind,)
        return "", r.choice([digits(r.randint(1, 8)), digits(r.choice([10, 12, 14, 16, 20])), f"{digits(1)}.{digits(1)}.{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(3)},{digits(3)},{digits(3)}", f"{word()}{digits(2)}", f"{word()}-{digits(4)}-{word()}", f"http://{word()}.{word()}.com/{word()}/{digits(5)}", f"@{word()}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"page={digits(2)}", f"{digits(3)}x{digits(4)}", f"{digits(4)}-{digits(4)}", f"{digits(5)} {digits(5)}", f"ISBN {digits(3)}-{digits(10)}", f"{digits(2)}th", f"CC BY-NC {digits(1)}.0", word() + digits(8) + word()]), ""

    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(0, 3))) + " ", []
        for _ in range(r.randint(1, 2)):
            lead, body, kind = made()
            text += lead
            if kind:
                spans.append((len(text), len(text) + len(body), kind))
            text += body + ('"' if lead.endswith('"') else "") + r.choice([" ", ". ", ", "]) + word() + " "
        out.append((text, spans))
    return out


def forward(scores: np.ndarray, segs: list[tuple[int, int]], n: int) -> np.ndarray:
    """Log sums over the segmentations of the atoms before each boundary."""
    total = np.zeros(n + 1)
    ends: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(segs):
        ends.setdefault(j, []).append(k)
    best = np.logaddexp.reduce(scores, 1) if len(segs) else np.zeros(0)
    for j in range(1, n + 1):
        total[j] = np.logaddexp.reduce([total[j - 1], *(total[segs[k][0]] + best[k] for k in ends.get(j, ()))])
    return total


@lru_cache(maxsize=1)
def fitted(epochs: int = 25, rate: float = 0.35, penalty: float = 2e-3) -> np.ndarray:
    """Weights (feature, type) by AdaGrad on the likelihood of the made fields."""
    known = []
    for text, spans in examples():
        for lo, hi in fields(text):
            atoms, segs, made = lattice(text, lo, hi)
            gold = np.zeros((len(segs), len(KINDS)))
            for k, (i, j) in enumerate(segs):
                for a, b, kind in spans:
                    if (atoms[i][0], atoms[j - 1][1]) == (a, b):
                        gold[k, KINDS.index(kind)] = 1
            if segs:
                known.append((len(atoms), segs, [(len(atoms) - j, len(atoms) - i) for i, j in segs], made, gold))
    weights, squares = np.zeros((len(NAMES), len(KINDS))), np.full((len(NAMES), len(KINDS)), 1e-3)
    for _ in range(epochs):
        slope = np.zeros_like(weights)
        for n, segs, back, made, gold in known:
            scores = made @ weights
            a, b = forward(scores, segs, n), forward(scores, back, n)
            outer = np.array([a[i] + b[n - j] for i, j in segs]) - a[n]
            slope += made.T @ (gold - np.exp(scores + outer[:, None]))
        slope = slope / len(known) - penalty * weights
        squares += slope**2
        weights += rate * slope / np.sqrt(squares)
    return weights


def decode(text: str, lo: int, hi: int, weights: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The best segmentation of a field: (start, end, kind) of its segments, clear of the taken spans; ties go to fewer segments."""
    atoms, segs, made = lattice(text, lo, hi)
    if not segs:
        return []
    scores = made @ weights
    kinds, best = scores.argmax(1), scores.max(1)
    n, value, back = len(atoms), np.zeros(len(atoms) + 1), [-1] * (len(atoms) + 1)
    ends: dict[int, list[int]] = {}
    taken = sorted(taken)
    begins, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
    for k, (i, j) in enumerate(segs):
        # Of the spans that begin before the segment's end, the furthest reaches no further than its start.
        if best[k] > 0 and reach[bisect_left(begins, atoms[j - 1][1])] <= atoms[i][0]:
            ends.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for k in ends.get(j, ()):
            if value[segs[k][0]] + best[k] > value[j]:
                value[j], back[j] = value[segs[k][0]] + best[k], k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            i, end = segs[back[j]]
            out.append((atoms[i][0], atoms[end - 1][1], KINDS[kinds[back[j]]]))
            j = i
    return out[::-1]


def find_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans."""
    base = base_spans(text)
    found, at = list(base), 0
    for lo, hi in fields(text):
        while at < len(base) and base[at][1] <= lo:
            at += 1
        to = at
        while to < len(base) and base[to][0] < hi:
            to += 1
        near = [(a, b) for a, b, _ in base[at:to]]
        if any(c.isdigit() or c in "@(" for c in without(text, lo, hi, near)):
            found += decode(text, lo, hi, weights, near)
    return base, sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def without(text: str, lo: int, hi: int, spans: list[tuple[int, int]]) -> str:
    """The part of a field that no span covers."""
    out, at = "", lo
    for a, b in sorted(spans):
        out += text[at : max(at, a)]
        at = max(at, b)
    return out + text[at:hi]


def _finder(weights: np.ndarray, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = np.zeros(256, bool)
        hint[[*range(48, 58), 64]] = True
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            marked = np.zeros(batch.num_rows, bool)
            for at, to, data, offsets in blocks(column):
                sums = np.concatenate([[0], np.cumsum(hint[data])])
                marked[at:to] = sums[offsets[1:]] > sums[offsets[:-1]]
                marked[at:to] |= np.array([b"(at)" in data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], bool)
            rows = {int(r): find_spans(column[int(r)].as_py(), weights) for r in np.flatnonzero(marked)}
            join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
            if redact:
                texts = column.to_pylist()
                for r, (_, spans) in rows.items():
                    texts[r] = redacted(texts[r], spans)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)
                continue
            empty: tuple = ([], [])
            base, every = zip(*(rows.get(r, empty) for r in range(batch.num_rows)), strict=True) if batch.num_rows else ((), ())
            counts = [pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64()) for kind in BASE]
            hashes = pa.array([hashlib.sha256(join(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array([join(x) for x in every], pa.string())], names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first one's mark covers all."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row per document."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return docs.mapInArrow(_finder(fitted(), False), "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents, columns and order of columns kept, with every span of the text replaced by its kind; a null text stays null."""
    moved = documents.select(*(c for c in documents.columns if c != text), text)
    return moved.mapInArrow(_finder(fitted(), True), moved.schema).select(*documents.columns)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
