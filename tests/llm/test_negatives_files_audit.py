"""Hard negatives, files of token ids and the filter audit: against plain code, SQL and the tokenizers library."""

import math
import random
import re
import uuid
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<double>, label int"


# --- hard negatives


def mined(rows, positives=5, negatives=3):
    """Plain code of the contract, in Python's integers."""
    usable = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in usable:
        if i % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in usable if j != i and len(w) == len(v)))
            for p, j, _ in [x for x in scored if x[2] == label][:positives]:
                fit = [x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
                out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def vectors(n, seed, dim=6, labels=4):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 1) for _ in range(dim)], r.randrange(labels)) for k in range(n)]
    return [(k, rows[3][1] if k % 3 == 0 else v, label) for k, v, label in rows]  # a third are one vector


def found(spark, rows, schema=VECTORS, **how):
    from stepweave.llm.op11_negatives import hard_negatives

    df = spark.createDataFrame(rows, schema).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives(df, df.where("vec_id % 50 = 0"), label=label, **how).collect()))


def test_negatives_equal_plain_code(spark, monkeypatch):
    from stepweave.llm import op11_negatives as op

    rows = vectors(900, 1)
    rows += [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1002, [math.nan] * 6, 1), (1003, [math.inf] * 6, 1), (1004, [1.0] * 6, None), (None, [1.0] * 6, 1), (1050, [], 2), (1051, [], 2), (1052, [], 3)]
    rows += [(1100, [0.5, 0.5], 1), (1101, [0.5, 0.4], 1), (1102, [0.3, 0.4], 2), (1150, [0.0] * 6, 0), (1151, [1e-9] * 6, 0)]
    want = mined(rows)
    assert len(want) > 100 and found(spark, rows) == want
    # Small blocks, a group a block, small batches.
    monkeypatch.setattr(op, "BLOCK_ROWS", 3)
    monkeypatch.setattr(op, "BATCH", 7)
    monkeypatch.setattr(op, "GROUP_MB", 0.002)
    assert found(spark, rows) == want


def test_negatives_beyond_exact_doubles(spark):
    """Components whose products pass 2**53: integers decide near ties that doubles can't see."""
    r = random.Random(5)
    rows = [(k, [float(r.randint(2**20, 2**20 + 3)) / 2 for _ in range(4)], r.randrange(2)) for k in range(120)]
    rows = [(k, [x * (0.8 if label else 1) for x in v], label) for k, v, label in rows]
    assert found(spark, rows) == mined(rows) != []


def test_negatives_with_repeated_rows(spark):
    """A repeated positive is a row of its own; repeated anchors give their rows once each."""
    rows = [(50, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.0], 2), (2, [0.7, 0.0], 2), (3, [0.6, 0.0], 2)]
    got = found(spark, rows)
    one = 256 * math.floor(256 * 0.9)
    assert got == sorted([(50, 1, k + 1, n, one, 256 * math.floor(256 * s)) for _ in range(2) for k, (n, s) in enumerate([(2, 0.7), (2, 0.7), (3, 0.6)])])


def test_negatives_sql_and_clashing_names(spark, tmp_path):
    from stepweave.llm.queries import oracle_sql, queries

    rows = [(k, v, label, "x", 1, 2.0, None, 0, 7) for k, v, label in vectors(400, 3)]
    clashing = "vec_id long, embedding array<float>, label int, block string, place int, score double, id string, anchor_id int, rank int"
    spark.createDataFrame(rows, clashing).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries()["op11_negatives"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(oracle_sql()["op11_negatives"])
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.select(*df.columns).fetchall())) != []


# --- files of ids


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def plain_ids(path, rows, end=0):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(path), 0, []
    tokenizer.encode_special_tokens = True
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def odd_texts(n, seed):
    r = random.Random(seed)
    alphabet = [" "] * (6 + seed) + ["\n"] * seed + list("abcAZ'st12.,\t\r") + ["  ", "\n\n", " \n", "\n ", " ", " ", "　", "é", "д", "中", "'s", "'re", "\x85", "<|endoftext|>", "😀", "\x1c", "​"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_pieces_encode_as_whole_texts(path, seed, monkeypatch):
    from stepweave.llm import op12_token_files as op

    monkeypatch.setattr(op, "MEMO", 5_000)
    encode, texts = op.Encoder(path), odd_texts(6_000, seed)
    for a, b, data, offsets in op.blocks(pa.array(texts), 4_000):
        ids, counts = encode(data, offsets)
        want = [x.ids for x in encode.tokenizer.encode_batch(texts[a:b], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("bits", [False, True])
def test_ids_round_trip(spark, path, tmp_path, bits):
    from stepweave.llm.op12_token_files import documents_of, read_ids, write_ids

    texts = odd_texts(300, 7)
    rows = [(k * 3 % 1000, t) for k, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, "word " * 60_000), (2003, "a" * 100_000), (-5, "minus"), (2**40, "far")]
    rows += [(3000, "same id")] * 3 + [(None, "no id")] * 40
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, id int, path string, start int").repartition(6)
    files = write_ids(df, f"{tmp_path}/ids", path, bits=bits, shards=7)
    assert sorted(map(tuple, read_ids(files).collect()), key=lambda r: r[1]) == plain_ids(path, rows)
    shards = files.orderBy("shard").collect()
    assert len(shards) > 4 and sum(s["n_docs"] for s in shards) == len(rows)
    for s in shards:
        held = list(documents_of(s["path"]))
        assert sum(len(ids) for _, ids in held) == s["n_ids"] and len(held) == s["n_docs"]


def test_equal_ids_go_by_text(spark, path, tmp_path):
    """Rows of one id, here all rows, are dealt to several files and still give the same places in another run."""
    from stepweave.llm.op12_token_files import read_ids, write_ids

    rows = [(None, f"text {k % 50}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = []
    for n in (3, 8):
        files = write_ids(df.repartition(n), f"{tmp_path}/{uuid.uuid4().hex}", path, shards=6)
        assert files.count() > 2
        runs.append(sorted((r["start"], r["ids_crc32"]) for r in read_ids(files).collect()))
    assert runs[0] == runs[1]


def test_planes():
    from stepweave.llm.op12_token_files import from_planes, to_planes

    r = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 50_257, 2**33, 2**64 - 1):
        for n in (0, 1, 7, 8, 1000):
            values = r.integers(0, top, n, dtype=np.uint64)
            for bits in (False, True):
                planes = to_planes(values, bits)
                assert (from_planes(planes, n, bits) == values).all()
                assert len(planes) <= (64 if bits else 8) and (not n or len(planes) <= int(values.max()).bit_length())


def test_damaged_files_are_noticed(spark, path, tmp_path):
    from stepweave.llm.op12_token_files import documents_of, write_ids

    df = spark.createDataFrame([(1, "some words of a text " * 50)], "doc_id long, text string")
    name = write_ids(df, f"{tmp_path}/ids", path, shards=1).collect()[0]["path"]
    whole = open(name, "rb").read()
    for broken in (whole[:-30], whole[:20], whole[:9] + bytes([whole[9] ^ 1]) + whole[10:], b""):
        with open(name, "wb") as f:
            f.write(broken)
        with pytest.raises(ValueError):
            list(documents_of(name))


def test_files_of_tasks_that_ran_twice(spark, path, tmp_path):
    """A file that no finished task names, as a lost one leaves, is not read."""
    from stepweave.llm.op12_token_files import read_ids, write_ids

    rows = [(k, f"text of {k}") for k in range(50)]
    files = write_ids(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/ids", path, shards=3)
    first = files.orderBy("shard").collect()[0]["path"]
    with open(f"{tmp_path}/ids/part-000000-lost.planes", "wb") as f:
        f.write(open(first, "rb").read()[:40])
    assert sorted(map(tuple, read_ids(files).collect())) == plain_ids(path, rows)


# --- filter audit


def audited(rows, labels):
    known = {}
    for d, quality, toxic in labels:
        good, bad = known.get(d, (False, False))
        known[d] = (good or quality == 1, bad or toxic == 1)
    first, docs = {}, []
    for d, text, _source in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((source or "", fails, *(known.get(d, (False, False)) if d is not None else (False, False))))
    out = []
    for part in {x[0] for x in docs}:
        shapley, made = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            alive = [x for x in docs if x[0] == part]
            for step, f in enumerate(order):
                gone = [x for x in alive if x[1][f]]
                total = [x for x in docs if x[0] == part and x[1][f]]
                alive = [x for x in alive if not x[1][f]]
                shapley[f] += len(gone)
                made.append((f, (part, "".join(order), step + 1, len(alive), len(gone), len(total) - len(gone), sum(sum(x[1].values()) == 1 for x in total), sum(x[2] for x in gone), sum(x[3] for x in gone))))
        out += [(*row, shapley[f]) for f, row in made]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        size = r.choice([10, 150, 250, 400])
        pool = [f"w{i}" for i in range(r.choice([20, 1000]))]
        text = " ".join(r.choice(pool) for _ in range(size))
        text = text.title() if r.random() < 0.3 else text
        out.append(text + ("\t#" if r.random() < 0.3 else "") + (" x" if k % 5 == 0 else ""))
    return out


def test_audit_equals_plain_code_and_sql(spark, tmp_path):
    from stepweave.llm.queries import oracle_sql, queries

    many = texts(2, 60)
    rows = [(k, many[k % 40 if k % 3 else 0], ["a", "b", None, ""][k % 4]) for k in range(150)]
    rows += [(200, None, "a"), (201, "", "b"), (202, None, None), (None, many[0], "a"), (None, many[0], "z"), (None, None, "z"), (7, many[7], "b"), (7, many[7], "b"), (300, "A" * 50_000 + " x" * 30_000, "only")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 150, 2)] + [(1, None, 1), (1, 1, None), (None, 1, 1), (7, 1, 0), (7, 0, 1), (9999, 1, 1)]
    spark.createDataFrame([(*r, "x", True, 5) for r in rows], "doc_id long, text string, source string, part string, A boolean, state int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = queries()["op13_filter_audit"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == audited(rows, labels) and len(got) == 600 * 5
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(map(tuple, c.sql(oracle_sql()["op13_filter_audit"]).select(*df.columns).fetchall()))
    assert [f.dataType for f in df.schema if f.name not in ("part", "filter_order", "step")] == [T.LongType()] * 7


def test_audit_visits_each_set_once(spark, monkeypatch):
    """Of three filters' 16 nodes of the trie below the root's orders, 7 sets are counted; what is persisted is given back."""
    from stepweave.llm import op13_filter_audit as op

    made, write = [], op.materialize
    monkeypatch.setattr(op, "materialize", lambda df, name: made.append(name) or write(df, name))
    rows = [(p, a, b, c, False, False) for p in ("x", "y") for a in (True, False) for b in (True, False) for c in (True, False)]
    fails = spark.createDataFrame(rows, "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    edges = op.edge_counts(fails, "ABC").collect()
    assert made == ["edges"] * 7 and len(edges) == 2 * 12
    assert all(r["removed"] * 2 == r["survivors"] == 8 // 2 ** len(r["state"]) for r in edges)
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


# --- mended in this round


def test_rows_without_an_id_decide_for_themselves(spark):
    """Near-duplicates without ids go but for one, and not because of other rows without ids."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    a, b = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120)) for _ in range(2))
    rows = [(1, a), (None, a), (None, b), (None, a + " more"), (None, b)]

    def kept(own):
        docs = spark.createDataFrame([(d, t, "x", 9) for d, t in own], "doc_id long, text string, source string, near_key int")
        out = pipeline.near_dedup(spark, docs, "")
        assert out.columns == docs.columns
        return sorted((x["doc_id"] or 0, x["text"]) for x in out.collect())

    assert kept(rows[:2]) == [(1, a)]
    assert kept(rows[:3]) == sorted([(1, a), (0, b)])
    assert kept(rows) == sorted([(1, a), (0, b)])
    assert kept(rows[2:]) == sorted([(0, b), *[x for x in kept(rows[2:]) if x[1] != b]]) and len(kept(rows[2:])) == 2
    assert kept(rows + rows) == sorted([(1, a), (1, a), (0, b)])


def test_prior_of_small_hosts(spark, tmp_path):
    """Hosts of one to five documents, with rates of known beta distributions: mean and mass are found again, and the SQL judges alike."""
    from stepweave.llm.op2_quality import ORACLE, beta_priors, op2_quality_rules

    r = np.random.default_rng(2)
    rows = []
    for alpha, beta in ((2, 8), (1, 3)):
        sizes = r.choice([1, 1, 1, 2, 3, 5], 30_000)
        rows.append(list(zip(sizes.tolist(), r.binomial(sizes, r.beta(alpha, beta, len(sizes))).tolist(), strict=True)))
    for made, mean, mass in zip(rows, (0.2, 0.25), (10, 4), strict=True):
        hosts = spark.createDataFrame(made, "host_docs long, failed_x long")
        got, own = beta_priors(hosts, {"x": ""})["x"]
        assert abs(got - mean) < 0.01 and 0.7 * mass < got * (1 - got) / own - 1 < 1.3 * mass
    assert beta_priors(spark.createDataFrame([(1, 1), (1, 0)], "host_docs long, failed_x long"), {"x": ""}) == {"x": (0.0, 0.0)}
    plain = " ".join(f"w{k} and{k} thus{k}" for k in range(30))
    docs = [(k, plain + (" #$%" * 12 if h < 3 or (k * 7919) % 23 == 0 else ""), "aa", f"h{h}", 1) for k, h in enumerate(r.integers(0, 60, 240).tolist())] + [(1000 + k, plain + " #" * 40, "aa", f"single{k}", 1) for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["kept"] for x in op2_quality_rules(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(c.sql(f"select doc_id, kept from ({ORACLE})").fetchall()) and not all(got.values()) and any(got.values())


def test_base_spans_are_the_patterns_and_linear():
    """The spans of the plain patterns, on random texts of their characters; and long runs without blanks are read once."""
    import time

    from stepweave.llm.op5_pii import base_spans

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for seed in range(20_000):
        r = random.Random(seed)
        text = "".join(r.choice("aZ0129..@@-_+% ()\n" if seed % 2 else "0123.... 25@a") for _ in range(r.randint(0, 40)))
        want = [(m.start(), m.end(), "email") for m in email.finditer(text)] + [(m.start(), m.end(), "ip") for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert sorted(s for s in base_spans(text) if s[2] in ("email", "ip")) == sorted(want)
    for text in ("1" * 400_000, "a" * 400_000 + " x@y.zz", "a@" * 200_000, "1.2" * 100_000, "a.b" * 100_000 + "@", "x@" + "a." * 200_000):
        began = time.time()
        base_spans(text)
        assert time.time() - began < 20
