"""Nearest vectors, exactly and through an inverted file, against plain numpy."""

import math

import numpy as np
import pytest

from stepweave.operators import routing
from stepweave.operators import vector_search as V

SCHEMA = "id long, vector array<double>"


def plain(queries, rows, k):
    """(query, id, rank) by cosine to twelve places, then id."""
    out = []
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in [(i, v) for i, v in usable if i in queries]:
        scored = []
        for i, v in usable:
            if len(v) == len(a):
                size = np.linalg.norm(a) * np.linalg.norm(v)
                scored.append((-round(float(a @ v / size), 12) + 0.0 if size else 0.0, i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def made(n, seed, dim=8, common=0.3):
    r = np.random.default_rng(seed)
    rows = [(k, r.normal(size=dim).tolist()) for k in range(n)]
    for k in range(int(n * common)):
        rows[3 * k % n] = (3 * k % n, rows[1][1])  # one vector of many rows
    return rows


@pytest.fixture
def small(monkeypatch):
    """Blocks of a few rows, so that a table has several groups."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "GROUP_MB", 0.004)
    monkeypatch.setattr(V, "BATCH", 32)


def answers(df):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in df.collect())


def test_nearest_equals_plain_code(spark, small):
    rows = made(700, 1) + [(1000, [0.0] * 8), (1050, [0.0] * 8), (1001, None), (1002, [None] * 8), (1003, [math.nan] * 8), (1004, [math.inf] * 8), (None, [1.0] * 8), (1100, [1.0, 2.0]), (1101, [2.0, 4.0]), (1102, [-1.0, 0.5]), (1150, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = {i for i, _ in rows if i is not None and i % 50 == 0}
    got = answers(V.nearest(df.where("id % 50 = 0"), df, 7))
    assert got == plain(asked, rows, 7) and len(got) > 100
    assert V.nearest(df.where("id < 0"), df).isEmpty() and V.nearest(df, df.where("id < 0")).isEmpty()


def test_great_and_small_vectors_keep_their_direction(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200]), (3, [5e-324, 0.0])]
    got = {(r["query_id"], r["id"]): r["score"] for r in V.nearest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] == pytest.approx(0, abs=1e-12) and got[0, 3] == pytest.approx(0.5**0.5)


def test_inverted_file(spark, tmp_path):
    """Every vector is in one list; all probes give the exact answers, and those told by the sample a recall of nine tenths of others' answers."""
    r = np.random.default_rng(3)
    middles = r.normal(size=(30, 16))
    rows = [(k, (middles[k % 30] + 0.4 * r.normal(size=16)).tolist()) for k in range(3000)] + [(5000 + k, middles[0].tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    index = V.build(df, f"{tmp_path}/index", lists=40)
    assert index.table.count() == 4500 and index.table.select("id").distinct().count() == 4500 and len(index.centroids) == 40
    again = V.build(df.repartition(3), f"{tmp_path}/again", lists=40)
    assert np.allclose(index.centroids, again.centroids)
    # The list of one vector that a third of all rows have is dealt to several files.
    hot = index.table.where("id >= 5000").selectExpr("_metadata.file_path AS f").distinct().count()
    assert hot > 1
    queries = df.where("id % 50 = 0")
    exact = V.nearest(queries, df, 10)
    assert answers(V.search(index, queries, 10, probes=40)) == answers(exact)
    probes = V.probes_for(index, df.where("id % 50 = 7"), 10, 0.95)
    found = V.search(index, queries, 10, probes)
    assert 1 <= probes < 20 and 0.9 <= V.recall(found, exact) <= 1
    assert V.recall(V.search(index, queries, 10, 1), exact) < V.recall(found, exact)
    empty = V.build(df.where("id < 0"), f"{tmp_path}/empty")
    assert V.search(empty, queries).isEmpty()


def test_recall_on_the_table(spark):
    from stepweave.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found, exact = (QUERIES[n](spark, folder) for n in ("indexed_vectors", "nearest_vectors"))
    assert V.recall(found, exact) >= 0.9


@pytest.mark.parametrize("n", [5, 1500])
def test_anchors_of_any_number(spark, small, n):
    """Beyond a thousand anchors as well, in several groups: each candidate's best, ties by position, scores ranked before they are rounded."""
    r = np.random.default_rng(n)
    anchors = [(f"a{k}", k, r.normal(size=4).tolist()) for k in range(n)]
    anchors[3] = ("a3", 3, anchors[1][2])
    candidates = [(f"c{k}", (np.array(anchors[k % n][2]) + r.normal(size=4) / 10).tolist()) for k in range(60)] + [("zero", [0.0] * 4), ("none", None)]
    got = routing.rank_anchors(spark.createDataFrame(candidates, "candidate_id string, vector array<double>"), spark.createDataFrame(anchors, "anchor string, position int, anchor_vector array<double>"))
    want = []
    for name, v in candidates:
        if v is not None:
            size = lambda a, v=v: np.linalg.norm(a) * np.linalg.norm(v)
            scored = sorted((-round(float(np.dot(a, v) / size(a)) if size(a) else 0.0, 12) + 0.0, p, x) for x, p, a in anchors)[:3]
            want += [(name, x, k + 1, round(-s, 5)) for k, (s, _, x) in enumerate(scored)]
    rows = sorted((x["candidate_id"], x["anchor"], x["rank"], x["score"]) for x in got.collect())
    assert [x[:3] for x in rows] == [x[:3] for x in sorted(want)]
    assert all(abs(a[3] - b[3]) <= 1e-5 for a, b in zip(rows, sorted(want), strict=True))


def test_near_ties_are_not_rounded_away(spark):
    anchors = [("first", 0, [1.0, 0.001]), ("second", 1, [1.0, 0.0])]
    got = routing.rank_anchors(spark.createDataFrame([("c", [1.0, 0.0])], "candidate_id string, vector array<double>"), spark.createDataFrame(anchors, "anchor string, position int, anchor_vector array<double>")).orderBy("rank").collect()
    assert [(r["anchor"], r["score"]) for r in got] == [("second", 1.0), ("first", 1.0)]


@pytest.mark.parametrize("name", ["anchor_topk", "anchor_rerank"])
def test_queries_rank_rounded_scores(spark, tmp_path, name):
    """Vectors so near each other that their scores are a tie after rounding, which the SQL breaks by the anchor."""
    import duckdb

    from stepweave.plans.queries import ORACLE, QUERIES

    r = np.random.default_rng(5)
    rows = [(k, k % 6, (np.array([1.0, 0.5, -0.3, 0.2]) + r.normal(size=4) / 500).tolist()) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(x) for x in QUERIES[name](spark, str(tmp_path)).select("candidate_id", "anchor", "score", "rank").collect()]
    assert sorted(got) == sorted(duck.sql(f"SELECT candidate_id, anchor, score, rank FROM ({ORACLE[name]})").fetchall())
