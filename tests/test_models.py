"""Models as a stage that goes on where it stopped: requests by digest, answers kept as they come."""

import json
import os
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepweave.operators import providers

TEMPLATE = "__DOMAIN_ID__|__CANDIDATES_JSON__"


def candidates(spark, n=50, parts=7):
    rows = [(f"d{k % 3 // 2}", f"c{k:03d}", json.dumps({"candidate_id": f"c{k:03d}"})) for k in range(n)]
    return spark.createDataFrame(rows + rows[:5] + [("d0", None, "{}"), ("d0", "x", None)], "domain_id string, candidate_id string, payload string").repartition(parts)


def model(calls, fail_at=None):
    """A model that leaves a file for each call, and kills the worker's process at one of them, once."""

    def generate(prompt):
        ids = [c["candidate_id"] for c in json.loads(prompt.split("|", 1)[1])]
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write(ids[0])
        if fail_at in ids and not os.path.exists(f"{calls}.failed"):
            open(f"{calls}.failed", "w").close()
            raise OSError("the model is gone")
        return json.dumps({"decisions": [{"candidate_id": i, "route": "reject", "confidence": 0.5} for i in ids]})

    return generate


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return f"{tmp_path}/calls"


def made(calls):
    return sorted(open(f"{calls}/{x}").read() for x in os.listdir(calls))


def test_requests_hang_on_candidates_alone(spark):
    a, b = ({(r["domain_id"], r["batch"], tuple(r["candidate_ids"]), r["request"]) for r in providers.model_requests(candidates(spark, parts=p), TEMPLATE, 8).collect()} for p in (1, 9))
    assert a == b and sum(len(x[2]) for x in a) == 50 and max(len(x[2]) for x in a) == 8 and len(a) == 5 + 2
    other = {r["request"] for r in providers.model_requests(candidates(spark), TEMPLATE, 8, model="other").collect()}
    assert not other & {x[3] for x in a}
    with pytest.raises(ValueError):
        providers.model_requests(candidates(spark), TEMPLATE, 0)


def test_a_failed_run_goes_on(spark, calls, tmp_path):
    """A run that fails in the middle, another with the same candidates and one with a few more: each request is asked once, but for the one that failed."""
    ask = lambda n=50: providers.model_decisions(candidates(spark, n), TEMPLATE, model(calls, "c010"), 4, 1, 0, f"{tmp_path}/answers").collect()
    with pytest.raises(PySparkException, match="the model is gone"):
        ask()
    before = made(calls)
    got = ask()
    assert len(got) == 50 and {r["route"] for r in got} == {"reject"}
    asked = made(calls)
    assert len(asked) == 9 + 4 + 1 and len(before) < len(asked) and len(set(asked)) == 13  # one request twice
    assert len(ask()) == 50 and made(calls) == asked
    assert len(ask(53)) == 53 and len(made(calls)) <= len(asked) + 2
    assert not [x for _, _, names in os.walk(f"{tmp_path}/answers") for x in names if "." in x]


def test_vectors_in_batches(spark, calls, tmp_path):
    def embed(texts):
        assert len(texts) <= 8
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write(texts[0])
        return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([(f"text {'x' * (k % 11)} {k % 40}\n\"é",) for k in range(100)] + [(None,)], "text string")
    empty = spark.createDataFrame([], "text_hash string, vector array<double>")
    for _ in range(2):
        whole, new = providers.embed_with_cache(texts, empty, lambda missing: providers.embed_texts(missing, embed, f"{tmp_path}/vectors", size=8))
        rows = whole.collect()
        assert len(rows) == texts.where("text IS NOT NULL").distinct().count() and all(r["vector"] == [len(r["text"]), 1.0] for r in rows)
    assert len(made(calls)) == -(-len(rows) // 8)
    with pytest.raises(PySparkException, match="vectors for"):
        providers.embed_texts(new.select("text_hash", "text"), lambda texts: [], size=8, tries=1).select(F.size("vector")).collect()
