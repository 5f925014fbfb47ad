"""Records that arrive in micro-batches, late ones and restarts included, give the tables of one run over all of them."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_assembly import step

from stepweave.operators import assembly, evidence
from stepweave.session import ensure_checkpoint_dir
from stepweave.sources.readers import parsed_lines
from stepweave.streaming.assembly import GraphStream

KINDS = [("pump", "Component"), ("seal", "Component"), ("leak", "Fault"), ("odor", "Signal"), ("hose", "Component"), ("Seal", "Component")]


def told(k, r):
    own = r.sample(KINDS, 2)
    ends = r.sample(["pump", "seal", "hose", "Seal"], 2)
    steps = [
        step(1, f"Inspect {own[0][0]}", "observe", own, [], [("inspects", own[1][0])], sequence_next="T2", structural_edges=[{"label": "contains", "head": ends[0], "tail": ends[1]}]),
        step(2, "Confirm", "verify", [r.choice(KINDS)], [], [], diagnostic_edges=[{"evidence_label": "odor", "indicated_label": "leak", "mechanism": r.choice([None, "propagation"])}]),
    ]
    document = [{"label": "indicates", "family": "communication", "head": "odor", "tail": x} for x in r.sample(["leak", "pump"], r.randint(1, 2))]
    return {"evidence_id": f"e{k}", "domain_id": "d" if k % 3 else "other", "source_type": "om", "timestamp": f"2024-01-{10 + k}T00:00:00Z", "step_records": steps, "document_relation_mentions": document}


@pytest.fixture(scope="module")
def decided(spark):
    ensure_checkpoint_dir(spark)
    rows = [(d, label, True, anchor, None) for d in ("d", "other") for label, anchor in KINDS]
    return spark.createDataFrame(rows, "domain_id string, label string, admit boolean, parent_anchor string, reject_reason string")


def whole(spark, rows, decided):
    lines = spark.createDataFrame([(json.dumps(x), "", 0) for x in rows], "value string, file string, input_pos long")
    return assembly.assemble(evidence.order_records(evidence.canonical(parsed_lines(lines))).checkpoint(), decided)


def same(got, want):
    rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert rows(got) == rows(want)


def test_batches_late_records_and_a_restart(spark, tmp_path, decided):
    r = random.Random(6)
    rows = [told(k, r) for k in range(8)]
    # The first of all by time, and it comes last; it knows all concepts.
    late = dict(rows.pop(0), domain_id="d", timestamp="2023-01-01T00:00:00Z", step_records=[step(1, "Inspect all", "observe", KINDS)])
    (tmp_path / "in").mkdir()
    graph = GraphStream(spark, f"{tmp_path}/graph", decided)

    def arrive(name, own):
        (tmp_path / "new.jsonl").write_text("\n".join(map(json.dumps, own)) + "\n\n")
        (tmp_path / "new.jsonl").rename(tmp_path / "in" / f"{name}.jsonl")
        lines = spark.readStream.text(f"{tmp_path}/in")
        query = graph.start(lines, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()  # a restart each time
        query.awaitTermination(600)

    arrive("a", rows[:3])
    arrive("b", [*rows[3:5], rows[0]])  # one record comes twice
    assert graph.batches() == [0, 1]
    before = {x["triple_id"]: x["status"] for x in graph.triples().collect()}
    arrive("c", [late, *rows[5:]])
    want = whole(spark, [late, *rows], decided)
    same(graph.nodes(), want.nodes)
    same(graph.edges(), want.edges)
    same(graph.triples(), want.triples)
    # The late record admitted relations of records that had come before it.
    after = {x["triple_id"]: x["status"] for x in graph.triples().collect()}
    assert any(after[t] != s for t, s in before.items())


def test_a_batch_that_failed_half_way(spark, tmp_path, decided, monkeypatch):
    r = random.Random(2)
    rows = [told(k, r) for k in range(5)]
    parsed = lambda own: evidence.canonical(parsed_lines(spark.createDataFrame([(json.dumps(x), "", 0) for x in own], "value string, file string, input_pos long")))
    graph = GraphStream(spark, f"{tmp_path}/graph", decided)
    graph.add(parsed(rows[2:4]), 0)
    write = GraphStream._write

    def broken(self, df, name, batch):
        if name == "edge_evidence":
            raise OSError("lost")
        return write(self, df, name, batch)

    monkeypatch.setattr(GraphStream, "_write", broken)
    with pytest.raises(OSError):
        graph.add(parsed([rows[0], rows[4]]), 1)
    monkeypatch.setattr(GraphStream, "_write", write)
    assert graph.batches() == [0]
    same(graph.edges(), whole(spark, rows[2:4], decided).edges)
    for _ in range(2):  # again, and once more, as a restart may do
        graph.add(parsed([rows[0], rows[4]]), 1)
    want = whole(spark, [rows[0], *rows[2:]], decided)
    same(graph.edges(), want.edges)
    assert graph.edges().agg(F.sum("mentions")).first()[0] == want.edges.agg(F.sum("mentions")).first()[0]
