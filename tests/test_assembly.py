"""Records to graph: the stream, the reasons, the edges, snapshots and what is asserted of them."""

import json

import pytest

from stepweave.operators import assembly, evidence, graph, temporal
from stepweave.session import ensure_checkpoint_dir
from stepweave.sources.readers import read_evidence


def mention(label, hint=None, **more):
    return {"label": label, "semantic_type_hint": hint, "node_worthy": True, **more}


def step(n, text, phase, concepts=(), relations=(), actions=(), **more):
    task = {"label": f"T{n}", "surface_form": text, "node_worthy": False}
    rel = [dict(zip(("label", "family", "head", "tail"), r, strict=True)) for r in relations]
    return {"step_id": f"T{n}", "task": task, "surface_form": text, "step_phase": phase, "concept_mentions": [mention(*c) for c in concepts], "relation_mentions": rel, "step_actions": [{"action_type": a, "target_label": t} for a, t in actions], **more}


RECORDS = [
    {
        "evidence_id": "e1", "domain_id": "d", "source_type": "om", "timestamp": "2024-01-01T00:00:00Z", "raw_text": "  a \n b",
        "step_records": [
            step(1, "Inspect coolant odor", "observe", [("coolant odors", "Signal"), ("pump", "Component", )], [("observes", "task_dependency", "T1", "coolant odor")], [("observes", "coolant odor"), ("checks", "pack")], sequence_next="T2", structural_edges=[{"label": "contains", "head": "pump", "tail": "seal"}, {"label": "contains", "head": "pump", "tail": "pump"}]),
            step(2, "Confirm dry seal", "verify", [("leak", "Fault"), ("seal", "Component"), ("pack", "Asset")], [], [("confirms", "leak"), ("confirms", "ghost")], diagnostic_edges=[{"evidence_label": "coolant odor", "indicated_label": "leak", "mechanism": "communication"}], state_transitions=[{"from_state": "dry", "to_state": "leak", "trigger_step": "T1"}]),
        ],
        "document_relation_mentions": [dict(zip(("label", "family", "head", "tail"), r, strict=True)) for r in (("indicates", "communication", "coolant odor", "leak"), ("indicates", "communication", "coolant odor", "leak"), ("indicates", "communication", "leak", "seal"), ("indicates", "communication", "leak", "pump"), ("contains", "structural", "branch path", "seal"), ("x", "odd", "pump", "seal"))],
        "cross_step_relations": [{"label": "indicates", "family": "communication", "head": "coolant odor", "tail": "leak", "head_step": "T1", "tail_step": "T2"}],
    },
    {"evidence_id": "e2", "domain_id": "d", "source_type": "om", "timestamp": "2024-02-01T00:00:00Z", "step_records": [step(1, "Inspect pump", "observe", [("pump", "Component"), ("late valve", "Component")], [], [("inspects", "pump")])]},
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    ensure_checkpoint_dir(spark)
    folder = tmp_path_factory.mktemp("records")
    (folder / "r.json").write_text(json.dumps({"samples": RECORDS}))
    return evidence.order_records(evidence.canonical(read_evidence(spark, f"{folder}/r.json"))).checkpoint()


@pytest.fixture(scope="module")
def decisions(spark):
    rows = [("coolant odor", True, "Signal", None), ("pump", True, "Component", None), ("seal", True, "Seal", None), ("leak", True, "Fault", None), ("pack", True, "Asset", None), ("late valve", True, "Component", None), ("ghost", False, None, "low_graph_value")]
    return spark.createDataFrame([("d", *r) for r in rows], "domain_id string, label string, admit boolean, parent_anchor string, reject_reason string")


@pytest.fixture(scope="module")
def made(records, decisions):
    return assembly.assemble(records, decisions)


def test_stream(records):
    got = [(r["seq"], r["origin"], r["label"], r["head"], r["tail"], r["source_field"], r["head_step"], r["tail_step"]) for r in assembly.relation_stream(records).where("evidence_id = 'e1'").orderBy("seq").collect()]
    assert [g[:3] for g in got] == [(1, "workflow", "triggers"), (2, "workflow", "observes"), (3, "workflow", "checks"), (4, "workflow", "confirms"), (5, "workflow", "confirms"), (6, "step", "contains"), (7, "step", "contains"), (8, "step", "indicates"), (9, "step", "transitionsTo"), (10, "document", "indicates"), (11, "document", "indicates"), (12, "document", "indicates"), (13, "document", "contains"), (14, "document", "x")]
    assert got[0][3:] == ("T1", "T2", "sequence_next", "T1", "T2") and got[1][3:] == ("T1", "coolant odor", "step_actions", "T1", None)
    assert got[7][5:] == got[9][5:] == ("cross_step_relations", "T1", "T2") and got[8][5:] == ("state_transitions", "T1", "T2")


def test_reasons(made):
    got = {r["seq"]: r for r in made.triples.where("evidence_id = 'e1'").collect()}
    assert {k: r["reject_reason"] for k, r in got.items() if r["reject_reason"]} == {
        5: "tail:low_graph_value", 7: "structural_self_loop", 9: "semantic_relation_requires_semantic_nodes", 11: "multi_target_diagnostic_hypothesis", 12: "multi_target_diagnostic_hypothesis",
        13: "structural_contextual_head", 14: "invalid_relation_family",
    }
    assert got[2]["attachment_refs"] == ["e1:T1", "d::coolant odor"] and got[2]["triple_id"] == "d::triple::e1::2" and got[2]["confidence"] == 1.0
    assert (got[2]["display_label"], got[2]["salience"], got[2]["display_admitted"]) == ("inspect", "high", True)
    assert (got[3]["display_admitted"], got[3]["hidden"]) == (False, "workflow_asset_context") and got[7]["hidden"] == "not_accepted"
    assert got[5]["workflow_kind"] == "action_object" and got[1]["workflow_kind"] == "sequence"


def test_single_step_documents(spark, records, decisions):
    """A document's diagnosis needs both ends in steps, and not in the same one."""
    stream = assembly.relation_stream(records).where("seq = 10 AND evidence_id = 'e1'")
    nodes = assembly.graph_nodes(records, decisions)[0]
    typed = nodes.select("domain_id", "label", "layer", assembly.semantic_type(nodes).alias("parent_anchor"), "first_record_idx")
    own = lambda *rows: spark.createDataFrame([("d", "e1", *r) for r in rows], "domain_id string, evidence_id string, label string, steps array<string>")
    reason = lambda supports: graph.judge_relations(stream, typed, supports).first()["reject_reason"]
    assert reason(own(("coolant odor", ["T1"]))) == "document_semantic_requires_step_grounding"
    assert reason(own(("coolant odor", ["T1"]), ("leak", ["T1"]))) == "single_step_diagnostic_hypothesis"
    assert reason(own(("coolant odor", ["T1"]), ("leak", ["T1", "T2"]))) is None


def test_nodes_and_edges(made):
    nodes = {r["label"]: r for r in made.nodes.collect()}
    assert len(nodes) == 15 + 3 + 6 and nodes["e1:T1"]["display_label"] == "Inspect coolant odor (T1)" and nodes["e1:T1"]["node_id"] == "d::node::e1:T1"
    assert (nodes["pump"]["parent_anchor"], nodes["pump"]["provenance"], nodes["pump"]["node_type"]) == ("Component", ["e1", "e2"], "adapter_concept") and nodes["Seal"]["node_type"] == "backbone_concept"
    assert nodes["late valve"]["first_record_idx"] == 2 and nodes["e1:T2"]["order_index"] == 2
    edges = {r["edge_id"]: r for r in made.edges.collect()}
    accepted = made.triples.where("status = 'accepted'").select("head", "label", "tail").distinct().count()
    assert len(edges) == accepted + 6
    e = edges["d::edge::coolant odor::indicates::leak"]
    assert (e["source_field"], e["head_step"], e["mechanism"], e["mentions"], e["family"]) == ("cross_step_relations", "T1", "communication", 2, "communication")
    assert (edges["d::edge::pump::is_a::Component"]["provenance"], edges["d::edge::pump::is_a::Component"]["salience"]) == (["e1", "e2"], "medium")
    assert edges["d::edge::e1:T1::observes::coolant odor"]["family"] == "action_object" and edges["d::edge::e1:T1::observes::coolant odor"]["valid_from"] == "2024-01-01T00:00:00Z"


def test_snapshots(spark, made, records, decisions, tmp_path):
    snaps = [tuple(r) for r in made.snapshots.select("snapshot_id", "parent_snapshot_id", "node_count", "evidence_count").orderBy("record_idx").collect()]
    assert snaps == [("d-snapshot-001", None, 22, 1), ("d-snapshot-002", "d-snapshot-001", 24, 2)]
    before = assembly.assemble(temporal.rollback(made.snapshots, records, "d-snapshot-001"), decisions)
    assert before.nodes.count() == 22 and before.edges.count() == made.snapshots.where("record_idx = 1").first()["edge_count"]
    assert before.nodes.where("label = 'pump'").first()["provenance"] == ["e1"]
    assert sorted(map(tuple, temporal.compare_snapshots(before.nodes, made.nodes).collect())) == [("d::node::e2:T1", "added"), ("d::node::late valve", "added")]
    with pytest.raises(KeyError):
        temporal.rollback(made.snapshots, records, "none")
    path = f"{tmp_path}/manifests"
    for _ in range(2):
        temporal.ingest(made.snapshots, path)
    held = spark.read.parquet(path)
    assert held.count() == 2 and temporal.at_time(held, "2024-01-15").first()["snapshot_id"] == "d-snapshot-001" and temporal.at_time(held, "2023").first()["snapshot_id"] == "__empty__"


def test_assertions_and_events(made):
    held = made.assertions.collect()
    assert len(held) == 9 + made.edges.count() and all(r["supersedes"] is None for r in held)
    assert "d-snapshot-002::schema::d::node::late valve" in {r["assertion_id"] for r in held}
    events = made.events.collect()
    assert len({r["event_id"] for r in events}) == len(events) == len(held) + 1 and {r["event_type"] for r in events} == {"creation"}
    assert [r["description"] for r in temporal.timeline(made.events, "e1:T1").collect()] == ["e1:T1 --triggers--> e1:T2"]
    assert temporal.history(made.assertions, "d::node::pump").count() == 1


def test_audits(made, records):
    got = {(r["property"], r["value"]): r["n"] for r in graph.relation_audit(made.triples).collect()}
    assert got["status", "accepted"] == made.triples.where("status = 'accepted'").count() and got["hidden_display", "workflow_asset_context"] == 1 and got["reject_reason", "structural_self_loop"] == 1
    unit = evidence.evidence_units(records).orderBy("locator").first()
    assert (unit["locator"], unit["text"]) == ("d/om/0", "a b")


def test_state_after_every_record(spark, tmp_path):
    """For every record, the versions give what assembling the records up to it gives: values, evidence and counts."""
    from stepweave.operators import versions

    kinds = [("pump", "Component"), ("seal", "Component"), ("leak", "Fault"), ("odor", "Signal"), ("Seal", "Component")]
    told = []
    for k in range(6):
        own = [kinds[(k + j) % 5] for j in range(2 + k % 2)]
        steps = [step(1, f"Inspect {own[0][0]}", "observe", own, [], [("inspects", own[0][0])], sequence_next="T2", structural_edges=[{"label": "contains", "head": "pump", "tail": "seal"}] if k % 3 == 1 else [])]
        diagnosis = [{"evidence_label": "odor", "indicated_label": "leak", "mechanism": "propagation" if k == 5 else None}] if k > 1 else []
        steps.append(step(2, "Confirm", "verify", [kinds[k % 5]], [], [], diagnostic_edges=diagnosis))
        # Another domain runs beside, and has an evidence id that this one has too.
        told.append({"evidence_id": f"e{k if k != 4 else 3}", "domain_id": "d" if k % 4 else "other", "source_type": "om", "timestamp": f"2024-01-0{9 - k}T00:00:00Z", "step_records": steps, "document_relation_mentions": [{"label": "indicates", "family": "communication", "head": "odor", "tail": "leak"}]})
    (tmp_path / "r.json").write_text(json.dumps({"samples": told}))
    records = evidence.order_records(evidence.canonical(read_evidence(spark, f"{tmp_path}/r.json"))).checkpoint()
    decided = spark.createDataFrame([(d, label, True, anchor, None) for d in ("d", "other") for label, anchor in kinds], "domain_id string, label string, admit boolean, parent_anchor string, reject_reason string")
    whole = assembly.assemble(records, decided)
    most = records.agg({"record_idx": "max"}).first()[0]
    assert most == 4
    grown = set()
    for idx in range(1, most + 1):
        alone = assembly.assemble(records.where(f"record_idx <= {idx}"), decided)
        nodes, edges = whole.as_of(idx)
        for got, want, columns in ((nodes, alone.nodes, alone.nodes.columns), (edges, alone.edges, alone.edges.columns)):
            rows = lambda df, columns=columns: sorted(map(repr, df.select(*columns).collect()))
            assert rows(got) == rows(want)
        grown |= {(r["edge_id"], r["mechanism"], r["mentions"], len(r["provenance"])) for r in edges.collect()}
    assert {m for e, m, *_ in grown if e == "d::edge::odor::indicates::leak"} and max(g[3] for g in grown) > 1
    counts = whole.as_of(most)[0].select("label", "mentions", "evidence_count", "provenance").collect()
    assert all(r["evidence_count"] == len(r["provenance"]) <= max(r["mentions"], 1) for r in counts)
    assert whole.edge_versions.groupBy(*assembly.EDGE_KEYS, "from_idx").count().where("count > 1").isEmpty() and versions.state(whole.edge_versions, 0, assembly.EDGE_KEYS).isEmpty()


def test_numbers_and_sums(spark):
    """Row numbers and running sums equal a window's, with nulls, ties, empty tables and a group of most rows."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from stepweave.operators.ordering import ranked

    r = random.Random(4)
    rows = [(None if k % 10 == 0 else "big" if k % 10 < 7 else f"g{k % 50}", None if k % 9 == 0 else r.randrange(200), k, r.choice([None, 0, 1, 5])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, k int, v int").repartition(7)
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first(), "k")
    want = df.select("*", F.row_number().over(w).cast("long").alias("n"), F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("s"))
    for n in (1, 3, 16):
        got = ranked(df, ["g"], ["t", "k"], "n", {"s": F.col("v")}, ranges=n)
        assert got.columns == [*df.columns, "n", "s"] and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    everything = ranked(df, [], [F.col("k") % 7, "k"], ranges=5).orderBy("n").collect()
    assert [x["n"] for x in everything] == list(range(1, 3001)) and [x["k"] for x in everything] == sorted(range(3000), key=lambda k: (k % 7, k))
    assert ranked(df.limit(0), ["g"], ["t"], "n", {"s": F.col("v")}).count() == 0
    tied = ranked(df, ["g"], [F.lit(1)], "n", {"s": F.lit(1)}, ranges=6)
    assert tied.where("n <> s").isEmpty() and tied.groupBy("g").agg((F.max("n") == F.count("*")).alias("x"), (F.count_distinct("n") == F.count("*")).alias("y")).where("NOT (x AND y)").isEmpty()
    plan = ranked(df, ["g"], ["t", "k"])._jdf.queryExecution().toString()
    assert "Window" not in plan
