"""Core operators: every registered query against its SQL twin, and hand-made cases."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from stepweave import settings
from stepweave.functions import display as D
from stepweave.functions import procedures
from stepweave.functions import text as T
from stepweave.operators import attachment, decisions, evidence, extraction, graph, providers, temporal
from stepweave.plans.queries import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[k] for k in at)) for r in relation.fetchall())


def one(spark, f, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(f(F.col("x"))).collect()]


def test_labels(spark):
    assert one(spark, T.canonical_label, "Hoses", "seal  rings", "T2 check", "busbar edges", "HC-1 pins", "axes", "path status stable", "orange handle sits proud", "batteries", "glass") == ["hos", "seal ring", "T2 check", "busbar edges", "HC-1 pins", "axis", "path status", "handle proud", "battery", "glass"]
    assert one(spark, T.step_id, "t3 verify", "T3x", "xT3", None) == ["T3", None, None, None]
    assert one(spark, T.step_token, "T 12 bolts", "T1-x", "T4", "T") == ["T12", None, "T4", None]
    assert one(spark, T.step_phase, "Inspect and verify", "inspect", "replaces seal", "walk") == ["verify", "observe", "repair", None]
    assert one(spark, T.type_hint, " ASSET", "seal", None) == ["Asset", None, None]


def relations(spark, *rows):
    full = [("d", "r", 1, k, *row) for k, row in enumerate(rows, 1)]
    return spark.createDataFrame(full, "domain_id string, evidence_id string, record_idx int, seq int, origin string, label string, family string, head string, tail string")


def test_reject_chain(spark):
    nodes = spark.createDataFrame([("d", "r:T1", "workflow", "Task", 1), ("d", "r:T2", "workflow", "Task", 1), ("d", "hose", "semantic", "Component", 1), ("d", "pump", "semantic", "Component", 1), ("d", "branch path", "semantic", "Component", 1), ("d", "leak", "semantic", "Fault", 1), ("d", "wet", "semantic", "Signal", 1), ("d", "late", "semantic", "Component", 2)], "domain_id string, label string, layer string, parent_anchor string, first_record_idx int")
    stream = relations(
        spark, ("workflow", "triggers", "task_dependency", "T1", "T2"), ("workflow", "observes", "task_dependency", "T1", "hose"), ("step", "contains", "structural", "pump", "hose"), ("step", "contains", "structural", "pump", "pump"), ("step", "contains", "structural", "branch path", "hose"), ("step", "x", "odd", "pump", "hose"),
        ("step", "indicates", "communication", "wet", "leak"), ("document", "indicates", "communication", "wet", "leak"), ("step", "causes", "propagation", "leak", "pump"), ("workflow", "observes", "task_dependency", "hose", "T1"), ("step", "contains", "structural", "pump", "late"), ("workflow", "observes", "task_dependency", "T1", "none"),
    )
    supports = spark.createDataFrame([("d", "r", "wet", ["T1"]), ("d", "r", "leak", ["T1"])], "domain_id string, evidence_id string, label string, steps array<string>")
    got = {r["seq"]: (r["status"], r["reject_reason"], r["workflow_kind"]) for r in graph.judge_relations(stream, nodes, supports).collect()}
    assert got[1] == ("accepted", None, "sequence") and got[2] == ("accepted", None, "action_object") and got[3] == ("accepted", None, None)
    assert [got[k][1] for k in range(4, 13)] == ["structural_self_loop", "structural_contextual_head", "invalid_relation_family", None, "single_step_diagnostic_hypothesis", "type_constraint:tail type 'Component' not allowed for family 'propagation' (allowed: ['Fault', 'Signal', 'State'])", "semantic_to_workflow_not_allowed", "semantic_relation_requires_semantic_nodes", "tail:not_in_graph"]


def test_rules(spark):
    rows = [("Dr. Smith", None, "Component"), ("service manual", None, "Component"), ("fault", None, "Fault"), ("valve", None, "Task"), ("valve", None, "Component"), ("Asset", None, None)]
    p = spark.createDataFrame([(*r, "vertical_specialize", 0.5, None) for r in rows], "label string, description string, parent_anchor string, route string, confidence double, reject_reason string")
    assert [(r["route"], r["reject_reason"]) for r in attachment.decide(p).collect()] == [("reject", "person_name"), ("reject", "document_title"), ("reject", "low_graph_value"), ("reject", "invalid_backbone_parent"), ("vertical_specialize", None), ("reuse_backbone", None)]


def test_evidence_to_graph(spark, tmp_path):
    from stepweave.sources.readers import read_evidence, read_markdown
    from stepweave.sources.writers import graphml

    step = lambda n, *labels: {"step_id": f"T{n}", "task": {"label": f"T{n}", "node_worthy": False}, "concept_mentions": [{"label": x, "semantic_type_hint": "component", "node_worthy": True} for x in labels]}
    record = {"evidence_id": "e1", "domain_id": "d", "source_type": "om", "timestamp": "2024-01-01T00:00:00Z", "step_records": [step(1, "pump", "hose clip"), step(2, "pumps")]}
    old = {"evidence_id": "e2", "domain_id": "d", "source_type": "om", "timestamp": "2023-01-01T00:00:00Z", "concept_mentions": [{"label": "pump", "gold_parent": "asset"}]}
    (tmp_path / "a.json").write_text(json.dumps({"samples": [record]}))
    (tmp_path / "b.json").write_text(json.dumps([old]))
    (tmp_path / "c.md").write_text("# Pump check\n| Time step | O&M sample text |\n|---|---|\n| T1 | look |\n| T2 | fix |\n")
    records = evidence.order_records(read_evidence(spark, f"{tmp_path}/*.json"))
    assert [(r["evidence_id"], r["record_idx"]) for r in records.orderBy("record_idx").collect()] == [("e2", 1), ("e1", 2)]
    m = evidence.mentions(records)
    c = evidence.candidates(m, spark.createDataFrame([("d", "pump", "hose clip", "structural")], "domain_id string, head string, tail string, family string"))
    got = {r["label"]: r for r in c.collect()}
    assert set(got) == {"pump", "hose clip"} and got["pump"]["evidence_ids"] == ["e2", "e1"] and got["pump"]["hint"] == "Component" and got["pump"]["head_count"] == 1
    nodes = graph.concept_nodes(m, attachment.decide(attachment.propose(c)))
    assert {(r["label"], r["first_record_idx"]) for r in nodes.collect()} == {("pump", 1), ("hose clip", 2)}
    edges = spark.createDataFrame([("d", "pump", "contains", "hose clip", True)], "domain_id string, head string, label string, tail string, display_admitted boolean")
    lines = [r["value"] for r in graphml(nodes, edges, "d").collect()]
    assert sum("<node" in x for x in lines) == 2 and any('source="d::node::pump"' in x for x in lines)
    assert [(r["title"], len(r["steps"])) for r in read_markdown(spark, str(tmp_path)).collect()] == [("Pump check", 2)]


def test_supersede_cycle(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 7)], "id long, supersedes long")
    got = {r["id"]: r["root"] for r in temporal.supersede_roots(links, rounds=6).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: None, 8: None}


def test_display(spark):
    assert one(spark, D.action, "Performed_on", "checks", "quick pressure-test", "holds", "", "walk", None) == [None, "inspect", "verify", None, None, None, None]
    assert one(spark, D.step_summary, "For the pack, lift the cover; then look", "Check, again", "while idle") == ["lift the cover", "Check", "while idle"]
    assert one(spark, D.short_summary, "a b c d e f g h i j k l", "w" * 80 + " x", "") == ["a b c d e f g h i j", "w" * 80, ""]
    rows = [("requires", "repair", "valve", "Component"), ("requires", "repair", "flow path", "Component"), ("checks", "inspect", "pack", "Asset"), ("checks", "inspect", "seal", None), ("compares", "compare", "gap", "Signal"), ("odd", None, "x", "State")]
    p = spark.createDataFrame(rows, "label string, act string, tail string, kind string").select(D.workflow_policy(F.col("label"), F.col("act"), F.col("tail"), F.col("kind")).alias("p")).select("p.*")
    assert [tuple(r) for r in p.collect()] == [("medium", True, None), ("low", False, "weak_workflow_relation"), ("low", False, "workflow_asset_context"), ("low", False, "inspect_requires_grounded_target"), ("medium", True, None), ("low", False, "unsupported_workflow_action")]
    from stepweave.sources.readers import STEP

    def step(text, phase, relations, concepts):
        return json.dumps({"step_id": "T1", "surface_form": text, "step_phase": phase, "relation_mentions": [dict(label=a, family="task_dependency", head="T1", tail=b) for a, b in relations], "concept_mentions": [dict(label=a, semantic_type_hint=b) for a, b in concepts]})

    cases = [step("Inspect hose", "observe", [("inspects", "hose")], [("hose", "Component")]), step("Inspect both", "observe", [("inspects", "hose"), ("inspects", "pump")], [("hose", "Component"), ("pump", "Component")]), step("Walk slowly, then stop", None, [], []), step("", None, [], [])]
    assert one(spark, lambda x: D.step_label(F.from_json(x, STEP)), *cases) == ["Inspect hose (T1)", "Inspect critical components (T1)", "Walk slowly (T1)", "T1"]


def test_decisions(spark):
    rows = [("Asset", None, [], [], None), ("a", None, [], [], "Signal"), ("b", "Fault", [], ["structural"], "Component"), ("c", "Component", [], ["structural"], "Fault"), ("d", None, ["State"], ["propagation"], "Asset"), ("e", None, None, None, "Task"), ("f", "Asset", [], ["task_dependency", "propagation"], "Seal")]
    c = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "candidate_id string, label string, hint string, hint_candidates array<string>, families array<string>, top_anchor string")
    got = [(r["route"], r["parent_anchor"], r["confidence"]) for r in decisions.top1_decisions(c).orderBy("candidate_id").collect()]
    assert got == [("reuse_backbone", None, 1.0), ("vertical_specialize", "Signal", 0.55), ("vertical_specialize", "Component", 0.55), ("vertical_specialize", "Component", 0.55), ("vertical_specialize", "State", 0.55), ("reject", None, 0.25), ("reject", None, 0.25)]
    assert [r["confidence"] for r in decisions.top1_decisions(c, least=0.6).orderBy("candidate_id").collect()][:2] == [1.0, 0.6]
    assert [r["strength"] for r in decisions.priors(c).orderBy("candidate_id").collect()] == ["low", "medium", "medium", "high", "high", "low", "low"]
    given = spark.createDataFrame([("0", "reuse_backbone", None, None, 0.9), ("1", "reuse_backbone", "Bogus", None, 0.8), ("5", "reuse_backbone", None, None, 0.7), ("9", "reject", None, "low_graph_value", 0.1)], "candidate_id string, route string, parent_anchor string, reject_reason string, confidence double")
    got = {r["candidate_id"]: (r["route"], r["parent_anchor"], r["reject_reason"]) for r in decisions.complete(c, given).collect()}
    assert got["0"] == ("reuse_backbone", None, None) and got["1"] == ("vertical_specialize", "Signal", None) and got["5"] == ("reject", None, "cannot_anchor_backbone") and got["2"] == ("reject", None, "llm_no_decision") and len(got) == 7


def test_procedures(spark):
    assert one(spark, procedures.normalize_content, "﻿## Head\n\n\n\n<b>x</b>```code\n```\n", "", None) == ["# Head\n\nx", "", None]
    assert [[tuple(x) for x in r] for r in one(spark, procedures.step_rows, "| t1 | look |\r\n| T2 || no |\n|T2| fix it |", "")] == [[("T1", "look"), ("T2", "| no"), ("T2", "fix it")], []]
    assert one(spark, procedures.document_label, " nearby hose", "vehicle ECU", "vehicle door", "T1 x") == ["hose", "ECU", "vehicle door", "T1 x"]
    assert one(spark, lambda x: procedures.document_time(x, F.lit("2020-01-01").cast("timestamp")), "on 2024-05-06T07:08:09+02:00 x", "2024-13-40 and 03-02-2021", "2022/01/02", "none") == ["2024-05-06T05:08:09Z", "2021-02-03T00:00:00Z", "2022-01-02T00:00:00Z", "2020-01-01T00:00:00Z"]
    assert one(spark, procedures.front_matter, "---\na: \"1\"\nb: x: y\na: 2\n---\ntext", "text") == [{"a": "2", "b": "x: y"}, {}]
    assert [tuple(r) if r else None for r in one(spark, procedures.procedure_meta, "# Pump leak inspection\nreplace", "hello")] == [("Pump", "inspection", "leak"), None]


def test_temporal_metrics(spark):
    held = spark.createDataFrame([("x", 1, "2024", "2025", "2024", None), ("x", 2, "2024", None, "2025", 1)], "object_id string, assertion_id long, valid_from string, valid_to string, transaction_time string, supersedes long")
    snaps = spark.createDataFrame([("d", "a", None, 1, 5, 5), ("d", "b", "z", 2, 4, 6)], "domain_id string, snapshot_id string, parent_snapshot_id string, created_at int, node_count int, edge_count int")
    roots = temporal.supersede_roots(held.select(F.col("assertion_id").alias("id"), "supersedes"))
    events = spark.createDataFrame([("x", "creation")], "object_id string, event string")
    gold = spark.createDataFrame([("x", "creation"), ("y", "update")], "object_id string, event string")
    (r,) = temporal.temporal_metrics(held, snaps, roots, events, gold).collect()
    assert (r["overlaps"], r["backward"], r["cycles"], r["orphans"], r["shrunk"], r["score"], r["event_coverage"], r["drift_rate"], r["monotonic"]) == (1, 0, 0, 1, 1, 0.4, 0.5, 0.5, 0.0)
    (r,) = temporal.temporal_metrics(held.limit(0), snaps.limit(0), roots.limit(0), events.limit(0), gold.limit(0)).collect()
    assert (r["score"], r["event_coverage"], r["drift_rate"]) == (1.0, 0.0, 0.0)


def test_relation_display(spark):
    rows = [("rejected", None, "structural", "contains", None, "x", None), ("accepted", "sequence", "task_dependency", "then", None, "r:T2", "Task"), ("accepted", "action_object", "task_dependency", "checks", "verify", "leak", "Fault"), ("accepted", "action_object", "task_dependency", "odd", None, "leak", "Fault"), ("accepted", None, "structural", "contains", None, "x", "Component"), ("accepted", None, "lifecycle", "hasState", None, "x", "State")]
    r = spark.createDataFrame(rows, "status string, kind string, family string, label string, act string, tail string, type string")
    got = r.select(D.relation_display(*(F.col(c) for c in r.columns)).alias("d")).select("d.*").collect()
    assert [tuple(x) for x in got] == [("contains", None, False, "not_accepted"), ("triggers", "high", True, None), ("verify", "high", True, None), ("odd", "low", False, "unsupported_workflow_action"), ("contains", "medium", True, None), ("hasState", "high", True, None)]


def test_aliases(spark):
    rows = [("d", "inner seal", "Component", 1), ("d", "internal lip seal", None, None), ("d", "retainer", None, None), ("d", "retainer clip", None, None), ("d", "hose clamp", None, None), ("d", "hose inlet clamp", None, None), ("d", "pump", None, None), ("d", "oil pump", None, None), ("d", "T1 x", None, None), ("d", "belt drive", "Fault", 2), ("d", "belt x drive", "Signal", 3), ("d", "a b", None, None), ("d", "a b c", None, None), ("d", "a b d", None, None), ("e", "a b", None, None), ("e", None, None, None)]
    labels = spark.createDataFrame(rows, "doc_id string, label string, hint string, pos int")
    assert sorted(map(tuple, extraction.aliases(labels).collect())) == [("d", "inner seal", "internal lip seal"), ("d", "retainer", "retainer clip")]
    assert extraction.aliases(labels.limit(0)).count() == 0


def test_surface_steps(spark):
    steps = spark.createDataFrame([("d", "T1", "The oil   Pump, (leaks) \\E here"), ("d", "T2", "oil pumps; seal ring"), ("d", "T3", "seal ring"), ("d", "T4", None)], "doc_id string, step_id string, text string")
    labels = spark.createDataFrame([("d", x) for x in ("Oil pump", "oil", "seal ring", "(leaks)", "leaks) \\E", "pump, (leaks)", None)] + [("e", "oil pump")], "doc_id string, label string")
    assert sorted(map(tuple, extraction.surface_steps(labels, steps).collect())) == [("d", "Oil pump", "T1"), ("d", "leaks) \\E", "T1"), ("d", "pump, (leaks)", "T1")]


def test_mended_relations(spark):
    concepts = spark.createDataFrame([("d", "new connector", "Component"), ("d", "Main coupler joint", "Component"), ("d", "connector shell", None), ("d", "crack", "Fault"), ("d", "shell wear", "Asset"), ("e", "joint a", None), ("e", "joint b", None)], "doc_id string, label string, hint string")
    relations = spark.createDataFrame([("d", 1, "contains", "structural", "coolant path", "retainer"), ("e", 1, "contains", "structural", "coolant path", "retainer"), ("d", 2, "contains", "structural", "pump", "retainer"), ("d", 3, "indicates", "communication", "stress whitening", "preload history"), ("e", 3, "indicates", "communication", "stress whitening", "x"), ("d", 4, "indicates", "communication", "noise", "x")], "doc_id string, pos int, label string, family string, head string, tail string")
    assert sorted((r["doc_id"], r["pos"], r["head"]) for r in extraction.mend_structural(relations, concepts).where("pos < 3").collect()) == [("d", 1, "Main coupler joint"), ("d", 2, "pump"), ("e", 1, "coolant path")]
    tails = lambda kept: sorted((r["doc_id"], r["pos"], r["tail"]) for r in extraction.mend_indicates(relations, kept).where("pos > 2").collect())
    assert tails(concepts) == [("d", 3, "preload history"), ("d", 4, "x"), ("e", 3, "x")]  # two that go equally well
    assert tails(concepts.where("label <> 'connector shell'")) == [("d", 3, "crack"), ("d", 4, "x"), ("e", 3, "x")]


def test_annotated_cross_steps(spark):
    stream = spark.createDataFrame([("r", 1, "causes", "propagation", "a", "b", "document", None, None), ("r", 2, "x", "structural", "a", "b", "step", "T9", None)], "evidence_id string, seq int, label string, family string, head string, tail string, source_field string, head_step string, tail_step string")
    crossing = spark.createDataFrame([("r", 1, "causes", "propagation", "a", "b", "T1", "T2"), ("r", 2, "causes", "propagation", "a", "b", None, "T3")], "evidence_id string, pos int, label string, family string, head string, tail string, head_step string, tail_step string")
    got = extraction.annotate_cross_steps(stream, crossing).orderBy("seq").select("source_field", "head_step", "tail_step").collect()
    assert [tuple(r) for r in got] == [("cross_step_relations", None, "T3"), ("step", "T9", None)]
    assert extraction.place_transitions(stream.select(F.col("evidence_id").alias("doc_id"), F.col("head_step").alias("trigger_step")), stream.select(F.col("evidence_id").alias("doc_id"), F.lit("T9").alias("step_id"))).count() == 1


def test_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    out, new = providers.embed_with_cache(texts, spark.createDataFrame([(None, [0.0])], "text_hash string, vector array<double>"), lambda m: m.withColumn("vector", F.array(F.lit(1.0))))
    assert sorted(r["text"] for r in out.collect()) == sorted(r["text"] for r in new.collect()) == ["a", "b"]


def test_answers():
    assert [providers.read_answer(x) for x in ('{"a": 1}', '```json\n{"a": 1}\n```', 'Well: {"a": "}{"} and {"b": 2}', "none", "{", "[1]", "", None)] == [{"a": 1}, {"a": 1}, {"a": "}{"}, None, None, None, None, None]
    answers = iter([ValueError("first"), "ok"])

    def generate(prompt):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.asked(generate, "p", wait=0) == "ok"
    with pytest.raises(StopIteration):
        providers.asked(generate, "p", wait=0)


def test_model_decisions(spark):
    rows = spark.createDataFrame([("d", f"d::{k}", json.dumps({"candidate_id": f"d::{k}"})) for k in range(5)] + [("e", "e::0", '{"candidate_id": "e::0"}'), ("e", None, None)], "domain_id string, candidate_id string, payload string")

    def generate(prompt):
        domain, listed = prompt.split("|")
        ids = [c["candidate_id"] for c in json.loads(listed)]
        assert len(ids) <= 2 and all(i.startswith(domain) for i in ids)
        return "Here: " + json.dumps({"decisions": [{"candidate_id": i, "route": "reject", "confidence": 0.5} for i in ids if i != "d::3"] + [{"candidate_id": "zz", "route": "reject"}]})

    got = providers.model_decisions(rows, "__DOMAIN_ID__|__CANDIDATES_JSON__", generate, size=2).collect()
    assert sorted((r["candidate_id"], r["route"], r["confidence"]) for r in got) == [(i, "reject", 0.5) for i in ("d::0", "d::1", "d::2", "d::4", "e::0")]
    assert providers.model_decisions(rows.limit(0), "x", generate).count() == 0


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SW_SET", "7")
    (tmp_path / "base.json").write_text('﻿{"a": {"x": 1, "y": [1]}, "b": "${SW_SET}/${SW_UNSET:-none}${SW_UNSET}"}')
    (tmp_path / "more.yaml").write_text("a: {y: [2], z: 3}\n")
    (tmp_path / "own.json").write_text('{"extends": ["base.json", "more.yaml"], "a": {"z": 4}, "c": null}')
    assert settings.load(tmp_path / "own.json") == {"a": {"x": 1, "y": [2], "z": 4}, "b": "7/none", "c": None}
    (tmp_path / "ring.json").write_text('{"extends": "ring.json"}')
    (tmp_path / "list.json").write_text("[]")
    (tmp_path / "bad.json").write_text('{"extends": 3}')
    for name in ("ring.json", "list.json", "bad.json", "none.json", "x.txt"):
        with pytest.raises(settings.SettingsError):
            settings.load(tmp_path / name)


def test_readers_and_writers(spark, tmp_path):
    """Several records in a file fail but as lines; an edge without its node fails; JSON lines keep nulls."""
    from stepweave.sources.readers import read_evidence, read_evidence_lines
    from stepweave.sources.writers import graphml, write_json_lines

    row = lambda k: json.dumps({"evidence_id": f"e{k}", "domain_id": "d", "timestamp": "2024"})
    (tmp_path / "two.json").write_text(row(1) + "\n" + row(2))
    (tmp_path / "two.jsonl").write_text("\ufeff" + row(1) + "\n\n" + row(2) + "\n")
    assert [r["evidence_id"] for r in read_evidence_lines(spark, f"{tmp_path}/two.jsonl").orderBy("input_pos").collect()] == ["e1", "e2"]
    with pytest.raises(Exception, match="several records"):
        read_evidence(spark, f"{tmp_path}/two.json").collect()
    nodes = spark.createDataFrame([("d", "a", "d::a")], "domain_id string, label string, node_id string")
    edges = spark.createDataFrame([("d", "a", "x", "b", True)], "domain_id string, head string, label string, tail string, display_admitted boolean")
    with pytest.raises(ValueError, match="no node"):
        graphml(nodes, edges, "d")
    with pytest.raises(ValueError, match="two nodes"):
        graphml(nodes.union(nodes), edges, "d")
    write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/lines")
    assert [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/lines").collect()] == [{"a": 1, "b": None}]


def test_routing_texts(spark):
    from stepweave.operators import routing

    c = spark.createDataFrame([("c", "seal", "a ring", ["x", "", "z"], ["structural"], "Component", ["Component"], "Seal"), ("e", "pump", None, None, None, None, None, None)], "candidate_id string, label string, description string, evidence_texts array<string>, families array<string>, hint string, hint_candidates array<string>, hypernym string")
    got = [r[0] for r in c.select(routing.contextual_text(c)).collect()]
    assert got == ["seal: a ring | evidence: x | relations: structural | semantic hint: Component | semantic hint candidates: Component | shared hypernym: Seal", "pump:"]
    v = c.select("candidate_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"), "hint", "hint_candidates", "hypernym", "families")
    anchors = spark.createDataFrame([("Component", 1, [[0.6, 0.8], [0.0, 1.0]]), ("Signal", 2, [[1.0, 0.0], [0.8, 0.6]])], "anchor string, position int, prototypes array<array<double>>")
    ranked = [(r["candidate_id"], r["anchor"], r["score"]) for r in routing.rerank_anchors(v, anchors, top=1).orderBy("candidate_id").collect()]
    assert ranked == [("c", "Component", pytest.approx(0.45 + 0.075 + 0.2 + 0.15)), ("e", "Signal", pytest.approx(0.75 + 0.225))] or ranked[1][1] == "Signal"
    assert routing.empty_rankings(v).count() == 0


def test_queries_reach_their_branches(spark):
    """Equal to SQL means something only where the rows differ: every reason, anchor, phase and type occurs."""
    rows = lambda name: QUERIES[name](spark, str(SF)).collect()
    assert {r["reject_reason"] for r in rows("rule_attachment")} == {
        None, "person_name", "document_title", "low_graph_value", "backbone_label_mismatch", "invalid_backbone_parent", "too_vague", "route_not_allowed", "cannot_anchor_backbone",
    }
    assert {r["anchor"] for r in rows("preferred_anchor")} == {"Signal", "Seal", "Fault", "State", "Component", "Asset", "none"}
    assert {r["phase"] for r in rows("step_phase_distribution")} == {"verify", "observe", "diagnose", "repair", "none"}
    hints = {r["hints"] for r in rows("type_hint_candidates")}
    assert {"", "Fault", "Signal", "State", "Component", "Component,Asset"} <= hints and any("," in h for h in hints - {"Component,Asset"})


def test_surface_steps_of_files_travel_without_texts(spark, tmp_path):
    """Files of few bytes, whose texts have many words: no side is broadcast, and a label is found wherever it stands."""
    filler = " ".join(f"w{k}" for k in range(200))
    rows = [(d, n, f"{filler} main valve {n % 4} {filler}") for d in range(20) for n in range(5)]
    spark.createDataFrame([*rows, (0, 3, "spare hose"), (0, 3, "spare hose")], "doc_id long, step_id long, text string").write.parquet(f"{tmp_path}/steps")
    steps = spark.read.parquet(f"{tmp_path}/steps")
    labels = spark.createDataFrame([(d, x) for d in range(20) for x in ("Main Valve 1", "main valve 0", "w7 w8", "spare hose")], "doc_id long, label string")
    out = extraction.surface_steps(labels, steps)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(0, "Main Valve 1", 1), (0, "spare hose", 3), *((d, "Main Valve 1", 1) for d in range(1, 20))]


@pytest.mark.parametrize("few", [0, 2, 64])
def test_surface_steps_of_few_and_many_labels(spark, monkeypatch, few):
    monkeypatch.setattr(extraction, "FEW_LABELS", few)
    steps = spark.createDataFrame([("d", "T1", "Main valve, (oil) pump"), ("d", "T2", "oil pump; valves"), ("d", "T2", "oil pump"), ("e", "T1", "oil pump --- ---")], "doc_id string, step_id string, text string")
    labels = spark.createDataFrame([("d", "main valve"), ("d", "Oil pump"), ("d", "(oil) pump"), ("d", "valves"), ("e", "oil pump"), ("e", "--- ---"), (None, "oil pump")], "doc_id string, label string")
    assert sorted(map(tuple, extraction.surface_steps(labels, steps).collect())) == [("d", "(oil) pump", "T1"), ("d", "Oil pump", "T2"), ("d", "main valve", "T1"), ("e", "--- ---", "T1"), ("e", "oil pump", "T1")]
