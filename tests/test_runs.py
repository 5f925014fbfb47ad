"""Records from extractions, scans of manuals, and whole runs with their folders."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_assembly import RECORDS

from stepweave import cli, runs, validation
from stepweave.operators import audits, metrics, records
from stepweave.session import ensure_checkpoint_dir
from stepweave.settings import SettingsError
from stepweave.sources import artifacts, manuals

TEXT = "# Pack leak diagnosis\n| Time step | Task |\n|---|---|\n| T1 | Inspect the coolant hose. Look for leak |\n| T2 | Replace the pump seal |\n"
_DOC = "doc_id string, domain_id string, role string, doc_type string, timestamp string, content string"
_CONCEPT = "doc_id string, pos int, label string, description string, surface_form string, node_worthy boolean, hint string, hypernym string"
_RELATION = "doc_id string, pos int, label string, family string, head string, tail string"


def composed(spark, docs, concepts=(), relations=(), transitions=(), diagnostics=()):
    found = records.Extracted(
        spark.createDataFrame(list(concepts), _CONCEPT), spark.createDataFrame(list(relations), _RELATION),
        spark.createDataFrame(list(transitions), "doc_id string, pos int, from_state string, to_state string, trigger_step string, evidence_label string"),
        spark.createDataFrame(list(diagnostics), "doc_id string, pos int, evidence_label string, indicated_label string, mechanism string"),
    )
    out = records.compose_records(spark.createDataFrame([(d, "battery", "target", "om_manual", "2024", t) for d, t in docs], _DOC), found)
    return {r["evidence_id"]: r.asDict(True) for r in out.collect()}


def test_composed_record(spark):
    concepts = [("a", 0, "coolant hose", "d", "", None, "component", None), ("a", 1, "pump seal", None, None, True, None, "Seal"), ("a", 2, "stray label", "", None, True, None, None), ("a", 3, "T1", None, None, True, None, None)]
    relations = [
        ("a", 0, "inspects", "task_dependency", "T1", "coolant hose"), ("a", 1, "triggers", "", "T1", "T2"), ("a", 2, "indicates", "communication", "coolant hose", "pump seal"),
        ("a", 3, "contains", "structural", "T2", "pump seal"), ("a", 4, "", "structural", "x", "y"), ("a", 5, "inspects", "task_dependency", "T1", "coolant hose"),
    ]
    got = composed(spark, [("a", TEXT)], concepts, relations, [("a", 0, "wet", "dry", "T2", ""), ("a", 1, "x", "y", "T9", "")], [("a", 0, "coolant hose", "leak", "communication")])["a"]
    one, two = got["step_records"]
    assert [(r["head"], r["label"], r["tail"]) for r in one["relation_mentions"]] == [("T1", "inspects", "coolant hose"), ("T1", "triggers", "T2")]
    assert one["step_summary"] == "Inspect the coolant hose" and one["sequence_next"] == "T2" and two["sequence_next"] is None
    assert [m["label"] for m in one["concept_mentions"]] == ["coolant hose"] and one["concept_mentions"][0]["semantic_type_hint"] == "Component"
    assert [a["target_label"] for a in one["step_actions"]] == ["coolant hose", "coolant hose"] and one["diagnostic_edges"][0]["indicated_label"] == "leak"
    assert two["structural_edges"][0]["tail"] == "pump seal" and [(t["from_state"], t["trigger_step"]) for t in two["state_transitions"]] == [("wet", "T2")]
    assert [m["label"] for m in got["document_concept_mentions"]] == ["stray label"]
    assert [(c["head_step"], c["tail_step"]) for c in got["cross_step_relations"]] == [("T1", "T2")]
    assert got["procedure_meta"]["primary_fault_type"] == "leak"


def test_records_without_steps_or_extractions(spark):
    relations = [("b", 0, "contains", "structural", "zeta", "alpha"), ("b", 1, "contains", "structural", "zeta", "alpha")]
    concepts = [("b", 0, "zeta", None, None, True, None, None), ("b", 1, "alpha", None, None, True, None, None), ("b", 2, "", None, None, True, None, None), ("b", 3, None, None, None, True, None, None)]
    got = composed(spark, [("b", "no table"), ("c", TEXT), ("n", None)], concepts, relations)
    assert [m["label"] for m in got["b"]["document_concept_mentions"]] == ["zeta", "alpha"] and got["b"]["step_records"] == []
    assert len(got["b"]["document_relation_mentions"]) == 1
    assert [s["step_id"] for s in got["c"]["step_records"]] == ["T1", "T2"] and got["c"]["document_concept_mentions"] == []
    assert got["n"]["step_records"] == [] and got["n"]["cross_step_relations"] == []
    assert composed(spark, []) == {}


def test_domain_scan(spark, tmp_path):
    for folder, name, text in (("battery", "BATOM_001.md", TEXT), ("ev_om_manual_en", "x.md", "﻿" + TEXT), ("other", "y.md", "letter")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(text)
    got = manuals.read_domains(spark, str(tmp_path), ["battery", "nev", "cnc"]).orderBy("domain_id").collect()
    assert [(r["domain_id"], r["doc_id"], r["title"], r["doc_type"]) for r in got] == [("battery", "BATOM_001", "Pack leak diagnosis", "om_manual"), ("nev", "x", "Pack leak diagnosis", "om_manual")]
    with pytest.raises(PySparkException, match="no manual"):
        manuals.read_domains(spark, str(tmp_path), ["other"]).collect()
    (tmp_path / "battery_om_manual_en").mkdir()
    (tmp_path / "battery_om_manual_en" / "z.md").write_text(TEXT)
    with pytest.raises(SettingsError, match="more than one folder"):
        manuals.read_domains(spark, str(tmp_path), ["battery"])


def test_small_files(spark, tmp_path):
    def file(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    rules = file("c.json", {"$schema": "x", "description": "y", "_n": 1, "structural": {"allowed_head_types": ["Asset"], "allowed_tail_types": ["Component"]}})
    assert manuals.read_constraints(spark, rules) == {"structural": (("Asset",), ("Component",))}
    assert manuals.read_concepts(spark, file("l.json", ["Valve", {"label": " Pipe ", "description": "tube"}, {"label": "Rod"}])) == {"Valve": "Valve", "Pipe": "tube", "Rod": "Rod"}
    with pytest.raises(SettingsError, match="entry 1"):
        manuals.read_concepts(spark, file("bad.json", {"concepts": {"": "x"}}))
    more = manuals.supplements(spark, {"a": file("a.json", {"concepts": {"Valve": "first", "Asset": "not new"}}), "b": None, "c": file("d.json", {"Valve": "second"})})
    got = {r["label"]: (r["description"], r["origin"], r["domain_id"]) for r in audits.build_backbone(more).collect()}
    assert got["Valve"] == ("first", "curated", "a") and got["Asset"][1] == "seed"


def test_validators():
    assert validation.domain_id("cnc_1") == "cnc_1" and validation.score(0.123456) == 0.1235 and validation.positive(1) == 1 and validation.label("a-B_1") == "a-B_1"
    for check, bad in ((validation.domain_id, "1x"), (validation.variant_id, ""), (validation.label, "a b"), (validation.score, 1.1), (validation.positive, 0), (validation.domain_id, "a\n")):
        with pytest.raises(SettingsError):
            check(bad)


def test_gold_of_documents(spark):
    gold = spark.createDataFrame([("d", "EV Man 1", "x"), ("d", "EV Man 1", "y"), ("d", "none", "z"), ("d", "man_2", "w")], "domain_id string, source_doc string, label string")
    ids = spark.createDataFrame([("evman1",), ("long_man_2_name",), (None,)], "evidence_id string")
    assert sorted(r["label"] for r in metrics.gold_of_documents(gold, ids).collect()) == ["w", "x", "y"]


def test_containment_equals_brute_force(spark):
    """Ids of few letters and all lengths, empty ones and others than ASCII: the gold rows of a comparison of all with all, without one in the plan."""
    import random

    r = random.Random(9)
    text = lambda: "".join(r.choice("abü") for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])))
    for n in range(4):
        docs, ids = [text() for _ in range(60)], [text() + ("q" if n else "") for _ in range(25)]
        gold = spark.createDataFrame([("d", d, f"l{k}") for k, d in enumerate(docs)], "domain_id string, source_doc string, label string")
        found = metrics.gold_of_documents(gold, spark.createDataFrame([(i,) for i in ids], "evidence_id string"))
        assert sorted(x["label"] for x in found.collect()) == sorted(f"l{k}" for k, d in enumerate(docs) if any(d in i or i in d for i in ids))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert metrics.gold_of_documents(gold, spark.createDataFrame([], "evidence_id string")).isEmpty()


def test_missing_decision_fails(spark):
    candidates = spark.createDataFrame([("d", "a"), ("d", "b")], "domain_id string, label string")
    decided = spark.createDataFrame([("d", "a", True, "vertical_specialize", None)], "domain_id string, label string, admit boolean, route string, reject_reason string")
    with pytest.raises(PySparkException, match="no decision on"):
        audits.judged_candidates(candidates, decided, candidates.select("label")).collect()


def test_vectors_and_records_are_added_once(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "one", [1.0]), ("h2", "two", [2.0])], "text_hash string, text string, vector array<double>")
    for _ in range(2):
        artifacts.save_vectors(rows, f"{tmp_path}/v", "m")
    assert artifacts.load_vectors(spark, f"{tmp_path}/v", "m").count() == 2 and artifacts.load_vectors(spark, f"{tmp_path}/v", "other").count() == 0
    told = spark.createDataFrame([("e1", "d", "x"), ("e2", "f", "y")], "evidence_id string, domain_id string, raw_text string")
    for _ in range(2):
        artifacts.write_records(told, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2


def test_run_and_its_folder(spark, tmp_path, capsys):
    ensure_checkpoint_dir(spark)
    (tmp_path / "e.json").write_text(json.dumps({"samples": RECORDS}))
    told = {"project_name": "p", "output_path": f"{tmp_path}/out", "domains": [{"domain_id": "d", "data_path": f"{tmp_path}/e.json", "source_types": ["om"]}], "variants": [{"variant_id": "full", "detailed": True}]}
    (tmp_path / "s.json").write_text(json.dumps(told))
    made, judged = runs.run(spark, runs.load_settings(f"{tmp_path}/s.json"))["full"]
    total = made.nodes.count()
    assert total > 0 and judged.where("outcome = 'adapter'").count() > 0
    row = spark.read.json(f"{tmp_path}/out/full/summaries/data_flow").first()
    assert row["graph_node_count"] == total and row["candidate_triple_count"] == made.triples.count() and row["schema_candidate_count"] == judged.count()
    last = spark.read.json(f"{tmp_path}/out/latest_summary").first()
    assert (last["variant_id"], last["node_count"], last["rejected_triple_count"]) == ("full", total, made.triples.where("status <> 'accepted'").count())
    first = made.snapshots.orderBy("record_idx").first()
    nodes, edges = artifacts.load_snapshot(spark, f"{tmp_path}/out", "full", "d", first["snapshot_id"])
    assert (nodes.count(), edges.count()) == (first["node_count"], first["edge_count"]) and nodes.count() < total
    with pytest.raises(KeyError):
        artifacts.load_snapshot(spark, f"{tmp_path}/out", "full", "d", "nothing")
    assert spark.read.text(f"{tmp_path}/out/full/graphml/d").where(F.col("value").startswith("<node")).count() > 0
    state = ["--run-dir", f"{tmp_path}/out", "--variant", "full", "--domain", "d"]
    assert cli.main(["replay", *state]) == 0 and f"{total} nodes" in capsys.readouterr().out
    assert cli.main(["rollback", *state, "--snapshot", "nothing"]) == 1 and "nothing" in capsys.readouterr().err


def test_settings_are_checked(tmp_path):
    for told, words in (
        ({"project_name": "p", "domains": [], "variants": []}, "needs a domain"), ({"project_name": "p", "domains": [{"domain_id": "d", "data_path": "x"}], "variants": [{"variant_id": "v", "strategy": "odd"}]}, "strategy"),
        ({"project_name": "p", "odd": 1}, "no odd"), ({"project_name": "p", "domains": [{"domain_id": "d", "data_path": "x"}] * 2, "variants": [{"variant_id": "v"}]}, "twice"),
    ):
        (tmp_path / "s.json").write_text(json.dumps(told))
        with pytest.raises(SettingsError, match=words):
            runs.load_settings(f"{tmp_path}/s.json")


def test_composing_deals_rows_out_few_times(spark):
    """The parts of steps are grouped together: before, the plan of the last job alone had 29 exchanges."""
    from stepweave.plans.queries import QUERIES

    plan = QUERIES["composed_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 12


def test_a_repeated_relation_stands_at_its_first_place(spark):
    relations = [("a", k, *r) for k, r in enumerate([("inspects", "task_dependency", "T1", "pump"), ("triggers", "", "T1", "T2"), ("contains", "structural", "T1", "hose"), ("inspects", "task_dependency", "T1", "pump"), ("contains", "structural", "T1", "hose")])]
    one, two = composed(spark, [("a", TEXT)], (), relations)["a"]["step_records"]
    assert [(r["label"], r["tail"]) for r in one["relation_mentions"]] == [("inspects", "pump"), ("triggers", "T2"), ("contains", "hose")] and two["relation_mentions"] == []
    assert [a["target_label"] for a in one["step_actions"]] == ["pump", "pump"] and [e["tail"] for e in one["structural_edges"]] == ["hose", "hose"]
