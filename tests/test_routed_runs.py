"""Runs that retrieve anchors by vectors, take curated concepts, families and constraint files, against runs that don't."""

import json

import pytest
from pyspark.sql import functions as F
from test_assembly import RECORDS, step

from stepweave import constants as K
from stepweave import runs
from stepweave.operators import graph, routing
from stepweave.session import ensure_checkpoint_dir
from stepweave.settings import SettingsError
from stepweave.sources import artifacts

#: Directions of the fake model: a text looks where its words point, the first that it has.
WORDS = ("valve", "pump", "fault leak", "odor signal", "pack asset", "seal")


def fake(calls):
    """A model of vectors as a plan of columns; calls gets the texts asked for."""

    def embed(missing):
        calls.extend(r["text"] for r in missing.select("text").collect())
        lower = F.lower("text")
        has = [F.coalesce(*(F.when(F.contains(lower, F.lit(w)), 1.0) for w in words.split()), F.lit(0.0)) for words in WORDS]
        return missing.withColumn("vector", F.array(*has, F.lit(0.01)))

    return embed


def write(folder, name, value):
    (folder / name).write_text(json.dumps(value))
    return str(folder / name)


@pytest.fixture
def told(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    plain = step(1, "Inspect manifold", "observe", [("relief valve", None), ("bleed valve", None), ("manifold", None), ("pump", None)], [], [("inspects", "manifold")], structural_edges=[{"label": "contains", "head": "relief valve", "tail": "pump"}])
    more = {"evidence_id": "e3", "domain_id": "d", "source_type": "om", "timestamp": "2024-03-01T00:00:00Z", "step_records": [plain]}
    other = dict(more, evidence_id="f1", domain_id="f")
    evidence = write(tmp_path, "e.json", {"samples": [*RECORDS, more]})
    (tmp_path / "f.jsonl").write_text(json.dumps(other) + "\n")
    concepts = write(tmp_path, "concepts.json", {"Valve": "a valve of any kind"})
    domains = [{"domain_id": "d", "data_path": evidence, "source_types": ["om"], "ontology_seed_path": concepts}, {"domain_id": "f", "data_path": f"{tmp_path}/f.jsonl", "source_types": ["om"]}]
    return {"project_name": "p", "domains": domains, "variants": [{"variant_id": "plain"}, {"variant_id": "near", "strategy": "embedding_top1", "routing": "baseline"}], "vectors_path": f"{tmp_path}/vectors", "embedding_model": "fake"}


def ran(spark, tmp_path, told, embed=None):
    return runs.run(spark, runs.load_settings(write(tmp_path, "s.json", told)), export=False, embed=embed)


def test_routes_and_curated_backbone(spark, tmp_path, told):
    calls = []
    made = ran(spark, tmp_path, told, embed=fake(calls))
    near, plain = ({(r["domain_id"], r["label"]): r for r in made[v][0].nodes.collect()} for v in ("near", "plain"))
    # The curated concept is a node of every domain, and candidates that the model finds near it specialize it.
    assert all(n["d", "Valve"]["node_type"] == n["f", "Valve"]["node_type"] == "backbone_concept" for n in (near, plain))
    assert near["d", "bleed valve"]["parent_anchor"] == near["f", "bleed valve"]["parent_anchor"] == "Valve" and ("d", "bleed valve") not in plain
    # What has a structural relation can't be of an anchor that the family doesn't know.
    assert ("d", "relief valve") not in near
    assert "d::edge::bleed valve::is_a::Valve" in {r["edge_id"] for r in made["near"][0].edges.collect()}
    assert len([n for n in near.values() if n["node_type"] == "backbone_concept"]) == 2 * (len(K.ANCHORS) + 1)
    judged = {(r["domain_id"], r["label"]): r for r in made["near"][1].collect()}
    best = judged["d", "relief valve"]["retrieved"]
    assert [r["rank"] for r in best] == [1, 2, 3] and best[0]["anchor"] == "Valve" and best[0]["score"] > best[1]["score"]
    # Every text was asked for once, and a second run finds all of them kept.
    assert len(calls) == len(set(calls)) > len(K.ANCHORS)
    held = artifacts.load_vectors(spark, f"{tmp_path}/vectors", "fake").count()
    asked = len(calls)
    again = ran(spark, tmp_path, told, embed=fake(calls))
    assert held == asked == len(calls)
    assert sorted(map(repr, again["near"][0].edges.collect())) == sorted(map(repr, made["near"][0].edges.collect()))


def test_contextual_routing(spark, tmp_path, told):
    told["variants"] = [{"variant_id": "near", "strategy": "embedding_top1", "routing": "contextual_rerank", "top": 2}]
    calls = []
    made, judged = ran(spark, tmp_path, told, embed=fake(calls))["near"]
    got = {(r["domain_id"], r["label"]): r["retrieved"] for r in judged.collect()}
    assert all(len(x) == 2 for x in got.values()) and got["f", "relief valve"][0]["anchor"] == "Valve"
    # A hint weighs more than words do: leak is hinted a Fault.
    assert got["d", "leak"][0]["anchor"] == "Fault" and any("Typical terms" in c for c in calls) and any(" | relations: " in c for c in calls)


def test_routing_needs_a_model(spark, tmp_path, told):
    with pytest.raises(SettingsError, match="needs a model"):
        ran(spark, tmp_path, told)
    with pytest.raises(SettingsError, match="needs routing"):
        runs.load_settings(write(tmp_path, "s.json", told | {"variants": [{"variant_id": "x", "strategy": "embedding_top1"}]}))
    with pytest.raises(ValueError, match="unknown routing mode"):
        routing.routed(spark.range(1), spark.range(1), None, "odd")


def test_families_and_constraint_files(spark, tmp_path, told):
    """Two domains under different rules in one run, and a run that takes some families alone."""
    any_ = sorted({*K.STRUCTURAL_ANCHORS, "Valve", "Signal", "Fault", "State", "Task"})
    loose = {f: {"allowed_head_types": any_, "allowed_tail_types": any_} for f in K.TYPE_CONSTRAINTS}
    strict = loose | {"structural": {"allowed_head_types": ["Asset"], "allowed_tail_types": ["Asset"]}}
    told["variants"] = [{"variant_id": "v"}]
    for d in told["domains"]:
        d["constraints_path"] = write(tmp_path, f"c{d['domain_id']}.json", strict if d["domain_id"] == "d" else loose)
    hinted = [("relief valve", "Component"), ("pump", "Component")]
    same = step(1, "Inspect", "observe", hinted, [], [], structural_edges=[{"label": "contains", "head": "relief valve", "tail": "pump"}])
    told["domains"][0]["data_path"] = write(tmp_path, "x.json", {"samples": [{"evidence_id": "x", "domain_id": "d", "source_type": "om", "timestamp": "2024", "step_records": [same]}]})
    told["domains"][1]["data_path"] = write(tmp_path, "y.json", {"samples": [{"evidence_id": "y", "domain_id": "f", "source_type": "om", "timestamp": "2024", "step_records": [same]}]})
    reasons = lambda: {r["domain_id"]: r["reject_reason"] for r in ran(spark, tmp_path, told)["v"][0].triples.where("label = 'contains'").collect()}
    assert reasons() == {"d": "type_constraint:head type 'Component' not allowed for family 'structural' (allowed: ['Asset'])", "f": None}
    told["relation_families"] = ["lifecycle"]
    assert reasons() == dict.fromkeys("df", "invalid_relation_family")
    told |= {"relation_families": list(K.TYPE_CONSTRAINTS), "validate_relations": False}
    assert reasons() == {"d": None, "f": None}


def test_rules_of_a_table_give_the_fixed_reasons(spark):
    """Reasons by a relation of rules are those of the fixed table, for every family and type, known or not."""
    types = [*K.ANCHORS, "Task", "Odd", None]
    rows = [(d, f, h, t) for d in ("d", "own", "none") for f in (*K.TYPE_CONSTRAINTS, "odd", None) for h in types for t in types]
    df = spark.createDataFrame(rows, "domain_id string, family string, h string, t string")
    rules = graph.constraint_rules(spark, {None: K.TYPE_CONSTRAINTS, "own": {"structural": ((), ("Asset",))}})
    placed = graph.with_constraints(df, rules)
    assert placed.count() == len(rows)
    got = placed.select("*", graph.rule_reason(F.col("family"), F.col("h"), F.col("t"), F.col("_rule")).alias("got"), graph.type_reason(F.col("family"), F.col("h"), F.col("t")).alias("want"))
    assert got.where("domain_id <> 'own' AND NOT got <=> want").isEmpty()
    own = {(r["family"], r["h"], r["t"]): r["got"] for r in got.where("domain_id = 'own'").collect()}
    assert own["structural", "Asset", "Asset"] == "head type 'Asset' not allowed for family 'structural' (allowed: [])"
    assert own["lifecycle", "Asset", "State"] == "family 'lifecycle' not defined in constraints"


def test_a_model_decides(spark, tmp_path, told):
    """A variant of strategy llm: the model sees what was retrieved and recommended, is asked once for each prompt over two runs, and what it leaves out is rejected."""
    (tmp_path / "asked").mkdir()
    folder = f"{tmp_path}/asked"

    def generate(prompt):
        import json
        import uuid

        listed = json.loads(prompt.split("|", 1)[1])
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(listed, f)
        return json.dumps({"decisions": [{"candidate_id": c["candidate_id"], "route": c["prior"]["recommended_route"], "parent_anchor": c["prior"]["recommended_anchor"], "confidence": 0.9} for c in listed if c["label"] != "manifold"]})

    told["variants"] = [{"variant_id": "m", "strategy": "llm", "routing": "baseline"}]
    settings = runs.load_settings(write(tmp_path, "s.json", told))
    labels = (*K.ANCHORS, "Valve")
    propose = runs.by_model("__DOMAIN_ID__|__CANDIDATES_JSON__", generate, f"{tmp_path}/answers", "m", 4, labels)
    for _ in range(2):
        made, judged = runs.run(spark, settings, propose, export=False, embed=fake([]))["m"]
        got = {(r["domain_id"], r["label"]): r for r in judged.collect()}
        assert got["d", "bleed valve"]["outcome"] == "adapter" and got["d", "manifold"]["reject_reason"] == "llm_no_decision"
    files = list((tmp_path / "asked").iterdir())
    seen = [c for f in files for c in json.loads(f.read_text())]
    assert len(seen) == len({c["candidate_id"] for c in seen}) == len(got) and max(len(json.loads(f.read_text())) for f in files) <= 4
    assert any(c["retrieved_anchors"][0]["anchor"] == "Valve" for c in seen)
    assert {r["parent_anchor"] for r in made.nodes.where("label = 'bleed valve'").collect()} == {"Valve"}
