"""Evidence files read in byte ranges of any size give the records of whole files."""

import json
import random

import pytest
from test_assembly import RECORDS

from stepweave.settings import SettingsError
from stepweave.sources.readers import read_evidence
from stepweave.sources.split_json import read_evidence_split

ODD = ['quo"te', "back\\", "\\\\\"", "{[", "]}", "ü€😀", "a\\\"b", "\n\t", '"samples": [', ""]


def records(n, seed):
    r = random.Random(seed)
    return [dict(RECORDS[k % 2], evidence_id=f"e{k}", raw_text=" ".join(r.choice(ODD) for _ in range(r.randint(0, 12)))) for k in range(n)]


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_ranges_give_whole_files(spark, tmp_path, split):
    n = 3 if split < 64 else 12
    forms = {
        "list.json": records(n, 1), "samples.json": {"meta": {"samples": [{"evidence_id": "no"}], "text": ODD}, "samples": records(n, 2), "more": [{"evidence_id": "no"}]},
        "evidence.json": {"evidence_records": records(n, 3)}, "one.json": records(1, 4)[0], "none.json": [], "empty.json": {"samples": []}, "bom.json": records(2, 5),
        "both.json": {"evidence_records": records(2, 6), "samples": records(3, 7)},
    }
    for name, value in forms.items():
        text = json.dumps(value, ensure_ascii=name == "list.json", indent=None if name == "one.json" else 1)
        (tmp_path / name).write_text(("﻿" if name == "bom.json" else "") + text, encoding="utf-8")
    got = read_evidence_split(spark, f"{tmp_path}/*.json", split)
    want = read_evidence(spark, f"{tmp_path}/*.json")
    assert sorted(got.columns) == sorted(want.columns)
    name = lambda x: x["file"].rsplit("/", 1)[-1]
    rows = lambda df: [(name(x), repr(x[2:])) for x in sorted(df.select("file", "input_pos", *(c for c in sorted(df.columns) if c not in ("file", "input_pos"))).collect(), key=lambda x: (name(x), x[1]))]
    assert rows(got) == rows(want) and len(rows(got)) == 3 * n + 1 + 2 + 3


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    with open(tmp_path / "large.json", "w") as f:
        f.write("[" + ",\n".join(json.dumps(x) for x in records(300, 8)) + "]")
    got = read_evidence_split(spark, f"{tmp_path}/large.json", 20_000)
    assert got.select("evidence_id").distinct().count() == got.count() == 300
    tasks = got.selectExpr("spark_partition_id() AS p").distinct().count()
    assert tasks > 1


def test_broken_files_fail(spark, tmp_path):
    for name, text, words in (("a", '[{"evidence_id": "x"}', "do not close"), ("b", '[{"evidence_id": "x}]', "do not close"), ("c", '{"evidence_id": "x"}\n{"evidence_id": "y"}', "several records"), ("d", '"x"', "neither an object")):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(SettingsError, match=words):
            read_evidence_split(spark, f"{tmp_path}/{name}.json", 5)
