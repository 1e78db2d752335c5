"""Files in and out, the in-memory taxonomy, skills of any nesting, numbering of candidates."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators.linkage import ordered_groups, single_source_counts
from weftline.operators.skills import exact_link, taxonomy_of
from weftline.plans.normalize import normalize_ats
from weftline.sources.adapters import ats_records
from weftline.sources.files import ReadError, read_payloads, read_text, write_json


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Grüße an ida@berg.no", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    rows = read_payloads(spark, {"recruiter_notes": str(tmp_path / "a.txt")}).collect()
    assert [tuple(r) for r in rows] == [("a", "recruiter_notes", "Grüße an ida@berg.no")]
    assert read_payloads(spark, {"recruiter_notes": str(tmp_path / "a.txt")}, "mine").first().bundle_id == "mine"
    assert read_text(spark, str(tmp_path / "a.txt")).startswith("Grüße")
    for bad in ("b.txt", "none.txt"):
        with pytest.raises(ReadError):
            read_text(spark, str(tmp_path / bad))
    with pytest.raises(ReadError):
        read_payloads(spark, {"elsewhere": "x"})
    assert read_payloads(spark, {}).count() == 0
    write_json(spark.createDataFrame([('{"a":1}',), ('{"a":2}',)], "output string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1}', '{"a":2}']


def test_taxonomy_of_words(spark):
    t = taxonomy_of(spark, [" Rust ", "C++", "rust", "", "Straße"])
    assert {(r.alias, r.canonical) for r in t.collect()} == {("rust", "rust"), ("c++", "C++"), ("strasse", "Straße")}
    forms = spark.createDataFrame([("rust",), ("zig",), (None,)], "alias string")
    assert {r.alias: r.canonical for r in exact_link(forms, t).collect()} == {"rust": "rust", "zig": None, None: None}


def test_skills_of_any_nesting(spark):
    deep = "Deep"
    for _ in range(30):
        deep = [{"value": deep}]
    person = {"skills": [["Go", {"name": "SQL; go"}], {"label": "x|y"}, 5, None, {"other": "no"}, {"name": None, "value": "never"}], "custom_fields": {"Tech Stack": {"skill": ["Rust"]}, "hobby": "chess"}, "technologies": deep}
    listed = {"custom_fields_values": [{"field_name": "Core skills", "values": ["A", ["B"]]}, {"name": "note", "value": "C"}, "bare"]}
    rows = spark.createDataFrame([("b", "ats_json", json.dumps([person, listed]))], "bundle_id string, source string, payload string")
    got = normalize_ats(ats_records(rows)).select("rec_ord", F.expr("transform(filter(obs, o -> o.field = 'skills'), o -> o.value)").alias("s")).collect()
    assert {r.rec_ord: r.s for r in got} == {0: ["Go", "SQL", "x", "y", "Deep", "Rust"], 1: ["A", "B"]}


def test_numbers_of_candidates(spark):
    placed = spark.createDataFrame([("b", 5, 2), ("b", 2, 2), ("b", 7, 7), ("c", 1, 1)], "bundle_id string, node bigint, root bigint")
    assert {(r.bundle_id, r.root): r.ordinal for r in ordered_groups(placed).collect()} == {("b", 2): 0, ("b", 7): 1, ("c", 1): 0}
    records = spark.createDataFrame([("b", "x"), ("b", "x"), ("b", "y"), ("c", "y")], "bundle_id string, source string")
    assert {r.bundle_id: r.most for r in single_source_counts(records).collect()} == {"b": 2, "c": 1}
