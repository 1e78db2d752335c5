"""Linking, fusion and projection of whole bundles; skills; clusters; components; streaming."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators.clusters import greedy_clusters
from weftline.operators.components import components
from weftline.operators.evidence import group_values, merge_multi, merge_single
from weftline.operators.linkage import candidates
from weftline.operators.score import overall_confidence
from weftline.operators.skills import CUTOFF, canonicalize, fuzzy_link, link_prose, load_taxonomy, ngrams, token_sort_ratio
from weftline.pipeline import run
from weftline.plans.fuse import fuse
from weftline.plans.project import Projection, ProjectionError
from weftline.streaming.bundles import read_stream, start

CSV = """first_name,last_name,headline,current_company,current_title,location,email,phone,linkedin_url,years_experience,top_skills,current_title_start,education_institution,education_degree,education_end_year
Ida,Berg,"Engineer | Data, ML",Northwind,Engineer,"Oslo, Norway",ida@berg.no,+47 22 33 44 55,https://linkedin.com/in/ida,9,"Python; k8s",2021-03,Uni Oslo,B.S.,2007
Max,Roe,,Initech,,Austin,max@roe.org,N/A,,twelve,,not-a-date,,,
"""
ATS = json.dumps({"first_name": "Ida", "last_name": "Berg", "email_addresses": [{"value": "ida@berg.no"}, {"value": "ida@work.no"}, "x"], "phone_numbers": [{"value": "+4722334455"}], "addresses": [{"value": "Oslo, Norway"}], "social_media_addresses": [{"value": "https://linkedin.com/in/ida"}], "employments": [{"company_name": "Northwind Inc.", "title": "Lead", "start_date": "2021-03"}], "educations": [{"school_name": "Uni Oslo", "degree": "Bachelor", "end_date": "2007"}], "skills": ["Python", {"name": "Go; SQL"}]})
GITHUB = json.dumps({"profile": {"name": "Ida Berg", "email": "IDA@berg.no", "bio": "Data", "html_url": "https://github.com/ida", "blog": "ida.dev"}, "repos": [{"name": "tool", "html_url": "https://github.com/ida/tool", "language": "Go"}, {"name": "copy", "fork": True, "language": "C"}, 5]})
NOTE = "Met Ida. Stack: Kubernetes, Go. Reach ida@berg.no"


@pytest.fixture(scope="module")
def taxonomy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tax") / "t.csv"
    path.write_text('canonical_skill,aliases\nKubernetes,"k8s, kube"\nPython,\nGo,golang\nSQL,\nMachine Learning,ml\n', encoding="utf-8")
    return load_taxonomy(spark, str(path)).cache()


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [("b1", "recruiter_csv", CSV), ("b1", "ats_json", ATS), ("b1", "github", GITHUB), ("b1", "recruiter_notes", NOTE), ("b2", "ats_json", "[1, 2"), ("b3", "recruiter_notes", "   "), ("b4", "elsewhere", "x"), ("b5", "recruiter_notes", "call 9876543210"), ("b6", "github", "")]
    return spark.createDataFrame(rows, "bundle_id string, source string, payload string")


@pytest.fixture(scope="module")
def outputs(payloads, taxonomy):
    rows = run(payloads, None, taxonomy, include_audit=True).collect()
    return {(r.bundle_id, json.loads(r.output)["full_name"]): (json.loads(r.output), r.audit_log) for r in rows}


def test_profiles(outputs):
    assert set(outputs) == {("b1", "Ida Berg"), ("b1", "Max Roe"), ("b5", "")}
    ida, _ = outputs["b1", "Ida Berg"]
    assert ida["candidate_id"] == "cand_" + hashlib.sha256(b"ida@berg.no").hexdigest()[:8]
    assert ida["emails"] == ["ida@berg.no", "ida@work.no"]
    assert ida["location"] == {"city": "Oslo", "region": None, "country": "NO"}
    assert [e["company"] for e in ida["experience"]] == ["Northwind Inc."]
    assert ida["experience"][0]["title"] == "Lead"  # .9 against Engineer, less the penalty, is over the threshold
    assert ida["education"][0]["end_year"] == 2007 and ida["education"][0]["degree"] is None
    assert [p["name"] for p in ida["projects"]] == ["tool"]
    assert ida["links"]["github"] == "https://github.com/ida" and ida["links"]["portfolio"] == "https://ida.dev"
    skills = {s["name"]: s for s in ida["skills"]}
    assert set(skills) == {"Python", "Kubernetes", "Go", "SQL"}
    assert skills["Python"]["confidence"] == pytest.approx(1 - 0.2 * 0.1) and skills["Kubernetes"]["confidence"] == pytest.approx(1 - 0.2 * (1 - 0.385))


def test_bad_values_and_audit(outputs):
    roe, audit = outputs["b1", "Max Roe"]
    assert roe["years_experience"] is None and roe["phones"] == [] and roe["experience"] == []
    said = {(e.stage, e.field, e.kind, e.reason) for e in audit}
    assert ("normalize", "phones", "value_dropped", "failed_normalization") in said
    assert ("normalize", "years_experience", "value_dropped", "failed_normalization") in said
    assert ("merge", "experience.company", "field_dropped", "winner_below_threshold") in said
    assert ("merge", "experience", "entry_dropped", "company_anchor_missing_after_merge") in said


def test_broken_payloads_are_told(payloads, taxonomy):
    said = {(r.bundle_id, r.kind, r.reason) for r in fuse(payloads, taxonomy).audit.where("root IS NULL").collect()}
    assert {("b2", "source_failed", "parse_failed"), ("b3", "source_empty", "empty_payload"), ("b4", "source_failed", "unknown_source")} <= said


def test_projection(payloads, taxonomy):
    config = {"fields": [{"name": "id", "path": "candidate_id", "type": "string", "on_missing": "error"}, {"path": "mail", "from": "emails[0]", "type": "string", "required": False}, {"name": "names", "path": "skills[].name", "type": "array"}, {"name": "last", "path": "emails[5]", "type": "string", "on_missing": "omit"}], "include_confidence": True}
    rows = [json.loads(r.output) for r in run(payloads.where("bundle_id = 'b1'"), config, taxonomy, on_error="quarantine").collect()]
    ida = next(r for r in rows if r["mail"] == "ida@berg.no")
    assert list(ida) == sorted(ida) and "last" not in ida and ida["confidence"]["id"] == 1.0
    assert len(ida["confidence"]["names"]) == len(ida["names"])
    with pytest.raises(ProjectionError):
        run(payloads, {"fields": [{"name": "x", "path": "emails", "type": "array", "normalize": "E164"}]}, taxonomy)
    bad = run(payloads.where("bundle_id = 'b5'"), {"fields": [{"name": "x", "path": "headline", "type": "string", "on_missing": "error"}]}, on_error="quarantine").first()
    assert bad.output is None and bad.errors
    assert Projection.parse(config).json_schema()["required"] == ["id"]


def test_evidence(spark):
    rows = [("k", "f", "a", "s1", "direct", 0.8, 0), ("k", "f", "a", "s2", "direct", 0.9, 1), ("k", "f", "b", "s1", "direct", 0.7, 2), ("k", "f", None, "s1", "direct", 0.7, 3)]
    g = group_values(spark.createDataFrame(rows, "k string, field string, value string, source string, method string, confidence double, ord int"), ["k"])
    m = merge_single(g, ["k"]).first()
    assert (m.value, m.source, m.method, m.losing_sources, m.kept) == ("a", "s2", "merged", 1, True)
    assert m.confidence == pytest.approx(0.98 * 0.85)
    assert [i["value"] for i in merge_multi(g, ["k"]).first()["items"]] == ["a", "b"]


def test_score_of_agreeing_sources(spark):
    """Acceptance values: a profile of all families, one of a single source, one of nothing."""
    means = {"full_name": 0.994, "emails": 0.9631, "phones": 0.9877, "location": 0.833, "links": 0.97885, "headline": 0.8, "years_experience": 0.8, "skills": 0.699, "experience": 0.98, "education": 0.8992, "projects": 0.7}
    one = spark.range(1)
    score = lambda families: one.select(overall_confidence({k: F.lit(v) for k, v in families.items()}).alias("s")).first().s
    assert score(means) == pytest.approx(0.924211, abs=2e-5)
    assert score({k: 0.8 for k in means}) == pytest.approx(0.8)
    assert score({}) == 0.0 and score({"emails": 0.0}) == 0.0


def test_components(spark):
    random.seed(1)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_attachment(spark):
    rec = [("one", 1, "a"), ("one", 2, "b"), ("none", 3, "a"), ("none", 4, "b"), ("many", 5, "a"), ("many", 6, "a"), ("two", 7, "a"), ("two", 8, "a"), ("two", 9, "b")]
    records = spark.createDataFrame(rec, "bundle_id string, node bigint, source string")
    tokens = spark.createDataFrame([("one", 2, "t"), ("two", 7, "x"), ("two", 8, "y")], "bundle_id string, node bigint, token string")
    got = {r.node: r.root for r in candidates(records, tokens).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}


def test_clusters(spark):
    rows = [("g", "k", 1, "a", None), ("g", "k", 2, None, None), ("g", "k", 3, "b", None), ("g", "k", 4, "a", "z"), ("g", "k", 5, "b", "y"), ("g", "j", 6, "a", None)]
    out = greedy_clusters(spark.createDataFrame(rows, "g string, key string, ord int, e1 string, e2 string"), ["g"], "key", ["e1", "e2"])
    assert {r.ord: r.cluster for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 3, 6: 6}


def test_skills(spark, taxonomy):
    forms = spark.createDataFrame([("k8s",), ("Kubernetess",), ("golang",), ("gl",), ("In House Tool",), (None,)], "x string")
    got = {r.x: r.canonical for r in canonicalize(forms, "x", taxonomy).collect()}
    assert got == {"k8s": "Kubernetes", "Kubernetess": "Kubernetes", "golang": "Go", "gl": "gl", "In House Tool": "In House Tool", None: None}
    pair = spark.createDataFrame([("kubernets", "kubernetes"), ("a b", "b a")], "a string, b string").select(F.round(token_sort_ratio(F.col("a"), F.col("b")), 2).alias("r"))
    assert [r.r for r in pair.collect()] == [94.74, 100.0]


def test_prose(spark, taxonomy):
    """Exact and similar forms, gates of short words and of runs that end in no noun, overlaps, repeats."""
    cases = {
        "We run Kubernetess daily. Tools: x; go | sql": [("Kubernetes", "Kubernetess", "fuzzy"), ("Go", "go", "exact"), ("SQL", "sql", "exact")],
        "They go there at once; ml is hard": [],
        "Stack: a bit of Go and ML": [("Go", "Go", "exact"), ("Machine Learning", "ML", "exact")],
        "Regards, - G": [],
        "Golang, golang; GO/ Python.": [("Go", "Golang", "exact"), ("Python", "Python", "exact")],
        "machine\n learning and machine-learning": [("Machine Learning", "machine\n learning", "exact")],
        "machine learning the": [("Machine Learning", "machine learning", "exact")],
        "machin learning, pythons?": [("Machine Learning", "machin learning", "fuzzy")],
        "Go": [("Go", "Go", "exact")],
        "": [],
        None: [],
        "nothing " * 5000 + "python": [("Python", "python", "exact")],
    }
    texts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "id int, note string, alias string").select("id", "note")
    got = {r.id: [(x.canonical, x.surface, x.method) for x in r.skills] for r in link_prose(texts, ["id"], "note", taxonomy).collect()}
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())
    # The gate is a parameter.
    strict = link_prose(texts, ["id"], "note", taxonomy, gate=lambda alias: F.lit(False))
    assert {x.method for r in strict.collect() for x in r.skills} == {"exact"}


def test_prose_of_many_rows_is_not_broadcast(spark):
    taxonomy = spark.createDataFrame([("go", "Go", "go"), ("python", "Python", "python")], "alias string, canonical string, surface string")
    rows = [(i, f"Go, {'python' if i % 2 else 'rust'}") for i in range(20)] + [(3, "Go, python"), (None, "Go"), (21, "rust"), (22, None)]
    linked = link_prose(spark.createDataFrame(rows, "id int, note string"), ["id"], "note", taxonomy)
    want = [(i, ["Go", "Python"] if i and i % 2 else ["Go"]) for i, _ in rows if i is None or i < 20]
    assert sorted([(r.id, [x.canonical for x in r.skills]) for r in linked.collect()], key=repr) == sorted(want, key=repr)
    # Only the table of known aliases goes to every task: runs and texts are as many as the data has.
    plan = linked._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and "Generate" not in plan


def test_ngrams_are_as_written(spark):
    t = "a, b.c  C++ (x)"
    row = spark.createDataFrame([(t,), ("...",)], "t string").select(ngrams(F.col("t")).alias("g")).collect()
    words = [m.span() for m in re.finditer(r"\.?[A-Za-z0-9][A-Za-z0-9.+#-]*", t)]
    want = [(i + 1, n, t[words[i][0] : words[i + n - 1][1]].rstrip(".,;:!?")) for i in range(len(words)) for n in (3, 2, 1) if i + n <= len(words)]
    assert [tuple(x) for x in row[0].g] == want and row[1].g == []


def _ratio(a, b):
    """Token-sort ratio of two aliases, by the table of common subsequences."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x, 1):
        for j, d in enumerate(y, 1):
            rows[i][j] = rows[i - 1][j - 1] + 1 if c == d else max(rows[i - 1][j], rows[i][j - 1])
    return 200.0 * rows[-1][-1] / (len(x) + len(y))


def test_fuzzy_link_of_all_lengths(spark):
    random.seed(5)
    known = {"".join(random.choices("abcdef", k=n)) for n in range(16, 41) for _ in range(2)} | {"language natural processing"}
    forms = {"natural language process"}
    for k in known:  # one to five characters more or fewer
        for d in range(1, 6):
            at = random.randrange(len(k) - d)
            forms |= {k[:at] + "z" * d + k[at:], k[:at] + k[at + d :]}
    forms -= known
    want = {}
    for f in forms:
        near = [(-r, k) for k in known if (r := _ratio(f, k)) >= CUTOFF]
        if near:
            want[f] = min(near)[1]
    table = spark.createDataFrame([(k, k, k) for k in known], "alias string, canonical string, surface string")
    got = {r.alias: r.surface for r in fuzzy_link(spark.createDataFrame([(f,) for f in forms], "alias string"), table).collect()}
    assert got == want and got["natural language process"] == "language natural processing"


def test_taxonomy_collision(spark, tmp_path):
    (tmp_path / "t.csv").write_text("canonical_skill,aliases\nGo,g\nGee,g\n")
    with pytest.raises(ValueError, match="collision"):
        load_taxonomy(spark, str(tmp_path / "t.csv"))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"bundle_id": "s", "source": "recruiter_notes", "payload": "ida@berg.no"}) + "\n")
    start(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1 and json.loads(rows[0].output)["emails"] == ["ida@berg.no"]
