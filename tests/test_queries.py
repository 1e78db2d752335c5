"""Registered queries over small tables, each against its SQL."""

import os

import duckdb
import pytest

from weftline import queries

TABLES = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
#: Queries that a wrong join or a row filter would show in; all others are held against SQL over larger tables.
NAMES = ["unanchored_attach", "identity_tokens", "identity_components", "audit_events", "provenance_rows", "csv_rows", "ats_observations", "github_projects", "projected_policies", "prose_skills", "skill_fuzzy_link", "greedy_cluster", "extract_phones"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, tables, name):
    out = queries.queries()[name](spark, TABLES)
    columns = sorted(out.columns)
    result = tables.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    rounded = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    want = sorted(rounded([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(names) == columns
    assert sorted((rounded(r) for r in out.select(*columns).collect()), key=repr) == sorted(want, key=repr) and want


def test_every_customer_and_event_is_read(spark, tables):
    n = tables.execute("SELECT (SELECT count(*) FROM customer), (SELECT count(*) FROM events)").fetchone()
    assert queries.identity_components(spark, TABLES).count() == n[0]
    assert queries.unanchored_attach(spark, TABLES).count() == n[1]
