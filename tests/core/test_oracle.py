"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from vecspark.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def rows(records, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert rows([r.asDict() for r in got.collect()], columns) == rows(want, columns)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_small_pools_find_most(spark, sf):
    """At least what the pools of these sizes are known to find, for every mode that looks everywhere."""
    least = {10: 58.8, 20: 76.6, 40: 88.2, 80: 94.7}
    for r in QUERIES["ann_recall_curve"](spark, sf).collect():
        assert r.recall >= least[r["size"]], r
    stats = {r["mode"]: r for r in QUERIES["ann_beam_stats"](spark, sf).collect()}
    assert all(r.recall >= 90 for m, r in stats.items() if m != "scatter_top_n") and stats["scatter_top_n"].recall >= 50
    assert stats["state_send"].mean_hops == stats["client_gather"].mean_hops
    assert QUERIES["graph_maintenance"](spark, sf).first()[0] >= 90
