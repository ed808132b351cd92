"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

from evigraph.plans import claim_queries, graph_queries, identity_queries, mechanism_queries, pass_queries, source_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = {name: (f, plan.ORACLE_SQL.get(name)) for plan in (graph_queries, identity_queries, claim_queries, pass_queries, source_queries, mechanism_queries) for name, f in plan.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(v):
    """A text for a value: null, NaN and '' differ, numbers are equal to 9 digits."""
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) and math.isfinite(float(v)) else str(v)
    except (TypeError, ValueError):
        return str(v)


def test_the_comparison_tells_null_from_blank():
    assert len({value(None), value(""), value(float("nan")), value(0.0), value(1e-7)}) == 5


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    query, sql = ALL[name]
    df = query(spark, SF)
    got = df.collect()
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, cur.fetchall())
