import datetime
import math

import __spark_entry__ as entry
import duckdb
import pytest
from tidewire.plans.oracles import ORACLES
from tidewire.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{v:.9g}")
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


def test_diversify_equals_a_walk(spark):
    """SQL has no such fold: the page is walked here row by row."""
    from tidewire.operators import feed
    from tidewire.plans import bindings, queries

    page = feed.page(bindings.news(spark, SF), since=queries.SINCE, limit=40).select("id", "source", "short_name").collect()
    want, sources, symbols = [], {}, {}
    for r in page:
        if len(want) < 14 and sources.get(r.source, 0) < 2 and symbols.get(r.short_name, 0) < 3:
            want.append(r.id)
            sources[r.source], symbols[r.short_name] = sources.get(r.source, 0) + 1, symbols.get(r.short_name, 0) + 1
    assert [r.id for r in QUERIES["diversify"](spark, SF).orderBy("pos").collect()] == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_nested_loops(spark):
    for name in ("price_series", "close_as_of", "trending_news", "feed_watchlist", "insert_absent"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    assert "WindowGroupLimit" in QUERIES["trending_news"](spark, SF)._jdf.queryExecution().executedPlan().toString()
