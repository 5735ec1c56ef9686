"""Stored tables: roll-ups by changed days, catalog tables, resolution and refresh."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewire.functions import sentiment
from tidewire.operators import insights, listings, rollups, upserts
from tidewire.sources import tables

NOW = datetime(2026, 1, 10, 12)


def test_changed_days_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    path = f"file://{tmp_path}/rollup"
    scores = {}
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "rollup").rglob("*.parquet")}
    for batch in range(4):
        days = range(6) if batch == 0 else rng.sample(range(6), 2)
        changed = []
        for i in range(60):
            if i % 6 in days and rng.random() < 0.8:
                new = rng.choice([None, round(rng.uniform(-1, 1), 3), 0.2, -0.2])
                changed.append((f"S{i % 4}", NOW - timedelta(days=i % 6), new, scores.get(i)))
                scores[i] = new
        before = files() if batch else {}
        rollups.applied(spark, path, spark.createDataFrame(changed, "short_name string, publish_time timestamp, sentiment double, before double"))
        touched = {f"date={(NOW - timedelta(days=d)).date()}" for d in days}
        assert {p for p, t in before.items() if files().get(p) != t} <= {p for p in before if p.parent.name in touched}
        news = spark.createDataFrame([(f"S{i % 4}", NOW - timedelta(days=i % 6), v) for i, v in scores.items()], "short_name string, publish_time timestamp, sentiment double")
        got = {(r.short_name, r.date): r for r in rollups.daily(rollups.stored(spark, path)).collect()}
        want = {(r.short_name, r.date): r for r in insights.rollup(news).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k].avg_sentiment == pytest.approx(r.avg_sentiment, abs=1e-9)
            assert [got[k][c] for c in rollups.SUMS[1:]] == [r[c] for c in rollups.SUMS[1:]]
    plan = rollups.merged(rollups.stored(spark, path), rollups.changes(spark.createDataFrame([("S0", NOW, 0.1, None)], "short_name string, publish_time timestamp, sentiment double, before double")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date#" in plan and "= 2026-01-10" in plan or "PartitionFilters: [date#" in plan


def test_tables_are_created_once_and_grow(spark):
    tables.create_tables(spark, "tw_test", buckets=4)
    spark.sql("INSERT INTO tw_test.app_config VALUES ('a', '1')")
    spark.sql("DROP TABLE tw_test.watchlist")
    spark.sql("CREATE TABLE tw_test.watchlist (short_name string, created_at timestamp, position bigint) USING parquet")
    spark.sql("INSERT INTO tw_test.watchlist VALUES ('X', NULL, 1)")
    tables.create_tables(spark, "tw_test", buckets=4)
    assert spark.table("tw_test.app_config").count() == 1
    assert spark.table("tw_test.watchlist").select("position", "backfilled_at").first() == (1, None)
    stored = spark.table("tw_test.news")
    batch = spark.createDataFrame([("X", f"u{i % 9}", i) for i in range(20)], "short_name string, url_hash string, arrival int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upserts.insert_absent(stored.select("short_name", "url_hash"), batch, ["short_name", "url_hash"], "arrival")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("FileScan parquet spark_catalog.tw_test.news") :]
    above = plan[plan.index("LeftAnti") : plan.index("FileScan parquet spark_catalog.tw_test.news")].split("\n")
    assert "Bucketed: true" in side
    assert not any("Exchange" in x for x in above[above.index(next(x for x in above if "Filter (isnotnull" in x)) - 3 :])
    spark.sql("DROP DATABASE tw_test CASCADE")


CANDIDATE = "short_name string, catalogue_name string, search int, place int, symbol string, quote_type string, exchange string, long_name string, other_name string, sector string, industry string"
STOCK = "short_name string, name string, yahoo_symbol string, exchange string, quote_currency string, resolved_at timestamp, sector string, industry string"


def test_resolutions_are_kept_and_sectors_filled(spark):
    stocks = spark.createDataFrame([("AAPL", "Apple Inc", None, None, None, None, None, None), ("MSFT", "Microsoft", "MSFT", "NMS", "USD", NOW, None, None), ("OLD", "Old plc", "OLD.L", "LSE", "GBP", NOW, "Energy", None), ("ZZZ", "Nothing", "", None, None, None, None, None)], STOCK)
    candidates = spark.createDataFrame(
        [
            ("AAPL", "Apple Inc", 0, 0, "AAPL.DE", "EQUITY", "GER", "Apple Inc", None, "Tech DE", "x"),
            ("AAPL", "Apple Inc", 0, 1, "AAPL", "EQUITY", "NMS", "Apple Inc", None, "Tech", "Phones"),
            ("MSFT", "Microsoft", 0, 0, "MSFT", "EQUITY", "NMS", "Microsoft", None, "Software", ""),
            ("OLD", "Old plc", 0, 0, "NEW.L", "EQUITY", "LSE", "Old plc", None, "Other", "y"),
        ],
        CANDIDATE,
    )
    quotes = spark.createDataFrame([("AAPL", "NMS", "USD", 10.0), ("AAPL.DE", "GER", "EUR", 9.0), ("NEW.L", "LSE", "GBP", 1.0)], "symbol string, exchange string, currency string, price double")
    got = {r.short_name: r for r in listings.with_resolutions(stocks, candidates, quotes, NOW).collect()}
    assert (got["AAPL"].yahoo_symbol, got["AAPL"].exchange, got["AAPL"].quote_currency, got["AAPL"].sector, got["AAPL"].industry) == ("AAPL", "NMS", "USD", "Tech", "Phones")
    assert (got["MSFT"].yahoo_symbol, got["MSFT"].sector, got["MSFT"].industry) == ("MSFT", "Software", None)
    assert (got["OLD"].yahoo_symbol, got["OLD"].sector) == ("OLD.L", "Energy")
    assert (got["ZZZ"].yahoo_symbol, got["ZZZ"].sector) == (None, None) and len(got) == 4


def test_scores_of_a_model_or_the_lexicon(spark):
    rows = [("shares plunge on fraud", None, None), ("shares plunge on fraud", "Positive", 0.91234), ("x", "negative", 0.7), ("shares plunge on fraud", "neutral", 0.9), ("a dull day", "neutral", 0.9)]
    frame = spark.createDataFrame(rows, "t string, label string, c double")
    own = frame.select(sentiment.compound(F.col("t")).alias("x")).first().x
    got = [r.s for r in frame.select(sentiment.dispatched(F.col("t"), F.col("label"), F.col("c")).alias("s")).collect()]
    assert got == [own, 0.912, -0.7, own, 0.0] and own < -0.5
    assert frame.select(sentiment.dispatched(F.col("t")).alias("s")).first().s == own
