"""Scans of keys in segments give what plain Python gives, whatever the segments."""

import random

import pytest
from pyspark.sql import functions as F
from tidewire.operators import prices, scans, sweeps


@pytest.fixture(params=["whole", "cut", "both"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(scans, "HOT", {"whole": 1 << 20, "cut": 0, "both": 60}[request.param])
    monkeypatch.setattr(scans, "SEGMENT_BITS", 2)


def rows_of(rng, n=400):
    """One key has over half of all rows; some have a few."""
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]) if i else None, i, rng.choice([None, None, float(rng.randrange(3))]), rng.random() < 0.2 if i % 50 > 20 else False) for i in rng.sample(range(n), n)]


def per_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_scans_equal_plain_loops(spark, sizes):
    rows = rows_of(random.Random(6))
    frame = spark.createDataFrame(rows, "k string, i long, v double, hit boolean")
    filled = {r.i: r.v for r in scans.carried(frame, "k", ["i"], "v").collect()}
    before = {r.i: r.p for r in scans.with_previous(frame, "k", ["i"], "v", "p").collect()}
    streaks = {r.i: r.n for r in scans.with_streaks(frame, "k", ["i"], F.col("hit"), "n").collect()}
    assert len(filled) == len(before) == len(streaks) == len(rows)
    for own in per_key(rows).values():
        last, previous, run = None, None, 0
        for _, i, v, hit in own:
            last = v if v is not None else last
            run = 0 if hit else run + 1
            assert (filled[i], before[i], streaks[i]) == (last, previous, run)
            previous = v


def test_operators_on_hot_keys(spark, sizes):
    rng = random.Random(7)
    at = F.timestamp_seconds("i")
    frame = spark.createDataFrame([(k or "none", i, v, hit) for k, i, v, hit in rows_of(rng)], "short_name string, i long, close double, resolved boolean").withColumn("ts", at)
    asked = frame.where("i % 3 = 0").select("short_name", (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.col("i").alias("request_id"))
    known = frame.where("close IS NOT NULL").withColumnRenamed("i", "id")
    got = {r.request_id: r.close for r in prices.as_of(asked, known).collect()}
    rows = [(r.short_name, r.id, r.close) for r in known.collect()]
    for r in asked.collect():
        held = [x for x in rows if x[0] == r.short_name and x[1] <= r.request_id + 1]
        assert got[r.request_id] == (max(held, key=lambda x: x[1])[2] if held else None)
    changed = sorted(r.ts for r in prices.changes(known.withColumn("interval", F.lit("snap"))).collect())
    want = []
    for own in per_key([(k, i, c) for k, i, c in rows]).values():
        want += [i for (_, i, c), b in zip(own, [None, *own], strict=False) if b is None or abs(c - b[2]) > 1e-9]
    assert len(changed) == len(want)
    swept = sweeps.swept(frame.select(F.col("short_name").alias("sweep"), F.col("i").alias("ordinal"), "resolved"), misses=5).collect()
    expected = []
    for k, own in per_key([(r.short_name, r.i, r.resolved) for r in frame.collect()]).items():
        run = 0
        for _, i, hit in own:
            run = 0 if hit else run + 1
            expected.append((k, i, run))
            if run >= 5:
                break
    assert sorted((r.sweep, r.ordinal, r.streak) for r in swept) == sorted(expected)


def test_empty(spark, sizes):
    none = spark.createDataFrame([], "k string, i long, v double")
    assert scans.carried(none, "k", ["i"], "v").count() == scans.with_streaks(none, "k", ["i"], F.lit(True), "n").count() == 0
