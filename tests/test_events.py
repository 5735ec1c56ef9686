import json
from datetime import datetime, timedelta

from tidewire.operators import events, sweeps

NOW = datetime(2026, 1, 10, 12)
PAGES = "short_name string, page long, ids array<long>, reply string, tokens long"


def test_replies(spark):
    good = {"headline": "g", "why_it_matters": "w", "impact": "medium", "article_numbers": [1, 2], "previously_known": "p"}
    odd = {"headline": " h ", "why_it_matters": "w", "impact": "HIGH", "article_numbers": [2, 2, 9, True, 1.0, "1"]}
    bad = [7, None, good | {"headline": 5}, good | {"impact": "vast"}, good | {"article_numbers": [0, 9]}, good | {"article_numbers": 1}, good | {"why_it_matters": "  "}]
    replies = [json.dumps({"events": [odd, *bad, good]}), "nonsense", None, '{"events":[]}', '{"events":5}', "[1]", "{}"]
    judged = events.judged(spark.createDataFrame([("A", i, [10 * i, 10 * i + 1, 10 * i + 2], r, 5) for i, r in enumerate(replies)], PAGES))
    assert [(r.ordinal, r.headline, r.previously_known, r.impact, r.news_ids, r.tokens_total) for r in events.events_of(judged).orderBy("ordinal").collect()] == [(0, "h", None, "high", [1], 5), (1, "g", "p", "medium", [0, 1], 0)]
    tiers = {r.id: r.impact for r in events.tiers_of(judged).collect()}
    assert len(tiers) == 21 and [tiers[i] for i in (0, 1, 2)] == ["medium", "high", "low"]
    assert {i for i, t in tiers.items() if i > 2 and t} == {30, 31, 32} and tiers[30] == "low"


def test_a_failing_call_costs_its_own_page(spark):
    def ask(prompt):
        if prompt == "b":
            raise RuntimeError("timeout")
        return None if prompt == "c" else (prompt.upper(), 3)

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "prompt string")
    assert sorted(map(tuple, events.answered(rows, ask).collect()), key=lambda r: r[0]) == [("a", "A", 3), ("b", None, 0), ("c", None, 0)]


def test_numbers_run_over_days_and_pages(spark):
    times = [NOW - timedelta(hours=3 * (i // 2)) for i in range(130)]
    rows = spark.createDataFrame([("A", i, t) for i, t in enumerate(times)] + [("A", 999, None), ("B", 5, NOW)], "short_name string, id long, publish_time timestamp")
    got = {(r.short_name, r.id): (r.page, r.number) for r in events.numbered(rows).collect()}
    order = sorted(range(130), key=lambda i: (times[i], i), reverse=True) + [999]
    assert got == {("A", x): (at // 60, at % 60 + 1) for at, x in enumerate(order)} | {("B", 5): (0, 1)}
    assert events.numbered(rows.limit(0)).count() == 0


def test_prompts_without_history(spark):
    news = "short_name string, id long, publish_time timestamp, source string, title string, description string"
    batch = spark.createDataFrame([("A", 1, NOW, None, "t", None)], news)
    known = spark.createDataFrame([], "short_name string, id long, headline string, created_at timestamp")
    (row,) = events.prompts(batch, batch, known, NOW).collect()
    assert row.ids == [1] and "(nothing on file" in row.prompt and "EVENTS" not in row.prompt and row.prompt.endswith("1. [2026-01-10 · ?] t")


def test_a_digest_lasts_a_day_or_until_news(spark):
    stocks = spark.createDataFrame([(s,) for s in "ABCDE"], "short_name string")
    summaries = spark.createDataFrame([(s, i, f"sum {s}", NOW - timedelta(hours=h)) for i, (s, h) in enumerate((("A", 1), ("B", 25), ("C", 3), ("E", 24)))], "short_name string, id long, ai_summary string, created_at timestamp")
    news = spark.createDataFrame([(s, i, NOW - timedelta(hours=2), "t", None) for i, s in enumerate("ABC")], "short_name string, id long, publish_time timestamp, title string, description string")
    got = {r.short_name: (r.ai_summary, r.prompt is not None) for r in events.digests(stocks, summaries, news, NOW).collect()}
    assert got == {"A": ("sum A", False), "B": (None, True), "C": (None, True), "E": ("sum E", False)}


def test_a_sweep_ends_at_a_run_of_misses(spark):
    hits = [None, False, True, False, False, False, True]
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate(hits)] + [(2, 0, False)], "sweep int, ordinal int, resolved boolean")
    got = [(r.sweep, r.ordinal, r.streak) for r in sweeps.swept(rows, misses=3).orderBy("sweep", "ordinal").collect()]
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 1), (1, 4, 2), (1, 5, 3), (2, 0, 1)]


def test_seed_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"S{i:03}", "n", "etf", None, True, None, 1, i) for i in range(50, 0, -1)], "symbol string, name string, quote_type string, currency string, exact_symbol boolean, name_score int, rank int, ordinal int")
    sweeps.write_seed(sweeps.publishable(rows), f"{tmp_path}/seed")
    lines = [json.loads(x) for f in sorted((tmp_path / "seed").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["symbol"] for x in lines] == [f"S{i:03}" for i in range(1, 51)] and lines[0] == {"symbol": "S001", "name": "n", "type": "ETF", "currency": ""}
