"""Articles and quotes as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: a copy of a story may come so much later.
HORIZON = "72 hours"


def daily_rollup(articles: DataFrame, delay: str = HORIZON) -> DataFrame:
    """The roll-up of each stock and UTC day; in update mode a late score changes its day."""
    scored = articles.where("sentiment IS NOT NULL").withWatermark("publish_time", delay)
    return scored.groupBy("short_name", F.window("publish_time", "1 day")).agg(F.avg("sentiment").alias("avg_sentiment"), F.count("*").alias("article_count")).select("short_name", F.to_date("window.start").alias("date"), "avg_sentiment", "article_count")


def first_by_url(articles: DataFrame, delay: str = HORIZON) -> DataFrame:
    """One article of each stock and URL within the horizon; the sink's anti-join has the last word."""
    return articles.withWatermark("publish_time", delay).dropDuplicatesWithinWatermark(["short_name", "url_hash"])


def changed_quotes(quotes: DataFrame) -> DataFrame:
    """A quote only when its close differs from the last one kept; short_name, ts and close. Quotes without a close are no quotes."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        last = state.get[0] if state.exists else None
        kept = []
        for ts, close in zip(rows["ts"], rows["close"], strict=True):
            if last is None or abs(close - last) > 1e-9:
                kept.append((key[0], ts, close))
                last = close
        state.update((last,))
        yield pd.DataFrame(kept, columns=["short_name", "ts", "close"])

    shape = "short_name string, ts timestamp, close double"
    return quotes.select("short_name", "ts", "close").where("close IS NOT NULL AND NOT isnan(close)").groupBy("short_name").applyInPandasWithState(keep, shape, "last double", "append", GroupStateTimeout.NoTimeout)


def ingest(articles: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run the batch pipeline on each micro-batch; the checkpoint makes a restart resume."""
    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
