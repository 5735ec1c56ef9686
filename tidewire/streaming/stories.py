"""Stories in a stream of articles, by similar headlines too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.functions.similarity import Pool, token_set_ratio
from tidewire.operators.stories import SIMILAR, WINDOW_SECONDS
from tidewire.streaming.micro_batches import HORIZON

TOLD = "arrival bigint, title string, title_key string, at double"
OUT = "short_name string, arrival bigint, winner bigint"


class Stories(StatefulProcessor):
    """Of each stock the winners that a later article may still tell: those of the window before the watermark.

    An article, in order of arrival, joins the first winner of its story or becomes one. A timer drops the winners of a stock
    that gets no more articles, so the state holds a window of winners a stock.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getListState("told", TOLD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = [tuple(x) for x in self.told.get()] if self.told.exists() else []
        times, pool = np.array([t[3] for t in told], float), Pool([t[1] for t in told])
        fresh: list[tuple] = []
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            near = np.abs(times - row.at) <= WINDOW_SECONDS
            same = next((i for i in np.flatnonzero(near).tolist() if row.title_key and told[i][2] == row.title_key), None)
            found = pool.first(row.title, SIMILAR, np.flatnonzero(near[:same]))
            found = same if found is None else found
            match = told[found] if found is not None else next((t for t in fresh if abs(t[3] - row.at) <= WINDOW_SECONDS and ((row.title_key and t[2] == row.title_key) or token_set_ratio(row.title, t[1]) >= SIMILAR)), None)
            if match is None:
                match = (row.arrival, row.title, row.title_key, row.at)
                fresh.append(match)
            out.append((key[0], row.arrival, match[0]))
        self.keep([*told, *fresh], timerValues.getCurrentWatermarkInMs() / 1000)
        yield pd.DataFrame(out, columns=["short_name", "arrival", "winner"])

    def keep(self, told: list[tuple], watermark: float) -> None:
        kept = [t for t in told if t[3] >= watermark - WINDOW_SECONDS]
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if kept:
            self.told.put(kept)
            self.handle.registerTimer(int((min(t[3] for t in kept) + WINDOW_SECONDS) * 1000) + 1)
        else:
            self.told.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.keep([tuple(x) for x in self.told.get()] if self.told.exists() else [], timerValues.getCurrentWatermarkInMs() / 1000)
        yield pd.DataFrame({"short_name": pd.Series([], dtype=str), "arrival": pd.Series([], dtype="int64"), "winner": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def winners(articles: DataFrame, delay: str = HORIZON) -> DataFrame:
    """short_name, arrival and winner (its own arrival, or that of the story that it tells) of a stream of articles: short_name,
    arrival, title, title_key and publish_time.

    As ``stories.elected`` in order of arrival, if micro-batches come in that order. Articles that lag the newest by more than
    ``delay`` are dropped. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = articles.withWatermark("publish_time", delay).select("short_name", F.col("arrival").cast("long").alias("arrival"), text("title"), text("title_key"), F.col("publish_time").cast("double").alias("at"), "publish_time")
    return rows.groupBy("short_name").transformWithStateInPandas(Stories(), OUT, "append", "EventTime")


