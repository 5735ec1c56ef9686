"""The stream of stories ends as the batch does, and forgets what no article can tell any more."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tidewire.operators import stories as batch
from tidewire.streaming import stories

NOW = datetime(2026, 1, 10, 12)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    words = [a + b for a in ("ba", "ko", "mi", "tu") for b in ("ra", "ne", "vi", "so")]
    base = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(8)]
    edited = lambda t: t if rng.random() < 0.5 else t.replace(rng.choice(t.split()), rng.choice(words), 1)
    rows = [(rng.choice(["AAPL", "AAPL", "MSFT"]), i, edited(rng.choice(base)), rng.choice(["", f"k{rng.randrange(6)}"]), NOW + timedelta(hours=2 * i)) for i in range(120)]
    schema = "short_name string, arrival long, title string, title_key string, publish_time timestamp"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = stories.winners(source).writeStream.format("memory").queryName("winners").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(200)
        got = {(r.short_name, r.arrival): r.winner for r in spark.table("winners").collect()}
    finally:
        spark.conf.unset(name)
    placed = spark.createDataFrame(rows, schema).select("short_name", F.col("arrival").alias("place"), "title", "title_key", F.col("publish_time").cast("double").alias("at"))
    want = {r.place: r.winner for r in batch.elected(placed).collect()}
    assert {k[1]: v for k, v in got.items()} == want
    assert 2 < len(set(want.values())) < len(want)


class Handle:
    """A list state and timers without a store."""

    def __init__(self):
        self.rows, self.timers = [], set()

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return iter(self.rows)

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_state_holds_a_window_only():
    handle, state = Handle(), stories.Stories()
    state.init(handle)
    hour = 3600.0
    state.keep([(i, f"t{i}", "", i * hour) for i in range(200)], 150 * hour)
    assert [r[0] for r in handle.rows] == list(range(78, 200)) and handle.timers == {int(150 * hour * 1000) + 1}
    state.keep(handle.rows, 300 * hour)
    assert not handle.rows and not handle.timers
