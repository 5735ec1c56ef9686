"""Catalogue sweeps: runs of misses and the published seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import scans

#: Misses in a row that end a sweep, the least score of a name, and the types worth publishing.
MISSES, NAME_FLOOR = 40, 85
TYPES = {"EQUITY": "STOCK", "MUTUALFUND": "FUND"}
KEPT = ("STOCK", "ETF", "FUND", "INDEX")


def swept(rows: DataFrame, *, misses: int = MISSES) -> DataFrame:
    """The rows of each sweep, in order of ordinal, up to the one that completes a run of misses, with the run's length so far.

    A null ``resolved`` is a miss. A sweep of any size is scanned in segments; its end is the least ordinal of a full run.
    """
    runs = scans.with_streaks(rows, "sweep", ["ordinal"], F.col("resolved"), "streak")
    ends = runs.where(F.col("streak") >= misses).groupBy(F.col("sweep").alias("ended")).agg(F.min("ordinal").alias("last"))
    return runs.join(ends, runs["sweep"].eqNullSafe(ends["ended"]), "left").where("last IS NULL OR ordinal <= last").drop("ended", "last")


def publishable(records: DataFrame) -> DataFrame:
    """Symbol, name, type and currency of each resolved symbol: best exchange, then best name, then first.

    Records whose symbol is not exact need a name of at least NAME_FLOOR; other types than KEPT go. A null currency is empty.
    """
    kind = F.upper(F.coalesce("quote_type", F.lit("")))
    named = F.coalesce(*(F.when(kind == k, v) for k, v in TYPES.items()), kind)
    fit = records.where("symbol IS NOT NULL").where(F.coalesce("exact_symbol", F.lit(False)) | (F.col("name_score") >= NAME_FLOOR)).withColumn("type", named).where(F.col("type").isin(*KEPT))
    best = F.min_by(F.struct("name", "type", F.coalesce("currency", F.lit("")).alias("currency")), F.struct("rank", -F.col("name_score"), "ordinal"))
    return fit.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")


def write_seed(rows: DataFrame, path: str) -> None:
    """JSON lines in order of symbol: sorted within each file and from file to file."""
    rows.orderBy("symbol").write.mode("overwrite").json(path)
