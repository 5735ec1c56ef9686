"""Mutations as pure functions from the old table and a batch to the new table; a writer overwrites with the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of the batch that are inserted: the first of each key by ``order``, unless stored. A null key never equals."""
    first = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
    return first.join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key wins; null keys are one key here."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    values = [c for c in stored.columns if c not in keys]
    latest = F.max_by(F.struct(*values), F.struct("__new", F.col(order)))
    return both.groupBy(*keys).agg(latest.alias("v")).select(*keys, "v.*").select(*stored.columns)


def one_per_key(batch: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """The row of each key that is last by ``order``, or by all its values where there is none."""
    rest = [c for c in batch.columns if c not in keys]
    row = F.struct(*rest)
    last = F.max(row) if order is None else F.max_by(row, F.struct(order, row))
    return batch.groupBy(*keys).agg(last.alias("__row")).select(*keys, "__row.*")


def patched(stored: DataFrame, patch: DataFrame, key: str, *, overwrite: list[str] = (), fill: list[str] = (), keep: list[str] = (), order: str | None = None) -> DataFrame:
    """Columns that a patch row overwrites, fills where null, or overwrites unless itself null.

    Of several patch rows of a key the last by ``order`` counts, so stored rows stay one each. A null key is not patched.
    """
    hit = F.col("__hit").isNotNull()
    columns = [key, *dict.fromkeys([*overwrite, *fill, *keep])]
    single = one_per_key(patch.select(*columns, *([order] if order and order not in columns else [])), [key], order).select(*columns)
    renamed = reduce(lambda df, c: df.withColumnRenamed(c, f"__{c}"), columns[1:], single).withColumn("__hit", F.lit(True))
    new = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in overwrite}
    new |= {c: F.coalesce(c, f"__{c}") for c in fill} | {c: F.coalesce(f"__{c}", c) for c in keep}
    return stored.join(renamed, key, "left").withColumns(new).select(*stored.columns)


def catalogue_upsert(stored: DataFrame, batch: DataFrame, order: str, *, overwrite: list[str] = ("name", "type")) -> DataFrame:
    """New instruments come in, known ones get ``overwrite`` and a currency that is not null.

    batch: short_name, name, type, currency_code and the order of its rows. Rows without name, type or short_name are skipped.
    The growth is the count of the result less that of what was stored.
    """
    fit = batch.where("short_name <> '' AND name <> '' AND type <> ''")
    last = one_per_key(fit, ["short_name"], order)
    held = patched(stored, last, "short_name", overwrite=list(overwrite), keep=["currency_code"])
    fresh = last.join(stored.select("short_name"), "short_name", "left_anti")
    return held.unionByName(fresh.drop(order) if order not in stored.columns else fresh, allowMissingColumns=True)


def followed(watchlist: DataFrame, symbol: str) -> DataFrame:
    """The watchlist with the symbol after its last position, from 0 on; unchanged where it is there."""
    place = watchlist.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("position"))
    new = place.select(F.lit(symbol).alias("short_name"), F.col("position").cast(watchlist.schema["position"].dataType).alias("position"))
    return watchlist.unionByName(new.join(watchlist.select("short_name"), "short_name", "left_anti"), allowMissingColumns=True)


def unfollowed(watchlist: DataFrame, symbol: str) -> DataFrame:
    """K13."""
    return watchlist.where(F.col("short_name") != symbol)


def retained(rows: DataFrame, column: str, cutoff) -> DataFrame:
    """What a deletion of all strictly older rows leaves; rows without a time stay."""
    return rows.where(~F.coalesce(F.col(column) < cutoff, F.lit(False)))


def reordered(watchlist: DataFrame, symbols: list[str]) -> DataFrame:
    """Positions follow the list; the others keep theirs."""
    wanted = watchlist.sparkSession.createDataFrame([(s, i) for i, s in enumerate(symbols)], "short_name string, position long")
    return patched(watchlist, wanted, "short_name", overwrite=["position"])
