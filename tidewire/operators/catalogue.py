"""Instruments: search, taxonomy, lookups and watchlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Exchanges of the United States.
US_EXCHANGES = ("NMS", "NYQ", "NGM", "NCM", "ASE", "PCX", "BTS")


def search(stocks: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Exact symbol, symbol prefix, name prefix, name anywhere; then stocks, US lines, symbols without digits, short names.

    Wildcards in the query are not escaped, symbols match by prefix only.
    """
    q = (query or "").strip()
    if not q:
        return stocks.limit(0)
    symbol, name = F.col("short_name"), F.col("name")
    exchange = F.col("exchange") if "exchange" in stocks.columns else F.lit(None).cast("string")
    kind = F.when(symbol == q.upper(), 0).when(symbol.ilike(q + "%"), 1).when(name.ilike(q + "%"), 2).otherwise(3)
    order = [kind, F.when(F.col("type") == "STOCK", 0).otherwise(1), F.when(exchange.isin(*US_EXCHANGES), 0).otherwise(1), F.when(symbol.rlike("[0-9]"), 1).otherwise(0), F.length(name), F.desc(F.length(symbol)), symbol]
    return stocks.where(symbol.ilike(q + "%") | name.ilike("%" + q + "%")).orderBy(*order).limit(limit)


def sectors(stocks: DataFrame) -> DataFrame:
    """Counts at both levels; a fine one names the first of its coarse ones."""
    coarse = stocks.where("sector <> ''").groupBy("sector").agg(F.count("*").alias("stock_count")).select("sector", F.lit("group").alias("level"), F.lit(None).cast("string").alias("group_name"), "stock_count")
    fine = stocks.where("industry <> ''").groupBy(F.col("industry").alias("sector_")).agg(F.min("sector").alias("group_name"), F.count("*").alias("stock_count")).select(F.col("sector_").alias("sector"), F.lit("industry").alias("level"), "group_name", "stock_count")
    return coarse.unionByName(fine)


def in_sector(stocks: DataFrame, sector: str) -> DataFrame:
    """Either level; a name that nothing has gives nothing."""
    return stocks.where((F.col("industry") == sector) | (F.col("sector") == sector)).select("short_name")


def watched(watchlist: DataFrame, stocks: DataFrame) -> DataFrame:
    """Symbols without an instrument stay."""
    return watchlist.join(stocks.select("short_name", "name", "price", "price_change_percent"), "short_name", "left").select("short_name", "position", F.coalesce("name", "short_name").alias("name"), "price", "price_change_percent")


def unlisted(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Found instruments that neither their symbol nor their traded symbol names among the stored ones."""
    return found.join(stored.select("short_name"), "short_name", "left_anti").join(stored.select(F.col("traded").alias("short_name")).where("short_name IS NOT NULL"), "short_name", "left_anti")


def best_listing(candidates: DataFrame) -> DataFrame:
    """Of each company's candidates the best exchange, then the best name, then the shortest symbol, then the first."""
    order = Window.partitionBy("company").orderBy("exchange_rank", F.desc("name_score"), F.length("symbol"), "ordinal", "symbol")
    return candidates.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
