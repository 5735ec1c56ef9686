"""Instruments by listing: which candidate of a search is the company's own, and rows for the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewire.functions import normalize
from tidewire.functions.similarity import token_set_ratio
from tidewire.operators import upserts

#: Ranks of exchanges, lower is better, what others get, and what a number on London's international board adds.
EXCHANGE_RANKS = {
    "NMS": 0, "NYQ": 0, "NGM": 0, "NCM": 0, "NAS": 0, "NYS": 0, "ASE": 1, "PCX": 1, "BTS": 1, "NEO": 1, "LSE": 2, "GER": 3, "AMS": 4, "PAR": 4, "MIL": 4, "EBS": 4, "BRU": 4, "LIS": 4,
    "MCE": 4, "STO": 4, "CPH": 4, "OSL": 4, "HEL": 4, "VIE": 4, "ISE": 4, "TOR": 5, "VAN": 6, "CNQ": 6, "FRA": 7, "STU": 7, "MUN": 7, "BER": 7, "DUS": 7, "HAM": 7, "HAN": 7,
    "GETTEX": 7, "IOB": 8, "TYO": 9, "JPX": 9, "HKG": 9, "SHH": 9, "SHZ": 9, "KSC": 9, "KOE": 9, "TAI": 9, "ASX": 9, "NSI": 9, "BSE": 9, "SES": 9, "NZE": 9, "SAO": 10, "MEX": 10,
    "JNB": 10, "TLV": 10, "IST": 10, "WSE": 10,
}
OTHER_RANK, BOARD_PENALTY = 12, 6
#: Exchanges of the United States.
US_EXCHANGES = ("NMS", "NYQ", "NGM", "NCM", "NAS", "NYS", "ASE", "PCX", "BTS")
#: Types of instruments that count, and their names in the catalogue.
TYPES = {"EQUITY": "STOCK", "ETF": "ETF", "MUTUALFUND": "FUND", "INDEX": "INDEX"}
#: The least score of a name, and candidates tried for a quote.
NAME_FLOOR, TRIED = 55, 4
#: What only derivatives have in their names.
DERIVATIVES = ("leverage shares", "leveraged", " -1x", " -2x", " -3x", " 1x ", " 2x ", " 3x ", "inverse", "short ", "etp", "etn", "certificate", "warrant", "turbo", "call option", "put option", "options ")


def exchange_rank(exchange: Column, symbol: Column | None = None) -> Column:
    """an exchange's rank; with a symbol, one that begins with a digit in London ranks lower."""
    code = F.upper(F.coalesce(exchange, F.lit("")))
    ranks = F.create_map(*(F.lit(x) for pair in EXCHANGE_RANKS.items() for x in pair))
    rank = F.coalesce(F.try_element_at(ranks, code), F.lit(OTHER_RANK))
    return rank if symbol is None else rank + F.when((code == "LSE") & symbol.rlike("^[0-9]"), BOARD_PENALTY).otherwise(0)


def is_us_listing(exchange: Column) -> Column:
    return F.upper(F.coalesce(exchange, F.lit(""))).isin(*US_EXCHANGES)


def is_derivative(name: Column) -> Column:
    """F16."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))
    return F.greatest(*(padded.contains(d) for d in DERIVATIVES))


@F.pandas_udf(DoubleType())
def alike(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([0.0 if not x or not y else token_set_ratio(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype=float)


def name_score(name: Column, long_name: Column, short_name: Column) -> Column:
    """the better token-set ratio, without case, of a name with a candidate's two; 0 without any."""
    return F.greatest(alike(name, long_name), alike(name, short_name))


def first_per_symbol(candidates: DataFrame) -> DataFrame:
    """Of the candidates of several searches of a company the first of each symbol, by search and place."""
    order = Window.partitionBy("short_name", "symbol").orderBy("search", "place")
    return candidates.where("symbol <> ''").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def ranked(candidates: DataFrame) -> DataFrame:
    """The plausible listings of each company with ``rank``, ``name_score``, ``exact_symbol`` and ``pick`` from 1, best first.

    candidates: short_name, catalogue_name, search, place, symbol, quote_type, exchange, long_name, other_name. Best exchange,
    then best name, then the exact symbol, then the shortest, then the first found.
    """
    kind = F.upper(F.coalesce("quote_type", F.lit("")))
    scored = first_per_symbol(candidates).where(kind.isin(*TYPES)).withColumns({
        "name_score": name_score(F.col("catalogue_name"), F.col("long_name"), F.col("other_name")),
        "exact_symbol": F.upper("symbol") == normalize.clean_symbol(F.col("short_name")),
        "rank": exchange_rank(F.col("exchange"), F.col("symbol")),
    })
    named = F.concat_ws(" ", F.coalesce("long_name", F.lit("")), F.coalesce("other_name", F.lit("")))
    fit = scored.where(((F.col("name_score") >= NAME_FLOOR) | F.col("exact_symbol")) & (is_derivative(named) == is_derivative(F.col("catalogue_name"))))
    order = Window.partitionBy("short_name").orderBy("rank", F.desc("name_score"), F.desc("exact_symbol"), F.length("symbol"), "search", "place")
    return fit.withColumn("pick", F.row_number().over(order))


def resolved(candidates: DataFrame, quotes: DataFrame) -> DataFrame:
    """Of the best TRIED listings of each company the first that has a price; exchange and currency as it is quoted."""
    priced = quotes.where("price IS NOT NULL AND price <> 0").select("symbol", F.col("exchange").alias("quoted_on"), "currency", "price")
    met = ranked(candidates).where(F.col("pick") <= TRIED).join(priced, "symbol")
    best = F.min_by(F.struct("symbol", F.coalesce(F.nullif("quoted_on", F.lit("")), "exchange").alias("exchange"), "currency", "price"), "pick")
    return met.groupBy("short_name").agg(best.alias("b")).select("short_name", "b.*")


def with_resolutions(stocks: DataFrame, candidates: DataFrame, quotes: DataFrame, as_of) -> DataFrame:
    """The stocks, of which those without a traded symbol take the listing that their candidates resolve to, and those
    with a symbol but without a sector take that of their best candidate, if it has one. What is known is never resolved again.

    candidates: as of ``ranked``, with sector and industry.
    """
    unknown = stocks.where(F.coalesce("yahoo_symbol", F.lit("")) == "").select("short_name")
    found = resolved(candidates.join(unknown, "short_name", "left_semi"), quotes)
    listed = found.select("short_name", F.col("symbol").alias("yahoo_symbol"), "exchange", F.col("currency").alias("quote_currency"), F.lit(as_of).cast("timestamp").alias("resolved_at"))
    known = upserts.patched(stocks.withColumn("yahoo_symbol", F.nullif("yahoo_symbol", F.lit(""))), listed, "short_name", fill=["yahoo_symbol"], keep=["exchange", "quote_currency", "resolved_at"])
    bare = known.where("yahoo_symbol IS NOT NULL AND coalesce(sector, '') = ''").select("short_name", F.col("yahoo_symbol").alias("traded"))
    picks = ranked(candidates.join(bare, "short_name"))
    # a newly resolved listing says its own sector, a known one that of the best candidate
    met = picks.join(found.select("short_name", F.col("symbol").alias("chosen")), "short_name", "left").where(F.coalesce(F.col("symbol") == F.col("chosen"), F.col("pick") == 1))
    named = met.where("sector <> ''").select("short_name", "sector", F.nullif("industry", F.lit("")).alias("industry"))
    return upserts.patched(known, named, "short_name", overwrite=["sector"], keep=["industry"])


def refreshed(stocks: DataFrame, watchlist: DataFrame, quotes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """The stocks with the quotes of the followed ones, and short_name and ok of each followed stock; one that has no
    symbol or no quote fails alone. quotes: symbol, currency, price, change, change_percent."""
    priced = quotes.where("price IS NOT NULL").select(F.col("symbol").alias("yahoo_symbol"), F.col("currency").alias("quote_currency"), "price", F.col("change").alias("price_change"), F.col("change_percent").alias("price_change_percent"))
    followed = watchlist.select("short_name").join(stocks.select("short_name", "yahoo_symbol"), "short_name", "left")
    patch = followed.join(priced, "yahoo_symbol").withColumn("price_updated_at", F.lit(as_of).cast("timestamp")).drop("yahoo_symbol")
    told = followed.join(patch.select("short_name", F.lit(True).alias("ok")).distinct(), "short_name", "left").select("short_name", F.coalesce("ok", F.lit(False)).alias("ok"))
    return upserts.patched(stocks, patch, "short_name", overwrite=["price", "price_change", "price_change_percent", "price_updated_at"], keep=["quote_currency"]), told


def looked_up(hits: DataFrame) -> DataFrame:
    """Hits of searches (query, place, symbol, quote_type, long_name, other_name, exchange) as rows of the catalogue, the first of each symbol."""
    kind, symbol = F.upper(F.coalesce("quote_type", F.lit(""))), normalize.clean_symbol(F.col("symbol"))
    fit = hits.withColumn("short_name", symbol).where(kind.isin(*TYPES) & normalize.valid_symbol(symbol))
    types = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    first = fit.withColumn("__n", F.row_number().over(Window.partitionBy("query", "short_name").orderBy("place"))).where("__n = 1")
    return first.select("query", "place", "short_name", F.coalesce(F.nullif("long_name", F.lit("")), F.nullif("other_name", F.lit("")), "short_name").alias("name"), F.try_element_at(types, kind).alias("type"), "exchange")


def aliases(yahoo_symbol: Column) -> Column:
    """The traded symbol and what stands before its first dot; none without one."""
    return F.when(F.coalesce(yahoo_symbol, F.lit("")) != "", F.array_distinct(F.array(yahoo_symbol, F.split_part(yahoo_symbol, F.lit("."), F.lit(1))))).otherwise(F.array().cast("array<string>"))


def work_list(stocks: DataFrame, done: DataFrame, *, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Named instruments that are no derivatives and not resolved yet, in order of symbol, or a seeded sample of so many."""
    open_ = stocks.where((F.col("name") != "") & ~is_derivative(F.col("name"))).select("short_name", "name").join(done.where("resolved").select("short_name"), "short_name", "left_anti")
    return open_.orderBy("short_name") if sample is None else open_.orderBy(F.xxhash64(F.lit(seed), "short_name")).limit(sample)
