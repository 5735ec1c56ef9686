"""The article feed: predicates, orders, pages and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SORT = "recent"


def sorts() -> dict[str, list[Column]]:
    """Total orders by name."""
    newest = [F.desc("publish_time"), F.desc("id")]
    return {"recent": newest, "sentiment": [F.desc_nulls_last("sentiment"), *newest], "symbol": [F.asc("short_name"), *newest], "coverage": [F.desc("coverage"), F.asc("short_name"), *newest]}


def literal_pattern(term: str) -> str:
    """A LIKE pattern in which nothing of the term is a wildcard."""
    return "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def in_scope(news: DataFrame, symbols: Sequence[str] | DataFrame | None) -> DataFrame:
    """None is every symbol, an empty list none; a DataFrame of short_name joins, so that a scope of any size does."""
    if symbols is None:
        return news
    if isinstance(symbols, DataFrame):
        return news.join(symbols.select("short_name").distinct(), "short_name", "left_semi")
    return news.where(F.col("short_name").isin(*symbols)) if symbols else news.limit(0)


def matching(news: DataFrame, *, symbols=None, since=None, until=None, sentiment: str | None = None, relevance: str | None = None, impact: str | None = None, query: str | None = None) -> DataFrame:
    """All optional predicates, without order."""
    out = in_scope(news, symbols)
    for name, value in (("relevance", relevance), ("impact", impact)):
        if value:
            out = out.where(F.col(name) == value)
    if since is not None:
        out = out.where(F.col("publish_time") >= since)
    if until is not None:
        out = out.where(F.col("publish_time") <= until)
    score = F.col("sentiment")
    if sentiment in ("positive", "negative", "neutral"):
        out = out.where({"positive": score > 0.2, "negative": score < -0.2, "neutral": score.isNull() | score.between(-0.2, 0.2)}[sentiment])
    if term := (query or "").strip():
        pattern = literal_pattern(term)
        out = out.where(F.col("title").ilike(pattern) | F.col("description").ilike(pattern) | F.col("short_name").ilike(pattern))
    return out


def page(news: DataFrame, *, sort: str | None = None, limit: int = 200, offset: int = 0, **predicates) -> DataFrame:
    """One page of the feed. Only by coverage are all of a symbol's rows counted, after the predicates."""
    out = matching(news, **predicates)
    name = sort if sort in sorts() else DEFAULT_SORT
    if name == "coverage":
        counts = out.groupBy("short_name").agg(F.count("*").alias("coverage"))  # a partial count first: no window over a busy symbol
        out = out.join(counts, "short_name")
    return out.orderBy(*sorts()[name]).offset(offset).limit(limit)


def trending(news: DataFrame, stocks: DataFrame, *, symbols=None, since=None, per_stock: int = 3, limit: int = 12) -> DataFrame:
    """Newest articles of the stocks that moved most; a stock without a quote has no move."""
    moved = stocks.where("price_change_percent IS NOT NULL").select("short_name", F.col("price_change_percent").alias("move_percent"))
    newest = Window.partitionBy("short_name").orderBy(F.desc("publish_time"), F.desc("id"))
    ranked = matching(news, symbols=symbols, since=since).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= per_stock)
    return ranked.join(moved, "short_name").orderBy(F.desc(F.abs("move_percent")), F.desc("publish_time"), F.desc("id")).limit(limit)


def fingerprints(news: DataFrame, since) -> DataFrame:
    """P12."""
    return news.where(F.col("publish_time") >= since).select("id", "short_name", "url", "title", "publish_time", "source_domain", F.col("description").isNotNull().alias("has_description"), F.col("image").isNotNull().alias("has_image"))


def unscored(news: DataFrame, limit: int = 500) -> DataFrame:
    """P10."""
    return news.where("sentiment IS NULL").select("id", "title", "description", "publish_time").orderBy(F.desc("publish_time"), F.desc("id")).limit(limit)


def image_backlog(news: DataFrame, limit: int = 12, symbols=None) -> DataFrame:
    """P11."""
    wanted = in_scope(news, symbols).where("image IS NULL AND source_domain IS NOT NULL AND source_domain NOT IN ('news.google.com', '')")
    return wanted.select("id", "url", "publish_time").orderBy(F.desc("publish_time"), F.desc("id")).limit(limit)


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def diversified(rows: DataFrame, *, per_source: int = 2, per_symbol: int = 3, most: int = 14) -> DataFrame:
    """Walk the page by ``pos``; take a row unless its source or symbol is full; stop at ``most``. A row that one limit
    rejects does not use up the other. The page is a bounded top-k, so the fold over it is too."""
    one = rows.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "source", "short_name"))).alias("page"))
    empty = F.array().cast("array<struct<pos:int,id:bigint,source:string,short_name:string>>")
    taken = F.aggregate(
        "page",
        empty,
        lambda done, x: F.when(
            (F.size(done) < most) & (F.size(F.filter(done, lambda d: d["source"] == x["source"])) < per_source) & (F.size(F.filter(done, lambda d: d["short_name"] == x["short_name"])) < per_symbol),
            F.concat(done, F.array(F.struct(x["pos"].cast("int").alias("pos"), x["id"].cast("bigint").alias("id"), x["source"].alias("source"), x["short_name"].alias("short_name")))),
        ).otherwise(done),
    )
    return one.select(F.explode(taken).alias("x")).select("x.*")
