"""Importance resampling towards a target distribution, by hashed n-grams.

DuckDB counts the n-grams of each document inside the tasks: SQL unnests its words, windows them to runs of one and two, and
a registered function of zlib gives each run's CRC and so its bucket. The counts of each document, at most BUCKETS of them,
are spilled to Parquet in the shared folder; from there Spark sums them over the corpus, compares them with the target's, and
scores every document. The draw is by Gumbel noise: the highest scores are a sample without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidewire.llm.common import chunks, pinned

BUCKETS = 10_000
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
#: Seed of the draw's noise, and of a hundred documents how many are drawn.
SEED, PERCENT = 7, 25
#: Text bytes that DuckDB takes at once; a longer text goes in pieces of about so many characters.
PIECE = 1 << 19
#: Documents that are scored at once.
ROWS = 200
SEPARATORS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
HELD = StructField("held", ArrayType(StructType([StructField("bucket", IntegerType()), StructField("n", IntegerType())])))
SEPARATOR = re.compile(f"[{re.escape(SEPARATORS)}]")

#: A piece of a text that goes on begins with the last word of the piece before, which counts in its pair only.
COUNTS = rf"""
WITH words AS (SELECT number, goes_on, unnest(said) AS word, generate_subscripts(said, 1) AS place
  FROM (SELECT number, goes_on, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS said FROM pieces)),
pairs AS (SELECT number, goes_on, place, word, word || ' ' || lead(word) OVER (PARTITION BY number ORDER BY place) AS pair FROM words),
grams AS (SELECT number, word AS gram FROM pairs WHERE NOT (goes_on AND place = 1) UNION ALL SELECT number, pair FROM pairs WHERE pair IS NOT NULL)
SELECT number, (crc(gram) % {BUCKETS})::INTEGER AS bucket, count(*) AS n FROM grams GROUP BY ALL ORDER BY ALL
"""


def crcs(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([*map(zlib.crc32, grams.cast(pa.binary()).to_numpy())], pa.uint32())


def counter() -> duckdb.DuckDBPyConnection:
    """A connection of one task: one thread, little memory and no folder of its own."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    con.create_function("crc", crcs, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def pieces(text: str) -> Iterator[tuple[bool, str]]:
    """A text in pieces that end between words; whether a piece begins with the last word of what came before, and the piece."""
    at, last = 0, ""
    while at < len(text):
        cut = SEPARATOR.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        own = text[at:end]
        yield bool(last), f"{last} {own}" if last else own
        solid = len(own.rstrip(SEPARATORS))
        if solid:
            head = solid
            while head and own[head - 1] not in SEPARATORS:
                head -= 1
            last = own[head:solid]
        at = end


def counts_of(con: duckdb.DuckDBPyConnection, numbers: list[int], goes_on: list[bool], texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """number, bucket and n, in order, of the n-grams of texts."""
    con.register("pieces", pa.table({"number": pa.array(numbers, pa.int32()), "goes_on": pa.array(goes_on, pa.bool_()), "text": pa.array(texts, pa.string()) if isinstance(texts, list) else texts}))
    found = con.execute(COUNTS).fetchnumpy()
    con.unregister("pieces")
    return found["number"], found["bucket"], found["n"]


def held_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but text, and ``held``: the buckets of each text's n-grams and how often each comes."""
    with counter() as con:
        for part in (p for batch in batches for p in chunks(batch, "text", PIECE)):
            texts = part.column("text")
            if part.num_rows == 1 and len(own := texts[0].as_py() or "") > PIECE:
                total = np.zeros(BUCKETS, np.int64)
                for goes_on, piece in pieces(own):
                    _, bucket, n = counts_of(con, [0], [goes_on], [piece])
                    total[bucket] += n
                number, bucket, n = np.zeros(np.count_nonzero(total), np.int32), np.flatnonzero(total), total[total > 0]
            else:
                number, bucket, n = counts_of(con, list(range(part.num_rows)), [False] * part.num_rows, texts.fill_null(""))
            held = pa.ListArray.from_arrays(pa.array(np.searchsorted(number, np.arange(part.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(n, pa.int32())], ["bucket", "n"]))
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), held], [*names, "held"])


def bucketed(rows: DataFrame) -> DataFrame:
    """Rows with text to the other columns and ``held``, written to the shared folder."""
    return pinned(rows.mapInArrow(held_counts, StructType([*(f for f in rows.schema if f.name != "text"), HELD])))


def totals(held: DataFrame) -> DataFrame:
    """bucket and n, summed over all texts: a row a bucket at most."""
    return held.select(F.inline("held")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """What each bucket adds to a document's weight: 1000 times the log of its smoothed share of the target over that of the source.

    The two tables, and so the array, hold BUCKETS rows at most, whatever the corpus.
    """
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = source.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    both = pinned(both)
    sums = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    ratio = (F.col("t") + 1) * F.lit(sums.S + BUCKETS) / ((F.col("s") + 1) * F.lit(sums.T + BUCKETS))
    told = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()
    return np.array([r.gain for r in told], np.int64)


def weighed(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """The other columns, n_features and weight, the floored mean of gains over a document's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            lists = batch.column("held")
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            n = np.asarray(flat.field("n"), np.int64)
            sums = [np.concatenate([np.zeros(1, np.int64), np.cumsum(x)]) for x in (n, n * gain[np.asarray(flat.field("bucket"))])]
            features, gained = (x[ends[1:]] - x[ends[:-1]] for x in sums)
            names = [c for c in batch.schema.names if c != "held"]
            weights = np.where(features > 0, gained // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(features), pa.array(weights)], [*names, "n_features", "weight"])

    return held.mapInArrow(run, StructType([*(f for f in held.schema if f.name != "held"), StructField("n_features", LongType()), StructField("weight", LongType())]))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the document's id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scores: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All rows with ``rank``: 1, 2, 3, ... of the drawn ones by falling score and then by doc_id (nulls last), else null.

    The count of each score, an integer between about -100,000 and 100,000 whatever the corpus, gives the lowest score that
    is drawn; only rows from there up are sorted, in ranges, and no task gathers them.
    """
    able = F.col("n_words") >= LEAST_WORDS
    counts = sorted(((r.score, r.n) for r in scores.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    at = np.searchsorted(np.cumsum([n for _, n in counts]), wanted) if wanted else None
    if at is None:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    high = able & (F.col("score") >= counts[at][0])
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("number")]
    placed = pinned(scores.where(high).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # a row for each range, of which there are as many as shuffle partitions
    heads = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("head"))
    told = placed.join(F.broadcast(heads), part == F.col("part")).withColumn("rank", F.col("head") + within + 1)
    drawn = told.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scores.columns, "rank")
    return drawn.unionByName(scores.where(~high).withColumn("rank", F.lit(None).cast("long")))


def scored(rows: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, text and more) without text, with n_features, n_words, weight, score and ``number``, a row's own."""
    held, wanted = bucketed(rows), bucketed(target.select("text"))
    weights = weighed(held, gains(totals(held), totals(wanted)))
    words = F.floor((F.col("n_features") + 1) / 2).cast("long")  # n words have n + n - 1 runs
    return pinned(weights.withColumns({"n_words": words, "score": F.col("weight") + noise(F.col("doc_id"), seed), "number": F.monotonically_increasing_id()}))


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents, all columns, whatever their names: ``percent`` of a hundred of those with LEAST_WORDS words.

    Documents like ``target``'s texts are likelier to be drawn. Null texts have no words and are never drawn; very long
    texts are counted whole, piece by piece; repeated rows are documents of their own with the same score, as rows without
    doc_id are with equal texts; ties go to the smaller doc_id. An empty table stays empty, an empty target has no words.
    """
    rows = documents.select(F.col("doc_id"), F.col("text"), F.struct("*").alias("row"))
    return ranked(scored(rows, target, seed), percent).where("rank is not null").select("row.*")


def importance_report(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of each document row; as ``resampled``, extra columns ignored."""
    return ranked(scored(documents.select("doc_id", "text"), target)).select("doc_id", "n_features", "weight", "score", "rank")
