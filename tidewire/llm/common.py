"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.shared import cleared, pinned, shared_dir  # noqa: F401

#: Text bytes handled at once inside a task, whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(documents: DataFrame, *apart: str) -> DataFrame:
    """``row``, a struct of all columns but those ``apart``, and these beside it: no name of the caller's can clash with an operator's."""
    own = [quoted(c) for c in documents.columns if c not in apart]
    return documents.select((F.struct(*own) if own else F.lit(None).cast("int")).alias("row"), *apart)


def unwrapped(rows: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The columns of rows that ``wrapped`` made, in their order."""
    return rows.select(*(F.col(c) if c in apart else F.col("row")[c].alias(c) for c in columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is made once, however often, and in whatever lambda, the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(name: str) -> Column:
    """A column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Parts into which the rows of one key are dealt before anything gathers them.
SALTS = 32


def with_totals(rows: DataFrame, keys: list[str], by: Column, totals: dict[str, tuple[str, Column]], keep: Column | None = None) -> DataFrame:
    """All rows of the keys that ``keep`` (of the totals) leaves, with totals of their key: name to ("sum", "min" or "max", column).

    No task gathers the rows of a key: they are dealt by ``by`` to SALTS parts, totals are taken of parts and then of keys,
    and come back only to the parts that a key has. Null keys are not matched.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(*keys, "__salt").agg(*(getattr(F, how)(c).alias(name) for name, (how, c) in totals.items()))
    whole = parts.groupBy(*keys).agg(*(getattr(F, how)(name).alias(name) for name, (how, _) in totals.items()), F.collect_list("__salt").alias("__salts"))
    if keep is not None:
        whole = whole.where(keep)
    return dealt.join(whole.withColumn("__salt", F.explode("__salts")).drop("__salts"), [*keys, "__salt"]).drop("__salt")


def salted_join(rows: DataFrame, one_each: DataFrame, keys: list[str], by: Column, salts: int = SALTS) -> DataFrame:
    """An inner join of rows with a table of one row a key, which is repeated for each of ``salts`` parts: for keys of many rows."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(one_each.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "__salt"]).drop("__salt")


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudorandom uint64 for a seed."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([seed], np.uint64))[0])


BYTE_CODES = stream(1, 256)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def byte_class(*, separators: bytes) -> np.ndarray:
    """256 booleans: which bytes belong to words. Bytes of 128 and over always do."""
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    return keep


#: ``[^\x20\x09-\x0D]+``
SPACED_WORDS = byte_class(separators=bytes([0x20, *range(0x09, 0x0E)]))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM_WORDS = byte_class(separators=bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (and the last ends). Null counts as empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: Characters of scripts that are written without blanks, and their punctuation, from one to another; each can be a word of its own.
UNSPACED = ((0x3001, 0x3002), (0xFF01, 0xFF1F), (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where the UTF-8 bytes of UNSPACED characters begin."""
    lead = np.flatnonzero(data >= 0xE0)
    long = data[lead] >= 0xF0
    follow = [(data[np.minimum(lead + k, len(data) - 1)] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
    code = np.where(long, (data[lead] & 7).astype(np.int64) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2], (data[lead] & 15).astype(np.int64) << 12 | follow[0] << 6 | follow[1])
    return lead[np.logical_or.reduce([(code >= a) & (code <= z) for a, z in UNSPACED])]


def words_of(texts: pa.Array, keep: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each ASCII-lower-cased word of all texts; where each text's words begin (and the last's end); where
    each word's bytes begin and end. With ``apart``, an UNSPACED character is a word."""
    data, offsets = text_bytes(texts)
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    inside = keep[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    if apart and len(alone := unspaced(data)):
        begins[alone] = True
        after = alone + np.where(data[alone] >= 0xF0, 4, 3)
        after = after[after < len(data)]
        begins[after] |= inside[after]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    word = np.cumsum(begins) - 1
    place = np.arange(len(data)) - starts[word]
    place[~inside] = 0
    parts = BYTE_CODES[LOWERED[data]]
    parts *= stream(2, int(place.max()) + 1)[place] | np.uint64(1)
    parts[~inside] = 0
    return mixed(np.add.reduceat(parts, starts)), np.searchsorted(starts, offsets), starts, starts + np.add.reduceat(inside, starts, dtype=np.int64)


def word_hashes(texts: pa.Array, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two of ``words_of``."""
    return words_of(texts, keep)[:2]
