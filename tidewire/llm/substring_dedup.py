"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewire.llm.common import SPACED_WORDS, chunks, mixed, pinned, text_bytes, unwrapped, words_of, wrapped

#: A span is the shortest run of sentences from its first one on, or up to its last one, that has so many words.
SPAN_WORDS = 20
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True


#: UTF-8 of the ideographic full stop, exclamation and question marks.
WIDE_STOPS = np.array([0xE38082, 0xEFBC81, 0xEFBC9F])


def stops(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether words that end before these bytes end a sentence."""
    last = data[ends - 1]
    out, wide = STOPS[last], np.flatnonzero((last >= 0x80) & (ends >= 3))
    at = ends[wide]
    out[wide] = np.isin(data[at - 3].astype(np.int64) << 16 | data[at - 2].astype(np.int64) << 8 | data[at - 1], WIDE_STOPS)
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; the first word of each sentence (and the number of words); where each text's sentences begin (and the
    last's end); where each sentence's bytes begin.

    A word is a run without blanks, or one character of a script that is written without them. A sentence ends after a word
    that ends in . ! or ? (ASCII or ideographic), at a line's end, and with the text.
    """
    data, _ = text_bytes(texts)
    hashes, offsets, starts, ends = words_of(texts, SPACED_WORDS, apart=True)
    if not len(hashes):
        return hashes, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), starts
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(hashes), bool)
    opens[1:] = stops(data, ends[:-1]) | (newlines[starts[1:]] > newlines[ends[:-1]])
    opens[offsets[:-1][offsets[:-1] < len(hashes)]] = True
    first = np.flatnonzero(opens)
    return hashes, np.append(first, len(hashes)), np.searchsorted(first, offsets), starts[first]


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, first sentence, sentences and hash of each span; sentence numbers begin at 0 in each text.

    Of a repeated passage of SPAN_WORDS words or more, spans from its first sentence on and up to its last one cover all.
    """
    hashes, first, owned, _ = sentences(texts)
    n = len(first) - 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row = np.repeat(np.arange(len(owned) - 1), np.diff(owned))
    last = np.searchsorted(first, first[:-1] + SPAN_WORDS)  # the sentence before this one has the last word needed
    onward = last <= owned[row + 1]
    begin = np.searchsorted(first, first[1:] - SPAN_WORDS, side="right") - 1  # the last sentence from which words suffice
    back = begin >= owned[row]
    places = np.arange(n)
    both = np.unique(np.concatenate([places[onward] * (n + 1) + last[onward], begin[back] * (n + 1) + places[back] + 1]))
    start, stop = both // (n + 1), both % (n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)])
    words = first[stop] - first[start]
    named = mixed((sums[first[stop]] - sums[first[start]]) * powers(UNBASE, len(hashes))[first[start]] + words.astype(np.uint64))
    return row[start], start - owned[row[start]], stop - start, named.view(np.int64)


def span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """none, id, text_hash and text to span, none, id, text_hash, first, size and later.

    Of a span that a chunk of texts has at several places, the first stands for all; the others are later copies whatever
    other chunks hold, and leave with ``later`` set. So a span of every document has one row a chunk to be joined.
    """
    for batch in batches:
        for part in chunks(batch, "text"):
            row, first, size, named = spans(part.column("text"))
            none, ids, hashes = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("none", "id", "text_hash"))
            order = np.lexsort((first, hashes, ids, none, named))
            first, size, named, none, ids, hashes = (x[order] for x in (first, size, named, none, ids, hashes))
            fresh = np.concatenate([[True], named[1:] != named[:-1]])[: len(named)]
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(named)), 0))
            later = (none != none[head]) | (ids != ids[head]) | (hashes != hashes[head]) | (first != first[head])
            keep = fresh | later  # a repeated row is no copy of itself
            columns = [(named, pa.int64()), (none, pa.bool_()), (ids, pa.int64()), (hashes, pa.int64()), (first, pa.int32()), (size, pa.int32()), (later, pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], k) for x, k in columns], ["span", "none", "id", "text_hash", "first", "size", "later"])


def covered(runs: list[dict], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r["first"]] += 1
        edge[r["first"] + r["size"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and runs of sentences to the text without them; what follows a removed sentence up to the next one goes with it."""
    for batch in batches:
        for part in chunks(batch, "text"):
            data, ends = text_bytes(part.column("text"))
            _, _, owned, at = sentences(part.column("text"))
            texts, counts, removed = [], np.diff(owned), np.zeros(part.num_rows, np.int64)
            for i, runs in enumerate(part.column("runs").to_pylist()):
                if not runs:
                    texts.append(part.column("text")[i].as_py())
                    continue
                gone = covered(runs, counts[i])
                removed[i] = gone.sum()
                cut = np.append(at[owned[i] : owned[i + 1]], ends[i + 1])
                texts.append((data[ends[i] : cut[0]].tobytes() + b"".join(data[a:b].tobytes() for a, b, g in zip(cut[:-1], cut[1:], gone, strict=True) if not g)).decode())
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "sentences", "removed"])


KEY = ("none", "id", "text_hash")


def edited(documents: DataFrame) -> DataFrame:
    """The rows as ``wrapped`` makes them, text (without repeated spans) apart, and ``sentences`` and ``removed``, the counts of sentences.

    A row goes by doc_id and a hash of its text, one without doc_id by two hashes of 64 bits.
    """
    told = wrapped(documents, "text").withColumn("given", F.col("row.doc_id").cast("long"))
    rows = told.select("row", "text", F.col("given").isNull().alias("none"), F.coalesce("given", F.xxhash64(F.lit("no id"), "text")).alias("id"), F.xxhash64("text").alias("text_hash"))
    found = pinned(rows.where("text is not null").select(*KEY, "text").mapInArrow(span_rows, "span long, none boolean, id long, text_hash long, first int, size int, later boolean"))
    place = F.struct(*KEY, "first")
    joined = found.where("not later")
    # a span that every chunk holds has a row in each: aggregates take them where they are, and the join may split its side
    first = joined.groupBy("span").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select("span", "kept")
    gone = joined.join(first, "span").where(place > F.col("kept")).select(*KEY, "first", "size").unionByName(found.where("later").select(*KEY, "first", "size"))
    runs = gone.groupBy(*KEY).agg(F.collect_set(F.struct("first", "size")).alias("runs"))
    met = rows.join(runs, list(KEY), "left").select("row", "text", "runs")
    more = [StructField("text", StringType()), StructField("sentences", LongType()), StructField("removed", LongType())]
    return met.mapInArrow(without, StructType([met.schema["row"], *more]))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents without sentences that a later copy of a span covers; all rows and columns stay, whatever their names.

    The first copy, by doc_id (nulls last) and sentence, stays; copies within one document count. Words compare without
    ASCII case, sentences by their words. Null texts, and texts of fewer than SPAN_WORDS words, stay as they are. Equal rows
    (same doc_id and text) are edited alike and are not copies of each other. Very long texts are taken whole. An empty table stays empty.
    """
    return unwrapped(edited(documents), documents.columns, "text")


def span_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, changed and the text that stays, of each document row."""
    return edited(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row.doc_id", F.col("sentences").alias("n_sentences"), F.col("removed").alias("n_removed"), (F.col("removed") > 0).alias("changed"), "text")
