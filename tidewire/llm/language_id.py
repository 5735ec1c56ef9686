"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, unwrapped, wrapped

#: The most frequent n-grams (n from 1 to 3) in a profile.
PROFILE = 300
#: One document in so many, by the checksum of its id, is held out from learning.
FOLDS = 5
#: Languages that one set of profiles may hold; profiles travel to every task.
MOST_LANGUAGES = 5000
UNKNOWN = "und"
PAD = 1
BITS = np.int64(21)


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and whether it is one or a mark that belongs to one, such as a vowel sign."""
    alone = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return alone, alone | np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of the lower-cased letters and their marks; each word is padded on both sides. None without a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter, part = letters()
    if not letter[points].any():
        return points[:0]
    points[~part[points]] = PAD
    points = points[np.concatenate([[True], (points[1:] != PAD) | (points[:-1] != PAD)])]
    one = points[points != PAD]
    two = (points[:-1] << BITS) | points[1:]
    three = (points[:-2] << (2 * BITS)) | (points[1:-1] << BITS) | points[2:]
    return np.concatenate([one, two, three[points[1:-1] != PAD]]) if len(one) else one


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, codes
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent codes, most frequent first; equal counts by code."""
    found, counts = counted(codes)
    if len(found) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        some = counts >= least
        found, counts = found[some], counts[some]
    return found[np.argsort(-counts, kind="stable")][:PROFILE]


class Profiles:
    """Rank of each n-gram in each language's profile: PROFILE entries a language, by n-gram."""

    def __init__(self, by_language: dict[str, list[int]]) -> None:
        self.languages = sorted(by_language)
        codes = np.array([c for name in self.languages for c in by_language[name]], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, starts = np.unique(codes[order], return_index=True)
        self.starts = np.append(starts, len(codes))
        self.language = np.repeat(np.arange(len(self.languages)), [len(by_language[name]) for name in self.languages])[order].astype(np.int32)
        self.rank = np.concatenate([np.arange(len(by_language[name])) for name in self.languages] or [np.zeros(0, np.int64)])[order].astype(np.int32)

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, the first by name among equals, and one less the share of the largest distance."""
        own = ranked(grams(text)) if text else ()
        if not len(own) or not len(self.codes):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == own)
        first, counts = self.starts[at[place]], np.diff(self.starts)[at[place]]
        entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        closer = PROFILE - np.abs(self.rank[entry] - np.repeat(place, counts))  # an n-gram that a profile lacks is PROFILE out of place
        apart = PROFILE * len(own) - np.bincount(self.language[entry], closer, len(self.languages))
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (PROFILE * len(own)))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and text to lang, gram and count, added up within each batch."""
    for batch in batches:
        held: dict[str, list[np.ndarray]] = {}
        for part in chunks(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(grams(text))
            for lang, codes in held.items():
                if sum(map(len, codes)) > 1 << 21:
                    yield counts_batch(lang, np.concatenate(codes))
                    codes.clear()
        for lang, codes in held.items():
            if codes:
                yield counts_batch(lang, np.concatenate(codes))


def counts_batch(lang: str, codes: np.ndarray) -> pa.RecordBatch:
    found, counts = counted(codes)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def held_out(doc_id: Column) -> Column:
    """The checksum of the id as text leaves 0 by FOLDS; a row without id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learned(documents: DataFrame) -> Profiles:
    """Profiles from the text and lang of every document that is not held out."""
    source = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    counts = source.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams"))
    rows = top.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Profiles({r.lang: r.grams for r in rows})


def identified(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of each row; only text decides."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [shared.value.nearest(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document row.

    Null text, or text without a letter: ``und`` and 0; so are all rows where nothing can be learned. Equal texts get equal
    values, repeated rows are each returned, extra columns are ignored, very long texts are read whole.
    """
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    return identified(documents, learned(documents)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, *, least_score: float = 0.0) -> DataFrame:
    """Documents in a learned language, with all their columns: no language and scores below ``least_score`` go.

    Null texts and texts without a letter have no language, nor has any where nothing can be learned. Repeated rows stay or go
    alike; ties fall to the first language by name; an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learned(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [shared.value.nearest(t) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array([x[0] != UNKNOWN and x[1] >= least_score for x in found], pa.bool_()))

    rows = wrapped(documents, "text")
    return unwrapped(rows.mapInArrow(run, rows.schema), documents.columns, "text")
