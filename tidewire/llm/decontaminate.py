"""Benchmark decontamination with one FM-index per training shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import ALNUM_WORDS, chunks, pinned, unwrapped, word_hashes, wrapped

#: Words in a window.
WINDOW = 13
#: Symbols in a shard's index, unless one document alone has more.
SHARD_SYMBOLS = 1 << 19
#: One suffix position in so many is kept.
SAMPLE_EVERY = 8
#: Pairs of a benchmark window and an item searched in one pass over the documents; more pairs take more passes.
BLOCK_WINDOWS = 200_000
#: A document word's symbol if no benchmark item has the word.
OTHER = 1


def suffix_rows(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 ends a document; each 0 sorts before all else, by its position.

    A round sorts only the suffixes that are still tied.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    below = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
    rank = below[symbols]
    rank[ends] = np.arange(len(ends))
    tied = np.flatnonzero(symbols != 0)
    step = 1
    while len(tied):
        key = rank[tied] * np.int64(n) + rank[np.minimum(tied + step, n - 1)]
        order = np.argsort(key)
        key, at = key[order], tied[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        head = key // n
        new_group = np.concatenate([[True], head[1:] != head[:-1]])
        spot = np.arange(len(key))
        first = np.maximum.accumulate(np.where(new_key, spot, 0))
        group = np.maximum.accumulate(np.where(new_group, spot, 0))
        rank[at] = head + first - group
        alone = new_key & np.concatenate([new_key[1:], [True]])
        tied = at[~alone]
        step *= 2
    rows = np.empty(n, np.int64)
    rows[rank] = np.arange(n)
    return rows


class WaveletMatrix:
    """Rank and access over a sequence of small integers, for arrays of queries."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels = []
        for level in reversed(range(levels)):
            bits = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.levels.append((level, len(values) - int(ones[-1]), ones))
            up = bits.astype(bool)
            values = np.concatenate([values[~up], values[up]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(upto)
        for level, zeros, ones in self.levels:
            up = (symbol >> level) & 1 == 1
            a, b = ones[start], ones[upto]
            start, upto = np.where(up, zeros + a, start - a), np.where(up, zeros + b, upto - b)
        return upto - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(at)
        for level, zeros, ones in self.levels:
            a = ones[at]
            up = ones[at + 1] > a
            out |= up.astype(out.dtype) << level
            at = np.where(up, zeros + a, at - a)
        return out


class FmIndex:
    """An FM-index over documents that each end in symbol 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        rows = suffix_rows(symbols)
        self.transform = WaveletMatrix(symbols[rows - 1], max(1, int(alphabet).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        heads = np.concatenate([[0], np.flatnonzero(symbols == 0)[:-1] + 1])
        place = np.arange(len(symbols)) - np.repeat(heads, np.diff([*heads, len(symbols)]))
        sampled = place[rows] % SAMPLE_EVERY == 0  # a document's first symbol always is, so no walk leaves a document
        self.samples_before = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = rows[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are right-aligned rows of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), total, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -back]
            low[live], high[live] = (self.below[symbol] + self.transform.rank(symbol, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a row has a sampled position."""
        at, walked, out = rows.copy(), np.zeros_like(rows), np.full_like(rows, -1)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            found = self.samples_before[here + 1] > self.samples_before[here]
            done = live[found]
            out[done] = self.samples[self.samples_before[at[done]]] + walked[done]
            live = live[~found]
            symbol = self.transform.access(at[live])
            at[live] = self.below[symbol] + self.transform.rank(symbol, at[live])
            walked[live] += 1
        return out


class Phrases:
    """A block of distinct benchmark windows as rows of symbols, and the items that each belongs to."""

    def __init__(self, windows: dict[tuple[int, ...], list[str]]) -> None:
        self.vocabulary = np.unique(np.array([w for p in windows for w in p], np.uint64))
        self.lengths = np.array([len(p) for p in windows], np.int64)
        self.width = int(self.lengths.max(initial=1))
        self.symbols = np.zeros((len(windows), self.width), np.int64)
        for i, p in enumerate(windows):
            self.symbols[i, self.width - len(p) :] = self.symbol(np.array(p, np.uint64))
        self.items = list(windows.values())

    def symbol(self, words: np.ndarray) -> np.ndarray:
        """Symbols of hashed words; a word that no window has is OTHER."""
        if not len(self.vocabulary):
            return np.full(len(words), OTHER, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + OTHER + 1, OTHER)


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id string, words array<long>): each item's windows of hashed words; an item of fewer words is one window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = word_hashes(batch.column("text"), ALNUM_WORDS)
            words, out = words.view(np.int64), []
            for item, a, b in zip(batch.column("item_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                out += [(item, words[i : min(b, i + width)].tolist()) for i in range(a, max(a + 1, b - width + 1)) if b > a and item is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(windows, "item_id string, words array<long>")


def shard_hits(phrases: Phrases, symbols: np.ndarray, origin: np.ndarray, word_doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of a shard a window covers, and the items found in each document.

    symbols: the indexed text; origin: the word number of each symbol; word_doc: each word's document; ends: words before each document and in all.
    """
    covered = np.zeros(int(ends[-1]) + 1, np.int64)
    index = FmIndex(symbols, len(phrases.vocabulary) + OTHER)
    low, high = index.search(phrases.symbols, phrases.lengths, len(symbols))
    hit = np.flatnonzero(low < high)
    found: dict[int, set[str]] = {}
    for at in range(0, len(hit), 4096):
        some = hit[at : at + 4096]
        counts = (high - low)[some]
        which = np.repeat(some, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
        word = origin[index.locate(rows)]
        np.add.at(covered, word, 1)
        np.add.at(covered, word + phrases.lengths[which], -1)
        for pair in np.unique(word_doc[word] * len(phrases.items) + which).tolist():
            found.setdefault(pair // len(phrases.items), set()).update(phrases.items[pair % len(phrases.items)])
    return np.cumsum(covered[:-1]) > 0, found


def shards(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
    """Slices of documents until their symbols fill a shard. A run of words that no window has is one symbol: no window crosses it."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for batch in batches:
        for part in chunks(batch, "text"):
            words, offsets = word_hashes(part.column("text"), ALNUM_WORDS)
            counts = np.diff(offsets)
            symbols = phrases.symbol(words)
            keep = symbols != OTHER
            keep[1:] |= symbols[:-1] != OTHER
            starts = offsets[:-1][counts > 0]
            keep[starts] = True
            # a document's end follows its last word
            kept = np.flatnonzero(keep)
            gaps = np.searchsorted(kept, offsets[1:])
            held[0].append(part)
            held[1].append(np.insert(symbols[kept], gaps, 0))
            held[2].append(np.insert(kept, gaps, offsets[1:]))
            held[3].append(counts)
            size += len(held[1][-1])
            if size >= SHARD_SYMBOLS:
                yield held
                held, size = ([], [], [], []), 0
    if held[0]:
        yield held


def scan(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[list[str]], list[list[tuple[int, int]]]]]:
    """Per shard: its rows, their word counts, their hit words, the items found in each row, and the merged spans of hit words."""
    for parts, symbols, origin, counts in shards(batches, phrases):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        before = np.concatenate([[0], np.cumsum([c.sum() for c in counts])])
        n_words = np.concatenate(counts)
        ends = np.concatenate([[0], np.cumsum(n_words)])
        word_doc = np.repeat(np.arange(len(n_words)), n_words)
        origin = np.concatenate([o + b for o, b in zip(origin, before, strict=False)])
        covered, found = shard_hits(phrases, np.concatenate(symbols), origin, word_doc, ends)
        total = np.concatenate([[0], np.cumsum(covered)])
        n_hit = total[ends[1:]] - total[ends[:-1]]
        spans: list[list[tuple[int, int]]] = [[] for _ in n_words]
        for doc in np.flatnonzero(n_hit).tolist():
            own = np.concatenate([[False], covered[ends[doc] : ends[doc + 1]], [False]]).astype(np.int8)
            edge = np.flatnonzero(np.diff(own))
            spans[doc] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        yield rows, n_words, n_hit, [sorted(found.get(i, ())) for i in range(len(n_words))], spans


HITS = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start:long,stop:long>>"


def passes(benchmark: DataFrame, width: int, block: int) -> tuple[DataFrame, int]:
    """Pairs of a distinct window and an item, each with the ``part`` that searches it, and how many parts there are, one at least."""
    pairs = benchmark_windows(benchmark, width).distinct()
    n = -(-pairs.count() // block) or 1
    return pairs.withColumn("part", F.pmod(F.xxhash64("words", "item_id"), F.lit(n)).cast("int")), n


def phrases_of(pairs: DataFrame, part: int) -> Phrases:
    """The windows of one part, about ``BLOCK_WINDOWS`` pairs, on the driver."""
    windows: dict[tuple[int, ...], list[str]] = {}
    for r in pairs.where(F.col("part") == part).toLocalIterator():
        windows.setdefault(tuple(np.array(r.words, np.int64).view(np.uint64).tolist()), []).append(r.item_id)
    return Phrases(windows)


def hits_of(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """row_id and HITS of each row of row_id and text, for one part."""
    key = docs.schema["row_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for rows, n_words, n_hit, items, spans in scan(batches, shared.value):
            yield pa.RecordBatch.from_arrays([rows.column("row_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], span)], ["row_id", "n_words", "n_hit", "item_ids", "hit_spans"])

    return docs.mapInArrow(run, f"row_id {key}, {HITS}")


def contamination(documents: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Benchmark hits of each document row: its column ``row_id``, and HITS.

    ``documents`` needs columns row_id (any type, null and repeated values too) and text. A null text, or one without words,
    has no words and no hits; benchmark rows with null text or null item_id have no windows; equal items are both reported.
    With no benchmark windows every document has no hits. Very long texts are indexed whole. Extra columns are ignored.
    Documents are indexed where they are read: no shuffle. The windows travel to the tasks in parts of about ``block`` pairs
    of window and item; more pairs take more passes over rows that are numbered once, whose hits are merged row by row.
    """
    pairs, n = passes(benchmark, width, block)
    docs = documents.select("row_id", "text")
    if n == 1:
        return hits_of(docs, phrases_of(pairs, 0))
    numbered = pinned(docs.withColumn("__row", F.monotonically_increasing_id()))
    merged = merged_passes(numbered.select(F.col("__row").alias("row_id"), "text"), pinned(pairs), n)
    return numbered.select("row_id", "__row").join(merged.withColumnRenamed("row_id", "__row"), "__row").drop("__row")


def merged_passes(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """row_id and HITS over all parts, of rows whose row_id is unique: items united, spans merged and counted again.

    Each part's hits are written before the next part's windows are gathered.
    """
    found = None
    for part in range(n):
        hits = pinned(hits_of(docs, phrases_of(pairs, part)))
        found = hits if found is None else found.unionByName(hits)
    ordered = F.array_sort(F.flatten(F.collect_list("hit_spans")))
    joined = F.aggregate(
        "spans",
        F.lit(None).cast("array<struct<start:long,stop:long>>"),
        lambda done, s: F.when(done.isNull(), F.array(s))
        .when(F.element_at(done, -1)["stop"] < s["start"], F.concat(done, F.array(s)))
        .otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"))))),
    )
    return (
        found.groupBy("row_id")
        .agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), ordered.alias("spans"))
        .withColumn("hit_spans", F.coalesce(joined, F.array().cast("array<struct<start:long,stop:long>>")))
        .select("row_id", "n_words", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"), "item_ids", "hit_spans")
    )


def is_contaminated():
    """A twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_report(documents: DataFrame, benchmark: DataFrame, *, block: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word numbers, merged) of each document row.

    Each row is judged by its own text, so rows with a null or repeated doc_id, and equal rows, are all returned.
    """
    hits = contamination(documents.select(F.col("doc_id").alias("row_id"), "text"), benchmark, block=block)
    return hits.select(
        F.col("row_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        F.transform("hit_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))).cast("string").alias("hit_spans"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Each row is judged by its own text."""
    pairs, n = passes(benchmark, WINDOW, block)
    if n > 1:
        numbered = pinned(wrapped(documents, "text").withColumn("row_id", F.monotonically_increasing_id()))
        bad = merged_passes(numbered.select("row_id", "text"), pinned(pairs), n).where(is_contaminated()).select("row_id")
        return unwrapped(numbered.join(bad, "row_id", "left_anti"), documents.columns, "text")
    shared = documents.sparkSession.sparkContext.broadcast(phrases_of(pairs, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n_words, n_hit, _, _ in scan(batches, shared.value):
            keep = ~((n_hit > 0) & (20 * n_hit >= n_words))
            yield rows.filter(pa.array(keep))

    rows = wrapped(documents, "text")
    return unwrapped(rows.mapInArrow(run, rows.schema), documents.columns, "text")


def sha_of_items(items: list[str]) -> str:
    """What items_sha256 holds."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
