"""Mixing sources to target weights by blocks of words, with DataFrame functions only.

The words of each source, in a pseudorandom order of its documents, are packed into blocks of ``BLOCK_WORDS``. The output is
a row of shards of ``SHARD_SLOTS`` slots. How many slots each source gets in each shard is a multinomial draw whose totals
are held to the targets: every source owns as many draws as its target needs, a pseudorandom permutation of all draws deals
them to shards, and the draws are counted by shard and source. The slots of a source, numbered through its shards by those
counts, go through its blocks by one pseudorandom permutation of block numbers after another, so no block comes more than
three times. The last slot of a source takes only the words that its target still lacks, so a source of any size meets it.
Slots and packed documents meet in a join by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import pinned

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Sources by code point weigh these in turn.
WEIGHTS = (1, 2, 3)
#: Most passes over a source.
REPEATS = 3
#: Documents of a source are put in order within buckets of about so many, and shards are numbered by so many.
BUCKET = 1 << 14
#: Rounds of the index permutation.
ROUNDS = 12
#: A table of so many sources may be broadcast.
SMALL = 100_000
#: Draws listed by one row before they are dealt out.
LOT = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def permuted(index: Column, size: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 (swap-or-not): each round swaps an index with its mirror, or doesn't."""
    return swapped(F.sequence(F.lit(1), F.lit(ROUNDS)), index, size, *seed)


def place_of(value: Column, size: Column, *seed: Column) -> Column:
    """The index that ``permuted`` takes to a value: each round undoes itself, so they run backwards."""
    return swapped(F.sequence(F.lit(ROUNDS), F.lit(1)), value, size, *seed)


def swapped(rounds: Column, index: Column, size: Column, *seed: Column) -> Column:
    def swap(x: Column, step: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(step, *seed), size) - x + size, size)
        return F.when(F.xxhash64(-step, F.greatest(x, mirror), *seed).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(rounds, index, swap)


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size of each row, and an order key; null text has no words."""
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("turn"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, blocks, draws, last_words and the first draw of each source.

    Weights share all words; a target stops at REPEATS times its source, and what is above is reshared by weight: sources
    in the order of REPEATS * size / weight stop as long as the even share of the rest is above that. The draws are the
    slots that hold the target's words, in the order of the permutations; the last one takes ``last_words`` of its block.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.asc_nulls_last("source"))
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(names) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    cap = REPEATS * F.col("source_size").cast("double")
    order = Window.orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    stopped = weighed.withColumn("share", share).withColumn("stops", F.col("share") * F.col("weight") > cap)
    level = F.min(F.when(~F.col("stops"), F.struct(cap / F.col("weight"), F.col("share").alias("share")))).over(whole)["share"]
    leveled = stopped.withColumn("target", F.when(F.col("stops"), cap).otherwise(F.least(F.col("weight") * level, cap)))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    wanted = F.least(F.round("target").cast("long"), REPEATS * F.col("source_size"))
    passed = leveled.withColumns({"blocks": blocks, "wanted": wanted, "passes": F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")})
    # of a pass that is not complete: the place of the source's last block, which may be short, and the words that are wanted of it
    short = F.when(F.col("blocks") > 0, place_of(F.col("blocks") - 1, F.col("blocks"), F.col("source"), F.col("passes")))
    opened = passed.withColumns({"short": short, "tail": F.col("source_size") - (F.col("blocks") - 1) * BLOCK_WORDS, "rest": F.col("wanted") - F.col("passes") * F.col("source_size")})
    even = lambda words: F.ceil(words / BLOCK_WORDS).cast("long")
    full = even(F.col("rest"))
    more = F.when(full <= F.col("short"), full).otherwise(F.greatest(F.col("short"), even(F.col("rest") - F.col("tail"))) + 1)
    before_last = F.when(F.col("more") - 1 <= F.col("short"), (F.col("more") - 1) * BLOCK_WORDS).otherwise((F.col("more") - 2) * BLOCK_WORDS + F.col("tail"))
    counted = opened.withColumn("more", F.when(F.col("rest") > 0, more).otherwise(0))
    drawn = counted.withColumns({"draws": F.coalesce(F.col("passes") * F.col("blocks") + F.col("more"), F.lit(0)).cast("long"), "last_words": F.when(F.col("more") > 0, F.col("rest") - before_last).otherwise(BLOCK_WORDS).cast("long")})
    return drawn.select("source", "source_size", "target", "blocks", "draws", "last_words", F.coalesce(F.sum("draws").over(names.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_draw"), F.sum("draws").over(whole).alias("all_draws"))


def dealt(goals: DataFrame) -> DataFrame:
    """shard, source and slots: how many slots of each output shard the draws give to each source."""
    lots = goals.where("draws > 0").select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("draws") / LOT).cast("long") - 1)).alias("lot"))
    width = int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: lots are few and small, what they list isn't
    draws = lots.repartition(width, "source", "lot").select("source", "all_draws", "first_draw", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("draws"), (F.col("lot") + 1) * LOT) - 1)).alias("draw"))
    place = permuted(F.col("first_draw") + F.col("draw"), F.col("all_draws"), F.lit("slots"))
    return draws.groupBy(F.floor(place / SHARD_SLOTS).cast("long").alias("shard"), "source").agg(F.count("*").alias("slots"))


def numbered(counts: DataFrame) -> DataFrame:
    """The counts and ``first``, the number of the source's first slot in the shard. Ranges of shards keep a source out of one window."""
    ranged = counts.withColumn("range", F.floor(F.col("shard") / BUCKET))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy("source", "range").agg(F.sum("slots").alias("n")).select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    within = Window.partitionBy("source", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("ahead", F.coalesce(F.sum("slots").over(within), F.lit(0)))
    return inside.join(heads, inside.source.eqNullSafe(heads.s) & (inside.range == heads.r)).select("shard", "source", "slots", (F.col("head") + F.col("ahead")).alias("first"))


def few(goals: DataFrame) -> DataFrame:
    """A table of a row for each source, broadcast where their count is small; else the join may split a hot source."""
    return F.broadcast(goals) if goals.count() <= SMALL else goals


def slots(goals: DataFrame) -> DataFrame:
    """shard, source and block of each slot of the mix, ``number``, which is unique in its shard and source, and the ``most`` words that it takes."""
    known = goals.select(F.col("source").alias("s"), "blocks", "draws", "last_words")
    counts = numbered(pinned(dealt(goals)))
    given = counts.join(few(known), counts.source.eqNullSafe(F.col("s")))
    each = given.select("shard", "source", "blocks", "draws", "last_words", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("number"))
    index = F.col("first") + F.col("number")
    return each.select("shard", "source", "number", permuted(index % F.col("blocks"), F.col("blocks"), F.col("source"), F.floor(index / F.col("blocks"))).alias("block"), F.when(index == F.col("draws") - 1, F.col("last_words")).otherwise(BLOCK_WORDS).alias("most"))


def placed(sizes: DataFrame) -> DataFrame:
    """Each document's first word in its source. Buckets, as many as the documents need, keep a source of any size out of one window."""
    buckets = -(-sizes.count() // BUCKET) or 1
    rows = sizes.where("size > 0").withColumn("bucket", F.pmod("turn", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("head"))
    within = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = started.source.eqNullSafe(heads.source) & (started.bucket == heads.bucket)
    return started.join(heads, same).select(started.source, "doc_id", "turn", "size", (F.col("start") + F.col("head")).alias("start"))


def pieces(places: DataFrame) -> DataFrame:
    """The part of a document in each of its blocks: source, block, doc_id, size, start, first_word, words and ``at``, its place in the block."""
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)))
    cut = places.select("*", block.alias("block"))
    head = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    tail = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return cut.select("source", "block", "doc_id", "turn", "size", "start", (head - F.col("start")).alias("first_word"), (tail - head).alias("words"), (head - F.col("block") * BLOCK_WORDS).alias("at"))


def words_within(most: Column) -> Column:
    """Of a piece's words those among the first ``most`` of its block."""
    return F.greatest(F.lit(0), F.least(F.col("words"), most - F.col("at")))


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: shard, number, source, block, doc_id, first_word and words, a row for each document's part of each slot."""
    sizes = pinned(sized(documents))
    parts, each = pieces(placed(sizes)), slots(pinned(targets(sizes)))
    same = parts.source.eqNullSafe(each.source) & (parts.block == each.block)
    # the planner takes listed slots for as few as the counts, so the join is named
    met = each.hint("merge").join(parts, same).withColumn("words", words_within(F.col("most"))).where("words > 0")
    return met.select("shard", "number", each.source, each.block, "doc_id", "first_word", "words")


def packed(documents: DataFrame) -> DataFrame:
    """The output: shard, slot, source, block and text, the block's words in order with one blank between them.

    The slots of a shard stand in a pseudorandom order. Blocks hold BLOCK_WORDS words, but for the last of a source; its last
    slot may hold the beginning of one.
    """
    sizes = pinned(sized(documents))
    goals = pinned(targets(sizes))
    parts = pieces(placed(sizes))
    texts = documents.where("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.col("source").alias("of"), F.regexp_extract_all("text", F.lit(f"({WORD})"), 1).alias("all_words"))
    own = parts.join(texts.dropDuplicates(["id", "key", "of"]), parts.doc_id.eqNullSafe(F.col("id")) & (parts.turn == F.col("key")) & parts.source.eqNullSafe(F.col("of")))
    piece = F.struct("start", "first_word", F.slice("all_words", F.col("first_word").cast("int") + 1, F.col("words").cast("int")).alias("own"))
    # a block gathers BLOCK_WORDS words, no more
    blocks = own.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["own"])), " ").alias("text"))
    each = slots(goals)
    met = each.hint("merge").join(blocks, each.source.eqNullSafe(F.col("s")) & (each.block == F.col("b")))
    joined = met.select("shard", "source", "number", "block", F.when(F.col("most") < BLOCK_WORDS, F.expr("substring_index(text, ' ', cast(most as int))")).otherwise(F.col("text")).alias("text"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("source", "number", "shard"), F.asc_nulls_last("source"), "number")
    return joined.select("shard", (F.row_number().over(order) - 1).alias("slot"), "source", "block", "text")


def shard_counts(documents: DataFrame) -> DataFrame:
    """Slots that each source got in each output shard."""
    return dealt(targets(sized(documents)))


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document row.

    A null source is a source of its own, the last. Null and empty texts have size 0 and nothing is taken from them; with
    no words at all, all targets are 0; an empty table gives no rows. Very long texts are cut whole. Rows that repeat a doc_id are separate documents, ordered by the hash of their text.
    Extra columns are ignored. Reruns agree: all draws are hashes of doc_id, text, source and numbers.
    """
    sizes = pinned(sized(documents))
    goals = pinned(targets(sizes))
    uses = slots(goals).groupBy("source", "block").agg(F.count("*").alias("uses"), F.min("most").alias("most"))
    parts = pieces(placed(sizes))
    same = parts.source.eqNullSafe(uses.source) & (parts.block == uses.block)
    # the planner takes listed slots for as few as the counts, so the join is named
    taken = parts.join(uses.hint("merge"), same, "left").groupBy(parts.source, "start", "doc_id", "size").agg(F.sum(F.coalesce((F.col("uses") - 1) * F.col("words") + words_within(F.col("most")), F.lit(0))).alias("taken"))
    rows = taken.select("source", "doc_id", "size", "taken").unionByName(sizes.where("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    told = few(goals.select(F.col("source").alias("s"), "source_size", "target"))
    return rows.join(told, rows.source.eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


