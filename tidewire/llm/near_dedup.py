"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles. Documents of equal sets are one set of the join. Each of several
independent trees branches the sets by selected minwise tokens: a node's sets that share the tokens of the selected
coordinates go to the same child. Nodes of at most ``WHOLE`` blocks of ``LEAF`` sets are compared exhaustively, two blocks at
a time. A larger node branches again, by as many tokens at once as bring its children down to that; a node that hardly
shrinks by branching is dense, that is, most of its sets are alike: its sets are dealt to blocks, each block is compared with a few pivots from the middle of the node and within itself, and what isn't linked to the first pivot
is compared with every block. So no node is dropped or cut, and no task holds more than a few blocks. Links are confirmed on full sets; a
comparison is skipped only where both sets are already in one component. Components come from alternating large and
small stars over written edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SPACED_WORDS, chunks, mixed, pinned, quoted, salted_join, stream, with_totals, word_hashes

#: Words in a shingle.
SHINGLE = 5
#: Minwise tokens of a set, and of them one in each tree's root.
TOKENS = 64
TREES = 8
#: Sets in a block of a node, and blocks of a node that is compared exhaustively: each set goes to WHOLE - 1 pairs of blocks at most.
LEAF = 512
WHOLE = 4
#: Tokens at most by which a node branches at once, the share of linked pairs that all ways of a node may miss together, and
#: how often nodes branch. With a mean similarity under DENSE a node of a million sets is down to LEAF long before; what is
#: larger still is compared block by block, so nothing is cut off.
JOINT = 8
MISSED = 0.03
DEPTH = 24
#: A large node is dense if SAMPLED of its sets are so similar to one another on average.
DENSE = 0.6
SAMPLED = 8
#: Sets that each block of a dense node is compared with.
PIVOTS = 8
#: Link where link[1] * intersection >= link[0] * union, unless a caller asks for another threshold.
LINK = (85, 100)

MULTIPLIERS = stream(7, SHINGLE) | np.uint64(1)
TOKEN_FACTORS, TOKEN_OFFSETS = stream(8, TOKENS) | np.uint64(1), stream(9, TOKENS)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's hashed words; fewer words than a shingle make one."""
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out += words[i : i + n] * MULTIPLIERS[i]
    return np.unique(mixed(out))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of TOKENS hashes over the set, 32 bits each."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        hashed = shingles[at : at + 4096, None] * TOKEN_FACTORS + TOKEN_OFFSETS
        out = np.minimum(out, hashed.min(axis=0) >> np.uint64(32))
    return out.astype(np.uint32).view(np.int32)


def sets_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in chunks(batch, column):
        words, offsets = word_hashes(part.column(column), SPACED_WORDS)
        yield part, [shingle_set(words[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


NAMES = stream(10, 2)


def named(sets: list[np.ndarray]) -> list[list[int | None]]:
    """128 bits that name each set, as two columns."""
    return [[int(mixed(s + f).sum().view(np.int64)) if len(s) else None for s in sets] for f in NAMES]


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key and text to doc_id, text_key, n_shingles, set_a, set_b (which name the set) and mins."""
    for batch in batches:
        for part, sets in sets_of(batch):
            mins = [minwise(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(n, pa.int64()) for n in named(sets)), pa.array(mins, pa.list_(pa.int32()))],
                ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "mins"],
            )


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield together(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield together(held)


def together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def sketch_agree(link: tuple[int, int]) -> int:
    """Tokens by which the sketches of linked sets agree at least: the threshold less five standard deviations of TOKENS tokens."""
    share = link[0] / link[1]
    return max(0, int(TOKENS * share - 5 * (TOKENS * share * (1 - share)) ** 0.5))


def alike(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """path, tree, rep, mins and leaves sorted by path to the path and rep of sets whose sketch agrees with another's in the node.

    leaves: bits of the trees whose root node of this set is compared whole. Two sets that also meet in an earlier such node are
    compared there and not again here.
    """
    bits = 1 << np.arange(TREES)
    for batch in groups(batches, ["path"]):
        if batch.num_rows < 2:
            continue
        mins = batch.column("mins").flatten().to_numpy().reshape(-1, TOKENS)
        roots = mins[:, :: TOKENS // TREES]
        earlier = (batch.column("leaves").to_numpy()[:, None] & bits > 0) & (np.arange(TREES) < batch.column("tree")[0].as_py())
        keep = np.zeros(len(mins), bool)
        for i in range(len(mins) - 1):
            same = np.flatnonzero((mins[i + 1 :] == mins[i]).sum(axis=1) >= agree) + i + 1
            same = same[~((roots[same] == roots[i]) & earlier[i]).any(axis=1)]
            keep[same] = True
            keep[i] |= len(same) > 0
        if keep.any():
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("path", "rep")], ["path", "rep"])


def linked(a: np.ndarray, b: np.ndarray, link: tuple[int, int]) -> bool:
    small, large = sorted((len(a), len(b)))
    if link[1] * small < link[0] * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return link[1] * same >= link[0] * (small + large - same)


#: Shingles of a block's sets in all that are compared by a matrix product, and columns of a product; a block of more goes pair by pair.
MOST_SHINGLES, COLUMNS = 1 << 19, 1024


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The intersection size of each pair of sets: a product of the sets' incidence with the shingles that two or more have."""
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    some = shared[which]
    column, row = (np.cumsum(shared, dtype=np.int32) - 1)[which[some]], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[some]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out, part = np.zeros((len(sets), len(sets)), np.float32), np.zeros((len(sets), COLUMNS), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
        part[row[a:b], column[a:b] - at] = 0
    return out


def linked_pairs(sets: list[np.ndarray], link: tuple[int, int], apart: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Pairs (i > j) of sets that are linked; pair by pair, those of unlike sizes, or not ``apart`` any more, are not compared."""
    sizes = np.array([len(s) for s in sets])
    same = overlaps(sets) if len(sets) > 8 and sizes.sum() <= MOST_SHINGLES else None
    for i in range(len(sets)):
        if same is not None:
            own = same[i, :i].astype(np.int64)
            yield from ((i, j) for j in np.flatnonzero(link[1] * own >= link[0] * (sizes[i] + sizes[:i] - own)).tolist())
        else:
            fits = np.flatnonzero((link[1] * sizes[:i] >= link[0] * sizes[i]) & (link[1] * sizes[i] >= link[0] * sizes[:i]))
            yield from ((i, j) for j in fits.tolist() if apart(i, j) and linked(sets[i], sets[j], link))


class Components:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


EDGES = "path long, a long, b long"


def confirm(batches: Iterator[pa.RecordBatch], link: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """path, block, role, rep and set sorted by path and block to edges of a forest over the links of each block.

    role 0: a set of the block, 1: a pivot, 2: a set that comes from elsewhere and is compared with sets of the block
    only. An edge from a set to itself says that it is not linked, by the block, to the first pivot.
    """
    for batch in groups(batches, ["path", "block"]):
        reps, roles = batch.column("rep").to_numpy(), batch.column("role").to_numpy()
        order = np.lexsort((reps, -roles))
        reps, roles = reps[order], roles[order]
        sets = [np.frombuffer(batch.column("set")[int(i)].as_buffer(), np.uint64) for i in order]
        if (roles == 1).any():  # a pivot is a set of its own block too
            first = sorted({(x, s.tobytes()): i for i, (x, s) in reversed(list(enumerate(zip(reps.tolist(), sets, strict=True))))}.values())
            reps, roles, sets = reps[first], roles[first], [sets[i] for i in first]
        tree = Components(len(sets))
        for i, j in linked_pairs(sets, link, lambda i, j: tree.find(i) != tree.find(j)):
            if roles[i] != 2 or roles[j] != 2:
                tree.join(i, j)
        roots = np.array([tree.find(i) for i in range(len(sets))])
        low: dict[int, int] = {}
        for r, x in zip(roots.tolist(), reps.tolist(), strict=True):
            low[r] = min(x, low.get(r, x))
        ends = np.array([low[r] for r in roots.tolist()])
        pairs = [(int(x), int(y)) for x, y in zip(reps, ends, strict=True) if x != y]
        if (roles == 1).any():
            main = roots[np.flatnonzero((roles == 1) & (reps == reps[roles == 1].min()))[0]]
            pairs += [(int(x), int(x)) for x, r in zip(reps, roots, strict=True) if r != main]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("path")[0].as_py()] * len(pairs), pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["path", "a", "b"])


def sets_for(documents: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and set of the reps wanted. ``reps``: rep and the low (a doc_id), set_a and set_b by which its text is known.

    Texts go over the network once, and what is kept is a set for each rep.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in sets_of(batch):
                own = [a == x and b == y for a, b, x, y in zip(*named(sets), part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True)]
                keep = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(keep)), pa.array([sets[i].tobytes() for i in keep.tolist()], pa.binary())], ["rep", "set"])

    found = documents.join(reps, documents.doc_id == F.col("low")).select("low", "rep", "set_a", "set_b", "text", F.xxhash64("text").alias("hash"))
    # repeated rows are one; the join has dealt them by doc_id already
    return pinned(found.dropDuplicates(["low", "rep", "hash"]).mapInArrow(make, "rep long, set binary"))


def confirmed(sets: DataFrame, wanted: DataFrame, link: tuple[int, int]) -> DataFrame:
    return wanted.join(sets, "rep").select("path", "block", "role", "rep", "set").repartition("path", "block").sortWithinPartitions("path", "block").mapInArrow(partial(confirm, link=link), EDGES)


def sized(members: DataFrame) -> DataFrame:
    """Members of nodes with two sets or more, and the node's size."""
    return with_totals(members, ["path"], F.col("rep"), {"size": ("sum", F.lit(1))}, F.col("size") > 1)


def cells(size: Column) -> Column:
    """Where a set of a node of at most WHOLE blocks is compared: in the node, if it is one block, or with each other block of it."""
    n = F.ceil(size / LEAF).cast("int")
    own = F.pmod(F.xxhash64("path", "rep"), n).cast("int")
    others = F.filter(F.sequence(F.lit(0), n - 1), lambda j: j != own)
    return F.when(n > 1, F.transform(others, lambda j: F.xxhash64(F.col("path"), F.least(own, j), F.greatest(own, j)))).otherwise(F.array("path"))


def child(path: Column, way: Column, joint: Column, level: int) -> Column:
    """The child to which a set goes one way: by ``joint`` tokens of different coordinates."""
    drawn = F.xxhash64(path, way, F.lit(level))
    step = F.shiftright(drawn, 32).bitwiseOR(F.lit(1))  # odd, so that TOKENS steps meet all coordinates
    tokens = F.transform(F.sequence(F.lit(0), joint - 1), lambda i: F.get("mins", F.pmod(F.pmod(drawn, F.lit(TOKENS)) + i * F.pmod(step, F.lit(TOKENS)), F.lit(TOKENS)).cast("int")))
    return F.xxhash64(path, way, tokens)


def branching(size: Column, mean: Column, link: tuple[int, int]) -> tuple[Column, Column]:
    """The number of tokens by which a node branches at once, and of ways.

    Most sets of a large node are often made from one text, whose token each holds with a probability p at a coordinate; two
    agree there with p * p, so p is the root of the mean. A way of k tokens takes p**k of them to one child and a linked pair
    with s**k, s being the threshold, so the ways, about 3.5 / s**k, leave about 3.5 * (p / s)**k rows a set in large children.
    One token at a time, two ways would leave 2 * p rows a set at each level, and so a power of the node's size in the end. A
    low threshold takes fewer tokens at once, which keeps the ways under 40 there too.
    """
    share = min(max(link[0] / link[1], 0.1), 0.99)
    most = max(1, min(JOINT, int(math.log(0.1) / math.log(share))))
    joint = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.log(size / (WHOLE * LEAF / 2)) / -F.log(F.sqrt(F.greatest(mean, F.lit(0.01))))))).cast("int")
    ways = F.ceil(F.log(F.lit(MISSED)) / F.log(1 - F.pow(F.lit(share), joint))).cast("int")
    return joint, ways


def agreeing(a: Column, b: Column) -> Column:
    """The number of tokens by which two sketches agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def density(members: DataFrame) -> DataFrame:
    """path, samples (the tokens of SAMPLED of its sets) and their mean similarity to one another: an aggregate, so no set meets another here."""
    picked = [F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("h"), F.col("mins"))).alias(f"p{i}") for i in range(SAMPLED)]
    pairs = [(i, j) for i in range(SAMPLED) for j in range(i)]
    mean = sum(agreeing(F.col(f"p{i}.mins"), F.col(f"p{j}.mins")) for i, j in pairs) / (len(pairs) * TOKENS)
    return members.groupBy("path").agg(*picked).select("path", mean.alias("mean"), F.array(*(F.col(f"p{i}.mins") for i in range(SAMPLED))).alias("samples"))


def judged(members: DataFrame, level: int, link: tuple[int, int]) -> DataFrame:
    """path, rep, size, mean (of the node), score (agreement with the node's samples: high at its middle) and, unless the node is dense, the paths of its children."""
    met = salted_join(members, density(members), ["path"], F.col("rep"))
    score = F.aggregate(F.transform("samples", lambda s: agreeing(s, F.col("mins"))), F.lit(0), lambda n, x: n + x)
    joint, n = branching(F.col("size"), F.col("mean"), link)
    ways = F.transform(F.sequence(F.lit(0), n - 1), lambda w: child(F.col("path"), w, joint, level))
    return pinned(met.select("path", "rep", "size", "mean", score.alias("score"), F.when(F.col("mean") < DENSE, ways).alias("ways")))


def edges_of(documents: DataFrame, known: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Edges (a > b) whose components are those of the links. ``known``: rep, mins, low, set_a and set_b of distinct sets."""
    sketches = known.select("rep", "mins")
    roots = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.get("mins", t * (TOKENS // TREES))).alias("path")))
    crowd = pinned(sized(sketches.select("rep", F.explode(roots).alias("n")).select("rep", "n.tree", "n.path")))
    whole = F.col("size") <= WHOLE * LEAF
    leaves = [crowd.where(whole).select("path", "tree", "rep", "size")]
    in_leaf = leaves[0].groupBy("rep").agg(F.sum(F.expr("shiftleft(1L, tree)")).alias("leaves"))
    dense = []
    large = crowd.where(~whole).select("path", "rep", "size")
    for level in range(DEPTH + 1):
        if large.isEmpty():
            break
        if level == DEPTH:
            dense.append(large.withColumn("score", F.lit(0)))
            break
        told = judged(pinned(large.join(sketches, "rep")), level, link)
        dense.append(told.where("ways IS NULL").select("path", "rep", "size", "score"))
        nodes = pinned(sized(told.where("ways IS NOT NULL").select("rep", F.explode("ways").alias("path"))))
        leaves.append(nodes.where(whole).select("path", F.lit(TREES).alias("tree"), "rep", "size"))
        large = nodes.where(~whole).select("path", "rep", "size")
    small = leaves[0]
    for x in leaves[1:]:
        small = small.unionByName(x)
    told = sketches.join(in_leaf, "rep", "left").select("rep", "mins", F.coalesce("leaves", F.lit(0)).alias("leaves"))
    pairs = small.select(F.explode(cells(F.col("size"))).alias("path"), "tree", "rep").join(told, "rep").repartition("path").sortWithinPartitions("path").mapInArrow(partial(alike, agree=sketch_agree(link)), "path long, rep long")
    wanted = pairs.select("path", F.lit(0).alias("block"), F.lit(0).alias("role"), "rep")
    blocks = None
    if dense:
        crowded = dense[0]
        for x in dense[1:]:
            crowded = crowded.unionByName(x)
        if not crowded.isEmpty():
            n_blocks = F.ceil(F.col("size") / LEAF).cast("int")
            blocks = pinned(crowded.select("path", F.pmod(F.xxhash64("path", "rep"), n_blocks).cast("int").alias("block"), n_blocks.alias("n_blocks"), "rep", "score"))
            # what a node's copies were made from is linked with most of them: likely its earliest set, or one of those nearest to its middle
            best = blocks.groupBy("path", "n_blocks", F.pmod("block", F.lit(PIVOTS)).alias("slot")).agg(F.max(F.struct("score", "rep")).alias("x"), F.min("rep").alias("least"))
            few = best.groupBy("path", "n_blocks").agg(F.array_union(F.array(F.min("least")), F.collect_set("x.rep")).alias("few"))
            pivots = few.select("path", "n_blocks", F.explode("few").alias("rep")).select("path", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "rep")
            wanted = wanted.unionByName(blocks.select("path", "block", F.lit(0).alias("role"), "rep")).unionByName(pivots.select("path", "block", F.lit(1).alias("role"), "rep"))
    wanted = pinned(wanted)
    sets = sets_for(documents, known.select("rep", "low", "set_a", "set_b").join(wanted.select("rep").distinct(), "rep"))  # of every set that is compared at all, so later comparisons find theirs
    found = pinned(confirmed(sets, wanted, link))
    out = found.where("a != b").select("a", "b")
    if blocks is not None:
        apart = found.where("a = b").select("path", F.col("a").alias("rep")).distinct()
        if not apart.isEmpty():
            # each set apart against every block, in groups of at most about LEAF of them
            many = pinned(apart.groupBy("path").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("lots")).join(blocks.groupBy("path").agg(F.max("n_blocks").alias("n_blocks")), "path"))
            spread = pinned(salted_join(apart, many, ["path"], F.col("rep")))
            lot = F.pmod(F.xxhash64("rep", "path"), F.col("lots")).cast("int")
            guests = spread.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: b * F.col("lots") + lot)).alias("block"), F.lit(2).alias("role"), "rep")
            hosts = salted_join(blocks, many.select("path", "lots"), ["path"], F.col("rep"))
            own = hosts.select("path", F.explode(F.sequence(F.col("block") * F.col("lots"), F.col("block") * F.col("lots") + F.col("lots") - 1)).alias("block"), F.lit(0).alias("role"), "rep")
            out = out.unionByName(pinned(confirmed(sets, guests.unionByName(own), link)).where("a != b").select("a", "b"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the edges can reach, by alternating large and small stars."""
    edges = pinned(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = with_totals(both, ["a"], F.col("b"), {"low": ("min", F.col("b"))}).withColumn("low", F.least("low", "a"))
        stars = near.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        ends = with_totals(stars, ["a"], F.col("b"), {"low": ("min", F.col("b"))})
        edges = pinned(ends.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
        state = now


ROWS = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, mins array<int>"


def grouped(source: DataFrame, link: tuple[int, int], *, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of doc_id, text_key, n_shingles, set_a and set_b of a source of doc_id, text_key and text, and the sets among them
    (of rows with words and doc_id): set_a, set_b, low (their smallest doc_id) and component (a number).

    Linked sets share a component; with ``by_id``, so do all sets of one doc_id.
    """
    rows = pinned(source.mapInArrow(sketch, ROWS))
    whole = rows.where("n_shingles > 0 and doc_id is not null")
    least = whole.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "mins")).alias("x"))
    known = pinned(least.select("set_a", "set_b", F.col("x.doc_id").alias("low"), F.col("x.mins").alias("mins"), F.col("x.doc_id").alias("rep")))
    if not known.groupBy("low").count().where("count > 1").isEmpty():  # sets that share their smallest doc_id get numbers in its order
        known = pinned(known.orderBy("low", "set_a", "set_b").withColumn("rep", F.monotonically_increasing_id()))
    edges = edges_of(source.where("doc_id is not null"), known, link)
    if by_id:
        several = whole.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y")).where("x != y").select(F.col("doc_id").alias("id"))
        own = whole.join(several, F.col("doc_id") == F.col("id")).select("doc_id", "set_a", "set_b").distinct().join(known.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
        tied = with_totals(own, ["doc_id"], F.col("rep"), {"low_rep": ("min", F.col("rep"))}).where("rep != low_rep")
        edges = edges.unionByName(tied.select(F.col("rep").alias("a"), F.col("low_rep").alias("b")))
    found = components(edges)
    sets = known.drop("mins").join(found, known.rep == found.id, "left").select("set_a", "set_b", "low", F.coalesce("component", "rep").alias("component"))
    return rows.drop("mins"), pinned(sets)


def near_duplicates(documents: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document row; sets of Jaccard link[0] / link[1] or more are linked.

    Null text and text without words: an empty set, linked with nothing. Rows of one doc_id are one document, which is linked
    by any of their texts, and so are those that it is linked with; n_shingles is each row's own. A row without doc_id is
    linked with nothing and kept. Extra columns are ignored. Documents of equal sets share their component. Ties: the
    smallest doc_id stays. Very long texts are taken whole; an empty table gives no rows.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), "text")
    rows, sets = grouped(source, link, by_id=True)
    named_sets = with_totals(sets, ["component"], F.struct("set_a", "set_b"), {"component_id": ("min", F.col("low"))}).select("set_a", "set_b", "component_id")
    whole = rows.where("n_shingles > 0 and doc_id is not null").join(named_sets, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    # rows of a document whose text has no words belong with its other rows
    rest = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    known = whole.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("component_id")) if not rest.where("doc_id is not null").isEmpty() else None
    filled = rest.withColumn("component_id", F.col("doc_id")) if known is None else rest.join(known, rest.doc_id == known.id, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return whole.unionByName(filled).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """One row of each group of near-duplicate rows with all its columns; rows without words, and without doc_id, stay.

    Here each row is a document of its own, so rows that share a doc_id but not their text are dropped only as copies. Of a
    group the row of the smallest doc_id stays; of its texts, if there are several, that of the smallest hash; of equal rows one.
    """
    keyed = documents.select(F.struct(*map(quoted, documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    judged = F.coalesce(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows, sets = grouped(keyed.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "text"), link, by_id=False)
    whole = rows.where("n_shingles > 0 and doc_id is not null").join(sets.select("set_a", "set_b", "component"), ["set_a", "set_b"]).select("doc_id", "text_key", "component")
    place = F.struct("doc_id", "text_key")
    later = with_totals(whole.distinct(), ["component"], place, {"first": ("min", place)})
    gone = later.where(place > F.col("first")).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    # equal rows first meet where they are read, and then share the join's partitions
    one = keyed.where(judged).groupBy("id", "key").agg(F.min("row").alias("row"))
    kept = one.join(gone, ["id", "key"], "left_anti").select("row.*")
    return kept.unionByName(keyed.where(~judged).select("row.*"))
