"""Conversation structure repair by weighted finite-state composition.

A conversation is an input acceptor, a symbol a turn; an edit transducer keeps, reroles, deletes and inserts turns at a cost;
an acceptor holds the grammar of roles, ``(s?(ua)+)?``. The three are composed lazily, state by state as the input is read,
and the shortest path in topological order, by weights (cost, label) compared in that order, is the repair; its label spells
the edits: K keep, R rerole, D delete, I insert.

A conversation of any length is cut into segments of SEGMENT turns, each solved in a task of its own from each role state to
each other; a fold over a conversation's segments chooses among them. Weights of one state never begin one another, as each
label ends in the edit that read the last turn: so a fold compares the ranks of the labels so far instead of the labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import pinned, with_totals

#: The grammar acceptor: from each state the roles it reads and where they lead; a repair ends in one of FINAL.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
STATES = range(4)
#: What edits cost, and what a truncated turn that isn't deleted adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A cheapest path inserts at most so many turns in a row: after two it would be in a role state where it was before.
MOST_INSERTS = 2
ROLES = {"u": "user", "a": "assistant"}
#: Turns in a segment, a power of two.
SEGMENT_BITS = 12
BLANK = r"[^\x20\x09-\x0D]"

# A turn's symbol is its role's initial, u, a, s or o (another), a capital if its text is truncated, and x if it must go.


def edits_of(symbol: str) -> list[tuple[str, str, int]]:
    """Arcs of the edit transducer that read a symbol: the edit, the role it writes (none if deleted) and its cost."""
    arcs = [("D", "", DELETE)]
    if symbol != "x":
        more = TRUNCATED * symbol.isupper()
        arcs += [("K", symbol.lower(), more), *(("R", role, REROLE + more) for role in ROLES)]
    return arcs


def inserted(state: int) -> Iterator[tuple[int, int]]:
    """Role states that insertions alone reach, and how many they take."""
    reached = [state]
    for n in range(MOST_INSERTS + 1):
        for g in reached:
            yield g, n
        reached = [GRAMMAR[g][role] for g in reached for role in ROLES if role in GRAMMAR[g]]


@lru_cache(maxsize=None)  # ten symbols and four states
def composed(symbol: str, state: int) -> tuple[tuple[int, int, str], ...]:
    """Paths of the composed machine from a role state that read one symbol last: the state reached, the cost and the label."""
    best: dict[int, tuple[int, str]] = {}
    for g, n in inserted(state):
        for edit, role, cost in edits_of(symbol):
            to = GRAMMAR[g].get(role) if role else g
            if to is not None:
                way = (n * INSERT + cost, "I" * n + edit)
                best[to] = min(way, best.get(to, way))
    return tuple((to, cost, label) for to, (cost, label) in best.items())


def ranks(ways: dict[int, tuple[int, int, str]]) -> dict[int, int]:
    """States numbered by their labels: by the label so far, that is its rank, and what was added."""
    return {g: i for i, (g, _) in enumerate(sorted(ways.items(), key=lambda x: x[1][1:]))}


@lru_cache(maxsize=1 << 14)
def shortest(symbols: str) -> tuple[tuple[int, int, int, str], ...]:
    """From each role state to each that is reached: (from, to, cost, label) of the shortest path that reads all symbols."""
    out = []
    for start in STATES:
        cost, rank, back = {start: 0}, {start: 0}, []
        for symbol in symbols:
            ways: dict[int, tuple[int, int, str, int]] = {}
            for g in cost:
                for to, c, label in composed(symbol, g):
                    way = (cost[g] + c, rank[g], label, g)
                    if to not in ways or way < ways[to]:
                        ways[to] = way
            back.append({to: (way[3], way[2]) for to, way in ways.items()})
            rank = ranks({to: way[:3] for to, way in ways.items()})
            cost = {to: way[0] for to, way in ways.items()}
        for to in cost:
            label, g = [], to
            for step in reversed(back):
                g, added = step[g]
                label.append(added)
            out.append((start, to, cost[to], "".join(reversed(label))))
    return tuple(out)


def folded(segments: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of a conversation's repair, and of each of its segments the role state before it and the label of its part.

    Segments hold their shortest paths. What is inserted at the end is the label of one more segment without turns.
    """
    cost, rank, back = {0: 0}, {0: 0}, []
    closing = [{"start": g, "stop": to, "cost": n * INSERT, "label": "I" * n} for g in STATES for to, n in inserted(g) if to in FINAL]
    for ways_of in [*segments, closing]:
        ways: dict[int, tuple[int, int, str, int]] = {}
        for x in ways_of:
            if x["start"] in cost:
                way = (cost[x["start"]] + x["cost"], rank[x["start"]], x["label"], x["start"])
                if x["stop"] not in ways or way < ways[x["stop"]]:
                    ways[x["stop"]] = way
        back.append({to: (way[3], way[2]) for to, way in ways.items()})
        rank, cost = ranks({to: way[:3] for to, way in ways.items()}), {to: way[0] for to, way in ways.items()}
    end = min(cost, key=lambda g: (cost[g], rank[g]))
    total, parts = cost[end], []
    for step in reversed(back):
        end, label = step[end]
        parts.append((end, label))
    return total, parts[::-1]


def noted(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text (and copies, how often each comes) to one row for all that are equal.

    conv_id, turn, role, print (a digest of the text), n, initial, blank and cut, whether the text ends as a sentence doesn't.
    """
    last = F.regexp_extract("text", rf"({BLANK})[\x20\x09-\x0D]*\z", 1)
    told = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("print"), "copies",
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o").alias("initial"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"),
    )
    return told.groupBy("conv_id", "turn", "role", "print", "initial", "blank", "cut").agg(F.sum("copies").alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """The noted rows with ``again``, whether an earlier turn says the same in the same role, in order: ``at`` numbers them.

    Rows are in order of turn (nulls first), then role, then print. Ranges of them are sorted, so a conversation of any
    size is in as many as it fills.
    """
    keyed = noted(rows).withColumn("said", F.struct("conv_id", "role", "print"))
    place = F.struct("turn")  # nulls come first
    told = with_totals(keyed, ["said"], place, {"first": ("min", place)}).withColumn("again", place > F.col("first")).drop("said", "first")
    order = ["conv_id", "turn", "role", "print"]
    return pinned(told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, segment, items (turn, role, print and n in order), symbols and initials, a character for each turn."""
    gone = F.col("blank") | F.col("again")
    first = F.when(gone, "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    symbols = F.concat(first, F.repeat(F.lit("x"), (F.col("n") - 1).cast("int")))
    item = F.struct("at", "turn", "role", "print", "n", symbols.alias("symbols"), F.repeat("initial", F.col("n").cast("int")).alias("initials"))
    held = turns.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = lambda name: F.array_join(F.transform("items", lambda x: x[name]), "").alias(name)
    return pinned(held.select("conv_id", "segment", F.transform("items", lambda x: x.dropFields("at", "symbols", "initials")).alias("items"), whole("symbols"), whole("initials")))


PATH = "struct<start:int,stop:int,cost:bigint,label:string>"


def paths(symbols: Column) -> Column:
    """The shortest paths through a segment, from each role state to each other."""

    @F.arrow_udf(f"array<{PATH}>")
    def solved(symbols: pa.Array) -> pa.Array:
        kind = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("label", pa.string())])
        return pa.array([[dict(zip(("start", "stop", "cost", "label"), x, strict=True)) for x in shortest(s.as_py())] for s in symbols], pa.list_(kind))

    return solved(symbols)


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repairs(held: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal and parts (segment, start, label; the last has no segment) of each conversation."""
    each = F.struct("segment", paths(F.col("symbols")).alias("ways"), "initials")
    found = held.select("conv_id", each.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    @F.arrow_udf("struct<cost:bigint,audit:string,illegal:bigint,parts:array<struct<segment:bigint,start:int,label:string>>>")
    def chosen(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs:
            own = x.as_py()
            cost, parts = folded([s["ways"] for s in own])
            illegal = illegal_pairs("".join(s["initials"] for s in own))
            out.append({"cost": cost, "audit": "".join(label for _, label in parts), "illegal": illegal, "parts": [{"segment": n, "start": g, "label": label} for n, (g, label) in zip([*(s["segment"] for s in own), None], parts, strict=True)]})
        part = pa.struct([("segment", pa.int64()), ("start", pa.int32()), ("label", pa.string())])
        return pa.array(out, pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("parts", pa.list_(part))]))

    return pinned(found.select("conv_id", chosen(F.col("xs")).alias("found")).select("conv_id", "found.*"))


def written(items: list[dict], start: int, label: str) -> list[tuple]:
    """turn, old_role, print, role, edit and place in the part of each turn that stays or is inserted; kept ones keep their role."""
    out, g, at, seen = [], start, 0, 0
    for place, edit in enumerate(label):
        item = None
        if edit != "I":
            item = items[at]
            seen += 1
            if seen == item["n"]:
                at, seen = at + 1, 0
        if edit == "D":
            continue
        role = item["role"][:1] if edit == "K" else next(r for r in ROLES if r in GRAMMAR[g])
        g = GRAMMAR[g][role]
        kept = {} if item is None else item
        out.append((kept.get("turn"), kept.get("role"), kept.get("print"), kept["role"] if edit == "K" else ROLES[role], edit, place))
    return out


def turns_of(held: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, segment, place, edit, role, and old_turn, old_role and print of what stays: the repaired conversations' turns."""
    parts = found.select(F.col("conv_id").alias("c"), F.explode("parts").alias("p")).select("c", "p.*")
    last = parts.where("segment is null").select(F.col("c").alias("conv_id"), F.lit((1 << 63) - 1).alias("segment"), F.array().cast(held.schema["items"].dataType).alias("items"), "start", "label")
    own = parts.select("c", F.col("segment").alias("s"), "start", "label")
    met = held.join(own, held.conv_id.eqNullSafe(own.c) & (held.segment == own.s)).select("conv_id", "segment", "items", "start", "label").unionByName(last)
    names = ("old_turn", "old_role", "print", "role", "edit", "place")
    turn = held.schema["items"].dataType.elementType["turn"].dataType.simpleString()

    @F.arrow_udf(f"array<struct<old_turn:{turn},old_role:string,print:binary,role:string,edit:string,place:int>>")
    def staying(items: pa.Array, starts: pa.Array, labels: pa.Array) -> pa.Array:
        kind = pa.struct([("old_turn", items.type.value_type.field("turn").type), ("old_role", pa.string()), ("print", pa.binary()), ("role", pa.string()), ("edit", pa.string()), ("place", pa.int32())])
        rows = zip(items, starts.to_pylist(), labels.to_pylist(), strict=True)
        return pa.array([[dict(zip(names, x, strict=True)) for x in written(i.as_py(), g, label)] for i, g, label in rows], pa.list_(kind))

    return met.select("conv_id", "segment", F.explode(staying("items", "start", "label")).alias("t")).select("conv_id", "segment", "t.*")


def with_texts(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """The repaired turns with their texts; inserted ones have an empty text."""
    texts = rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.unhex(F.sha2("text", 256)).alias("p"), "text").groupBy("c", "t", "r", "p").agg(F.first("text").alias("text"))
    same = turns.conv_id.eqNullSafe(texts.c) & turns.old_turn.eqNullSafe(texts.t) & (turns.old_role == texts.r) & (turns.print == texts.p)
    own = turns.where("print is not null").join(texts, same).select(*turns.columns, "text")
    return own.unionByName(turns.where("print is null").withColumn("text", F.lit("")))


def cleaned(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, a null role or text as one blank, and ``copies``, 1."""
    return conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, place, edit, role, text and old_turn of the repaired conversations' turns, in order of segment and place.

    Turns are in order of turn (nulls first), then role, then the text's digest; rows that repeat one another are turns of
    their own, and duplicates. Null conv_ids are one conversation; a null role or text is one blank, so such a turn is
    reroled or deleted. Empty texts are blank; very long ones are judged by their ends and travel once. An empty table, and
    a conversation of which nothing stays, has no turns. Extra columns are ignored.
    """
    rows = cleaned(conversations)
    held = segments(judged(rows))
    return with_texts(turns_of(held, repairs(held)), rows).select("conv_id", "segment", "place", "edit", "role", "text", "old_turn")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the CRC of ``conv_id:turn`` (nulls: one blank) modulo 20, and copies: 0 drops a row, 1 empties its
    text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    rows = cleaned(conversations)
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(fault != 0).withColumns({"role": F.when(fault == 4, "user").otherwise(F.col("role")), "text": text, "copies": F.when(fault == 3, 2).otherwise(1)})


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the turns' ``role:text``, newline-joined.

    A hash is made from front to back, so one task walks a conversation's sorted turns; it holds one batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda c, h: pa.RecordBatch.from_arrays([pa.array([c], kind), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])
        now, hashed, kind = None, None, None
        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            for conv, role, text in zip(*(batch.column(c) for c in ("conv_id", "role", "text")), strict=True):
                conv, line = conv.as_py(), f"{role.as_py()}:{text.as_py()}"
                if hashed is None or conv != now:
                    if hashed is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = conv, hashlib.sha256(line.encode())
                else:
                    hashed.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], ["conv_id", "repaired_sha256"])
        if hashed is not None:
            yield made(now, hashed)

    order = ["conv_id", "segment", "place"]
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation once damaged.

    Nulls, repeats and empty tables as in ``repaired``; a conversation without rows after the damage has zeros, an empty
    audit and the hash of nothing.
    """
    rows = damaged(conversations)
    turns = judged(rows)
    held = segments(turns)
    found = repairs(held)
    counts = [F.sum(c.cast("long")).alias(name) for name, c in (("blank", F.when(F.col("blank"), F.col("n")).otherwise(0)), ("duplicate", F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)), ("truncated", (F.col("cut") & ~F.col("again")).cast("int")))]
    by_turn = turns.groupBy("conv_id", "turn").agg(*counts)
    faults = by_turn.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    digest = digests(with_texts(turns_of(held, found), rows))
    told = conversations.select("conv_id").distinct()
    for side in (faults, found.select("conv_id", "illegal", "cost", "audit"), digest):
        other = side.withColumnRenamed("conv_id", "c")
        told = told.join(other, told.conv_id.eqNullSafe(other.c), "left").drop("c")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
