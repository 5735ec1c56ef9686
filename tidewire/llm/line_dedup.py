"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Of every window of RUN consecutive non-blank lines the line of smallest hash, the last of equals, is selected: the distinct
places so selected, about two in RUN + 1, are a text's fingerprints, and two copies of a run of RUN lines share one. Places
are joined by fingerprint: those whose line is selected nowhere else drop out. The rest are extended both ways, to the
windows that selected them; a window to which an earlier place of the same fingerprint extends as well is a later copy and
goes. Overlapping windows of one document chain to its maximal repeated runs.

Runs of one or two lines are no window. A caller that gives ``long_words`` has those of more words looked up whole: each line
and each pair of consecutive non-blank lines of over ``long_words`` words is a fingerprint of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import let, pinned, unwrapped, with_totals, wrapped

#: Non-blank lines in a window, the shortest run that is deleted.
RUN = 3
#: What a blank line holds, if anything.
BLANKS = " \t\n\x0b\f\r"
#: A word: a run of characters that are not blank, or one character of a script that is written without blanks.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = rf"[{UNSPACED}]|[^\s{UNSPACED}]+"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def words_in(line: Column) -> Column:
    return F.when(F.octet_length(line) == F.length(line), F.regexp_count(line, F.lit(r"\S+"))).otherwise(F.regexp_count(line, F.lit(WORD)))


def keyed(documents: DataFrame) -> DataFrame:
    """Rows with a key by which the corpus is ordered: doc_id (nulls last), then the text's hash. Equal rows have one key."""
    return documents.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))


def solid_lines(text: Column, more: dict | None = None) -> Column:
    """The non-blank lines: line number, and what ``more`` computes of each."""
    each = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("line"), (F.trim(x, F.lit(BLANKS)) == "").alias("blank"), *(f(x).alias(n) for n, f in (more or {}).items())))
    return F.filter(each, lambda x: ~x["blank"])


def window(i: Column) -> Column:
    """The window of lines from one on: the place that it selects and its key."""
    a, b, c = (F.get("lines", i + k)["hash"] for k in range(RUN))
    return F.struct(F.when((c <= a) & (c <= b), i + 2).when(b <= a, i + 1).otherwise(i).alias("pick"), F.xxhash64(a, b, c).alias("key"))


def fingerprint(x: Column, i: Column, long_words: int | None) -> Column:
    """The line at a place: print (its hash), at, and units, the windows or long runs that it stands for (key, from and size)."""
    unit = lambda key, start, size: F.struct(key.alias("key"), start.cast("int").alias("from"), F.lit(size).alias("size"))
    units = [F.when(F.get("windows", i - k)["pick"] == i, unit(F.get("windows", i - k)["key"], i - k, RUN)) for k in range(RUN)]
    if long_words is not None:
        after = F.get("lines", i + 1)
        units.append(F.when(x["words"] > long_words, unit(F.xxhash64(F.lit(1), x["salted"]), i, 1)))
        units.append(F.when(x["words"] + after["words"] > long_words, unit(F.xxhash64(F.lit(2), x["salted"], after["hash"], after["salted"]), i, 2)))
    return F.struct(x["hash"].alias("print"), i.alias("at"), F.array_compact(F.array(*units)).alias("units"))


def fingerprints(rows: DataFrame, long_words: int | None) -> DataFrame:
    """__key, print, at and units of each selected place."""
    more = {"hash": F.xxhash64} | ({} if long_words is None else {"words": words_in, "salted": lambda x: F.xxhash64(F.lit("long"), x)})
    told = rows.where("text is not null").select("__key", solid_lines(F.col("text"), more).alias("lines"))
    if long_words is None:
        told = told.where(F.size("lines") >= RUN)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("lines") - RUN, F.lit(0))), window)
    placed = told.select("__key", "lines", F.when(F.size("lines") >= RUN, windows).otherwise(F.slice(windows, 1, 0)).alias("windows"))
    chosen = F.filter(F.transform("lines", lambda x, i: fingerprint(x, i, long_words)), lambda x: F.size(x["units"]) > 0)
    return placed.select("__key", F.explode(chosen).alias("f")).select("__key", "f.*")


def matches(rows: DataFrame, long_words: int | None = None) -> DataFrame:
    """__key, from and size (places among the non-blank lines) of each run with an earlier copy."""
    selected = pinned(fingerprints(rows, long_words))  # so that texts are read once
    shared = with_totals(selected, ["print"], F.struct("__key", "at"), {"copies": ("sum", F.lit(1))}, F.col("copies") > 1)
    runs = pinned(shared.select("__key", "print", F.explode("units").alias("u")).select("__key", "print", "u.*"))
    place = F.struct("__key", "from")
    compared = with_totals(runs, ["print", "key", "size"], place, {"first": ("min", place), "last": ("max", place)}, F.col("first") < F.col("last"))
    return compared.where(place > F.col("first")).select("__key", "from", "size")


def edited(documents: DataFrame, long_words: int | None = None) -> DataFrame:
    """The rows as ``wrapped`` makes them, text (without later copies of runs) apart, and ``lines`` and ``removed``, the counts of lines."""
    rows = keyed(wrapped(documents, "text").withColumn("doc_id", F.col("row.doc_id")))
    runs = matches(rows, long_words).groupBy("__key").agg(F.collect_set(F.struct("from", "size")).alias("runs")).withColumnRenamed("__key", "other")
    # the join keeps a repeated row as often as it comes
    met = rows.join(runs, rows["__key"] == F.col("other"), "left")

    def without(gone: Column) -> Column:
        """One sort puts each line number that goes before its line: linear, however many lines there are."""
        numbered = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("tag"), x.alias("line")))
        marks = F.transform(gone, lambda i: F.struct(i.alias("i"), F.lit(0).alias("tag"), F.lit(None).cast("string").alias("line")))
        kept = lambda tagged: F.filter(tagged, lambda x, j: (x["tag"] == 1) & ~F.coalesce(F.get(tagged, j - 1)["i"] == x["i"], F.lit(False)))
        text = F.array_join(F.transform(let(F.array_sort(F.concat(numbered, marks)), kept), lambda x: x["line"]), "\n")
        return F.struct(text.alias("text"), F.size(gone).alias("removed"))

    solid = F.transform(solid_lines(F.col("text")), lambda x: x["line"])
    gone = let(solid, lambda lines: F.array_distinct(F.flatten(F.transform("runs", lambda r: F.slice(lines, r["from"] + 1, r["size"])))))
    # exploded, so that no later filter makes it again
    done = met.select("row", "doc_id", "text", F.explode(F.array(F.when(F.col("runs").isNotNull(), let(gone, without)))).alias("done"))
    return done.select(
        "row",
        "doc_id",
        F.when(F.col("done").isNull(), F.col("text")).otherwise(F.col("done.text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text")))).cast("long").alias("lines"),
        F.coalesce("done.removed", F.lit(0)).cast("long").alias("removed"),
    )


def deduplicated(documents: DataFrame, long_words: int | None = None, *, emptied: bool = True) -> DataFrame:
    """The documents with later copies of runs of three or more non-blank lines deleted; all rows and columns stay, whatever their names.

    With ``long_words``, later copies of one or two consecutive non-blank lines of over so many words go too. Unless
    ``emptied``, texts of which nothing but blanks stays go as well.
    The first copy, by doc_id (nulls last) and line, stays; copies within one document count. Blank lines, of no characters
    but ASCII blanks, neither make a run nor break it and stay, so lines may end with a carriage return. Null and empty
    texts stay as they are; very long ones are edited whole; an empty table stays empty. Equal rows (same doc_id and text)
    are edited alike and are not copies of each other.
    """
    rows = edited(documents, long_words)
    return unwrapped(rows if emptied else rows.where(r"removed = 0 or text rlike '\\S'"), documents.columns, "text")


#: Words that a repeated run of fewer than RUN lines must exceed in the report, and in the corpus pipeline.
LONG_WORDS = 50


def line_report(documents: DataFrame, long_words: int | None = LONG_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars and kept_sha256 (of the text that stays) of each document row.

    Runs of three or more lines, and shorter ones of over ``long_words`` words, as in ``deduplicated``.
    """
    return edited(documents.select("doc_id", "text"), long_words).select("doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
