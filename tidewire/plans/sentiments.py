"""Queries that score headlines, and their DuckDB SQL: the same rules over rows of words, with windows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import sentiment
from tidewire.operators import lookups, upserts
from tidewire.plans import bindings as b

#: Words of made headlines: they have every rule at work.
WORDS = """
Shares of beats not estimates plunges very BUT Acme! raises its full-year guidance kind of profits least at fraud no or RECORD cuts the dividend never so
upgraded hardly LAWSUIT up? without doubt soaring (down), really isn't won; price target cut slightly 52-week low but SURGES to die for nor this hold may gains?!
extremely miss. THE stock to beating heart sort of growth
""".split()


def headline(words: Column, number: Column) -> Column:
    """A made headline of as many words as there are pieces, each by its piece's length, its place and the number."""
    known = F.expr("array(" + ", ".join(map(sentiment.quoted, WORDS)) + ")")
    return F.array_join(F.transform(words, lambda w, i: F.get(known, ((F.length(w) * 13 + i * i * 7 + number * (i + 3)) % len(WORDS)).cast("int"))), " ")


def sentiment_score(spark, d):
    """Of every document's first line a made headline, a word for each clause, and the line itself."""
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    rows = b.table(spark, d, "documents").select("doc_id", line.alias("line"), headline(F.split(line, "[,.] "), F.col("doc_id")).alias("title"))
    return rows.select("doc_id", F.sha2(sentiment.collapsed(F.col("title")), 256).alias("collapsed_sha256"), sentiment.compound(F.col("title")).alias("score"), sentiment.compound(F.col("line")).alias("line_score"))


def titled(spark, d):
    """Articles with made headlines and descriptions."""
    made = lambda more: headline(F.split(F.repeat(F.lit("x "), (F.col("id") % 9 + more).cast("int")), " "), F.col("id"))
    return b.news(spark, d).withColumns({"title": made(1), "description": F.when(F.col("description").isNotNull(), made(5))})


def score_patch(spark, d):
    rows = titled(spark, d).select("id", "title", "description", "publish_time", "sentiment")
    scores = lookups.scored(rows, sentiment.article_score(F.col("title"), F.col("description")))
    return upserts.patched(rows, scores, "id", overwrite=["sentiment"]).select("id", "sentiment")


QUERIES = {f.__name__: f for f in (sentiment_score, score_patch)}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def table_of(pairs: dict[str, float]) -> str:
    return "(VALUES " + ", ".join(f"({quoted(k)}, {v}::DOUBLE)" for k, v in pairs.items()) + ")"


def headline_sql(words: str, number: str) -> str:
    known = "[" + ", ".join(map(quoted, WORDS)) + "]"
    return f"array_to_string(list_transform({words}, lambda w, i: {known}[(length(w) * 13 + (i - 1) * (i - 1) * 7 + {number} * (i + 2)) % {len(WORDS)} + 1]), ' ')"


def rounded_sql(x: str) -> str:
    tie, scale = f"round(abs({x}) * 10000)::HUGEINT", "4611686018427387904"
    own, half = f"(abs({x}) * {scale}::DOUBLE)::HUGEINT * 10000", f"{tie} * {scale}::HUGEINT"
    up = f"({tie} = 5 OR {own} > {half} OR ({own} = {half} AND {tie} // 10 % 2 = 1))::INT"
    return f"CASE WHEN round({x}, 4) = {x} AND {tie} % 10 = 5 THEN sign({x}) * ({tie} // 10 + {up})::DOUBLE / 1000 ELSE round({x}, 3) END"


def compounds(source: str, name: str) -> str:
    """CTEs that end in ``name``: k, collapsed and score of the texts ``said`` of a relation of k and said."""
    phrases = " UNION ALL ".join(f"SELECT {quoted(' '.join(re.split('[ -]', p)))} AS said, {quoted(sentiment.one_token(p))} AS token" for p in sentiment.PHRASES)
    n = name
    loud = lambda w, v, x: f"CASE WHEN {w} AND shouted THEN CASE WHEN {v} > 0 THEN {x} + {sentiment.CAPITALS} ELSE {x} - {sentiment.CAPITALS} END ELSE {x} END"

    def step(k: int) -> str:
        """v after the k-th word before."""
        added = f"v + CASE WHEN b{k} IS NULL THEN 0 ELSE {sentiment.FADED[k - 1]} * ({loud(f'u{k}', 'v', f'CASE WHEN v < 0 THEN -b{k} ELSE b{k} END')}) END"
        so1, so2 = (f"coalesce(l{j}, '') IN ('so', 'this')" for j in (1, 2))
        never = {1: "false", 2: f"l2 = 'never' AND {so1}", 3: f"(l3 = 'never' AND {so2}) OR {so1}"}[k]
        doubtless = {1: "false", 2: "l2 = 'without' AND l1 = 'doubt'", 3: "l3 = 'without' AND (l2 = 'doubt' OR l1 = 'doubt')"}[k]
        turned = f"CASE WHEN {never} THEN ({added}) * {sentiment.NEVER_SO} WHEN {doubtless} THEN {added} WHEN n{k} THEN ({added}) * {sentiment.TURNED} ELSE {added} END"
        return f"SELECT * REPLACE (CASE WHEN l{k} IS NULL OR w{k} IS NOT NULL THEN v ELSE {turned} END AS v)"

    idiom = table_of(sentiment.IDIOMS)
    looked = lambda *runs: ", ".join(f"(SELECT x FROM {idiom} i(p, x) WHERE p = concat_ws(' ', {r}))" for r in runs)
    weaker = " ".join(f"+ CASE WHEN concat_ws(' ', {r}) IN {listed(sentiment.WEAKER_PAIRS)} THEN -{sentiment.BOOST} ELSE 0 END" for r in ("l3, l2", "l2, l1"))
    windows = ", ".join(f"lag(low, {k}) OVER o AS l{k}, lag(w, {k}) OVER o AS w{k}, lag(b, {k}) OVER o AS b{k}, lag(n, {k}) OVER o AS n{k}, lag(u, {k}) OVER o AS u{k}" for k in (1, 2, 3))
    marks = f"least(length(said) - length(replace(said, '!', '')), {sentiment.MOST_BANGS}) * {sentiment.BANG} + CASE WHEN q > 3 THEN {sentiment.MUCH_ASKED} WHEN q > 1 THEN q * {sentiment.ASKED} ELSE 0 END"
    return rf"""
{n}_marked AS (SELECT k, unnest(string_split(regexp_replace(said, '(?i)({sentiment.phrase_pattern().replace("'", "''")})', chr(1) || '\1' || chr(2), 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(said, '(?i)({sentiment.phrase_pattern().replace("'", "''")})', chr(1) || '\1' || chr(2), 'g'), chr(1)), 1) AS i FROM {source}),
{n}_phrases AS ({phrases}),
{n}_known AS (SELECT DISTINCT said, first(token) AS token FROM {n}_phrases GROUP BY said),
{n}_parts AS (SELECT k, i, part, CASE WHEN contains(part, chr(2)) THEN trim(regexp_replace(lower(split_part(part, chr(2), 1)), '[\s\-]+', ' ', 'g')) END AS m FROM {n}_marked),
{n}_said AS (SELECT k, string_agg(CASE WHEN m IS NULL THEN part ELSE coalesce(a.token, z.token, replace(m, ' ', '_')) || split_part(part, chr(2), 2) END, '' ORDER BY i) AS said FROM {n}_parts LEFT JOIN {n}_known a ON a.said = m LEFT JOIN {n}_known z ON z.said = split_part(m, ' ', 1) || ' ' || split_part(m, ' ', -1) GROUP BY k),
{n}_words AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY i) AS i FROM (SELECT k, unnest(string_split_regex(said, '[\s\x0B\x1C-\x1F]+')) AS w, generate_subscripts(string_split_regex(said, '[\s\x0B\x1C-\x1F]+'), 1) AS i FROM {n}_said) WHERE w <> ''),
{n}_bare AS (SELECT k, i, CASE WHEN length(t) <= 2 THEN w ELSE t END AS w FROM (SELECT *, regexp_replace(regexp_replace(w, '^[!-/:-@\[-`{{-~]+', ''), '[!-/:-@\[-`{{-~]+$', '') AS t FROM {n}_words)),
{n}_items AS (SELECT k, i, lower(b.w) AS low, x.v AS w, CASE WHEN lower(b.w) IN {listed(sentiment.STRONGER)} THEN {sentiment.BOOST} WHEN lower(b.w) IN {listed(sentiment.WEAKER)} THEN -{sentiment.BOOST} END::DOUBLE AS b, lower(b.w) IN {listed(sentiment.NEGATIONS)} OR contains(lower(b.w), 'n''t') AS n, upper(b.w) = b.w AND lower(b.w) <> b.w AS u
  FROM {n}_bare b LEFT JOIN {table_of(sentiment.lexicon())} x(t, v) ON x.t = lower(b.w)),
{n}_seen AS (SELECT *, {windows}, lead(low) OVER o AS f1, lead(low, 2) OVER o AS f2, lead(w) OVER o AS fw, count(*) FILTER (u) OVER p BETWEEN 1 AND count(*) OVER p - 1 AS shouted, min(CASE WHEN low = 'but' THEN i END) OVER p AS turn FROM {n}_items WINDOW o AS (PARTITION BY k ORDER BY i), p AS (PARTITION BY k)),
{n}_own AS (SELECT *, CASE WHEN coalesce(l1, '') = 'no' OR coalesce(l2, '') = 'no' OR (coalesce(l3, '') = 'no' AND l1 IN ('or', 'nor')) THEN w * {sentiment.TURNED} WHEN low = 'no' AND fw IS NOT NULL THEN 0 ELSE w END AS own FROM {n}_seen WHERE w IS NOT NULL AND b IS NULL AND NOT (low = 'kind' AND coalesce(f1, '') = 'of')),
{n}_v AS (SELECT *, ({loud("u", "own", "own")})::DOUBLE AS v FROM {n}_own), {n}_1 AS ({step(1)} FROM {n}_v), {n}_2 AS ({step(2)} FROM {n}_1), {n}_3 AS ({step(3)} FROM {n}_2),
{n}_idiom AS (SELECT * REPLACE (CASE WHEN l3 IS NULL OR w3 IS NOT NULL THEN v ELSE coalesce({looked("low, f1, f2", "low, f1", "l1, low", "l2, l1, low", "l2, l1", "l3, l2, l1", "l3, l2")}, v) {weaker} END AS v) FROM {n}_3),
{n}_least AS (SELECT k, v * CASE WHEN l1 = 'least' AND w1 IS NULL AND coalesce(l2, '') NOT IN ('at', 'very') THEN {sentiment.TURNED} ELSE 1 END * CASE WHEN i < turn THEN {sentiment.BEFORE_BUT} WHEN i > turn THEN {sentiment.AFTER_BUT} ELSE 1 END AS v, i FROM {n}_idiom),
{n}_sum AS (SELECT k, sum(v ORDER BY i) AS v FROM {n}_least GROUP BY k),
{n}_total AS (SELECT s.k, s.said, coalesce(v, 0) + sign(coalesce(v, 0)) * ({marks}) AS t FROM (SELECT *, length(said) - length(replace(said, '?', '')) AS q FROM {n}_said) s LEFT JOIN {n}_sum USING (k)),
{n}_fine AS (SELECT k, said, round(t / sqrt(t * t + {sentiment.LEVEL}), 4) AS x FROM {n}_total),
{n} AS (SELECT k, said AS collapsed, {rounded_sql("x")} AS score FROM {n}_fine)"""


TITLED = f"(SELECT * REPLACE ({headline_sql('''string_split(repeat('x ', (id % 9 + 1)::INT), ' ')''', 'id')} AS title, CASE WHEN description IS NOT NULL THEN {headline_sql('''string_split(repeat('x ', (id % 9 + 5)::INT), ' ')''', 'id')} END AS description) FROM {b.NEWS})"
BLEND = "0.75 * t.score + 0.25 * d.score"
ORACLES = {
    "sentiment_score": f"""WITH a AS (SELECT row_number() OVER () AS k, doc_id, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents), m AS (SELECT k, {headline_sql("string_split_regex(line, '[,.] ')", "doc_id")} AS said FROM a), r AS (SELECT k, line AS said FROM a),
        {compounds("m", "t")}, {compounds("r", "d")}
        SELECT doc_id, sha256(t.collapsed) AS collapsed_sha256, t.score, d.score AS line_score FROM a JOIN t USING (k) JOIN d USING (k)""",
    "score_patch": f"""WITH a AS (SELECT id AS k, title, trim(coalesce(description, ''))[1:600] AS body FROM {TITLED} WHERE sentiment IS NULL ORDER BY publish_time DESC, id DESC LIMIT 500), m AS (SELECT k, title AS said FROM a), r AS (SELECT k, body AS said FROM a),
        {compounds("m", "t")}, {compounds("r", "d")}
        SELECT n.id, CASE WHEN a.k IS NULL THEN n.sentiment WHEN body = '' THEN t.score ELSE {rounded_sql(f"({BLEND})")} END AS sentiment FROM {b.NEWS} n LEFT JOIN a ON a.k = n.id LEFT JOIN t ON t.k = a.k LEFT JOIN d ON d.k = a.k""",
}
