"""DuckDB SQL for the queries that SQL can express. Plain forms, independent of the operators' methods."""

from __future__ import annotations

from tidewire.llm import licenses, pii

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS id, doc_id AS low FROM n UNION SELECT e.x, r.low FROM r JOIN e ON e.y = r.id),
c AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, d.doc_id = coalesce(c.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[][] WHEN len(ws) < 13 THEN [ws] ELSE list_transform(range(1, len(ws) - 11), lambda i: ws[i:i+12]) END) AS win FROM b),
bk AS (SELECT item, len(win) AS n, array_to_string(win, ' ') AS k FROM bw),
ln AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {{'i': i, 'k': array_to_string(ws[i:i+n-1], ' ')}}), recursive := true) FROM d, ln WHERE len(ws) >= n),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bk ON bk.k = dw.k AND bk.n = dw.n),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS z FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) - 1 AS p FROM h)) GROUP BY doc_id, g),
ss AS (SELECT doc_id, '[' || string_agg(a || '-' || z, ', ' ORDER BY a) || ']' AS spans FROM sp GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(spans, '[]') AS hit_spans
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ss USING (doc_id)
"""

# a word: a run without blanks, or one character of a script that is written without them
UNSPACED = r"\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
WORDS = rf"len(regexp_extract_all(t, '[{UNSPACED}]|[^ \t\n\x0B\f\r{UNSPACED}]+'))"
# every run of three non-blank lines, and of one or two with over 50 words, that came before in the corpus goes
OP7 = rf"""
WITH l AS (SELECT doc_id, unnest(list_transform(range(1, len(x) + 1), lambda i: {{'i': i - 1, 't': x[i]}}), recursive := true) FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
q AS (SELECT doc_id, i, t, {WORDS} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
v AS (SELECT doc_id, p, t, n, t || chr(10) || lead(t) OVER o AS t2, n + lead(n) OVER o AS n2, t || chr(10) || lead(t) OVER o || chr(10) || lead(t, 2) OVER o AS t3 FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
w AS (SELECT doc_id, p, 3 AS size, t3 AS k FROM v UNION ALL SELECT doc_id, p, 1, t FROM v WHERE n > 50 UNION ALL SELECT doc_id, p, 2, t2 FROM v WHERE n2 > 50),
r AS (SELECT doc_id, p, size, row_number() OVER (PARTITION BY size, k ORDER BY doc_id, p) AS n FROM w WHERE k IS NOT NULL),
g AS (SELECT DISTINCT q.doc_id, q.i FROM r JOIN q ON q.doc_id = r.doc_id AND q.p BETWEEN r.p AND r.p + r.size - 1 WHERE r.n > 1),
k AS (SELECT l.doc_id, string_agg(t, chr(10) ORDER BY i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND g.i = l.i) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(length(k.text), 0)::BIGINT AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP5 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + n + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""



def op4() -> str:
    """Fragments are unnested; a recursive walk grows a run from each while a known sentence goes on so; rules are folded one by one."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(n)}, {quote(i)})" for n, i in licenses.KNOWN.items())
    rules = [(name, rule) for name, rules in licenses.RULES.items() for rule in rules]
    folds, last = [], "f0"
    for k, (name, rule) in enumerate(rules, 1):
        hit, rest = quote(licenses.pattern(rule)), quote("".join(f"\\{j}" for j in range(1, len(rule))))
        folds.append(f"f{k} AS (SELECT doc_id, n, ids, regexp_replace(seq, {hit}, {rest}) AS seq, CASE WHEN regexp_matches(seq, {hit}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names FROM {last})")
        last = f"f{k}"
    return rf"""
WITH RECURSIVE known(t, id) AS (VALUES {known}),
a AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
o AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(^|[^a-z0-9])([a-z])\.', '\1\2 ', 'g'), '(^|[^a-z0-9])([a-z])\.', '\1\2 ', 'g') AS x FROM a),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[.!?]["'')\]]*([ \t\r]+|$)', chr(2), 'g'), '[.!?]["'')\]]*\n', chr(2) || chr(10), 'g') AS x FROM o),
l AS (SELECT doc_id, unnest(list_transform(string_split(x, chr(10)), lambda y, i: {{'line': i, 'y': y, 'last': i = len(string_split(x, chr(10)))}}), recursive := true) FROM b),
h AS (SELECT doc_id, line, CASE WHEN line > 1 AND NOT last AND NOT regexp_matches(y, '[a-z0-9]') THEN chr(2) ELSE y END AS y FROM l),
p AS (SELECT doc_id, line, unnest(list_transform(string_split(replace(regexp_replace(y, '[,;:]["'')]*[ \t]', chr(1), 'g'), chr(2), chr(2) || chr(1)), chr(1)), lambda z, i: {{'i': i, 'z': z}}), recursive := true) FROM h),
q AS (SELECT doc_id, line, i, trim(regexp_replace(replace(z, chr(2), ''), '[^a-z0-9]+', ' ', 'g')) AS t, contains(z, chr(2)) AS hard FROM p),
s AS (SELECT doc_id, t, hard, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) AS n FROM q WHERE t <> '' OR hard),
r AS (SELECT doc_id, n AS first, n AS upto, t AS said, hard FROM s WHERE t <> '' AND EXISTS (SELECT 1 FROM known WHERE known.t = s.t OR starts_with(known.t, s.t || ' '))
  UNION ALL SELECT r.doc_id, first, s.n, CASE WHEN s.t = '' THEN said ELSE said || ' ' || s.t END, s.hard FROM r JOIN s ON s.doc_id = r.doc_id AND s.n = r.upto + 1
  WHERE NOT r.hard AND EXISTS (SELECT 1 FROM known WHERE known.t = said || ' ' || s.t OR starts_with(known.t, said || ' ' || s.t || ' '))),
m AS (SELECT doc_id, first, arg_max(id, upto) AS id FROM r JOIN known ON known.t = r.said GROUP BY 1, 2),
f0 AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY first) AS ids, ';' || string_agg(id, ';;' ORDER BY first) || ';' AS seq, []::VARCHAR[] AS names FROM m GROUP BY 1),
{", ".join(folds)}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids,
  CASE WHEN names IS NULL THEN '' WHEN len(names) = 0 AND contains(seq, ';{licenses.RESERVED};') THEN '{licenses.RESERVED_NAME}' ELSE array_to_string(names, ',') END AS licenses
FROM documents d LEFT JOIN {last} f ON f.doc_id = d.doc_id
"""


def crc_table() -> list[int]:
    """What each byte makes of the CRC of 32 bits."""
    def step(x: int) -> int:
        return (x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1

    out = list(range(256))
    for _ in range(8):
        out = [step(x) for x in out]
    return out


def crc(text: str) -> str:
    """The unsigned CRC of a text's UTF-8 bytes."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, ({crc_table()}::BIGINT[])[xor(c, b) % 256 + 1])))"


def op11() -> str:
    """A recursive walk carries, turn by turn, the cheapest cost and audit that reach each role state; v0 to v3, null if unreached."""
    def add(v: str, cost: str | int, letter: str) -> str:
        return f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'l': {v}.l || '{letter}'}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def when(condition: str, way: str) -> str:
        return f"CASE WHEN {condition} THEN {way} END"

    keep, whole = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END", "(fault IS NULL OR fault = 'truncated')"
    read = [
        add("u0", 2, "D"),
        least(add("u1", 2, "D"), when(f"{whole} AND r = 's'", add("u0", keep, "K"))),
        least(add("u2", 2, "D"), when(f"{whole} AND r = 'u'", add("to_user", keep, "K")), when(whole, add("to_user", f"1 + {keep}", "R"))),
        least(add("u3", 2, "D"), when(f"{whole} AND r = 'a'", add("u2", keep, "K")), when(whole, add("u2", f"1 + {keep}", "R"))),
    ]
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("k")} % 20 AS f FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM c),
o AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS p FROM d),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{SPACED}') THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY p) || r AS pair FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS said FROM o)),
t AS (SELECT conv_id, 0::BIGINT AS p, {{'c': 0::BIGINT, 'l': ''}} AS v0, NULL::STRUCT(c BIGINT, l VARCHAR) AS v1, NULL::STRUCT(c BIGINT, l VARCHAR) AS v2, NULL::STRUCT(c BIGINT, l VARCHAR) AS v3 FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL SELECT conv_id, p, {read[0]}, {read[1]}, {read[2]}, {read[3]}
  FROM (SELECT *, {least("u0", "u1", "u3")} AS to_user FROM (SELECT *, v0 AS u0, v1 AS u1, {least("v2", "i2", add("i3", 5, "I"))} AS u2, {least("v3", "i3", add("i2", 5, "I"))} AS u3
    FROM (SELECT t.* EXCLUDE (p), g.p, g.r, g.fault, {least(add("v0", 5, "I"), add("v1", 5, "I"), add("v3", 5, "I"))} AS i2, {add("v2", 5, "I")} AS i3 FROM t JOIN g ON g.conv_id IS NOT DISTINCT FROM t.conv_id AND g.p = t.p + 1)))),
z AS (SELECT conv_id, {least("v0", "v3", add("v2", 5, "I"), add("v1", 10, "II"))} AS v FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.conv_id IS NOT DISTINCT FROM t.conv_id AND g.p = t.p + 1)),
e AS (SELECT conv_id, unnest(list_transform(range(1, length(v.l) + 1), lambda i: {{'i': i, 'x': substr(v.l, i, 1), 'p': length(replace(left(v.l, i), 'I', ''))}}), recursive := true) FROM z),
k AS (SELECT e.*, g.role, g.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY i) AS n, first_value(CASE WHEN x = 'K' AND g.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id ORDER BY i) AS s
  FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.p = e.p AND e.x <> 'I' WHERE x <> 'D'),
q AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (n - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS said FROM k GROUP BY 1),
h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.l, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op12() -> str:
    grams = f"(SELECT k, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM"
    each = "unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g"
    return rf"""
WITH d AS {grams} (SELECT row_number() OVER () AS k, * FROM documents)),
f AS (SELECT k, {each} FROM d),
e AS (SELECT {each} FROM {grams} (SELECT 0 AS k, 0 AS doc_id, text FROM benchmark))),
x AS (SELECT g, {crc("g")} % 10000 AS bucket FROM (SELECT g FROM f UNION SELECT g FROM e)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN x USING (g) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM e JOIN x USING (g) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS s_all, (SELECT count(*) FROM e)::DOUBLE AS t_all),
y AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS gain FROM s FULL JOIN t USING (bucket), n),
m AS (SELECT k, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN x USING (g) JOIN y USING (bucket) GROUP BY 1),
r AS (SELECT d.k, d.doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (k)),
o AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS able FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (k)
"""


def op13() -> str:
    """Matches are marked by two private-use characters, which texts give up for a third; their places add up from what is between them."""
    found = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}
    marked = " UNION ALL ".join(rf"SELECT k, {i} AS kind, string_split(regexp_replace(x, '({p})', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS parts FROM d WHERE regexp_matches(x, '{p}')" for i, p in enumerate(found.values()))
    lengths = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTHS.items()) + "}"
    luhn = "list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE (2 * c::INT) // 10 + (2 * c::INT) % 10 END)) % 10 = 0"
    account = "substr(account, 5) || left(account, 4)"
    letters = f"list_transform(string_split({account}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE c::INT END)"
    mod_97 = f"list_reduce(list_prepend(0, {letters}), lambda n, v: (n * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    cut = "regexp_extract(m, '^(?:[A-Z0-9]\\x20?){' || (wanted - 1) || '}[A-Z0-9]')"
    tells = lambda words: " OR ".join(rf"regexp_matches({part}, '(?i)\b(?:{words})\b')" for part in (f"substr(x, greatest(a - {pii.NEAR}, 0) + 1, a - greatest(a - {pii.NEAR}, 0))", f"substr(x, z + 1, {pii.NEAR})"))
    score = lambda kind: f"{pii.PRIOR[kind]} + CASE WHEN {tells(pii.TELLING[kind])} THEN {pii.TELLS} ELSE 0 END - CASE WHEN {tells(pii.DENYING)} THEN {pii.DENIES} ELSE 0 END >= {pii.CUT}"
    names = "[" + ", ".join(f"'{k}'" for k in found) + "]"
    listed = lambda where: f"coalesce(string_agg({names}[kind + 1] || ':' || a || ':' || z, ',' ORDER BY kind, a) FILTER (WHERE {where}), '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(57346) || chr(57346)) AS x FROM documents),
p AS ({marked}),
q AS (SELECT k, kind, i, part, split_part(part, chr(57345), 1) AS m, length(replace(part, chr(57345), '')) AS n FROM (SELECT k, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p)),
r AS (SELECT k, kind, i, m, (sum(n) OVER (PARTITION BY k, kind ORDER BY i) - n)::BIGINT AS a FROM q),
s AS (SELECT k, kind, m, a, a + length(CASE WHEN kind = 4 THEN {cut} ELSE m END) AS z, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace({cut}, ' ', '') AS account, wanted
  FROM (SELECT *, coalesce({lengths}[left(m, 2)], 1) AS wanted FROM r WHERE i > 1)),
t AS (SELECT s.k, kind, a, z FROM s JOIN d USING (k) WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN list_bool_and(list_transform(string_split(m, '.'), lambda c: c::HUGEINT <= 255)) WHEN 2 THEN length(digits) BETWEEN 13 AND 19 AND {luhn} WHEN 3 THEN length(digits) BETWEEN 9 AND 15
  WHEN 4 THEN wanted > 1 AND length(account) = wanted AND NOT regexp_matches(substr(x, z + 1, 1), '[A-Za-z0-9_]') AND {mod_97} AND {score("iban")}
  ELSE left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND m[5:6] <> '00' AND right(m, 4) <> '0000' AND {score("ssn")} END),
u AS (SELECT k, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{kind}" for i, kind in enumerate(pii.BASE))}, {listed("kind < 4")} AS base, {listed("true")} AS spans FROM t GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN u USING (k)
"""


ORACLES = {"op11_structure_repair": op11(), "op12_target_sampling": op12(), "op13_pii": op13(), "op4_license_scan": op4(), "op5_chat_format": OP5.replace("\\\\", "\\"), "op7_line_dedup": OP7, "op2_near_dedup": OP2, "op3_decontaminate": OP3}
