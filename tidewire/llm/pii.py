"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their scores.

E-mail addresses, IP addresses, card numbers and phone numbers are found by fixed rules and always stay. Bank accounts and
social security numbers are proposed by patterns too, and stay if their score reaches CUT.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed; the first four are found by fixed rules.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score of a span whose check holds, and what a telling or a denying word adds or takes.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
TELLS, DENIES = 0.4, 0.4
#: A span beyond the fixed rules stays from this score on.
CUT = 0.5
#: Words count that stand within so many code points before or after a span.
NEAR = 60
#: Words that tell of a kind, and those that deny personal data of any kind.
TELLING = {
    "email": "e-?mail|contact|mailto|write",
    "ip": "ip|client|host|login",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|taxpayer",
}
DENYING = "example|sample|dummy|placeholder|version|isbn|part number"
#: The lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, and takes the last run whole; so the look back changes no match and saves retries
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", re.ASCII)
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
WORDS = {kind: re.compile(rf"\b(?:{words})\b", re.ASCII | re.IGNORECASE) for kind, words in (TELLING | {"": DENYING}).items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def digits_of(said: str) -> str:
    return re.sub(r"[^0-9]", "", said)


def luhn(digits: str) -> bool:
    """Every second digit from the right doubles; the digits of all add up to a multiple of ten."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod_97(account: str) -> bool:
    """The account with its first four characters last and letters as 10 to 35 leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, @ and a domain: each local part reaches back from its @, so a text is walked once."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start, after = at, at + 1
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at)):
            yield start, domain.end()
            floor = after = domain.end()
        at = text.find("@", after)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many characters as the country's accounts have, with single blanks between them, where a word ends."""
    for m in IBAN.finditer(text):
        wanted, end = IBAN_LENGTHS.get(m.group()[:2], 0), m.start()
        account = ""
        for c in m.group():
            if len(account) == wanted:
                break
            account, end = account + c.replace(" ", ""), end + 1
        if wanted and len(account) == wanted and not re.match(r"\w", text[end : end + 1], re.ASCII) and mod_97(account):
            yield m.start(), end


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def scored(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior score, more with a telling word nearby, less with a denying one."""
    near = (text[max(0, start - NEAR) : start], text[end : end + NEAR])
    told, denied = (any(WORDS[w].search(x) for x in near) for w in (kind, ""))
    return round(min(1.0, max(0.0, PRIOR[kind] + TELLS * told - DENIES * denied)), 3)


def spans_in(text: str) -> list[Span]:
    """All spans of a text, by kind as listed and then by start, in code points, the end exclusive."""
    found = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        each = (Span(kind, a, z, scored(text, kind, a, z)) for a, z in FINDERS[kind](text))
        found += [s for s in each if kind in BASE or s.score >= CUT]
    return found


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def spans_of(text: Column) -> Column:
    """An array of spans (kind, start, end, score) of each text; null and empty texts have none."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    def found(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        # all kinds have a digit or an @, and most texts have neither; only the rest are walked in Python
        worth = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
        return pa.array([[s._asdict() for s in spans_in(t.as_py())] if w else [] for t, w in zip(texts, worth, strict=True)], pa.list_(SPAN))

    return found(text)


def masked(documents: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; all rows and columns stay, whatever their names.

    Spans that overlap are replaced together, by the kind of the first. Null and empty texts stay as they are; very long
    ones are masked whole, each row by itself, so repeated rows are masked alike; an empty table stays empty.
    """

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text, parts, at = t.as_py(), [], 0
            for s in sorted(spans_in(text or ""), key=lambda s: (s.start, -s.end)):
                if s.start >= at:
                    parts += [text[at : s.start], f"<{s.kind.upper()}>"]
                at = max(at, s.end)
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pa.array(out, pa.string())

    return documents.withColumn("text", replaced("text"))


def with_spans(documents: DataFrame, name: str = "spans") -> DataFrame:
    """The documents with their spans in a further column, which takes the place of one of that name."""
    return documents.withColumn(name, spans_of(F.col("text")))


def pii_report(documents: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each fixed kind, base_sha256 (of those spans) and spans (all of them, listed) of each row.

    A null text counts as empty and has no span. Repeated rows are rows of their own. Extra columns are ignored.
    """
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), kind.eqNullSafe)).cast("long").alias(f"n_{k}") for k, kind in ((k, F.lit(k)) for k in BASE)]
    return with_spans(documents.select("doc_id", "text")).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
