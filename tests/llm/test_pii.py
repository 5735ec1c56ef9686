import random
import re
import time

import duckdb
from conftest_llm import documents
from tidewire.llm import pii, sql

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KNOWN = [
    "mail bo@x.org or a.b_c%+d@mail-7.example.co.uk, not a@b or @c.de or x@y@z.w",
    "10.0.0.1 999.1.1.1 256.1.1.1 1.2.3.4.5.6.7.8 007.0.0.0001 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111, 5500005555555559",
    "+1 (017) 555-7713 and +4930123456 and +1 2 and + 1234567890 and +12345678901234567",
    "account DE89 3704 0044 0532 0130 00 here; GB82WEST12345698765432! GB82WEST12345698765433 NL91ABNA0417164300x FR1420041010050500013M02606",
    "example DE89370400440532013000", "ssn 123-45-6789", "order 123-45-6789", "social security: 666-45-6789 000-12-3456 912-12-3456 123-00-4567", "ſsn 123-45-6789 ssnx",
    "a@b.cc_x@d.ef.gh@i.jk", "é10.0.0.1é\U0001f600 bo@x.org ",
]


def texts():
    rng = random.Random(2)
    pool = [".", "@", "+", "-", " ", "(", ")", "1", "4", "23", "4111111111111111", "10.0.0.1", "a", "Z", "_", "é", "\n", "ssn", "IBAN", "DE89370400440532013000", "123-45-6789", "bo@x.org", ","]
    return [None, "", " ", *KNOWN, *("".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400))]


def test_base_spans_equal_plain_patterns():
    """The patterns as stated, without the finders' shortcuts."""
    for text in texts():
        got = [(s.kind, s.start, s.end) for s in pii.spans_in(text or "") if s.kind in pii.BASE]
        want = []
        for kind, pattern in PLAIN.items():
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m.group())
                odd = sum(int(d) for d in digits[::-1][::2]) + sum(int(c) for d in digits[::-1][1::2] for c in str(2 * int(d)))
                ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15}
                if ok[kind]:
                    want.append((kind, *m.span()))
        assert got == want, text


def test_report_equals_sql(spark):
    docs = documents(spark, texts(), ids=[None if i % 50 == 7 else i // 2 for i in range(len(texts()))])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(sql.ORACLES["op13_pii"])
    names = [d[0] for d in want.description]
    got = pii.pii_report(docs)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_checked_and_scored_spans():
    found = {t: [(s.kind, t[s.start : s.end]) for s in pii.spans_in(t) if s.kind not in pii.BASE] for t in KNOWN}
    assert found[KNOWN[4]] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("iban", "FR1420041010050500013M02606")]
    assert found["example DE89370400440532013000"] == []
    assert found["ssn 123-45-6789"] == [("ssn", "123-45-6789")]
    assert found["order 123-45-6789"] == found[KNOWN[8]] == found["ſsn 123-45-6789 ssnx"] == []
    assert pii.spans_in("call +4930123456")[0].score > pii.spans_in("is +4930123456")[0].score > pii.spans_in("version +4930123456")[0].score


def test_masked_keeps_rows_and_columns(spark):
    docs = documents(spark, ["to bo@x.org, 4111 1111 1111 1111.", None, "", "plain", "plain"], ids=[1, None, 2, 3, 3]).withColumnRenamed("score", "spans")
    out = pii.masked(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == ["", "None", "plain", "plain", "to <EMAIL>, <CARD>."]


def test_long_hostile_texts():
    for text in ("a" * 500_000, "1" * 500_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "A1" * 200_000, "+1" + " " * 400_000):
        began = time.perf_counter()
        pii.spans_in(text)
        assert time.perf_counter() - began < 10
