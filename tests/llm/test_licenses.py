import textwrap

import duckdb
import pytest
from conftest_llm import documents
from tidewire.llm import licenses, sql

S = licenses.SENTENCES
COMMENTS = ("{}", "# {}", " * {}", "// {}", ";; {}")


def wrapped(sentences, width, mark):
    """Paragraphs of sentences, wrapped, each line behind a comment mark."""
    lines = [x for s in sentences for x in (*textwrap.wrap(s, width), "")]
    return "\n".join(mark.format(x).rstrip() for x in lines)


TEXTS = [
    None, "", "Some words. Released under the MIT License. More", "LICENSED under CC BY-NC 4.0.\nAll rights reserved.",
    "/* " + S["mit-grant"] + "\n\n" + S["mit-notice"] + "\n" + S["mit-warranty"], S["mit-notice"] + "\n" + S["mit-grant"],
    S["bsd-grant"] + "\n" + S["bsd-source"] + "\n" + S["bsd-binary"] + "\n" + S["bsd-names"], "x " * 50_000 + ".\n" + S["gpl3-short"], S["mit-short"],
    f"{S['apache-grant']}\n{S['apache-copy']}\n{S['apache-warranty']}", "Released under the MIT License, see LICENSE.", "Copyright 2020 Acme. All rights reserved.",
    wrapped([S["mit-grant"], S["mit-notice"], S["mit-warranty"]], 72, " * {}"),
    wrapped(["Copyright (c) 2019, Acme", "All rights reserved.", S["bsd-grant"], "1. " + S["bsd-source"], "2. " + S["bsd-binary"], "3. " + S["bsd-names"]], 60, "# {}"),
    wrapped([S["bsd-grant"], S["bsd-source"], S["bsd-binary"]], 60, "{}") + "\n" + wrapped([S["bsd-grant"], S["bsd-source"], S["bsd-binary"], S["bsd-names"]], 70, "{}"),
    wrapped([S["gpl-grant"], S["gpl-hope"] + " " + S["gpl-see"]], 70, "// {}"), wrapped([S["mpl-grant"] + " " + S["mpl-copy"]], 66, "{}"),
    wrapped([S["apache-grant"] + " " + S["apache-copy"], S["apache-warranty"] + " " + S["apache-see"]], 72, "# {}"), "not Released under the MIT License.", "permission\nis hereby granted",
]
WANT = ["", "", "MIT", "CC-BY-NC-4.0", "MIT", "", "BSD-3-Clause", "GPL-3.0", "MIT", "Apache-2.0", "MIT", "Proprietary", "MIT", "BSD-3-Clause", "BSD-3-Clause,BSD-2-Clause", "GPL-3.0", "MPL-2.0", "Apache-2.0", "", ""]


def test_rules_and_odd_rows(spark):
    docs = documents(spark, TEXTS)
    rows = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    assert [rows[i].licenses for i in range(len(TEXTS))] == WANT
    assert rows[5].sentence_ids == "mit-notice,mit-grant"
    assert licenses.license_report(documents(spark, ["a"]).limit(0)).count() == 0
    twice = documents(spark, [S["mit-short"]] * 2, ids=[3, 3]).withColumnRenamed("score", "found").withColumnRenamed("path", "licenses").withColumnRenamed("rank", "fragments")
    got = licenses.scanned(twice)
    assert got.columns == [*twice.columns, "_found"] and [(r.licenses, r._found.licenses) for r in got.collect()] == [("y", ["MIT"])] * 2


@pytest.mark.parametrize("width", [40, 76])
def test_every_sentence_is_found_wrapped_and_not(spark, width):
    names = list(S)
    texts = [t for i in names for t in (S[i], wrapped(["First words here.", S[i], "Last words."], width, COMMENTS[len(i) % 5]))]
    rows = licenses.license_report(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.sentence_ids for r in rows] == [i for i in names for _ in range(2)]


def test_every_rule_can_be_found(spark):
    cases = [(name, rule) for name, rules in licenses.RULES.items() for rule in rules]
    rows = licenses.license_report(documents(spark, ["\n\n".join(S[i] for i in rule) for _, rule in cases])).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == [name for name, _ in cases]


def test_equals_sql(spark, tmp_path):
    texts = TEXTS[:7] + TEXTS[8:] + [wrapped(list(S.values()), w, COMMENTS[w % 5]) for w in (30, 50, 71, 200)]
    docs = documents(spark, texts).select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/d")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(duck.sql(f"SELECT doc_id, n_known, sentence_ids, licenses FROM ({sql.ORACLES['op4_license_scan']})").fetchall())
    assert sorted(map(tuple, licenses.license_report(docs).collect())) == want
