"""Columns of the caller's whose names are those that the operators use inside: none is changed, and none stops a job."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidewire.llm import chat, decontaminate, language_id, licenses, line_dedup, mixing, near_dedup, pii, secrets, structure_repair, substring_dedup, target_sampling

LLM = Path(line_dedup.__file__).parent
BASE = ["doc_id", "text", "lang", "source", "n_chars"]


def names_in(*modules):
    """Every name of a column in the modules' source, but those of the documents themselves."""
    found = set()
    for m in modules:
        found |= set(re.findall(r'"(_{0,2}[a-z][a-z_0-9]*)"', (LLM / m).read_text()))
    return sorted(found - set(BASE))


def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string")


OPERATORS = {
    "lines": (("line_dedup.py", "common.py"), lambda spark, docs: line_dedup.deduplicated(docs, long_words=50)),
    "near": (("near_dedup.py", "common.py"), lambda spark, docs: near_dedup.deduplicated(docs)),
    "spans": (("substring_dedup.py", "common.py"), lambda spark, docs: substring_dedup.deduplicated(docs)),
    "benchmark": (("decontaminate.py", "common.py"), lambda spark, docs: decontaminate.decontaminated(docs, bench(spark))),
    "benchmark in passes": (("decontaminate.py", "common.py"), lambda spark, docs: decontaminate.decontaminated(docs, bench(spark), block=2)),
    "language": (("language_id.py", "common.py"), lambda spark, docs: language_id.accepted(docs)),
    "pii": (("pii.py", "common.py"), lambda spark, docs: pii.masked(docs)),
    "licenses": (("licenses.py", "common.py"), lambda spark, docs: licenses.scanned(docs).select(*(f"`{c}`" for c in docs.columns))),
    "target": (("target_sampling.py", "common.py"), lambda spark, docs: target_sampling.resampled(docs, bench(spark), percent=100)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    modules, operator = OPERATORS[name]
    clashing = [n for n in [*names_in(*modules), "__key", "__id", "__row", "__runs", "__lines", "__removed", "__hash", "__fragments", "__ids", "a.b", "Ä x"] if n.lower() not in BASE]
    text = ". ".join(f"the w{i} and w{i + 1}\n of it" for i in range(40))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([text, "the and of", text.replace("w3 ", "other "), "\n".join(f"l{i} the and" for i in range(60))])]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *(F.lit(7).alias(n) for n in dict.fromkeys(clashing)))
    out = operator(spark, docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted((r["doc_id"], r["text"]) for r in operator(spark, plain).collect())
    assert all(v == 7 for r in found for v in r[len(BASE) :])


def test_reports_ignore_other_columns(spark):
    names = [n for n in names_in("mixing.py", "common.py", "secrets.py", "language_id.py") if n not in BASE]
    plain = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (2, "e f", "en", "t", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *(F.lit(7).alias(n) for n in names))
    for report in (mixing.mix_report, language_id.language_report, secrets.secret_report):
        assert sorted(map(repr, report(docs).collect())) == sorted(map(repr, report(plain).collect()))
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    more = turns.select("*", *(F.lit(7).alias(n) for n in names_in("structure_repair.py", "chat.py") if n not in turns.columns))
    for report in (structure_repair.repair_report, chat.chat_report):
        assert sorted(map(repr, report(more).collect())) == sorted(map(repr, report(turns).collect()))
