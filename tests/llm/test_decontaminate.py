import hashlib
import re

import numpy as np
from conftest_llm import documents, prose
from tidewire.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def expected(texts, items):
    windows = {}
    for item, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - 12)) if ws else ():
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(str(item))
    out = []
    for i, t in enumerate(texts):
        ws, hit, found = words(t), set(), set()
        for w, own in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= own
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(ws)))
    return out


def fixture(spark, rng):
    items = [(i, prose(rng, 14 + i)) for i in range(12)] + [(100, "kora minera"), (101, ""), (102, None), (9, "solo"), (10, "SOLO!")]
    texts = [None, "", "...", "kora, Minera", "solo solo x"] + [prose(rng, 40) + " " + items[i][1].upper() + " " + prose(rng, 30 * i) for i in range(12)] + [prose(rng, 30000) + items[3][1]]
    texts += [items[0][1][: len(items[0][1]) // 2], texts[7], texts[7]]
    return texts, items, documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark, rng):
    texts, items, docs, bench = fixture(spark, rng)
    got = sorted(tuple(r)[:6] for r in decontaminate.contamination_report(docs, bench).collect())
    assert got == expected(texts, items)


def test_passes_agree(spark, rng):
    _, _, docs, bench = fixture(spark, rng)
    rows = docs.withColumnRenamed("doc_id", "row_id")
    one, many = (sorted(map(str, decontaminate.contamination(rows, bench, block=b).select("row_id", "n_words", "n_hit", "item_ids", "hit_spans").collect())) for b in (10**6, 20))
    assert one == many


def test_any_benchmark_size_keeps_each_row(spark, rng):
    texts, items, _, bench = fixture(spark, rng)
    texts = [*texts[5:9], *texts[5:7], "clean one", "clean two", "clean two"]
    docs = documents(spark, texts, [1, 1, None, None, 1, 2, 1, None, None])
    one, many = (sorted(map(str, decontaminate.contamination_report(docs, bench, block=b).collect())) for b in (10**6, 25))
    assert one == many and len(one) == len(texts)
    kept = [sorted(map(str, decontaminate.decontaminated(docs, bench, block=b).collect())) for b in (10**6, 25)]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_filter_keeps_clean_rows(spark, rng):
    texts, items, docs, bench = fixture(spark, rng)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [e[0] for e in expected(texts, items) if not e[5]]
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.contamination_report(docs.limit(0), bench).count() == 0


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    for _ in range(100):
        text = rng.integers(0, 4, rng.integers(1, 80))
        text[-1] = 0
        index = decontaminate.FmIndex(text, 3)
        for n in (1, 2, 3):
            phrases = rng.integers(1, 4, (5, 3))
            low, high = index.search(phrases, np.full(5, n), len(text))
            for p, a, b in zip(phrases, low, high):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[3 - n :]).all()]
