import re

from conftest_llm import documents, prose
from pyspark.sql import functions as F
from tidewire.llm import substring_dedup


def cut(text):
    """Sentences with what follows each up to the next, after what comes before the first."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    heads = [i for i, w in enumerate(words) if i == 0 or words[i - 1][0][-1] in ".!?" or "\n" in text[words[i - 1].end() : w.start()]]
    starts = [words[i].start() for i in heads]
    lead = text[: starts[0]] if starts else text
    return lead, [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])]


def expected(ids, texts):
    seen, out = set(), {}
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        lead, parts = cut(texts[i] or "")
        words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), p)) for p in parts]
        gone, runs = set(), set()
        for a in range(len(parts)):
            b = next((b for b in range(a + 1, len(parts) + 1) if sum(map(len, words[a:b])) >= 20), None)
            runs |= {(a, b)} if b else set()
            c = next((c for c in range(a, -1, -1) if sum(map(len, words[c : a + 1])) >= 20), None)
            runs |= {(c, a + 1)} if c is not None else set()
        for a, b in sorted(runs):
            run = tuple(w for s in words[a:b] for w in s)
            if run in seen:
                gone |= set(range(a, b))
            seen.add(run)
        out[ids[i]] = (len(parts), len(gone), lead + "".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_equals_brute_force(spark, rng):
    passages = [prose(rng, 60) + "." for _ in range(4)]
    texts = [None, "", "  ", "\n. .", "short."] + [prose(rng, rng.randrange(80)) + "\n" + rng.choice(passages) + " " + prose(rng, rng.randrange(80)) for _ in range(30)]
    texts += [prose(rng, 20000), texts[9].upper(), "é. " * 50]
    ids = [i * 13 % 991 for i in range(len(texts))]
    docs = documents(spark, texts, ids)
    want = expected(ids, texts)
    rows = substring_dedup.span_report(docs).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text or "") for r in rows} == want
    assert all(r.changed == (r.n_removed > 0) for r in rows)
    for p in passages:
        assert sum(cut(p)[1][2].strip() in (r.text or "") for r in rows) <= 2
    assert substring_dedup.deduplicated(docs).columns == docs.columns


def test_whole_of_a_passage_goes(spark):
    lengths = (25, 12, 7)
    passage = " ".join(" ".join(f"p{k}x{i}" for i in range(n)) + "." for k, n in enumerate(lengths))
    rows = substring_dedup.span_report(documents(spark, ["One here. " + passage + " After it.", "Other start. " + passage + " End now."])).collect()
    assert {r.doc_id: r.text for r in rows}[1] == "Other start. End now."


def test_clashing_names(spark):
    names = ["id", "text_hash", "runs", "span", "first", "size", "later", "kept"]
    text = " ".join(f"w{i}." for i in range(40))
    docs = documents(spark, [text, text]).withColumns({n: F.lit(7) for n in names})
    rows = substring_dedup.deduplicated(docs)
    assert rows.columns == docs.columns
    assert sorted(len(r.text) for r in rows.collect()) == [0, len(text)] and all(r[n] == 7 for r in rows.collect() for n in names)


def test_odd_rows(spark):
    text = " ".join(f"w{i}." for i in range(40))
    rows = substring_dedup.span_report(documents(spark, [text, text, text], [1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 0), ("1", 0), ("None", 40)]
    assert substring_dedup.span_report(documents(spark, ["a"]).limit(0)).count() == 0


def test_rows_without_id_keep_to_themselves(spark):
    """Texts whose 32-bit hashes are equal, all without doc_id: each loses only what it repeats itself."""
    head = " ".join(f"h{i}" for i in range(25)) + "."
    tails = spark.range(400_000).selectExpr("concat(id, '.') AS t").withColumn("text", F.concat(F.lit(head + " "), "t")).withColumn("h", F.hash("text"))
    twins = tails.groupBy("h").agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").first().texts
    short = spark.range(400_000).selectExpr("concat('s', id) AS text").withColumn("h", F.hash("text"))
    other = short.join(tails.select("h").distinct(), "h").first()
    same = tails.where(F.col("h") == other.h).first().text
    texts = [head, *twins, other.text, same]
    kept = substring_dedup.span_report(documents(spark, texts, [1] + [None] * (len(texts) - 1))).collect()
    assert sorted(r.text for r in kept) == sorted([head, *(t[len(head) + 1 :] for t in twins), other.text, same[len(head) + 1 :]])


def test_texts_without_blanks(spark):
    """Each Han, kana or Thai character is a word, an ideographic full stop ends a sentence."""
    said = "".join(chr(0x4E00 + i) for i in range(30)) + "。"
    thai = "".join(chr(0x0E01 + i) for i in range(25))
    texts = [said + "好。", "是。" + said + "a b。", thai, f"Hello.\n{thai}", "\U00020000" * 30, "x.\n" + "\U00020000" * 30, "é" * 40]
    rows = {r.doc_id: (r.n_sentences, r.text) for r in substring_dedup.span_report(documents(spark, texts)).collect()}
    assert rows == {0: (2, texts[0]), 1: (3, "是。a b。"), 2: (1, thai), 3: (2, "Hello.\n"), 4: (1, texts[4]), 5: (2, "x.\n"), 6: (1, texts[6])}
