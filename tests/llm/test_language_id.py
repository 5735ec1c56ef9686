import zlib

from conftest_llm import documents
from tidewire.llm import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_odd_rows(spark):
    texts = [None, "", "123 !?", "the cat and the hat", "der hund und die katze", "the the the", "der der", "Ω"] * 6
    langs = [None, "en", "en", "en", "de", "en", "de", None] * 6
    docs = documents(spark, texts, langs=langs)
    rows = {r.doc_id: r for r in language_id.language_report(docs).collect()}
    for i, text in enumerate(texts):
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0) if text in (None, "", "123 !?") else rows[i].lang_pred in ("en", "de")
        assert 0 <= rows[i].score <= 1
    assert rows[3].lang_pred == "en" and rows[4].lang_pred == "de"
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]


def test_nothing_to_learn(spark):
    docs = documents(spark, ["abc"], langs=[None])
    assert [(r.lang_pred, r.score) for r in language_id.language_report(docs).collect()] == [("und", 0.0)]
    assert language_id.language_report(docs.limit(0)).count() == 0
    (row,) = language_id.language_report(documents(spark, ["abc"], ids=[None])).collect()
    assert row.held_out is False


def test_profile_ranks_by_frequency_then_code():
    assert language_id.ranked(language_id.grams("aab"))[:2].tolist() == [ord("a"), ord("b")]


def plain_grams(text):
    """Counted 1-, 2- and 3-grams as strings."""
    import unicodedata
    from collections import Counter

    if not any(c.isalpha() for c in text):
        return Counter()
    words = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower()).split()
    out = Counter()
    line = " " + " ".join(words) + " "
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if n == 1 and g == " " or n == 3 and g[1] == " ":
                continue
            out[g] += 1
    return out


def plain_profile(counts):
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:300]]


def test_equals_brute_force(spark, rng):
    """Profiles and distances by hand, for each row of a table."""
    import zlib
    from collections import Counter

    alphabets = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "\u0915\u093e\u0916\u093f\u0917", "ww": "\u0431\u0432\u0433\u0434"}
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randrange(1, 7)))
    langs = [rng.choice([*alphabets, None]) for _ in range(60)]
    texts = [" ".join(word(alphabets[x or "xx"]) for _ in range(rng.randrange(1, 90))) + rng.choice([".", " 12", "\n"]) for x in langs] + [None, "", "12 .", "\u093e", "Abc"]
    langs += ["xx"] * 5
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    learned = {}
    for i, (t, x) in enumerate(zip(texts, langs)):
        if x and t and not held(i):
            learned.setdefault(x, Counter()).update(plain_grams(t))
    profiles = {x: {g: r for r, g in enumerate(plain_profile(c))} for x, c in learned.items()}
    rows = {r.doc_id: r for r in language_id.language_report(documents(spark, texts, langs=langs)).collect()}
    for i, t in enumerate(texts):
        own = plain_profile(plain_grams(t or ""))
        apart = {x: sum(abs(p[g] - r) if g in p else 300 for r, g in enumerate(own)) for x, p in profiles.items()}
        want = min(apart, key=lambda x: (apart[x], x)) if own else "und"
        assert (rows[i].lang_pred, rows[i].held_out) == (want, held(i))
        assert abs(rows[i].score - (1 - apart[want] / (300 * len(own)) if own else 0)) < 1e-9
