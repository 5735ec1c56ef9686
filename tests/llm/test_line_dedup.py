import corpus_pipeline
import duckdb
from conftest_llm import documents, prose
from tidewire.llm import line_dedup, sql


def expected(ids, texts):
    seen, out = set(), {}
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for i in order:
        if texts[i] is None:
            out[ids[i]] = (0, 0, "")
            continue
        lines = texts[i].split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a in range(len(solid) - 2):
            run = tuple(lines[k] for k in solid[a : a + 3])
            if run in seen:
                gone |= set(solid[a : a + 3])
            seen.add(run)
        out[ids[i]] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_equals_brute_force(spark, rng):
    block = [prose(rng, 4).replace("\n", " ") for _ in range(6)]
    texts = [None, "", "\n\n", "a\nb\nc", "x\na\n \nb\nc\ny", "a\nb\nx", "a\na\na\na\na", "\n".join(block), "q\n" + "\n".join(block[1:5]) + "\nr"]
    for _ in range(40):
        texts.append("\n".join(rng.choice(["a", "b", "c", "", " ", *block]) for _ in range(rng.randrange(30))))
    texts.append("\n".join(rng.choice(["a", "b", *block]) for _ in range(5000)))
    ids = [i * 11 % 997 for i in range(len(texts))]
    docs = documents(spark, texts, ids)
    want = expected(ids, texts)
    rows = line_dedup.line_report(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_chars) for r in rows} == {i: (n, g, len(t)) for i, (n, g, t) in want.items()}
    kept = line_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text or "" for r in kept.collect()} == {i: t for i, (_, _, t) in want.items()}


def test_odd_rows(spark):
    docs = documents(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc"], [3, 3, None])
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.deduplicated(docs).collect()) == [("3", "a\nb\nc"), ("3", "a\nb\nc"), ("None", "")]
    assert line_dedup.line_report(docs.limit(0)).count() == 0


def test_long_runs_of_one_or_two_lines(spark, rng):
    line = lambda n, at: " ".join("w%d" % (at + i) for i in range(n))
    one, a, b, short, han = line(51, 0), line(30, 100), line(21, 200), line(50, 300), "".join(chr(0x4E00 + i) for i in range(51))
    texts = [one, f"x\n{one}\ny", one, f"{a}\n \n{b}", f"u\n{a}\n{b}\nv", a, b, short, short, f"{one}\n{one}", han, han, f"{b}\n{a}", None, ""]
    want = [one, "x\ny", "", f"{a}\n \n{b}", "u\nv", a, b, short, short, "", han, "", f"{b}\n{a}", None, ""]
    docs = documents(spark, texts)
    kept = line_dedup.deduplicated(docs, long_words=50)
    assert kept.columns == docs.columns
    assert [r.text for r in kept.orderBy("doc_id").collect()] == want
    assert [r.text for r in line_dedup.deduplicated(docs).orderBy("doc_id").collect()] == texts
    stage = corpus_pipeline.lines(spark, docs, "").orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in stage] == [(t, len(t or "")) for t, old in zip(want, texts) if t or not old]


def test_runs_of_three_with_long_words(spark, rng):
    """Where no line is long, long_words changes nothing."""
    texts = ["\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randrange(30))) for _ in range(30)]
    docs = documents(spark, texts)
    texts_of = lambda df: [r.text for r in df.orderBy("doc_id").collect()]
    assert texts_of(line_dedup.deduplicated(docs, long_words=70)) == texts_of(line_dedup.deduplicated(docs))


def test_blank_lines_hold_ascii_blanks_only(spark):
    """Lines that end with a carriage return: blank ones are no run; a no-break space is text."""
    texts = ["first\r\n\r\n\r\n\r\nother", "second\r\n\r\n\r\n\r\nlast", "\t\n \x0b\n\x0c\n\r", "\t\n \x0b\n\x0c\n\r", "a\r\nb\r\nc\r", "x\r\n\r\na\r\nb\r\nc\r", " \n \n ", " \n \n "]
    kept = [r.text for r in line_dedup.deduplicated(documents(spark, texts)).orderBy("doc_id").collect()]
    assert kept == [*texts[:5], "x\r\n\r", texts[6], ""]
    con = duckdb.connect()
    con.register("documents", documents(spark, texts).toArrow())
    want = con.execute(f"SELECT doc_id, n_lines, n_removed, kept_chars, kept_sha256 FROM ({sql.ORACLES['op7_line_dedup']})").fetchall()
    assert sorted(map(tuple, line_dedup.line_report(documents(spark, texts)).collect())) == sorted(want)
