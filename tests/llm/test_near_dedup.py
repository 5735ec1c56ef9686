import re

import corpus_pipeline
import pytest
from conftest_llm import documents, prose
from tidewire.llm import near_dedup


def expected(ids, texts):
    sets = {}
    for i, t in zip(ids, texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(rng):
    texts = [None, "", " \n ", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = prose(rng, 120).split(" ")
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(1000)
            texts.append(" ".join(words))
    texts += [prose(rng, 50) for _ in range(10)] + [texts[20], texts[30].upper()] + [prose(rng, 20000)]
    return texts


@pytest.mark.parametrize("leaf", [512, 6, 3])
def test_components_equal_brute_force(spark, rng, monkeypatch, leaf):
    """Small leaves take the ways of branching and dense nodes."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    texts = corpus(rng)
    ids = [i * 7 % 1009 for i in range(len(texts))]
    got = sorted(map(tuple, near_dedup.near_duplicates(documents(spark, texts, ids)).collect()))
    assert got == expected(ids, texts)


def test_odd_rows(spark):
    text = "p q r s t u v w"
    rows = near_dedup.near_duplicates(documents(spark, [text, text, text, "z", None], [None, 4, 4, 9, None])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in rows if r.doc_id) == [(False, 4, True), (False, 4, True), (False, 9, True)]
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = near_dedup.deduplicated(documents(spark, [text, text, text, "z", None], [None, 4, 4, 9, None]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None", "None"]
    assert kept.columns == documents(spark, ["a"]).columns


def test_rows_of_one_id_are_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = documents(spark, [a, a, b, b, None, "lone"], [1, 5, 5, 7, 7, 9])
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (7, 1, False), (9, 9, True)]


def test_only_copies_go(spark):
    """Rows that share a doc_id but not their text stay; reruns agree."""
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = documents(spark, [a, a, b, b, "lone", "lone", None, " "], [1, 5, 5, 7, 9, 9, 9, 9])
    for n in (1, 3):
        kept = near_dedup.deduplicated(docs.repartition(n)).collect()
        assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, a), (5, b), (9, ""), (9, " "), (9, "lone")]


def test_empty(spark):
    none = documents(spark, ["a"]).limit(0)
    assert near_dedup.near_duplicates(none).count() == 0


def test_threshold_is_the_callers(spark, rng):
    """One word of 52 apart makes a Jaccard of 43/53 = 0.811."""
    words = ["w%d" % i for i in range(52)]
    texts = [" ".join(words), " ".join([*words[:20], "edit", *words[21:]])]
    docs = documents(spark, texts)
    components = lambda **link: sorted(r.component_id for r in near_dedup.near_duplicates(docs, **link).collect())
    assert components() == components(link=(85, 100)) == [0, 1]
    assert components(link=(80, 100)) == [0, 0]
    assert components(link=(82, 100)) == [0, 1]
    assert near_dedup.deduplicated(docs, link=(80, 100)).count() == 1
    assert [near_dedup.sketch_agree(x) for x in ((85, 100), (80, 100))] == [40, 35]


def test_pipeline_stage_links_at_four_fifths(spark):
    words = ["w%d" % i for i in range(52)]
    docs = documents(spark, [" ".join(words), " ".join([*words[:20], "edit", *words[21:]]), " ".join(words[::-1])])
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2]


def test_branching_grows_with_the_input(spark, rng, monkeypatch):
    """Sketches of one text's copies, each with two thirds of its tokens: four times as many make about four times the rows."""
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    made, sized = [], near_dedup.sized

    def counted(members):
        out = sized(members)
        made.append(out.count())
        return out

    class Branched(Exception):
        pass

    def stop(*_):
        raise Branched

    monkeypatch.setattr(near_dedup, "sized", counted)
    monkeypatch.setattr(near_dedup, "alike", lambda batches, agree: iter(()))
    monkeypatch.setattr(near_dedup, "sets_for", stop)
    rows = []
    for n in (150, 600):
        made.clear()
        mins = [[t if rng.random() < 0.67 else rng.randrange(1000, 2**31) for t in range(near_dedup.TOKENS)] for _ in range(n)]
        known = spark.createDataFrame([(i, m, i, i, i) for i, m in enumerate(mins)], "rep long, mins array<int>, low long, set_a long, set_b long")
        with pytest.raises(Branched):
            near_dedup.edges_of(known, known, (80, 100))
        rows.append(sum(made))
    assert rows[1] <= 6 * rows[0]


class Branched(Exception):
    pass


def rows_made(spark, rng, monkeypatch, n):
    """The rows of n sketches of one text's copies, each with two thirds of its tokens: those at the roots, and all that branching and comparing make of them."""
    made, pinned, sized = [], near_dedup.pinned, near_dedup.sized

    def entered(members):
        made.append(members.count())
        return sized(members)

    def written(df):
        out = pinned(df)
        if out.columns == ["path", "block", "role", "rep"]:
            made.append(out.count())
        return out

    def stop(*_):
        raise Branched

    monkeypatch.setattr(near_dedup, "sized", entered)
    monkeypatch.setattr(near_dedup, "pinned", written)
    monkeypatch.setattr(near_dedup, "sketch_agree", lambda link: 0)
    monkeypatch.setattr(near_dedup, "sets_for", stop)
    mins = [[t if rng.random() < 0.67 else rng.randrange(1000, 2**31) for t in range(near_dedup.TOKENS)] for _ in range(n)]
    known = spark.createDataFrame([(i, m, i, i, i) for i, m in enumerate(mins)], "rep long, mins array<int>, low long, set_a long, set_b long")
    with pytest.raises(Branched):
        near_dedup.edges_of(known, known, (80, 100))
    monkeypatch.undo()
    return made[0], sum(made[1:])


def test_a_node_of_a_few_blocks_is_compared_by_blocks(spark, rng, monkeypatch):
    """Of 80 sets some 54 are in the large node of a root, which is four blocks: three rows a set, and none of ways."""
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    roots, rest = rows_made(spark, rng, monkeypatch, 80)
    assert roots == 8 * 80 and rest <= 3 * roots


def group(rng, n):
    """Copies of one text with one to five words changed, some copies of copies: most are not linked."""
    base = prose(rng, 45).split(" ")
    texts = [list(base)]
    for i in range(n):
        words = list(rng.choice(texts) if i % 4 == 0 else base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10000)
        texts.append(words)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("leaf", [512, 40, 12, 3])
def test_components_of_a_group_equal_brute_force(spark, rng, monkeypatch, leaf):
    """Compared in one block, in a few, and by branching or as a dense node."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    texts = group(rng, 130)
    ids = list(range(len(texts)))
    assert sorted(map(tuple, near_dedup.near_duplicates(documents(spark, texts, ids)).collect())) == expected(ids, texts)
