import hashlib
import itertools
import random
import re
import zlib

import duckdb
from tidewire.llm import sql, structure_repair

ROW = "conv_id long, turn long, role string, text string, at long, segment string, items int, start string"


def conversations(spark, rows):
    """Conversations with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], ROW)


def by_search(turns):
    """The cheapest audit of (role, text) turns and its repair, by trying every path of at most two insertions in a row."""
    faults, seen = [], set()
    for role, text in turns:
        solid = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = []

    def walk(i, cost, audit, out, inserts):
        if i == len(turns):
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best.append((cost, audit, out))
        else:
            role, text = turns[i]
            walk(i + 1, cost + 2, audit + "D", out, 0)
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                walk(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    walk(i + 1, cost + 1 + more, audit + "R", [*out, (r, text)], 0)
        if inserts < 2:
            for r in ("user", "assistant"):
                walk(i, cost + 5, audit + "I", [*out, (r, "")], inserts + 1)

    walk(0, 0, "", [], 0)
    cost, audit, out = min(best, key=lambda x: x[:2])
    return [faults.count(f) for f in ("blank", "duplicate", "truncated")], cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


TEXTS = ["Yes.", "No", " ", "Why?", "And so on", "Well!  ", ""]


def test_equals_exhaustive_search(spark):
    rng = random.Random(3)
    kept, convs = [], {}
    for c in range(45):
        roles = ["user", "assistant", "system"] if c % 3 == 0 else ["system", "user", "assistant", "tool", "sage", ""]
        turns = [(i if c % 3 == 0 else rng.choice([None, 0, 1, 2, 3, 5]), rng.choice(roles), rng.choice(TEXTS)) for i in range(rng.randrange(1, 4))]
        convs[c] = turns
        kept += [(c, *t) for t in turns]
    rng.shuffle(kept)
    got = {}
    for r in structure_repair.repaired(conversations(spark, kept)).orderBy("conv_id", "segment", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    rows = structure_repair.cleaned(conversations(spark, kept))
    found = {r.conv_id: (r.cost, r.audit) for r in structure_repair.repairs(structure_repair.segments(structure_repair.judged(rows))).collect()}
    for c, turns in convs.items():
        ordered = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        _, cost, audit, said = by_search([t[1:] for t in ordered])
        assert found[c] == (cost, audit), (c, ordered)
        assert "\n".join(f"{r}:{t}" for r, t in got.get(c, [])) == said


def sorted_nulls(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_report_equals_sql(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(9)]), rng.choice([None, "system", "user", "assistant", "user", "assistant", "tool"]), rng.choice([None, "é.", *TEXTS])) for _ in range(400)]
    rows += [(77, i, ("user", "assistant")[i % 2], rng.choice(["Yes %d.", "no %d"]) % (i // 3)) for i in range(300)]
    monkeypatch.setattr(structure_repair, "SEGMENT_BITS", 5)  # many segments a conversation
    got = structure_repair.repair_report(conversations(spark, rows))
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toArrow())
    want = con.execute(sql.ORACLES["op11_structure_repair"])
    names = [d[0] for d in want.description]
    assert sorted_nulls(tuple(r[n] for n in names) for r in got.collect()) == sorted_nulls(want.fetchall())


def test_segments_do_not_matter(spark, monkeypatch):
    rng = random.Random(5)
    for n in (1, 2, 50):
        symbols = "".join(rng.choice("suaoSUAOxuaua") for _ in range(n))
        whole = [{"start": a, "stop": z, "cost": c, "label": x} for a, z, c, x in structure_repair.shortest(symbols)]
        for size in (1, 3, 7):
            cut = [[{"start": a, "stop": z, "cost": c, "label": x} for a, z, c, x in structure_repair.shortest("".join(s))] for s in itertools.batched(symbols, size)]
            one, many = structure_repair.folded([whole]), structure_repair.folded(cut)
            assert one[0] == many[0]
            assert "".join(x for _, x in one[1]) == "".join(x for _, x in many[1])


def test_empty_and_dropped(spark):
    none = conversations(spark, [(1, 1, "user", "a.")]).limit(0)
    assert structure_repair.repair_report(none).count() == 0
    assert structure_repair.repaired(none).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = structure_repair.repair_report(conversations(spark, [(5, gone, "user", "Hi.")])).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_texts_and_repeats(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "Yes.")] + [(2, 0, "user", "Hi.")] * 500
    turns = structure_repair.repaired(conversations(spark, rows)).orderBy("conv_id", "segment", "place").collect()
    assert [(t.conv_id, t.edit, t.role, len(t.text)) for t in turns] == [(1, "K", "user", len(long)), (1, "K", "assistant", 4)]
