import re
from collections import defaultdict

import pytest
from conftest_llm import documents, prose
from pyspark.sql import functions as F
from tidewire.llm import mixing


def targets(sizes):
    """Share by weight, stop, share what is above again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        rest -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return out


def test_targets_and_takes(spark, rng):
    sources = [rng.choice(["big", "big", "big", "a", "é", None, "tiny" if i % 40 == 0 else "big"]) for i in range(400)]
    texts = [rng.choice([None, "", " "]) if i % 25 == 0 else prose(rng, rng.randrange(1, 400)) for i in range(399)] + [prose(rng, 30000)]
    docs = documents(spark, texts, sources=sources)
    rows = mixing.mix_report(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(sizes), defaultdict(int)
    for r in rows:
        source = sources[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, n in taken.items():
        assert n == pytest.approx(want[s], abs=1)
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect())) == sorted(map(tuple, rows))
    mix = mixing.mixed(docs).groupBy("doc_id").sum("words").collect()
    assert {r[0]: r[1] for r in mix} == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.shard_counts(docs).count() > 0


def test_packed_blocks(spark, rng, monkeypatch):
    """Every slot holds a block of its source's words in order, every shard its slots, and the counts are those of the draw."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "BUCKET", 8)
    sources = [rng.choice(["a", "b", None]) for _ in range(60)]
    texts = [" ".join(f"d{i}w{k}" for k in range(rng.randrange(200))) for i in range(60)]
    docs = documents(spark, texts, sources=sources).withColumn("block", F.lit(1)).withColumn("start", F.lit(2))
    rows = mixing.packed(docs).collect()
    by_shard, blocks, counts = defaultdict(list), {}, defaultdict(int)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        counts[r.shard, r.source] += 1
        known = blocks.setdefault((r.source, r.block), r.text)
        assert known.startswith(r.text) or r.text.startswith(known)  # the last slot of a source takes what its target lacks
        blocks[r.source, r.block] = max(known, r.text, key=len)
    assert sorted(by_shard) == list(range(len(by_shard))) and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert sorted(map(len, by_shard.values()))[1:] == [16] * (len(by_shard) - 1)
    assert {(r.shard, r.source): r.slots for r in mixing.shard_counts(docs).collect()} == dict(counts)
    assert len({tuple(sorted((str(s), n) for (k, s), n in counts.items() if k == shard)) for shard in by_shard}) > 1  # shards differ
    taken = defaultdict(int)
    for r in rows:
        for w in r.text.split():
            taken[int(w[1:].split("w")[0])] += 1
    assert dict(taken) == {r.doc_id: r.taken for r in mixing.mix_report(docs).collect() if r.taken}
    for source in ("a", "b", None):
        own = [blocks[k] for k in sorted(k for k in blocks if k[0] == source)]
        assert sum(len(x.split()) != mixing.BLOCK_WORDS for x in own[:-1]) <= 1
        heard = " ".join(own).split()
        runs = [w.split("w")[0] for i, w in enumerate(heard) if not i or w.split("w")[0] != heard[i - 1].split("w")[0]]
        assert len(set(heard)) == len(heard) and (len(runs) == len(set(runs)) or len(own) < max(k[1] for k in blocks if k[0] == source) + 1)


def test_report_follows_the_draw(spark, rng):
    plan = mixing.mix_report(documents(spark, [prose(rng, 90) for _ in range(20)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "first" in plan and "slots" in plan


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("x")).collect()
        assert sorted(r.x for r in rows) == list(range(n))


def test_places_undo_the_permutation(spark):
    for n in (1, 2, 7, 1000):
        seed = (F.lit("k"), F.lit(3))
        rows = spark.range(n).select("id", mixing.place_of(mixing.permuted(F.col("id"), F.lit(n), *seed), F.lit(n), *seed).alias("x")).collect()
        assert all(r.x == r.id for r in rows)


def test_small_sources_meet_their_targets(spark, rng):
    """Sources of a few words, of whole blocks, of one document and of many."""
    held = [rng.randrange(1, 40) for _ in range(120)] + [64, 128, 192, 1, 2, 63, 65, 129]
    sources = [f"s{i // 3:02}" for i in range(120)] + [f"t{i}" for i in range(8)]
    texts = [" ".join("w" * n) for n in held]
    rows = mixing.mix_report(documents(spark, texts, sources=sources)).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in target)


def test_odd_rows(spark):
    docs = documents(spark, ["a b", "a b", None], [5, 5, None], sources=["s", "s", None])
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 3 and sum(r.taken for r in rows) == 4
    assert mixing.mix_report(docs.limit(0)).count() == 0
    (row,) = mixing.mix_report(documents(spark, [""])).collect()
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)
