import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
from conftest_llm import documents
from tidewire.llm import sql, target_sampling


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, Counter(zlib.crc32(g.encode()) % 10_000 for g in [*words, *map(" ".join, zip(words, words[1:], strict=False))])


def texts(rng):
    pool = ["Alpha", "beta", "gamma", "delta!", "épsilon", "10", "ÀB", "x\x00y", "語", "\n", "--"]
    return [None, "", "...", "one", *(" ".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(60)), " ".join(rng.choice(pool) for _ in range(3000))]


def test_report_equals_brute_force_and_sql(spark, monkeypatch):
    rng = random.Random(1)
    held, items = texts(rng), ["alpha beta 10", None, "語 語 gamma"]
    held += held[-3:]
    ids = [None if i % 20 == 3 else i * 7 % 90 for i in range(len(held))]
    monkeypatch.setattr(target_sampling, "PIECE", 500)  # long texts go in pieces
    docs, bench = documents(spark, held, ids), spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    each = [grams(t) for t in held]
    source, target = sum((c for _, c in each), Counter()), sum((grams(t)[1] for t in items), Counter())
    total, wanted = source.total(), target.total()
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (total + 10_000) / ((source[b] + 1) * (wanted + 10_000)))) for b in source}
    want = []
    for i, (words, counts) in zip(ids, each, strict=True):
        weight = sum(gain[b] * n for b, n in counts.items()) // counts.total() if words else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, counts.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    for rank, w in enumerate(able[: 25 * len(able) // 100], 1):
        w[4] = rank
    got = target_sampling.importance_report(docs, bench).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(w[:5])) for w in want)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    told = con.execute(sql.ORACLES["op12_target_sampling"])
    names = [d[0] for d in told.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got))) == sorted(map(repr, told.fetchall()))


def test_pieces_lose_nothing(monkeypatch):
    rng = random.Random(2)
    con = target_sampling.counter()
    monkeypatch.setattr(target_sampling, "PIECE", 30)
    for text in ("a" * 200 + " b " + " " * 100 + "c", " ".join("ab"[rng.randrange(2)] * rng.randrange(1, 60) for _ in range(50)), "-" * 100, "é" * 31 + "-" * 40 + "A b"):
        total = np.zeros(target_sampling.BUCKETS, int)
        for goes_on, piece in target_sampling.pieces(text):
            _, bucket, n = target_sampling.counts_of(con, [0], [goes_on], [piece])
            total[bucket] += n
        assert {b: n for b, n in enumerate(total) if n} == dict(grams(text)[1])


def test_resampled_draws_what_is_like_the_target(spark):
    rng = random.Random(3)
    like, other = [["sun", "sea", "sand", "salt"], ["law", "tax", "duty", "fee"]]
    held = [" ".join(rng.choice(like if i < 100 else other) for _ in range(40)) for i in range(400)]
    docs = documents(spark, [*held, None, "", "short"]).withColumnRenamed("path", "number").withColumnRenamed("lang", "held")
    bench = spark.createDataFrame([(0, " ".join(rng.choice(like) for _ in range(400)))], "item_id long, text string")
    out = target_sampling.resampled(docs, bench)
    assert out.columns == docs.columns
    drawn = [r.doc_id for r in out.collect()]
    assert len(drawn) == len(set(drawn)) == 100
    assert sum(i < 100 for i in drawn) > 60
    assert target_sampling.resampled(docs.limit(0), bench).count() == 0
    assert target_sampling.importance_report(docs, bench.limit(0)).count() == 403
    assert target_sampling.importance_report(docs.where("n_chars < 10"), bench).where("rank is not null").count() == 0
