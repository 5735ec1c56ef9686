import corpus_pipeline
from conftest_llm import documents, prose


def test_stages(spark, rng, tmp_path):
    bench = [(i, prose(rng, 30)) for i in range(3)]
    base = prose(rng, 200).replace("\n", " ")  # one line, so that its near copy is left to the stage of near copies
    texts = [None, "123", base, base + " tail"] + [prose(rng, 80) for _ in range(20)] + [bench[0][1]]
    docs = documents(spark, texts).drop("score", "path", "rank")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == [2, *range(4, 24)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "mix"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_repeated_rows_and_clashing_names(spark, rng, tmp_path):
    text, item = prose(rng, 60), prose(rng, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [text, text, text + " more", None, item, prose(rng, 70)], [1, 1, None, 2, 3, 1])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept[name] = sorted((str(r.doc_id), len(r.text or "")) for r in out.collect())
    everything = sorted((str(r.doc_id), len(r.text or "")) for r in docs.collect())
    assert kept["language"] == [x for x in everything if x[1]]
    assert len(kept["near"]) == len(everything) - 1  # of the equal rows one
    assert kept["benchmark"] == [x for x in everything if x != ("3", len(item))]
    assert corpus_pipeline.mix(spark, docs, str(tmp_path)).count() == len(everything)
