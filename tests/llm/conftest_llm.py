WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "se", "lan", "dor") for b in ("ra", "ne", "vi", "so", "pu", "gal")]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, path string, `rank` int"


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append(w + (rng.choice([".", ".\n", "", "", "", "!"]) if i % 3 == 2 else ""))
    return " ".join(out)


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)
