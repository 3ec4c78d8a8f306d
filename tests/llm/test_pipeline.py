"""The corpus pipeline, stage by stage, on a small corpus whose answers are known."""

import random


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    parts = {"en": ["th", "ing", "er", "wh", "ou"], "de": ["sch", "ein", "ung", "ich", "ver"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    texts = [(lang, " ".join(word(lang) for _ in range(80))) for lang in ("en", "de") * 30]
    rows = [(k, t, lang, "s", len(t)) for k, (lang, t) in enumerate(texts)]
    copy = texts[3][1].split()
    copy[10] = "changed"
    rows += [(100, texts[3][1], "de", "s", 1), (101, " ".join(copy), "de", "s", 1), (102, "12 34", None, "s", 5), (103, None, None, "s", 0)]
    rows += [(104, texts[5][1][:-40] + " other words here mail me at someone@mail.example.com " + " ".join(word("de") for _ in range(60)), "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r["doc_id"] for r in found} for name, found in kept.items()}
    assert ids["language"] == set(range(60)) | {100, 101, 104}
    assert ids["near_dedup"] == set(range(60)) | {104} and ids["pii"] == ids["packing"] == ids["near_dedup"]
    text = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert "<EMAIL>" in text[104] and "@" not in text[104] and all(text[k] == texts[k][1] for k in range(60))
    want = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in kept["packing"])
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect()) == want
