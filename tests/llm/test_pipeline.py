"""The pipeline against a plain version on planted cases."""

import random

import corpus_pipeline
from surveyloom.llm import near_dup


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = {"en": ["the", "thing", "with", "hand", "other", "night"] + [f"ing{i}th" for i in range(80)], "es": ["ción", "mente", "esta", "ñaro"] + [f"azo{i}ción" for i in range(80)]}
    make = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [(i, make("en", 30) + ". " + make("en", 10) + ".") for i in range(6)]
    rows = [(i, make(lang, 60), lang) for i, lang in enumerate(["en", "es"] * 20)]
    rows += [(100 + i, rows[i][1], "en") for i in range(5)]  # copies
    rows += [(200, rows[7][1] + " tail", "en"), (300, make("en", 20) + " " + items[2][1] + " " + make("en", 20), "en")]  # near copy, leak
    rows += [(400, make("es", 20) + " me@mail.example.com " + make("es", 20), "es"), (500, None, None), (501, "12345 !!", None)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    want = {i for i, *_ in rows if i < 100} | {400}
    assert 100 * len(near_dup.shingle_set(rows[7][1].encode(), 5)) >= 80 * len(near_dup.shingle_set((rows[7][1] + " tail").encode(), 5))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert set(text) == want and "[EMAIL]" in text[400] and "@" not in text[400]
    got = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in got.collect()} == want and got.columns == ["doc_id", "n_tokens", "ids"]
