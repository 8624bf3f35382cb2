"""Operators for training text do the whole job: exact counts, whole texts, statistics over all items."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from surveyloom.llm import decontamination, language_id, personal_data

SYLLABLES = "ka lo mi ru te so pa ne di vu".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(4))


def test_contexts_are_counted_exactly(spark):
    """Three different contexts are three, whatever their hashes share."""
    rng = random.Random(1)
    texts = [f"{word(rng)} {word(rng)} zanzibar boss@firm.example {word(rng)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    slots = {}
    for r in personal_data.find_base(df).select("doc_id", F.expr("pmod(near[0].context, 64)").alias("slot")).collect():
        slots.setdefault(r.slot, []).append(r.doc_id)
    same = next(ids[:3] for ids in slots.values() if len(ids) >= 3)
    rows = [(i, texts[i]) for i in same] + [(1000 + i, f"some other text of day {i}") for i in range(40)]
    found = {r.doc_id: r.more for r in personal_data.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all([texts[i][m.start : m.end] for m in found[i]] == ["zanzibar"] for i in same)


def test_terms_far_from_the_mention(spark):
    """A name that stands in all documents of an address, but far from it, is removed wherever it stands there."""
    rng = random.Random(2)
    filler = lambda n: " ".join(word(rng) for _ in range(n))
    mail = [(i, f"boss@firm.example {filler(40)} zanzibar {filler(2)} zanzibar common") for i in range(4)]
    mixed = [(10 + i, f"{filler(3)} quetzal {filler(1)} head@firm.example {filler(3)}") for i in range(3)] + [(20 + i, f"quetzal {filler(40)} head@firm.example {filler(3)}") for i in range(3)]
    copies = [(30 + i, f"copy@firm.example {passage} yggdrasil") for i, passage in enumerate([filler(40)] * 4)]
    rows = mail + mixed + copies + [(100 + i, f"{filler(12)} common") for i in range(60)]
    text, found = dict(rows), {r.doc_id: r.more for r in personal_data.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    got = {i: [text[i][m.start : m.end] for m in more] for i, more in found.items() if more}
    assert got == {i: ["zanzibar"] * 2 for i, _ in mail} | {i: ["quetzal"] for i, _ in mixed}


def test_items_in_passes_have_one_set_of_statistics(spark):
    """Rows, scores included, do not depend on where the benchmark is cut into passes."""
    rng = random.Random(3)
    common, rare = [word(rng) for _ in range(12)], [word(rng) for _ in range(600)]
    item = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    items = [(i, item(rng.randint(8, 40)) + ". " + item(6) + ".") for i in range(25)]

    def damaged(text, share):
        return " ".join(rng.choice(common) if w not in common and rng.random() < share else w for w in text.split())

    rows = [(100 * k + i, item(rng.randint(0, 60)) + " " + damaged(t, k / 8) + " " + item(rng.randint(0, 60))) for i, t in items for k in range(6)]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda size: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontamination.find_leaks(df, bench, decontamination.LeakRule(pass_bytes=size)).collect())
    whole = found(16 << 20)
    assert whole and found(500) == whole and found(1) == whole


def test_clean_mixed_documents_stay(spark):
    """Documents of one to four languages in equal parts pass the pipeline's first stage; texts without letters do not."""
    rng = random.Random(4)
    letters = {"a": "bdgo", "b": "klmei", "c": "rstu", "d": "vwxyq"}
    said = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(6)) for _ in range(n))
    rows = [(i, said(lang, 60), lang) for i, lang in enumerate(["a", "b", "c", "d"] * 15)]
    mixed = [(100 + 10 * k + j, "\n".join(said(lang, 40) for lang in rng.sample("abcd", k)), None) for k in (1, 2, 3, 4) for j in range(8)]
    df = spark.createDataFrame(rows + mixed + [(900, "12345 !!", None)], "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.languages(spark, df, "").collect()}
    assert kept == {i for i, *_ in rows + mixed}
    spans = {r.id: len(r.spans) for r in language_id.identify(df, language_id.train(df)).collect()}
    assert all(spans[i] == (i - 100) // 10 for i, *_ in mixed)
