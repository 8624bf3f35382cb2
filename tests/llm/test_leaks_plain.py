"""The decontamination query against scores of every item for every passage, by loops."""

import math
import random
import re

from surveyloom.llm import decontamination, queries


def words_of(text):
    return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", t.lower()) for t in (text or "").split()) if w]


def plain(docs, items):
    """(doc, item): best score of a verified passage, by definition."""
    rule = decontamination.LeakRule()
    known = [(i, t, words_of(t)) for i, t in items if words_of(t)]
    n, mean = len(known), sum(len(w) for *_, w in known) / max(1, len(known))
    df = {}
    for *_, w in known:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for item, text, w in known:
        k = rule.k1 * (1 - rule.b + rule.b * len(w) / mean)
        weight = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * (rule.k1 + 1) / (w.count(t) + k) for t in set(w)}
        width = max(16, 2 ** math.ceil(math.log2(len(w))))
        sentences = [x for x in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text)) if x]
        question, answer = (sum(sentences[:-1], []), sentences[-1]) if len(sentences) > 1 else (w[: len(w) // 2], w[len(w) // 2 :])

        def overlap(part, passage):
            k = min(rule.run, len(part))
            grams = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)} if k else set()
            return len([g for g in grams if g in {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}]) / len(grams) if grams else 1.0

        for doc, t in docs:
            tokens = (t or "").split()
            for start in range(0, len(tokens), width):
                passage = words_of(" ".join(tokens[start : start + 2 * width]))
                score = sum(x for u, x in weight.items() if u in passage) / sum(weight.values())
                if score >= rule.threshold - 1e-9 and overlap(question, passage) >= rule.overlap and overlap(answer, passage) >= rule.overlap:
                    out[doc, item] = max(out.get((doc, item), 0.0), min(1.0, score))
    return out


def made(seed=4):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.randint(5, 60)) + ". " + say(r.randint(3, 9)) + "!") for i in range(25)] + [(25, say(7)), (26, None), (27, "--")]
    docs = []
    for k in range(120):
        kept = " ".join(w for w in items[k % 26][1].split() if r.random() < r.choice([1, 0.95, 0.7]))
        docs.append((k, say(r.randint(0, 150)) + " " + kept + " " + say(r.randint(0, 150))))
    return docs + [(900, None), (901, ""), (None, docs[0][1])], items


def test_query_equals_loops(spark, tmp_path):
    docs, items = made()
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in queries.QUERIES["op9_decontamination"](spark, str(tmp_path)).collect()}
    want = plain(docs, items)
    assert len(want) > 40 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_long_item_changes_nothing_for_the_others(spark):
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(i, say(20) + ". " + say(8) + ".") for i in range(40)]
    docs = [(i, (t.split(". ")[0] + ". " + say(300) + " " + t.split(". ")[1])) for i, t in items] + [(100 + i, say(20) + " " + t + " " + say(9)) for i, t in items[:5]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = lambda some: {(x.doc_id, x.item_id) for x in decontamination.find_leaks(df, spark.createDataFrame(some, "item_id bigint, text string")).collect()}
    assert found(items) == found([*items, (99, say(2050))]) == {(100 + i, i) for i in range(5)}
