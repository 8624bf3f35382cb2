"""Lexical search against all scores, and its blocks against all cuts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from surveyloom.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_terms_equal_pattern():
    texts = ["Ab-c É\x00x\x7fy_z A1", None, "", "...", "日本 ÀB c", "a\tb\nc@D"]
    flat, of = ls.terms(pa.array(["cut", *texts, "cut"], pa.string()).slice(1, len(texts)))
    got = [[] for _ in texts]
    for w, i in zip(flat.to_pylist(), of.tolist()):
        got[i].append(w)
    assert got == [words(t) for t in texts]
    assert len(ls.terms(pa.array([], pa.string()))[0]) == 0


def test_blocks_have_least_error():
    r = random.Random(3)
    for _ in range(60):
        lists = [[r.randint(1, 30) for _ in range(r.randint(1, 9))] for _ in range(4)]
        longest, price = r.choice([2, 3, 9]), r.choice([0.2, 0.5, 1.5])
        got = ls.block_ends(np.array(sum(lists, [])), np.cumsum([0, *map(len, lists)]), longest, price)

        def cost(s, ends):
            fee = max(1, int(price * max(s)))
            return sum(max(s[a:b]) * (b - a) - sum(s[a:b]) + fee for a, b in zip([0, *ends], ends))

        for s, ends in zip(lists, got):
            cuts = [[*c, len(s)] for k in range(len(s)) for c in itertools.combinations(range(1, len(s)), k)]
            assert ends[-1] == len(s) and max(np.diff([0, *ends])) <= longest
            assert cost(s, ends) == min(cost(s, c) for c in cuts if max(np.diff([0, *c])) <= longest)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([0, 1, 5, 30, 200])))) for i in r.sample(range(10 * n), n)]
    docs += [(docs[5][0], docs[5][1]), (None, docs[6][1]), (None, None), (-3, docs[6][1].upper()), (-4, "")]
    docs += [(10**6 + i, docs[7][1]) for i in range(n // 3)]  # copies
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 4, 20])))) for i in range(25)] + [(0, "w1 w1 w2"), (None, "w3"), (90, None), (91, "--"), (92, "absent")]
    return docs, items


def test_search_equals_all_scores(spark):
    docs, items = corpus(500, 1)
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'a' as score", "1 as shard")
    queries = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'a' as rank")
    want = plain(docs, items)
    for parts, rule in ((1, ls.SearchRule()), (7, ls.SearchRule(docs=40, longest=4, price=0.5)), (3, ls.SearchRule(postings=100, pass_bytes=60))):
        got = sorted((tuple(r) for r in ls.ranked(rows.repartition(parts), queries, rule).collect()), key=str)
        assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ls.ranked(none, items).count() == 0
    assert ls.ranked(spark.createDataFrame([(1, "a b")], none.schema), items.limit(0)).count() == 0
    assert ls.ranked(spark.createDataFrame([(1, None), (2, "")], none.schema), items).count() == 0
