"""Terms of whole texts by plain loops, and how often they travel."""

import math
import re
from collections import Counter, defaultdict

from surveyloom.functions.text import STOP_WORDS
from surveyloom.operators import models

ROWS = [(1, "Red apple and red pear"), (2, None), (3, "pear tree in the green garden"), (3, "a second text of row three, pear tree"), (4, ""), (None, "pear of no key"), (5, "red apple")]


def _plain():
    tf = defaultdict(Counter)
    for k, t in ROWS:
        w = [x for x in re.findall(r"\w\w+", (t or "").lower()) if x not in STOP_WORDS]
        tf[k].update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    df = Counter(term for c in tf.values() for term in c)
    out = {}
    for k, c in tf.items():
        x = {term: n * (math.log((1 + len(ROWS)) / (1 + df[term])) + 1) for term, n in c.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        out |= {(k, term): v / length for term, v in x.items()}
    return out


def test_terms_equal_loops(spark, monkeypatch):
    monkeypatch.setattr(models, "TEXT_PART", 40)
    monkeypatch.setattr(models, "TERM_PART", 70)
    df = spark.createDataFrame(ROWS, "id bigint, text string")
    want = _plain()
    got = {(r.id, r.term): r.w for r in models.tfidf_terms(df, "id").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    only = spark.createDataFrame([("pear tree",), ("red",), ("red",)], "term string")
    few = {(r.id, r.term): r.w for r in models.tfidf_terms(df, "id", only=only).collect()}
    assert few.keys() == {k for k in want if k[1] in ("pear tree", "red")} and all(abs(few[k] - want[k]) < 1e-12 for k in few)


def test_terms_travel_once(spark):
    plan = models.tfidf_terms(spark.createDataFrame(ROWS, "id bigint, text string"), "id")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning\(", line)]
    # no exchange of (key, term) pairs: texts go by key, terms by term
    assert exchanges and not any(re.search(r"hashpartitioning\(id#\d+L?, term#", line) for line in exchanges)
