"""Terms around personal data: names that also stand in addresses, and texts of many addresses."""

import time

from surveyloom.llm import personal_data


def test_names_in_addresses_are_judged_alike(spark):
    for address in ("contact@example.com", "zorblatt@example.com"):
        fill = ["alpha beta gamma", "delta eta theta", "iota kappa lambda", "omega sigma tau"]
        rows = [(i, f"{fill[i % 4]} number{'x' * i} {'Zorblatt wrote' if i < 8 else 'someone wrote'} from {address} on {'y' * (i + 3)} {fill[(i + 1) % 4]}") for i in range(16)]
        rows += [(i, f"plain text {'z' * (i - 90)} of {fill[i % 4]}") for i in range(100, 140)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        clean = {r.doc_id: r.text for r in personal_data.sanitise(df).collect()}
        assert all("Zorblatt" not in clean[i] for i in range(8)), address


def test_terms_touch_no_span(spark):
    from pyspark.sql import functions as F

    texts = ["abc éabcd@x.com def", "x@y.zzz", "ééé@a.bb abc 1.2.3.4abc +1 234 567 890 xyz", "abc", "abcd@x.yy,efgh,ijk@l.mm nop" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("b", personal_data.base_spans(F.col("t")))
    import re

    for r in df.select("t", "b", personal_data.outside_terms(F.col("t"), F.col("b")).alias("w")).collect():
        want = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", r.t) if not any(b.start < m.end() and m.start() < b.end for b in r.b)]
        assert [tuple(w) for w in r.w] == want


def test_many_addresses_in_one_text(spark):
    text = " ".join(f"person{'abcdefghij'[i % 10]} lives here user{i}@mail{i % 7}.example.org today" for i in range(2000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    personal_data.find_base(df.limit(1)).collect()
    began = time.time()
    row = personal_data.find_base(df).where("doc_id = 1").first()
    assert len(row.near) == 2000 and time.time() - began < 15
    assert all(1 <= len(m.terms) <= 20 for m in row.near) and len(row.words) == 8000
