"""The ten operators against brute force, and on edge cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from surveyloom.llm import decontamination, fingerprints, language_id, near_dup, personal_data, pieces, sharding, substring_dedup, suffix_dedup, superkmers, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words(rng, n, vocabulary=60):
    return " ".join(rng.choice(VOCABULARY[:vocabulary]) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice("abcdefgéñ中") for _ in range(1 + i % 7)) for i in range(400)]


def corpus():
    """Copies, shared passages, edge texts, equal ids, null ids and repeated rows."""
    rng = random.Random(5)
    passage, line = words(rng, 40, 400), words(rng, 20, 400)
    rows = [(i, words(rng, rng.randint(1, 120), 400)) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(12)] + [(60 + i, words(rng, 10, 400) + "\n" + passage + "  " + words(rng, 15, 400)) for i in range(12)]
    rows += [(80 + i, line + " " + words(rng, 5)) for i in range(8)] + [(90, None), (91, ""), (92, " \t\n"), (93, "one"), (94, "x" * 5000), (95, words(rng, 4000, 400))]
    rows += [(96, rows[3][1]), (96, rows[4][1]), (97, rows[3][1]), (97, rows[3][1]), (None, passage), (None, None)]
    base = rows[20][1].split()
    rows += [(100 + i, " ".join(base[:i] + ["edited"] + base[i + 1 :]).title()) for i in range(6)]
    return [(i, t, None, "s", 0) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("text_", F.lit(1)).withColumn("id", F.lit("clash")).withColumn("k", F.lit(2)).repartition(3)


def empty(docs):
    return docs.limit(0)


def removed(rows, items_of, size, join):
    """Brute force of both substring operators: items of each row, and those that a smaller id's window covers."""
    first = {}
    for i, t, *_ in rows:
        items = items_of(t)
        for a in range(len(items) - size + 1) if i is not None else ():
            w = tuple(items[a : a + size])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        items = items_of(t)
        gone = [False] * len(items)
        for a in range(len(items) - size + 1) if i is not None else ():
            if first[tuple(items[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        kept = join([x for x, g in zip(items, gone, strict=True) if not g])
        out.append((i, len(items), sum(gone), sum(g and (a == 0 or not gone[a - 1]) for a, g in enumerate(gone)), sha(kept)))
    return out


ordered = lambda rows: sorted(rows, key=str)



def test_substring_dedup(spark, docs):
    rows, df = docs
    want = [(a, b, c, e) for a, b, c, _, e in removed(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), 13, " ".join)]
    assert ordered(map(tuple, substring_dedup.dedup_windows(df).collect())) == ordered(want)
    assert substring_dedup.dedup_windows(empty(df)).count() == 0


def test_suffix_dedup(spark, docs):
    rows, df = docs
    want = removed(rows, lambda t: list((t or "").encode()), 50, bytes)
    assert ordered(map(tuple, suffix_dedup.dedup_bytes(df).collect())) == ordered(want)
    assert suffix_dedup.dedup_bytes(empty(df)).count() == 0


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_large_buckets_take_turns(monkeypatch, module):
    """Parts of a bucket, and windows dealt by hash, give the same ranges as one part."""
    import numpy as np

    rows = [(i, t) for i, t, *_ in corpus() if i is not None and t]
    rows.sort(key=lambda r: r[0])
    ids, data = np.array([i for i, _ in rows], np.int64), np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in rows])])
    doc, start, windows, low, high, _, extra, block = module.runs_of_block(ids, data, offsets)
    columns = [superkmers.steps_of(ids[doc]), np.zeros(len(doc), np.int32), start.astype(np.int32), windows.astype(np.uint8), extra.astype(np.uint8), (high - low).astype(np.int32)]
    blob = superkmers.Packed.dump(columns, superkmers.gather(block, low, high - low))

    def covered():
        return {(int(i), x) for found in module.copies_of_bucket([blob]) for i, _, a, b in zip(*found, strict=True) for x in range(a, b)}

    whole = covered()
    assert whole
    for size, kept in ((2000, 1 << 20), (40, 0)):
        monkeypatch.setattr(superkmers, "TURN_BYTES", size)
        monkeypatch.setattr(superkmers, "KEPT_BYTES", kept)
        assert covered() == whole


def test_runs_of_a_frequent_minimiser_are_cut_without_growing(monkeypatch):
    """All runs in one slot: each part has few bytes, each window is in one part, and the ranges are those of one part."""
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 101, 300, np.uint8) for _ in range(150)]
    texts = [np.concatenate([t, texts[i - 3][40:200], t[:9]]) for i, t in enumerate(texts)]
    ids, data, offsets = np.arange(150), np.concatenate(texts), np.arange(151) * len(texts[0])
    doc, start, windows, low, high, _, extra, block = suffix_dedup.runs_of_block(ids, data, offsets)
    columns = [superkmers.steps_of(ids[doc]), np.zeros(len(doc), np.int32), start.astype(np.int32), windows.astype(np.uint8), extra.astype(np.uint8), (high - low).astype(np.int32)]
    blob = superkmers.Packed.dump(columns, superkmers.gather(block, low, high - low))
    seen, plain = [], suffix_dedup._copies

    def copies(ids, keys, start, windows, lengths, data, window):
        seen.append((len(data), sum((list(zip((ids[i] + 0 * np.arange(n)).tolist(), (start[i] + np.arange(n)).tolist())) for i, n in enumerate(windows.astype(int))), [])))
        return plain(ids, keys, start, windows, lengths, data, window)

    def covered():
        seen.clear()
        return {(int(i), x) for found in suffix_dedup.copies_of_bucket([blob]) for i, _, a, b in zip(*found, strict=True) for x in range(a, b)}

    monkeypatch.setattr(suffix_dedup, "_copies", copies)
    monkeypatch.setattr(suffix_dedup, "_slot_of", lambda c, d, low: np.zeros(len(low), np.int64))
    whole = covered()
    assert whole and len(seen) == 1
    every = sorted(seen[0][1])
    for kept in (1 << 20, 0):
        monkeypatch.setattr(superkmers, "TURN_BYTES", 4000)
        monkeypatch.setattr(superkmers, "KEPT_BYTES", kept)
        assert covered() == whole
        assert sorted(sum((w for _, w in seen), [])) == every
        assert max(n for n, _ in seen) <= 4 * 4000


def test_longest_previous():
    """Factors against brute force, in any order of the documents; smaller neighbours against a scan."""
    import numpy as np

    rng = random.Random(1)
    for n in (60, 300, 900):
        text = bytes(rng.choice(b"ab") for _ in range(20)) * (n // 20) + bytes(rng.choice(b"ab") for _ in range(n))
        for owners in (sorted, lambda x: rng.sample(x, len(x))):
            at = np.arange(len(text) - 40)
            owner = np.array(owners([rng.randint(0, 5) for _ in at]), np.int32)
            least = {}
            for p, o in zip(at, owner, strict=True):
                least[text[p : p + 40]] = min(least.get(text[p : p + 40], 9), o)
            want = [40 * (least[text[p : p + 40]] < o) for p, o in zip(at, owner, strict=True)]
            assert suffix_dedup.longest_previous(np.frombuffer(text, np.uint8), at, owner, 40).tolist() == want
    value, first = np.array([3, 1, 1, 2, 0, 5, 5, 4, 4, 6]), np.array([1, 0, 0, 0, 0, 1, 0, 0, 0, 0], bool)
    assert suffix_dedup.previous_smaller(value, first).tolist() == [-1, -1, -1, 2, -1, -1, -1, -1, -1, 8]
    assert suffix_dedup.next_smaller(value, first).tolist() == [1, 4, 4, 4, 10, 7, 7, 10, 10, 10]


@pytest.mark.parametrize("rule", [near_dup.CONTRACT, near_dup.NearDup()])
def test_near_dup(spark, docs, rule):
    rows, df = docs
    sets = [(i, near_dup.shingle_set((t or "").encode(), rule.shingle)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = [(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets]
    assert ordered(map(tuple, near_dup.near_duplicates(df, rule).collect())) == ordered(want)
    assert near_dup.near_duplicates(empty(df), rule).count() == 0


def test_near_dup_group(spark):
    """A large group of near copies, more than a small key holds and than a block: one component, as by brute force."""
    rng = random.Random(3)
    base = words(rng, 120, 400).split()
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.sample(range(120), rng.randint(0, 6)):
            w[p] = f"new{i}"
        rows.append((i, " ".join(w)))
    sets = {i: near_dup.shingle_set(t.encode(), 3) for i, t in rows}
    group = {i: i for i in sets}
    for _ in range(60):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    got = {r.doc_id: r.root for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), near_dup.CONTRACT).collect()}
    assert got == group


def test_near_dup_texts_of_one_id(spark):
    """An id with several texts is one document with the links of all of them, in any order of the rows."""
    rng = random.Random(12)
    one, two = words(rng, 120, 400), words(rng, 120, 400)
    edited = two.split()
    for p in (10, 60, 110):
        edited[p] = "edited"
    rows = [(5, one), (5, two), (9, " ".join(edited)), (12, one + " tail"), (13, words(rng, 80, 400)), (7, two)]
    for turn in range(3):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string").repartition(turn + 1)
        got = {(r.doc_id, r.root, r.kept) for r in near_dup.near_duplicates(df, near_dup.CONTRACT).collect()}
        assert got == {(5, 5, True), (9, 5, False), (12, 5, False), (7, 5, False), (13, 13, True)}


def test_small_keys_over_batches():
    """Pairs of small keys equal brute force however the rows are cut into batches."""
    import numpy as np
    import pyarrow as pa

    rule, rng = near_dup.CONTRACT, np.random.default_rng(3)
    base = rng.integers(0, 256, (20, rule.k), dtype=np.uint8)
    sigs = np.repeat(base, 5, axis=0)
    for row in sigs:
        row[rng.choice(rule.k, rng.integers(0, 14), replace=False)] ^= 1
    keys = near_dup.index_keys(sigs, rule).view(np.int64)
    rows = sorted((int(k), s, i) for i, row in enumerate(keys) for s, k in enumerate(row))
    counts = {}
    for k, _, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    rows = [r for r in rows if counts[r[0]] > 1]
    comp = rng.integers(0, 60, len(sigs))
    want = {(i, j) for i in range(len(sigs)) for j in range(i) if comp[i] != comp[j] and (sigs[i] != sigs[j]).sum() <= rule.distance}
    for size in (1, 7, 1000000):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part]), pa.array([int(comp[r[2]]) for r in part]), pa.array([sigs[r[2]].tobytes() for r in part], pa.binary())], names=["key", "slot", "id", "comp", "sig"])
            for part in (rows[i : i + size] for i in range(0, len(rows), size))
        ]
        got = [(b, a) for out in near_dup._small_keys(iter(batches), rule) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_signature_distance_is_guaranteed():
    """Every pair of signatures within the distance shares a key, and the first shared one is found."""
    import numpy as np

    rule, rng = near_dup.CONTRACT, np.random.default_rng(0)
    a = rng.integers(0, 256, (200, rule.k), dtype=np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(rule.k, rule.distance, replace=False)
        row[at] ^= rng.integers(1, 256, rule.distance, dtype=np.uint8)
    ka, kb = near_dup.index_keys(a, rule), near_dup.index_keys(b, rule)
    for i in range(len(a)):
        shared = np.flatnonzero(ka[i] == kb[i])
        assert len(shared) and near_dup.first_slots((a != b)[i : i + 1], rule)[0] == shared[0]


def test_fingerprints(spark, docs):
    rows, df = docs
    assert fingerprints.with_fingerprint(empty(df)).count() == 0
    got = fingerprints.with_fingerprint(df.select("doc_id", "text")).collect()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.chosen) == r.chosen and len(r.positions) == len(r.chosen)
        n = max(len(re.findall(fingerprints.TOKEN.replace("\\x{20000}-\\x{3FFFF}", "\U00020000-\U0003ffff"), r.text or "")) - fingerprints.K + 1, 1)
        # every window of grams holds a chosen one
        if r.positions:
            marks = [-1, *r.positions, n]
            assert max(b - a for a, b in zip(marks, marks[1:], strict=False)) <= fingerprints.WINDOW and r.positions == sorted(r.positions)
    assert by_text[""] == []


def test_fingerprint_next_and_edit(spark, tmp_path):
    rows = [(5, "a b c d e f g h"), (1, "x y z w v u t s"), (9, None), (7, "q")]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(t[: len(t) - h] + nxt[:h])
    assert got[9].near_edited == 1.0 and got[9].near_next == 0.0 and got[9].fingerprint == ""


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_personal_data_spans(spark):
    rng = random.Random(2)
    pieces_ = ["a@b.c", "a@b.c_d@e.f", "x.y@z", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "010.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 123-4567", "+123", "é中😀", " ", "\n", "word", "@", "+", "..", "-", "12"]
    texts = ["".join(rng.choice(pieces_) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "1" * 3000, "a" * 3000 + "@b.cc" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in df.select("text", personal_data.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect():
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "") if valid(k, m[0])]
        assert [(x.kind, x.start, x.end) for x in r.s] == want, r.text


def test_disclosing_terms(spark):
    """A name that only one entity's mentions have is removed there; common words and other documents stay."""
    rows = [(i, f"{w} and the mail of zanzibar is boss@firm.example or {v} later") for i, (w, v) in enumerate(zip("abcdef", "uvwxyz", strict=True))]
    rows += [(10 + i, f"the mail and the note of day {i} or later") for i in range(60)] + [(90, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in personal_data.find_spans(df).collect()}
    text = dict(rows)[0]
    assert [(m.action, text[m.start : m.end]) for m in found[0].more] == [("removed", "zanzibar")] and found[10].more == []
    clean = {r.doc_id: r.text for r in personal_data.sanitise(df).collect()}
    assert clean[0] == text.replace("zanzibar", "").replace("boss@firm.example", "[EMAIL]") and clean[10] == dict(rows)[10] and clean[90] is None
    assert personal_data.find_spans(df.limit(0)).count() == 0


def test_pieces_equal_library(spark):
    import sentencepiece

    data = open(pieces.default_model(), "rb").read()
    model, library = pieces.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(1)
    texts = ["", " ", "  a", "▁x", "\0", "�", "😀 中文 é", "a" * 500, "\n\t x"] + ["".join(rng.choice("ab  \t\n▁éñ中文😀aaeeething.,-12") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == library.decode(ids)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab c"), (3, "ab c")], "doc_id bigint, text string")
    got = pieces.piece_digests(df).collect()
    assert ordered((r.doc_id, r.n_tokens) for r in got) == ordered([(1, 0), (2, 0)] + [(3, len(library.encode("ab c")))] * 2)
    assert pieces.with_pieces(df.limit(0)).count() == 0
    clash = pieces.with_pieces(df.selectExpr("*", "'kept' as IDS"))
    assert clash.columns[-2:] == ["IDS", "ids_"] and {r.IDS for r in clash.collect()} == {"kept"}


def test_language_id(spark):
    rng = random.Random(4)
    make = {"aa": lambda: " ".join(rng.choice(["tha", "thing", "with", "hand"]) for _ in range(30)), "bb": lambda: " ".join(rng.choice(["ción", "mente", "esta", "ñaro"]) for _ in range(30)), "ru": lambda: "привет как дела " * 8}
    rows = [(i, make[lang](), lang) for i, lang in enumerate(["aa", "bb", "ru"] * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df)
    ask = spark.createDataFrame([(1, make["aa"]()), (2, make["bb"]() + " " + make["aa"]() + " " + make["aa"]()), (3, None), (4, "123 !!"), (5, "привет"), (6, ""), (7, "漢字")], "doc_id bigint, text string")
    got = {r.id: r for r in language_id.identify(ask, model).collect()}
    assert got[1].lang_pred == "aa" and got[5].lang_pred == "ru" and all(got[i].lang_pred == "und" for i in (3, 4, 6)) and got[7].lang_pred in make
    assert [(s.start, s.end, s.lang) for s in got[2].spans] == [(0, 30, "bb"), (30, 90, "aa")] and got[2].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.train(df.limit(0)) is None and language_id.identify(ask, None).first().lang_pred == "und"


def test_languages_without_spaces(spark):
    """Text without spaces is cut where its script changes and into short words, so that spans can end inside it."""
    rng = random.Random(6)
    han = lambda: "".join(rng.choice("漢字語言文學生活時間") for _ in range(40))
    latin = lambda: " ".join(rng.choice(["tha", "thing", "with", "hand"]) for _ in range(30))
    df = spark.createDataFrame([(i, han() if i % 2 else latin(), "zz" if i % 2 else "aa") for i in range(40)], "doc_id bigint, text string, lang string")
    model = language_id.train(df)
    mixed = han() + "thing" + "with" * 12 + " " + latin()
    got = {r.id: r for r in language_id.identify(spark.createDataFrame([(1, mixed), (2, han())], "doc_id bigint, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["zz", "aa"] and [(s.start, s.end) for s in got[1].spans][0] == (0, 10)
    assert got[2].lang_pred == "zz" and [s.lang for s in got[2].spans] == ["zz"]


def test_best_path_equals_all_paths():
    """The walk over words finds a labelling that no other beats."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(150):
        s = rng.normal(0, 3, (rng.integers(1, 7), 3))
        worth = lambda p: sum(s[t, x] for t, x in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert worth(tuple(language_id.best_path(s, 2.5))) == pytest.approx(max(worth(p) for p in product(range(3), repeat=len(s))))


def test_viterbi_shortcut():
    """Where the shortcut keeps one language, the full walk gives the same."""
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(0, 3, (rng.integers(1, 30), 3))
        best = int(s.sum(0).argmax())
        gain = max(0.0, *[max((np.cumsum(s[a:, j] - s[a:, best]).max() for a in range(len(s))), default=0) for j in range(3)])
        if gain <= 12:
            assert set(language_id.best_path(s, 24.0)) == {best}


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "p" * 150 if i % 3 == 0 else f"page {i} " * (i % 40)) for i in range(80)] + [(5, "http://again", "q" * 200), (5, "http://again", "q" * 200), (81, None, None), (None, "u", "z" * 120), (82, "u", "z" * 120)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(0))
    rule = warc.Archive(roll_bytes=2000)
    files = warc.write_archives(df.repartition(3), f"file://{tmp_path}/a", rule)
    again = warc.write_archives(df.repartition(5), f"file://{tmp_path}/b", rule)
    assert files == again and len(files) > 3 and all(f["bytes"] < 6000 for f in files) and not (tmp_path / "a/_temporary").exists()
    got = ordered((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect())
    least, want, seen = {}, [], set()
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    for i, _, h in rows:
        h = h or ""
        revisit = i is not None and len(h) >= 100 and (least[h] != i or (i, h) in seen)
        seen.add((i, h))
        want.append((i, len(h), sha(h), "revisit" if revisit else "response", least[h] if revisit else None))
    assert got == ordered(want)
    assert warc.write_archives(df.limit(0), f"file://{tmp_path}/c") == [] and warc.read_archives(spark, f"file://{tmp_path}/c").count() == 0


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    held = sharding.fill(names, 1009).tolist()
    counts = [held.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill(names[:-1], 1009).tolist()
    assert sum(a != b for a, b in zip(held, fewer, strict=True)) < 2 * 1009 * 2 / 7  # a lost shard moves few other slots
    df = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint").withColumn("x", F.lit(1))
    got = sharding.place(df, "doc_id", names, 1009).collect()
    assert len(got) == 3 and all(r.shard == names[held[r.slot]] for r in got)
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)
    clash = sharding.place(df.withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(-1)), "doc_id", names, 1009)
    assert clash.columns.count("shard") == 1 and {(r.doc_id, r.slot, r.shard) for r in clash.collect()} == {(r.doc_id, r.slot, r.shard) for r in got}
    assert sharding.place(df.limit(0), "doc_id", names, 1009).count() == 0


def test_sharding_equals_plain_filling():
    """Shards take turns: each claims the first free slot of its own permutation of all slots."""
    names, slots = [f"s{i}" for i in range(5)], 53
    held = sharding.fill(names, slots).tolist()
    number = lambda text: int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    starts, steps = [number(f"start:{n}") % slots for n in names], [number(f"step:{n}") % (slots - 1) + 1 for n in names]
    order = [iter([(a + j * b) % slots for j in range(slots)]) for a, b in zip(starts, steps, strict=True)]
    want = [None] * slots
    turn = 0
    while None in want:
        want[next(p for p in order[turn % 5] if want[p] is None)] = turn % 5
        turn += 1
    assert held == want


def test_clashing_columns(spark):
    """Columns of the names that an operator uses inside come back unchanged."""
    rows = [(1, "write to a@b.cc now", "mine"), (2, None, "mine")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _key string").withColumn("_s", F.lit(7)).withColumn("_T", F.lit(8))
    got = personal_data.sanitise(df)
    assert got.columns == df.columns and ordered(map(tuple, got.collect())) == [(1, "write to [EMAIL] now", "mine", 7, 8), (2, None, "mine", 7, 8)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").withColumn("_b", F.lit(5)).withColumn("_g", F.lit(6)).withColumn("_at", F.lit(4))
    assert ordered(map(tuple, fingerprints.with_next(df).collect())) == [(1, "a", 5, 6, 4, "b"), (2, "b", 5, 6, 4, "a")]
    assert fingerprints.with_next(df.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, words(rng, 25, 400) + ". " + words(rng, 8, 400) + ".") for i in range(30)] + [(30, None), (31, ""), (32, "short item")]
    docs_ = [(i, words(rng, rng.randint(0, 300), 400)) for i in range(60)]
    docs_ += [(100 + i, words(rng, 70, 400) + "\n" + items[i][1].upper().replace(".", " ;") + " " + words(rng, 50, 400)) for i in range(30)] + [(200, None), (201, "")]
    df, bench = spark.createDataFrame(docs_, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(30)}
    passes = decontamination.LeakRule(pass_bytes=500)
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench, passes).collect()} == got
    assert {r.doc_id for r in decontamination.without_leaks(df, bench, passes).collect()} == {i for i, _ in docs_} - {i for i, _ in got}
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0 and decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_wand_equals_all_scores():
    rng = random.Random(9)
    items = [(i, words(rng, rng.randint(3, 20), 40)) for i in range(60)]
    groups = decontamination.ItemIndex(items, decontamination.LeakRule(threshold=0.6)).groups
    assert [g.width for g in groups] == [16, 32]
    for turn in range(200):
        index = groups[turn % 2]
        terms = sorted(set(rng.choices(range(len(index.terms)), k=rng.randint(1, 30))))
        scores = {}
        for t in terms:
            for j, w in zip(index.postings[t], index.weights[t], strict=True):
                scores[j] = scores.get(j, 0) + w
        want = {j: s for j, s in scores.items() if s >= 0.6 - 1e-9}
        assert {j: pytest.approx(s) for j, s in index.search(terms)} == want
