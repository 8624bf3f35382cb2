"""Queries of the operators against plain Python over the same rows, and the stages of the pipeline on edge cases."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
import regex
import xxhash

import corpus_pipeline
from surveyloom.llm import decontamination, fingerprints, language_id, near_dup, personal_data, queries, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "ka lo mi ru te so pa ne di vu".split()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def word(rng, n=3):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def written(spark, path, rows):
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def hashed(values, seed=42):
    """Spark's xxhash64 of strings and longs, unsigned."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed=seed)
    return seed


ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
TOKEN = regex.compile(f"[\x21-\x7e¡-ɏ]{{1,24}}|[{ALONE}]|[^ \t\n\x0b\f\r\x21-\x7e¡-ɏ{ALONE}]{{1,24}}")


def winnowed(text):
    """(position, hash) of the chosen grams: the least hash of every four grams of three tokens, the rightmost on ties."""
    ids = [hashed([t]) for t in TOKEN.findall(text)]
    grams = [hashed(ids[i : i + 3]) >> 32 for i in range(max(len(ids) - 2, min(len(ids), 1)))]
    out = []
    for a in range(max(len(grams) - 3, min(len(grams), 1))):
        part = grams[a : a + 4]
        at = a + max(i for i, h in enumerate(part) if h == min(part))
        if at not in [p for p, _ in out]:
            out.append((at, grams[at]))
    return out


def test_fingerprint_query(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(word(rng, 2) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "one", "a b", "a b c d", "漢字漢字漢字 x é", "same " * 50, "x" * 3000]
    texts += [texts[3], texts[3]]
    rows = [(7 * i + 3, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in queries.QUERIES["op2_fingerprints"](spark, written(spark, tmp_path, rows)).collect()}
    likeness = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        mine, other, following = winnowed(t), winnowed(edited), winnowed(after)
        shown = lambda f: ",".join(f"{p}:{h:08x}" for p, h in f)
        hashes = [{h for _, h in f} for f in (mine, other, following)]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(edited))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(mine), shown(other)), t
        assert (got[i].near_edited, got[i].near_next) == (likeness(hashes[0], hashes[1]), likeness(hashes[0], hashes[2]))
    one = tmp_path / "one"
    assert queries.QUERIES["op2_fingerprints"](spark, written(spark, one, [(5, "a b c d", None)])).first().near_next == 1.0
    assert queries.QUERIES["op2_fingerprints"](spark, written(spark, tmp_path / "none", [])).count() == 0


def test_language_query_learns_from_its_part_only(spark, tmp_path):
    rng = random.Random(2)
    make = {"a": lambda: " ".join(rng.choice(["tha", "thing", "with"]) for _ in range(20)), "b": lambda: " ".join(rng.choice(["ción", "mente", "esta"]) for _ in range(20))}
    rows = [(i, make[lang](), lang) for i, lang in enumerate(["a", "b"] * 60)] + [(500, None, None), (501, "12 34", "a"), (502, "漢字", None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    other = [(i, t, "c" if held(i) else lang) for i, t, lang in rows]  # labels of the held-out rows must not matter
    ask = lambda path, r: {x.doc_id: (x.held_out, x.lang_pred, x.score) for x in queries.QUERIES["op1_language_id"](spark, written(spark, path, r)).collect()}
    got = ask(tmp_path / "x", rows)
    assert got == ask(tmp_path / "y", other) and {i: x[0] for i, x in got.items()} == {i: held(i) for i, *_ in rows}
    assert all(got[i][1] == lang for i, t, lang in rows if i < 500) and got[500][1] == got[501][1] == "und" and all(0 <= x[2] <= 1 for x in got.values())
    model = language_id.train(spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id bigint, text string, lang string"))
    plain = language_id.label(pa.array([t for _, t, _ in rows]), model)
    assert {i: got[i][1] for i, *_ in rows} == {r[0]: x[0] for r, x in zip(rows, plain, strict=True)}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "card":
            twice = [sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))]
            return 16 <= len(d) <= 19 and sum(twice) % 10 == 0
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "phone" and 8 <= len(d) <= 15)

    return [(k, m.start(), m.end(), m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def disclosed(rows, rule):
    """Added spans of each document by the definition of disclosure."""
    found, pairs, df_e, df_t, contexts_of = {}, {}, {}, {}, {}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for i, t in rows:
        spans = base(t)
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < b for _, a, b, _ in spans)]
        for term in {w for w, *_ in words}:
            df_t[term] = df_t.get(term, 0) + 1
        words = words if spans else []
        near, least = {}, {}
        for kind, a, b, value in spans:
            entity = kind + ":" + (re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())
            low, high = max(a - 100, 0), min(b + 100, len(t))
            context = signed(hashed([re.sub(r"[\W\d_]+", " ", t[low:high])]))
            least[entity] = min(least.get(entity, context), context)
            contexts_of.setdefault(entity, set()).add(context)
            for term, x, y in words:
                if (x > low or low == 0) and (y < high or high == len(t)) and low <= x and y <= high:
                    near.setdefault((entity, term), set()).add(context)
        for entity in least:
            df_e[entity] = df_e.get(entity, 0) + 1
            for term in {w for w, *_ in words}:
                j, held = pairs.setdefault((entity, term), [0, set()])
                pairs[entity, term][0] = j + 1
                held |= near.get((entity, term), {least[entity]})
        found[i] = (words, set(least))
    n, risky = len(rows), {}
    for (entity, term), (j, held) in pairs.items():
        if len(contexts_of[entity]) >= rule.support and len(held) >= rule.support and df_e[entity] < n:
            d = math.log(n * j / (df_t[term] * df_e[entity])) / math.log(n / df_e[entity])
            if d >= rule.generalise:
                risky[entity, term] = "removed" if d >= rule.remove else "generalised"
    out = {}
    for i, (words, entities) in found.items():
        spans = {}
        for term, x, y in words:
            for entity in entities:
                if (entity, term) in risky:
                    spans[x, y] = max(spans.get((x, y), ""), risky[entity, term])
        out[i] = sorted((x, y, a) for (x, y), a in spans.items())
    return out


def test_personal_data_query(spark, tmp_path):
    rng = random.Random(3)
    common = [word(rng) for _ in range(30)]
    rows = []
    for i in range(260):
        words = [rng.choice(common) for _ in range(rng.randint(0, 50))]
        if i % 3 == 0:
            name = i // 3 % 7
            words.insert(rng.randint(0, len(words)), f"boss{name}@firm.example")
            if rng.random() < 0.9:
                words.insert(rng.randint(0, len(words)), f"zan{'abcdefg'[name]}ibar")
        elif rng.random() < 0.02:
            words.append("zanaibar")
        if i % 11 == 0:
            words.append(rng.choice(["10.1.2.3", "+1 555 123 4567", "4111 1111 1111 1111"]))
        rows.append((i, " ".join(words)))
    rows += [(900, ""), (901, "x" * 4000 + " a@b.cc " + "zanzibar " * 300)]
    got = {r.doc_id: r for r in queries.QUERIES["op3_personal_data"](spark, written(spark, tmp_path, [(i, t, None) for i, t in rows] + [(902, None, None)])).collect()}
    want = disclosed([*rows, (902, "")], personal_data.Disclosure())
    assert any(want.values())
    for i, t in rows:
        spans = base(t)
        listed = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
        more = [f"term_{a}:{x}:{y}" for kind in ("generalised", "removed") for x, y, a in want[i] if a == kind]
        assert got[i].base_sha256 == sha(",".join(listed)) and got[i].spans == ",".join(listed + more), (i, t)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in spans) for k in PATTERNS] and got[i].n_term == len(want[i])
    assert got[902].spans == "" and got[902].base_sha256 == sha("")


def test_sharding_query(spark, tmp_path):
    rows = [(i, "t", None) for i in range(300)] + [(5, "again", None)]
    got = queries.QUERIES["op8_sharding"](spark, written(spark, tmp_path, rows)).collect()
    held = sharding.fill([f"shard-{i:03d}" for i in range(64)]).tolist()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    assert len(got) == 301 and all(r.slot == signed(hashed([r.doc_id])) % sharding.SLOTS and r.shard == f"shard-{held[r.slot]:03d}" for r in got)


def test_decontamination_finds_what_all_scores_find(monkeypatch, spark):
    """The search with bounds gives the leaks that scoring every item for every passage gives."""
    rng = random.Random(5)
    vocabulary = [word(rng, 2) for _ in range(90)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(8, 30)) + ". " + say(6) + ".") for i in range(40)]
    texts = [say(rng.randint(0, 200)) + " " + " ".join(w for w in items[k % 40][1].split() if rng.random() < 0.9) + " " + say(rng.randint(0, 90)) for k in range(60)] + [None, ""]
    index = next(decontamination.item_indexes(spark.createDataFrame(items, "item_id bigint, text string"), decontamination.LeakRule()))
    found = index.leaks(pa.array(texts))

    def every(self, terms):
        scores = {}
        for t in terms:
            for j, w in zip(self.postings[t], self.weights[t], strict=True):
                scores[int(j)] = scores.get(int(j), 0.0) + float(w)
        return [(j, s) for j, s in scores.items() if s >= self.rule.threshold - 1e-9]

    monkeypatch.setattr(decontamination.GroupIndex, "search", every)
    plain = index.leaks(pa.array(texts))
    assert any(found) and [sorted(x) for x in found] == [sorted(x) for x in plain]


def test_near_duplicate_recall_is_whole(spark):
    """Links at the contract's threshold: every pair that an exact join finds is in one component, and no other."""
    rng = random.Random(6)
    rows = []
    for g in range(40):
        text = [word(rng, 2) for _ in range(rng.randint(30, 120))]
        for _ in range(6):
            t = list(text)
            for p in rng.sample(range(len(t)), rng.randint(0, 2)):
                t[p] = word(rng)
            rows.append((len(rows), " ".join(t)))
    sets = [near_dup.shingle_set(t.encode(), 3) for _, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    got = {r.doc_id: r.root for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), near_dup.CONTRACT).collect()}
    assert len(links) > 150 and got == {i: top(i) for i in range(len(rows))}


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables pass every stage; columns stay as they are."""
    schema = SCHEMA + ", _key string, id bigint, k int, root string, kept string, slot int, _s int"
    more = ("key", 1, 2, "r", "x", 3, 4)
    text = " ".join(word(random.Random(i)) for i in range(80))
    rows = [(1, text, "a", "s", 1, *more), (1, text, "a", "s", 1, *more), (2, text, "a", "s", 1, *more), (None, text, "a", "s", None, *more), (3, None, None, None, None, *more), (4, "", "a", "s", 0, *more), (5, "a@b.cc " + text[::-1], None, None, None, *more)]
    spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        full = bool(docs.count())
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), schema)
        left = [(r.doc_id, r._key, r.kept) for r in docs.collect()]
        assert sorted(left, key=str) == ([(1, "key", "x"), (1, "key", "x"), (5, "key", "x"), (None, "key", "x")] if full else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(left)
    assert fingerprints.with_fingerprint(spark.createDataFrame(rows, schema)).count() == len(rows)
    with pytest.raises(ValueError):
        fingerprints.chosen_grams(docs["text"], window=3)
