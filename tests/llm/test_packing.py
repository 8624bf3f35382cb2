"""Packing against the library's ids, and against the fewest sequences that best fit on one list needs."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from surveyloom.llm import packing

RULE = packing.PackRule()


def library():
    t = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def texts(n, seed=5):
    r = random.Random(seed)
    pieces = ["The", "the.", "été,", "İ,", "J̌", "é.", "x\u0085y", "a b", "don't", "<|endoftext|>", "<|STARTOFTEXT|>.", "ab12.", "...", "Σας.", "漢字かな", "\x00", "🙂,", "K", ",", "word" * 30, "Ωh,", "H̱."]
    return ["".join(r.choice(pieces) + r.choice([" ", "  ", "\n", "\t", ""]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_library():
    want, mine = library(), packing.WordEncoder(open(packing.default_tokenizer(), encoding="utf-8").read())
    mine.REMEMBERED = 5
    some = [*texts(300), None, "", " ", "\n\n"]
    for at in range(0, len(some), 50):
        part = some[at : at + 50]
        ids, bounds = mine.encode(pa.array(["skipped", *part], pa.string()).slice(1), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [want(t) for t in part]


def check(rows, docs, capacity):
    """Pieces cover the documents, sequences are gapless and within capacity; their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want, encode = [], library()
    for i, text in docs:
        ids = encode(text)
        for p, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((i if i is not None else -1, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert found == sorted(want)
    return len(by)


def test_packing_is_whole_and_tight(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["alpha", "of", "Zebra,", "é"]) for _ in range(r.choice([0, 3, 40, 300, 900, 5000, 9000])))) for i in range(400)]
    docs += [(7, docs[7][1]), (None, None), (None, ""), (401, "one two " * 20000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'a' as sequence_id", "1 as piece").repartition(23)
    rows = packing.pack(packing.token_pieces(df, with_ids=False)).collect()
    n = check(rows, docs, 4096)
    assert n <= len(packing.best_fit([r.length for r in rows], 4096)) * 1.01 + 1


def test_sequences_have_the_ids(spark):
    docs = [(i, t) for i, t in enumerate(texts(40))]
    placed = packing.pack(packing.token_pieces(spark.createDataFrame(docs, "doc_id bigint, text string"), packing.PackRule(capacity=64)), packing.PackRule(capacity=64, slack=1, loose=8))
    encode, out = library(), packing.sequences(placed).collect()
    found = {}
    for row in out:
        assert len(row.ids) <= 64 and len(row.starts) == len(row.doc_ids)
    for r in placed.collect():
        found.setdefault(r.doc_id, {})[r.piece] = r.ids
    assert {i: [x for p in sorted(v) for x in v[p]] for i, v in found.items()} == {i: encode(t) for i, t in docs}


def test_blocks_and_rounds_keep_everything(spark):
    rule = packing.PackRule(capacity=100, slack=1, loose=20, block_rows=50, fan_in=2)
    r = random.Random(4)
    for sizes in ([r.randint(1, 100) for _ in range(3000)], [51] * 700, [100] * 90, [1] * 1234, [34, 33] * 500, []):
        rows = [(i, s) for i, s in enumerate(sizes)] + [(None, None), (None, 0), (-1, 101)]
        packed = packing.pack(spark.createDataFrame(rows, "k int, length int").selectExpr("*", "'x' as Offset").repartition(9), rule)
        assert packed.columns == ["k", "length", "Offset", "sequence_id", "offset_"]
        got = packed.drop("Offset").withColumnRenamed("offset_", "offset").collect()
        assert sorted((x.k is None, x.k, x.length) for x in got if x.sequence_id is not None) == [(False, i, s) for i, s in enumerate(sizes)]
        assert sum(x.sequence_id is None for x in got) == 3
        by = {}
        for x in got:
            by.setdefault(x.sequence_id, []).append((x.offset, x.length))
        by.pop(None)
        assert all(sum(n for _, n in v) <= 100 and all(o == sum(n for p, n in v if p < o) for o, _ in v) for v in by.values())
        plain = len(packing.best_fit(sizes, 100))
        assert len(by) <= plain * 1.02 + 1


def test_empty_table(spark):
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
