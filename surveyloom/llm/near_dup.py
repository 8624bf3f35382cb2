"""Near-duplicate documents: b-bit MinHash signatures, joined by a multi-index under a Hamming distance.

A signature has ``k`` symbols of 8 bits, one for each minimum over a document's
shingles. Two documents of similarity J differ in about k(1 - J) symbols;
``distance`` lies four standard deviations above that for J at the threshold.
The symbols are cut into ``chunks``. By the pigeonhole principle two signatures
within the distance agree, in some chunk, up to floor(distance / chunks)
symbols; that many are enumerated as holes of a key, so that every such pair
shares a key. Pairs within the distance are confirmed on the full sets.

Members of a key are not compared all with all at first, but with the least
member only. What that has joined needs no comparison any more. Keys that still
hold several components are looked at once more: in small keys every pair is
reported by the first key that it shares; the members of large keys are
gathered into clusters and compared in blocks of a cluster, with their texts at
hand, so that only links leave a task. A large group of copies thus costs in
proportion to its size, unless its members are no copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import superkmers as sk
from surveyloom.llm.shared import discard, n_partitions, released, staged, table


@dataclass(frozen=True)
class NearDup:
    """Shingles of ``shingle`` words; linked if 100 |A and B| >= percent |A or B|."""

    shingle: int = 5
    percent: int = 80
    k: int = 128
    distance: int = 43
    chunks: int = 22

    @property
    def holes(self) -> int:
        return self.distance // self.chunks


#: Three words and 85 hundredths: of 64 symbols 9.6 differ on average (deviation 2.9), 21 or fewer but for 1 pair in 10,000.
CONTRACT = NearDup(shingle=3, percent=85, k=64, distance=21, chunks=11)


@lru_cache(maxsize=4)
def _multipliers(k: int) -> np.ndarray:
    return sk.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles of a block of documents, by document, then hash."""
    low = (data >= 65) & (data <= 90)
    data = data + (low * np.uint8(32))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = np.diff(offsets) > 0
    first[offsets[:-1][some]] = inside[offsets[:-1][some]]
    last[offsets[1:][some] - 1] = inside[offsets[1:][some] - 1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, at, "right") - 1
    word = sk.range_hashes(data, at, end)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    word0 = np.cumsum(words) - words
    which = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + word0[which]
    h = sk.range_hashes(word, start, start + np.minimum(words, shingle)[which])
    order = np.lexsort((h, which))
    which, h = which[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
    return which[new], h[new]


_SIG_DDL = "id bigint, n bigint, lo bigint, hi bigint, sig binary"
_SIG = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("sig", pa.binary())])


def signatures(docs: DataFrame, rule: NearDup, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id, set size, a 128-bit digest of the set, the signature (k bytes; empty for empty sets), and the text ``t`` if asked for."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _multipliers(rule.k)
        for batch in released(batches):
            known = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(1), batch.column(2)], names=["id", "k", "t"])
            for rows, _, data, offsets in sk.blocks(iter([known])):
                which, h = shingle_hashes(data, offsets, rule.shingle)
                n = np.bincount(which, minlength=len(rows))
                some = np.flatnonzero(n)
                cut = (np.cumsum(n) - n)[some]
                lo, hi = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
                sig = np.zeros((len(rows), rule.k), np.uint8)
                if len(some):
                    lo[some] = np.add.reduceat(h, cut)
                    hi[some] = np.add.reduceat(sk.mix(h ^ a[0]), cut)
                    for j in range(rule.k):
                        sig[some, j] = (sk.mix(np.minimum.reduceat(h * a[j], cut)) >> np.uint64(56)).astype(np.uint8)
                sigs = [sig[i].tobytes() if n[i] else b"" for i in range(len(rows))]
                ids = batch.column(0).take(pa.array(rows))
                out = pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(sigs, pa.binary())], schema=_SIG)
                if keep_text:
                    out = pa.RecordBatch.from_arrays([*out.columns, batch.column(2).take(pa.array(rows)).cast(pa.binary())], names=[*_SIG.names, "t"])
                yield out

    return source.mapInArrow(sign, _SIG_DDL + (", t binary" if keep_text else ""))


def index_keys(sigs: np.ndarray, rule: NearDup) -> np.ndarray:
    """(rows, keys) array: one key for each chunk and each choice of holes in it."""
    out = []
    for c, part in enumerate(np.array_split(np.arange(rule.k), rule.chunks)):
        for holes in combinations(range(len(part)), min(rule.holes, len(part) - 1)):
            left = np.delete(part, holes)
            h = np.full(len(sigs), c * 1009 + sum(1 << x for x in holes) + 1, np.uint64)
            for p in left:
                h = sk.mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, p].astype(np.uint64) + np.uint64(1))
            out.append(h)
    return np.stack(out, axis=1)


def _index(batches: Iterator[pa.RecordBatch], rule: NearDup) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch.slice(i, 2000)
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(part), rule.k)
            keys = index_keys(sigs, rule)
            ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            slots = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(ids), pa.array(slots)], names=["key", "id", "slot"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, id): those of keys with several members, with the least member."""
    last_key, last_id, last_slot, alone = None, None, None, False
    for batch in batches:
        key, ids, slot = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        center = ids[np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))]
        if not new[0]:
            head = int(np.argmax(new)) if new.any() else len(key)
            center[:head] = last_id
        more = np.zeros(len(key), bool)  # rows whose key goes on
        more[:-1] = ~new[1:]
        keep = ~new | more
        rows = [key[keep], ids[keep], center[keep], slot[keep]]
        if alone and not new[0]:  # the last row of the batch before belongs to a shared key after all
            rows = [np.concatenate([[x], r]) for x, r in zip((last_key, last_id, last_id, last_slot), rows, strict=True)]
        alone = bool(new[-1])
        last_key, last_id, last_slot = key[-1], center[-1], slot[-1]
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["key", "id", "center", "slot"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b); the root is the least id of the component.

    Every round each vertex joins the neighbour of least priority and the graph
    is contracted; the priority is the id and a random number by turns, so the
    number of rounds is logarithmic. Nothing but whether edges are left reaches
    the driver.
    """
    spark = edges.sparkSession
    left = left_held = staged(edges.where("a <> b").distinct(), "edges")
    path, held, turn = None, None, 0
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least id settles stars at once; random priorities keep long paths from taking a round for each step
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c) if turn % 2 else c, c.alias("v"))  # noqa: B023, E731
        join = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        join = staged(join.select(F.col("a").alias("v"), F.when(F.col("m") < rank(F.col("a")), F.col("m")["v"]).otherwise(F.col("a")).alias("w")), "joins")
        step = join.select(F.col("v"), F.col("w"))
        if path is None:
            path = step.select(F.col("v").alias("id"), F.col("w").alias("root"))
        else:
            path = path.join(step, path["root"] == step["v"], "left").select("id", F.coalesce("w", "root").alias("root"))
        known, path = held, staged(path, "roots")
        held = path
        left = left.join(step.withColumnRenamed("w", "wa"), left["a"] == F.col("v")).drop("v").join(step.withColumnRenamed("w", "wb"), F.col("b") == F.col("v"))
        edges, left = left_held, staged(left.select(F.least("wa", "wb").alias("a"), F.greatest("wa", "wb").alias("b")).where("a <> b").distinct(), "edges")
        left_held = left
        discard(edges, join, *([known] if known is not None else []))
        turn += 1
    if path is None:
        return spark.createDataFrame([], "id bigint, root bigint")
    least = path.groupBy("root").agg(F.min("id").alias("least"))
    return path.join(least, "root").select("id", F.col("least").alias("root"))


def _within(batches: Iterator[pa.RecordBatch], rule: NearDup) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x, y = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, rule.k) for i in (2, 3)]
            near = (x != y).sum(axis=1) <= rule.distance
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"])


def shingle_set(text: bytes, shingle: int) -> set:
    words = text.lower().split()
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(shingle)], strict=False))


def _confirm(batches: Iterator[pa.RecordBatch], rule: NearDup) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, whether it is a itself first): links of a to documents of enough similarity."""
    group, mine = None, set()
    for batch in released(batches):
        a, salt, leaf, doc, text = [batch.column(i).to_pylist() for i in range(5)]
        out = []
        for i in range(len(a)):
            have = shingle_set(text[i], rule.shingle)
            if not leaf[i]:
                group, mine = (a[i], salt[i]), have
            elif group == (a[i], salt[i]):
                both = len(mine & have)
                if 100 * both >= rule.percent * (len(mine) + len(have) - both):
                    out.append((a[i], doc[i]))
        if out:
            x, y = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


#: Documents that are compared with one other in a task; members of a small key; and of a block of a cluster.
LEAVES, SMALL, BLOCK = 256, 16, 512


def confirmed(pairs: DataFrame, texts: DataFrame, rule: NearDup) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. A document with many partners is sent to several tasks."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / LEAVES)).cast("int")).select("a", "b", "salt")
    dealt = staged(dealt, "pairs")
    asked = dealt.select("a", "salt", F.lit(True).alias("leaf"), F.col("b").alias("id")).unionByName(
        dealt.select("a", "salt").distinct().select("a", "salt", F.lit(False).alias("leaf"), F.col("a").alias("id"))
    )
    rows = asked.join(texts, "id").select("a", "salt", "leaf", "id", "t")
    rows = rows.repartition(n_partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "leaf")
    return rows.mapInArrow(lambda b: _confirm(b, rule), "a bigint, b bigint")


def first_slots(differs: np.ndarray, rule: NearDup) -> np.ndarray:
    """For rows of symbol-wise differences, the first key (its number in index_keys) that the two share; -1 if none."""
    out, offset = np.full(len(differs), -1, np.int64), 0
    for part in np.array_split(np.arange(rule.k), rule.chunks):
        holes = [sum(1 << x for x in h) for h in combinations(range(len(part)), min(rule.holes, len(part) - 1))]
        covers = np.array([next((i for i, h in enumerate(holes) if mask & ~h == 0), -1) for mask in range(1 << len(part))])
        found = covers[differs[:, part] @ (1 << np.arange(len(part)))]
        out = np.where((out < 0) & (found >= 0), found + offset, out)
        offset += len(holes)
    return out


def groups_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by their first ``width`` columns, group by group."""
    group, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:width] != group:
                if held:
                    yield group, held
                group, held = row[:width], []
            held.append(row[width:])
    if held:
        yield group, held


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _small_keys(batches: Iterator[pa.RecordBatch], rule: NearDup, step: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Rows (key; slot, id, comp, sig) sorted by key: pairs of different components within the distance that share no earlier key."""
    rest = None  # rows of the last key, which may go on in the next batch
    for batch in chain(released(batches), [None]):
        if batch is not None:
            if not len(batch):
                continue
            sigs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(batch), rule.k)
            held = [*(batch.column(i).to_numpy() for i in range(4)), sigs]
            if rest is not None:
                held = [np.concatenate(x) for x in zip(rest, held, strict=True)]
            other = np.flatnonzero(held[0] != held[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
        elif rest is None:
            return
        else:
            held, cut = rest, len(rest[0])
        rest = [x[cut:] for x in held]
        key, slot, ids, comp, sigs = (x[:cut] for x in held)
        for apart in range(1, SMALL):
            if len(key) <= apart:
                break
            every = np.flatnonzero((key[apart:] == key[:-apart]) & (comp[apart:] != comp[:-apart]))
            if not len(every):
                continue
            for i in range(0, len(every), step):
                x = every[i : i + step]
                differs = sigs[x] != sigs[x + apart]
                near = np.flatnonzero(differs.sum(axis=1) <= rule.distance)
                near = near[first_slots(differs[near], rule) == slot[x[near]]]
                if len(near):
                    one, two = ids[x[near]], ids[x[near] + apart]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])


def _clusters(batches: Iterator[pa.RecordBatch], rule: NearDup) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j; block, id, comp, sig, text): links between components, as many as join them."""
    for (_, i, j), held in groups_of(batches, 3):
        held.sort(key=lambda r: r[1])
        sigs = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), rule.k)
        block, comp = np.array([r[0] for r in held]), [r[2] for r in held]
        number: dict[tuple, int] = {}
        sets = [np.sort(np.fromiter((number.setdefault(x, len(number)) for x in shingle_set(r[4], rule.shingle)), np.int64)) for r in held]
        sizes = np.array([len(x) for x in sets])
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:  # noqa: B023
                c = joined[c]  # noqa: B023
            return c

        out, left, right = [], np.flatnonzero(block == i), np.flatnonzero(block == j)
        for p in left.tolist():
            q = right[right > p] if i == j else right
            # similar sets have similar sizes
            q = q[(100 * np.minimum(sizes[q], sizes[p]) >= rule.percent * np.maximum(sizes[q], sizes[p]))]
            q = q[(sigs[q] != sigs[p]).sum(axis=1) <= rule.distance]
            mine, own = root(comp[p]), sets[p]
            for x in q.tolist():
                other = root(comp[x])
                if other == mine:
                    continue
                both = len(np.intersect1d(own, sets[x], assume_unique=True))
                if 100 * both >= rule.percent * (len(own) + len(sets[x]) - both):
                    out.append((held[p][1], held[x][1]))
                    joined[max(mine, other)] = mine = min(mine, other)
        if out:
            yield _pairs(out)


def remaining_links(members: DataFrame, roots: DataFrame, sigs: DataFrame, texts: DataFrame, tested: DataFrame, rule: NearDup) -> DataFrame:
    """Links between components that share a key: all that the comparison with least members has left open."""
    spark = members.sparkSession
    parts = n_partitions(spark)
    known = members.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    several = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("key", "n")
    mixed = staged(known.join(several, "key"), "mixed")
    small = mixed.where(F.col("n") <= SMALL).join(sigs, "id").select("key", "slot", "id", "comp", "sig")
    small = small.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: _small_keys(b, rule), "a bigint, b bigint")
    links = confirmed(staged(small.join(tested, ["a", "b"], "left_anti"), "small"), texts, rule)
    large = mixed.where(F.col("n") > SMALL)
    if not large.limit(1).count():
        return links
    cluster = components(large.select(F.col("center").alias("a"), F.col("id").alias("b")))
    rows = large.select("id", "comp").distinct().join(cluster.withColumnRenamed("root", "cluster"), "id")
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(sigs, "id").join(texts, "id")
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    rows = rows.withColumn("at", F.explode(other)).select("cluster", "at.i", "at.j", "block", "id", "comp", "sig", "t")
    rows = rows.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return links.unionByName(rows.mapInArrow(lambda b: _clusters(b, rule), "a bigint, b bigint"))


def _numbered(rows: DataFrame) -> DataFrame:
    """A number for each different (id, set), ascending with the id: id, n, lo, hi, v."""
    each = rows.where("n > 0 and id is not null").select("id", "n", "lo", "hi").distinct()
    each = each.repartitionByRange(n_partitions(rows.sparkSession), "id", "n", "lo", "hi").sortWithinPartitions("id", "n", "lo", "hi")
    return staged(each.withColumn("v", F.monotonically_increasing_id()), "numbers")


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, set size ``n``, ``root`` (least id of the component) and ``kept``.

    Null and empty texts have the empty set and are linked with nothing. Rows
    of one id count as one document, whatever their texts: their sets are told
    apart by a number and linked with one another. Rows of null id are linked
    with nothing and kept. An empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    rows = staged(signatures(docs, rule, id_col, text_col), "signatures")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    filled = rows.where("n > 0 and id is not null")
    repeated = filled.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    if not repeated:
        roots = _roots(filled, texts, None, rule)
    else:
        number = _numbered(rows)
        sets = signatures(docs, rule, id_col, text_col, keep_text=True).join(number, ["id", "n", "lo", "hi"])
        numbered_texts = staged(sets.select(F.col("v").alias("id"), "t").dropDuplicates(["id"]), "texts")
        firsts = number.groupBy("id").agg(F.min("v").alias("a"))
        same = number.join(firsts, "id").select("a", F.col("v").alias("b")).where("a <> b")
        roots = _roots(filled.join(number, ["id", "n", "lo", "hi"]).drop("id").withColumnRenamed("v", "id"), numbered_texts, same, rule)
        back = number.select(F.col("v").alias("root"), F.col("id").alias("least"))
        roots = roots.join(back, "root").select("n", "lo", "hi", F.col("least").alias("root"))
    named = rows.where("id is not null").drop("sig").join(roots, ["n", "lo", "hi"], "left").select("id", "n", F.coalesce("root", "id").alias("root"))
    out = named.unionByName(rows.where("id is null").select("id", "n", F.lit(None).cast("bigint").alias("root")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("root"), F.lit(True))).withColumnRenamed("id", id_col)


def _roots(rows: DataFrame, texts: DataFrame, same: DataFrame | None, rule: NearDup) -> DataFrame:
    """(n, lo, hi, root) for each set: the least id of its component. An id has one set and one text; ``same`` are links that hold anyway."""
    spark = rows.sparkSession
    classes = rows.groupBy("n", "lo", "hi").agg(F.min(F.struct("id", "sig")).alias("m"))
    classes = staged(classes.select("n", "lo", "hi", F.col("m.id").alias("rep"), F.col("m.sig").alias("sig")), "classes")
    sigs = classes.select(F.col("rep").alias("id"), "sig")
    keys = sigs.mapInArrow(lambda b: _index(b, rule), "key bigint, id bigint, slot int")
    keys = keys.repartition(n_partitions(spark), "key").sortWithinPartitions("key", "id")
    members = staged(keys.mapInArrow(_shared, "key bigint, id bigint, center bigint, slot int"), "members")
    texts = staged(texts.join(members.select("id").distinct(), "id", "left_semi"), "texts")

    candidates = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    sig_a, sig_b = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    candidates = candidates.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sa", "sb")
    tested = staged(candidates.mapInArrow(lambda b: _within(b, rule), "a bigint, b bigint"), "tested")
    links = confirmed(tested, texts, rule)
    if same is not None:
        reps = rows.join(classes.drop("sig"), ["n", "lo", "hi"]).select(F.col("id").alias("v"), "rep")
        known = same.join(reps.select(F.col("v").alias("a"), F.col("rep").alias("ra")).distinct(), "a").join(reps.select(F.col("v").alias("b"), F.col("rep").alias("rb")).distinct(), "b")
        links = links.unionByName(known.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b"))
    links = staged(links, "links")
    roots = staged(components(links), "components")
    more = staged(remaining_links(members, roots, sigs, texts, tested, rule), "links")
    discard(members, texts, tested)
    if more.limit(1).count():
        roots = staged(components(links.unionByName(more)), "components")
    return classes.select("n", "lo", "hi", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("n", "lo", "hi", F.coalesce("root", "rep").alias("root"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of 0.85 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), CONTRACT)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), "kept")
