"""Ranked lexical search by variable-block-max WAND.

One pass over the texts writes segments: the postings of up to ``SearchRule.docs``
documents for the terms that some query has, with the documents' lengths.
Statistics are sums over the segments. Then each segment is a shard. Its
scores are computed, dynamic programming cuts each posting list into blocks
that keep the block maxima close to the scores, and WAND finds the best
documents of each query, skipping blocks whose maxima cannot reach them.
Shards' best are merged by rank. All arithmetic but a term's weight is in
integers, so results do not depend on shards.

Queries come in passes of at most ``pass_bytes`` of text; statistics are those
of all documents in every pass. A segment's size is bounded, and so is what a
task holds.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm.shared import by_bytes, released, staged, table
from surveyloom.sources.shipping import ship


@dataclass(frozen=True)
class SearchRule:
    """``docs`` and ``postings`` bound a segment, ``longest`` a block; ``price`` of a block is in units of its list's best score."""

    k: int = 10
    docs: int = 1 << 15
    postings: int = 1 << 20
    longest: int = 128
    price: float = 8.0
    pass_bytes: int = 16 << 20
    batch_bytes: int = 8 << 20


#: What separates terms becomes a space, A-Z become a-z, other bytes stay.
_BYTES = np.array([b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts (null: none), and the text of each."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(_BYTES[raw]))
    split = pc.ascii_split_whitespace(plain)
    flat, of = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), of[some.to_numpy(zero_copy_only=False)]


_SEGMENT = pa.schema([("shard", pa.int64()), ("term", pa.int32()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])
_SEGMENT_DDL = "shard bigint, term int, at array<int>, tf array<bigint>, ids array<bigint>"


class _Segment:
    """Documents and postings of a shard in the making."""

    def __init__(self):
        self.ids, self.sizes, self.doc, self.term, self.tf, self.n, self.held = [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array, vocabulary: pa.Array) -> None:
        words, of = terms(texts)
        coded = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False)
        term = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        hit = term >= 0
        pair, count = np.unique(of[hit].astype(np.int64) * max(1, len(vocabulary)) + term[hit], return_counts=True)
        self.doc.append(pair // max(1, len(vocabulary)) + self.n)
        self.term.append(pair % max(1, len(vocabulary)))
        self.tf.append(count)
        self.ids.append(ids)
        self.sizes.append(np.bincount(of, minlength=len(texts)))
        self.n += len(texts)
        self.held += len(pair)

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row for each term, and one (term -1) for the documents: their ids and lengths, by ascending id."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term, tf = place[np.concatenate(self.doc)], np.concatenate(self.term), np.concatenate(self.tf)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        lists = np.concatenate([[0, 0], np.append(first[1:], len(term))]) if len(term) else np.zeros(2, np.int64)
        n = len(lists) - 1
        sizes = np.concatenate(self.sizes)[order]
        at = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(doc, pa.int32()))
        # the documents' lengths stand before the counts of terms
        tfs = pa.ListArray.from_arrays(pa.array(np.append(0, lists[1:] + len(sizes)), pa.int32()), pa.array(np.concatenate([sizes, tf]), pa.int64()))
        own = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * n, pa.int32()), ids.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int64()), pa.array(np.append(-1, term[first]), pa.int32()), at, tfs, own], schema=_SEGMENT)


def segments(docs: DataFrame, vocabulary: list[str], rule: SearchRule, id_col: str, text_col: str) -> DataFrame:
    """Postings of the vocabulary's terms in whole texts, in segments (shard)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, shard, segment = pa.array(vocabulary, pa.string()), TaskContext.get().partitionId() << 32, _Segment()
        for batch in released(batches):
            for at, size in by_bytes(batch.column(1), rule.batch_bytes):
                segment.add(batch.column(0).slice(at, size), batch.column(1).slice(at, size), known)
                if segment.n >= rule.docs or segment.held >= rule.postings:
                    yield segment.rows(shard)
                    shard, segment = shard + 1, _Segment()
        if segment.n:
            yield segment.rows(shard)

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(build, _SEGMENT_DDL)


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and the documents that hold each term of the vocabulary."""

    n: int
    total: int
    df: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.n + 2) / (2 * self.df[term] + 1)))


def statistics(index: DataFrame) -> Statistics:
    own = F.col("term") == -1
    with_terms = F.when(own, F.size(F.filter("tf", lambda n: n > 0))).otherwise(F.size("at")).cast("bigint")
    words = F.when(own, F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, n: a + n))
    rows = index.groupBy("term").agg(F.sum(with_terms).alias("c"), F.sum(words).alias("w")).collect()  # a row for each term of the pass
    found = {r["term"]: (r["c"], r["w"]) for r in rows}
    n, total = found.pop(-1, (0, 0))
    return Statistics(n, total, {t: c for t, (c, _) in found.items()})


def norms(sizes: np.ndarray, stats: Statistics) -> np.ndarray:
    if 75 * int(sizes.max(initial=0)) * stats.n < 1 << 62:
        return 25 + 75 * sizes * stats.n // max(1, stats.total)
    return np.array([25 + 75 * int(n) * stats.n // max(1, stats.total) for n in sizes], np.int64)


def block_ends(scores: np.ndarray, lists: np.ndarray, longest: int, price: float) -> list[list[int]]:
    """Ends of the blocks of each posting list (``lists``: their bounds in ``scores``; none is empty).

    The cuts minimise, over blocks of at most ``longest`` postings, the sum of
    (block maximum - score) plus ``price`` best scores of the list a block.
    All lists advance together, a posting at a time.
    """
    start, size = lists[:-1], np.diff(lists)
    by = np.argsort(-size, kind="stable")
    start, size = start[by], size[by]
    if not len(size):
        return []
    fee = np.maximum(1, (price * np.maximum.reduceat(scores, lists[:-1])[by]).astype(np.int64))
    cost = np.zeros((len(fee), longest), np.int64)  # of the best cuts before each block start, in a ring
    top = np.zeros((len(fee), longest), np.int64)  # of a block from there to here
    parent = np.zeros(len(scores), np.int32)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    before = np.zeros(len(fee), np.int64)
    for i in range(int(size[0])):
        m = alive[i]
        s = scores[start[:m] + i]
        slot, width = i % longest, min(i + 1, longest)
        cost[:m, slot] = before[:m]
        top[:m, slot] = 0
        np.maximum(top[:m, :width], s[:, None], out=top[:m, :width])
        # the block from the start in ring place p has (slot - p) % longest + 1 postings
        count = (slot - np.arange(width)) % longest + 1
        sums = cost[:m, :width] + top[:m, :width] * count
        best = sums.argmin(axis=1)
        before[:m] = sums[np.arange(m), best] + fee[:m]
        parent[start[:m] + i] = i + 1 - count[best]
    ends: list[list[int]] = [[] for _ in by]
    for k, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        cuts = []
        while n:
            cuts.append(n)
            n = int(parent[a + n - 1])
        ends[by[k]] = cuts[::-1]
    return ends


class ShardIndex:
    """Scored postings of a shard with their blocks."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, stats: Statistics, rule: SearchRule):
        norm = norms(sizes, stats)
        kept = [(t, at, w * (1_000_000_000 * tf // (1000 * tf + 8 * norm[at]))) for t, (at, tf) in rows.items() if (w := stats.weight(t)) > 0]
        bounds = np.cumsum([0, *(len(at) for _, at, _ in kept)])
        flat = np.concatenate([s for _, _, s in kept]) if kept else np.zeros(0, np.int64)
        ends = block_ends(flat, bounds, rule.longest, rule.price)
        self.k = rule.k
        self.lists: dict[int, tuple] = {}  # of a term: documents, scores, best score, last document and best score of each block
        for (t, at, s), cuts in zip(kept, ends, strict=True):
            if len(at):
                last = np.array(cuts) - 1
                tops = np.maximum.reduceat(s, np.append(0, last[:-1] + 1))
                self.lists[t] = (at.tolist(), s.tolist(), int(s.max()), at[last].tolist(), tops.tolist())

    def search(self, query: dict[int, int]) -> list[tuple[int, int]]:
        """The ``k`` best (score, document) with a score above 0, ties to the lower document, by block-max WAND."""
        k = self.k
        # a cursor: document, postings, place, block, times, best score
        cursors = [[entry[0][0], entry, 0, 0, times, times * entry[2]] for t, times in query.items() if (entry := self.lists.get(t))]
        heap: list[tuple[int, int]] = []
        least = self._sure(cursors)
        by_doc = lambda c: c[0]
        while cursors:
            cursors.sort(key=by_doc)
            reach, pivot = 0, -1
            for p, c in enumerate(cursors):
                reach += c[5]
                if reach > least:
                    pivot = p
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            n = len(cursors)
            while pivot + 1 < n and cursors[pivot + 1][0] == doc:
                pivot += 1
            ahead = cursors[: pivot + 1]
            reach, end = 0, None
            for c in ahead:
                entry = c[1]
                lasts = entry[3]
                b = c[3]
                if b < len(lasts) and lasts[b] < doc:
                    b = c[3] = bisect_left(lasts, doc, b)
                if b < len(lasts):
                    reach += c[4] * entry[4][b]
                    if end is None or lasts[b] < end:
                        end = lasts[b]
            if reach <= least:
                to = doc + 1 if end is None else end + 1
                if pivot + 1 < n and cursors[pivot + 1][0] < to:
                    to = cursors[pivot + 1][0]
            elif ahead[0][0] == doc:
                score = sum([c[4] * c[1][1][c[2]] for c in ahead])
                if score > least:
                    # documents come in ascending order, so an equal score later never wins
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -doc))
                    else:
                        heapq.heapreplace(heap, (score, -doc))
                    if len(heap) == k:
                        least = max(least, heap[0][0])
                to = doc + 1
            else:
                to = doc
            ended = False
            for c in ahead:
                if c[0] < to:
                    docs = c[1][0]
                    p = c[2] = bisect_left(docs, to, c[2])
                    if p < len(docs):
                        c[0] = docs[p]
                    else:
                        c[0] = -1
                        ended = True
            if ended:
                cursors = [c for c in cursors if c[0] >= 0]
        return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))

    def _sure(self, cursors: list) -> int:
        """A score that at least ``k`` documents exceed, from single terms: the search need not look below it."""
        least = 0
        for c in cursors:
            scores = c[1][1]
            if len(scores) >= self.k and c[5] > least:
                key = id(c[1])
                kth = self._kth.get(key)
                if kth is None:
                    kth = self._kth[key] = heapq.nlargest(self.k, scores)[-1]
                least = max(least, c[4] * kth - 1)
        return least

    @property
    def _kth(self) -> dict:
        return self.__dict__.setdefault("_kth_best", {})


def _passes(queries: DataFrame, rule: SearchRule, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Queries with a text in passes of bounded size; a longer one stands alone."""
    block, size = [], 0
    for row in queries.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint"), text_col).orderBy(id_col, text_col).toLocalIterator():
        if block and size + len(row[1]) > rule.pass_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def _searched(docs: DataFrame, block: list[tuple[int, str]], first: int, rule: SearchRule, id_col: str, text_col: str) -> DataFrame:
    """The best documents of each query in each shard, with the query's number."""
    spark = docs.sparkSession
    words, of = terms(pa.array([t for _, t in block], pa.string()))
    coded = words.dictionary_encode()
    wanted: list[Counter] = [Counter() for _ in block]
    for q, t in zip(of.tolist(), coded.indices.to_pylist(), strict=True):
        wanted[q][t] += 1
    index = staged(segments(docs, coded.dictionary.to_pylist(), rule, id_col, text_col), "postings")
    stats = statistics(index)
    shared = spark.sparkContext.broadcast((stats, [(i, dict(c)) for (i, _), c in zip(block, wanted, strict=True)]))  # at most a pass of queries

    def search(shard: pa.Table) -> pa.Table:
        stats, wanted = shared.value
        rows, ids, sizes = {}, None, None
        for chunk in shard.to_batches():
            lists, tfs = chunk.column("at"), chunk.column("tf")
            for r, t in enumerate(chunk.column("term").to_pylist()):
                if t < 0:
                    ids, sizes = chunk.column("ids")[r].values, tfs[r].values.to_numpy()
                else:
                    rows[t] = lists[r].values.to_numpy(), tfs[r].values.to_numpy()
        found = ShardIndex(rows, sizes, stats, rule)
        out = [(q + first, item, d, s) for q, (item, query) in enumerate(wanted) for s, d in found.search(query)]
        no, item, at, score = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"query": pa.array(no, pa.int64()), "item_id": pa.array(item, pa.int64()), "doc_id": ids.take(pa.array(at, pa.int64())), "score": pa.array(score, pa.int64())})

    return index.groupBy("shard").applyInArrow(search, "query bigint, item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, queries: DataFrame, rule: SearchRule = SearchRule(), id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query, equal scores by ascending id (null last).

    Null and empty texts match nothing; a query without terms or without a
    matching document has no rows. Rows of null or repeated ids are ranked
    each on their own, on both sides; other columns are not read.
    """
    ship(docs.sparkSession)
    out, first = None, 0
    for block in _passes(queries, rule, query_col, query_text):
        best = _searched(docs, block, first, rule, id_col, text_col)
        out = best if out is None else out.unionByName(best)
        first += len(block)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rule.k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
