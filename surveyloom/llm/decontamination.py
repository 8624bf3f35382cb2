"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND.

Items are grouped by length, up to a power of two. For each group, passages are
windows of two chunks of that many words, so every verbatim item lies in some
passage, and no item's result depends on how long others are. An item's
scores are divided by its score against itself; passages that reach
``threshold`` of it are candidates, and all of them are found: first a bound
from the chunks' terms and the largest weight in each block of items rules out
most passages at once, then WAND walks the postings of the others, skipping
blocks whose maxima cannot reach the threshold. Candidates are verified on
word runs of the item's question (all but its last sentence) and answer (the
last sentence; halves, if there is one sentence).

The index covers at most ``pass_bytes`` of items. A larger benchmark takes
several passes over the documents, a block of items each; counts, document
frequencies and mean length are those of the whole benchmark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.shared import released, table

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class LeakRule:
    threshold: float = 0.7
    overlap: float = 0.5
    run: int = 3
    block: int = 4
    k1: float = 1.2
    b: float = 0.75
    pass_bytes: int = 16 << 20


def word_of(token: str) -> str:
    """A token in lower case without punctuation at its ends."""
    token = token.lower()
    return token if token.isalnum() else _EDGE.sub("", token)


def words_of(text: str | None) -> list[str]:
    return [w for w in map(word_of, (text or "").split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    return words[: len(words) // 2], words[len(words) // 2 :]


def overlap(part: list[str], passage: list[str], run: int) -> float:
    """Share of the part's runs of words that the passage has; shorter parts are one run. An empty part has 1."""
    k = min(run, len(part))
    if not k:
        return 1.0
    grams = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
    have = {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
    return len(grams & have) / len(grams)


@dataclass(frozen=True)
class ItemStats:
    """Of all items with words: their number, document frequencies of words and mean length."""

    n: int
    df: dict[str, int]
    mean: float

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> ItemStats:
        n, total, df = 0, 0, Counter()
        for words in map(words_of, texts):
            if words:
                n, total = n + 1, total + len(words)
                df.update(set(words))
        return cls(n, df, total / n if n else 1.0)


#: Words of the shortest chunk.
LEAST_WIDTH = 16


def width_of(words: int) -> int:
    """The words of a chunk for an item: its own number, up to a power of two."""
    return max(LEAST_WIDTH, 1 << (words - 1).bit_length())


class ItemIndex:
    """Indexes of a block of items, one for each length of chunk; terms are numbered together.

    ``stats`` are those of all items; without them the block is all there is.
    """

    def __init__(self, items: list[tuple[int, str]], rule: LeakRule, stats: ItemStats | None = None):
        stats = stats or ItemStats.of(t for _, t in items)
        self.vocabulary: dict[str, int] = {}
        groups: dict[int, list] = {}
        for i, t in items:
            if words := words_of(t):
                groups.setdefault(width_of(len(words)), []).append((i, t, words))
        self.groups = [GroupIndex(groups[w], w, self.vocabulary, rule, stats) for w in sorted(groups)]

    def leaks(self, texts: pa.Array) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: verified items with the best score, and question and answer overlap."""
        found: list[dict] = [{} for _ in range(len(texts))]
        if not self.groups or not len(texts):
            return found
        split = pc.utf8_split_whitespace(texts.fill_null(""))
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = pc.list_flatten(split).dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        unique = coded.dictionary.to_pylist()
        lookup = self.vocabulary.get
        term = np.array([lookup(word_of(w), -1) for w in unique], np.int64)[coded.indices.to_numpy()] if unique else np.zeros(0, np.int64)
        for group in self.groups:
            group.add_leaks(found, sizes, coded, unique, term)
        return found


class GroupIndex:
    """Postings of items of one length of chunk: for each term its items, weights (as shares of the item's own score) and block maxima."""

    def __init__(self, items: list[tuple[int, str, list[str]]], width: int, vocabulary: dict[str, int], rule: LeakRule, stats: ItemStats):
        self.rule, self.items, self.width = rule, items, width
        known: dict[str, int] = {}  # this group's numbers of its terms
        counts: list[dict[int, int]] = []
        for _, _, words in self.items:
            tf: dict[int, int] = {}
            for w in words:
                t = known.setdefault(w, len(known))
                tf[t] = tf.get(t, 0) + 1
            counts.append(tf)
        n = len(self.items)
        self.terms = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in known], np.int64)
        df = np.array([stats.df[w] for w in known], np.float64)
        idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
        self.postings: list[list[int]] = [[] for _ in df]
        self.weights: list[list[float]] = [[] for _ in df]
        for j, tf in enumerate(counts):
            norm = rule.k1 * (1 - rule.b + rule.b * len(self.items[j][2]) / stats.mean)
            w = {t: idf[t] * f * (rule.k1 + 1) / (f + norm) for t, f in tf.items()}
            whole = sum(w.values())
            for t, x in w.items():
                self.postings[t].append(j)
                self.weights[t].append(x / whole)
        # the bound needs few columns however many items there are
        self.wide = max(rule.block, -(-n // 64))
        self.bound = np.zeros((len(df), max(1, -(-n // self.wide))), np.float32)
        for t, (p, w) in enumerate(zip(self.postings, self.weights, strict=True)):
            np.maximum.at(self.bound[t], np.array(p) // self.wide, np.array(w, np.float32))
        self.most = [max(w) for w in self.weights]
        self.blocks = []  # of each term: last item and largest weight of each block
        for p, w in zip(self.postings, self.weights, strict=True):
            cuts = range(0, len(p), rule.block)
            self.blocks.append(([p[min(c + rule.block, len(p)) - 1] for c in cuts], [max(w[c : c + rule.block]) for c in cuts]))
        self.parts = [question_and_answer(t) for _, t, _ in self.items]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold, by block-max WAND."""
        least = self.rule.threshold - 1e-9
        cursors = [[self.postings[t][0], t, 0] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, None
            for k, (_, t, _) in enumerate(cursors):
                reach += self.most[t]
                if reach >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            reach, end = 0.0, None
            for _, t, _ in cursors[: pivot + 1]:
                lasts, tops = self.blocks[t]
                k = bisect_left(lasts, item)
                if k < len(lasts):
                    reach += tops[k]
                    end = lasts[k] if end is None else min(end, lasts[k])
            if reach < least:
                to = (end if end is not None else item) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = fsum(self.weights[t][at] for x, t, at in cursors[: pivot + 1] if x == item)  # the same in any order of terms
                if score >= least:
                    out.append((item, score))
                to, moved = item + 1, cursors[: pivot + 1]
            else:
                to, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                p = self.postings[c[1]]
                c[2] = bisect_left(p, to, c[2])
                c[0] = p[c[2]] if c[2] < len(p) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def add_leaks(self, found: list[dict], sizes: np.ndarray, coded: pa.DictionaryArray, unique: list[str], term: np.ndarray) -> None:
        """Adds the group's verified items of each text; words are coded, ``term`` are their numbers in the whole vocabulary."""
        own = np.full(int(max(term.max(initial=-1), self.terms.max())) + 2, -1, np.int64)  # the last place is for words without a number
        own[self.terms] = np.arange(len(self.terms))
        term = own[term]
        # chunks never cross texts
        per = -(-sizes // self.width)
        chunk0 = np.cumsum(per) - per
        doc = np.repeat(np.arange(len(sizes)), sizes)
        word0 = np.cumsum(sizes) - sizes
        chunk = chunk0[doc] + (np.arange(len(doc)) - word0[doc]) // self.width
        hit = np.flatnonzero(term >= 0)
        n_chunks = int(per.sum())
        if not len(hit):
            return
        pair = np.unique(chunk[hit] * len(self.terms) + term[hit])
        owner, terms = pair // len(self.terms), pair % len(self.terms)
        sums = np.zeros((n_chunks, self.bound.shape[1]), np.float32)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for a in range(0, len(cuts), 4096):
            b = cuts[a + 4096] if a + 4096 < len(cuts) else len(owner)
            sums[owner[cuts[a : a + 4096]]] = np.add.reduceat(self.bound[terms[cuts[a] : b]], cuts[a : a + 4096] - cuts[a])
        of = np.repeat(np.arange(len(sizes)), per)
        both = sums.copy()
        both[:-1] += np.where((of[1:] == of[:-1])[:, None], sums[1:], 0)
        low, high = np.searchsorted(owner, np.arange(n_chunks)), np.searchsorted(owner, np.arange(n_chunks), "right")
        for c in np.flatnonzero(both.max(axis=1) >= self.rule.threshold - 1e-4).tolist():
            d = int(of[c])
            last = high[c + 1] if c + 1 < n_chunks and of[c + 1] == d else high[c]
            items = self.search(sorted(set(terms[low[c] : last].tolist())))
            if not items:
                continue
            start = word0[d] + (c - chunk0[d]) * self.width
            at = coded.indices.slice(int(start), int(min(2 * self.width, word0[d] + sizes[d] - start))).to_pylist()
            passage = [w for w in (word_of(unique[i]) for i in at) if w]
            for item, score in items:
                q, a = (overlap(p, passage, self.rule.run) for p in self.parts[item])
                if q >= self.rule.overlap and a >= self.rule.overlap:
                    key = self.items[item][0]
                    found[d][key] = max(found[d].get(key, (0.0, 0.0, 0.0)), (min(1.0, score), q, a))


def item_blocks(benchmark: DataFrame, rule: LeakRule, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items, by id, in blocks of at most ``rule.pass_bytes`` of text (a longer item stands alone)."""
    block, size = [], 0
    for row in benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        if block and size + len(row[1]) > rule.pass_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def item_indexes(benchmark: DataFrame, rule: LeakRule, id_col: str = "item_id", text_col: str = "text") -> Iterator[ItemIndex]:
    """An index for each block of items, all with the statistics of the whole benchmark."""
    stats = ItemStats.of(row[0] for row in benchmark.where(F.col(text_col).isNotNull()).select(text_col).toLocalIterator())
    for items in item_blocks(benchmark, rule, id_col, text_col):
        yield ItemIndex(items, rule, stats)


_ROWS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and verified item: doc_id, item_id, score (share of the item's own), overlaps.

    Null and empty texts and items match nothing; repeated items match each.
    Rows of null or repeated ids are searched like any other.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    out = None
    for block in item_indexes(benchmark, rule):
        index = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                for i in range(0, len(batch), 400):
                    part = batch.slice(i, 400)
                    ids = part.column(0).to_pylist()
                    rows = [(ids[k], item, *x) for k, found in enumerate(index.value.leaks(part.column(1))) for item, x in sorted(found.items())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

        found = source.mapInArrow(search, "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a verified item; no shuffle."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for block in item_indexes(benchmark, rule):
        index = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                for i in range(0, len(batch), 400):
                    part = batch.slice(i, 400)
                    yield part.filter(pa.array([not found for found in index.value.leaks(part.column(at))], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
