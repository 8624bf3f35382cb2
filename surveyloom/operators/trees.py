"""Trees grown level by level from histograms of binned features.

Rows are small integers. A job sums the histograms of open nodes over the rows,
merged as a tree of tasks; the driver picks splits from them and sends the grown
trees with the next job. Counts are integers and gradients are rounded to
multiples of 2^-20 before they are summed, so trees do not depend on how rows
are dealt. ``most_cells`` bounds what a job sums: more open nodes than fit take
several jobs. In a forest that holds for nodes of many rows; the rows of small
nodes are shuffled to the task that splits the node, one job a level, and the
driver gets the splits only. Trees of a forest grow together as far as
``most_nodes`` allows; then they are written to the shared folder.
"""

from __future__ import annotations

import heapq
import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.operators.gather import gathered
from surveyloom.sources.scratch import drop, filesystem, fresh_path, written

UNIT = float(1 << 20)
#: Rows of a task whose shares are summed at once.
ROWS = 100_000
#: Rows of small nodes that are split together.
BLOCK = 50_000


def _number(column: str):
    """A column as a double; NaN is null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def modes(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """The most frequent value of each column (the least of several; 0 without values)."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _number(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = each.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    found = {r["column"]: r["value"] for r in counts.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value")).collect()}
    return {c: found.get(c, 0.0) for c in columns}


def _bin(value, cuts: np.ndarray):
    """The number of cuts below a value."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x < value)) if len(cuts) else F.lit(0)


@dataclass
class Bins:
    """Modes and cuts of the features, fitted on training rows once; a value is in the bin of the first cut that is not below it."""

    columns: list[str]
    modes: dict[str, float]
    cuts: list[np.ndarray]

    @property
    def width(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    def applied(self, rows: DataFrame, name: str = "bins") -> DataFrame:
        """``rows`` with their bins; null and NaN values count as the training mode."""
        bins = [_bin(F.coalesce(_number(c), F.lit(self.modes[c])), cuts) for c, cuts in zip(self.columns, self.cuts, strict=True)]
        return rows.withColumn(name, F.array(*bins))


def fit_bins(train: DataFrame, columns: list[str], bins: int = 32) -> Bins:
    """At most ``bins`` bins a feature: one for each value if there are as few, else quantiles."""
    most = modes(train, columns)
    filled = train.select(*[F.coalesce(_number(c), F.lit(most[c])).alias(f"x{i}") for i, c in enumerate(columns)])
    shares = [(i + 1) / bins for i in range(bins - 1)]
    wanted = [F.percentile_approx(f"x{i}", shares, 10_000).alias(f"q{i}") for i in range(len(columns))]
    few = [F.slice(F.array_sort(F.collect_set(F.when(F.col(f"x{i}").isNotNull(), F.col(f"x{i}")))), 1, bins + 1).alias(f"v{i}") for i in range(len(columns))]
    near = [F.approx_count_distinct(f"x{i}").alias(f"n{i}") for i in range(len(columns))]
    first = filled.agg(*wanted, *near).first()
    small = [i for i in range(len(columns)) if first[f"n{i}"] <= 2 * bins]  # sets of such columns are small
    values = filled.agg(*[few[i] for i in small]).first() if small else None
    cuts = []
    for i in range(len(columns)):
        own = values[f"v{i}"] if i in small else None
        cuts.append(np.array(own[:-1] if own is not None and len(own) <= bins else sorted(set(first[f"q{i}"] or [])), float))
    return Bins(columns, most, cuts)


@dataclass
class Tree:
    """Nodes by number: the feature and the last bin that goes left (feature -1: a leaf), children, and a value each."""

    feature: array = field(default_factory=lambda: array("h", [-1]))
    cut: array = field(default_factory=lambda: array("h", [0]))
    left: array = field(default_factory=lambda: array("i", [-1]))
    right: array = field(default_factory=lambda: array("i", [-1]))
    value: list = field(default_factory=lambda: [None])
    depth: array = field(default_factory=lambda: array("h", [0]))

    def split(self, node: int, feature: int, cut: int, values: tuple) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        for value in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(value)
            self.depth.append(self.depth[node] + 1)
        self.left[node], self.right[node] = len(self.feature) - 2, len(self.feature) - 1
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        inner = feature[node] >= 0
        while inner.any():
            at = np.flatnonzero(inner)
            here = node[at]
            goes = bins[at, feature[here]] <= cut[here]
            node[at] = np.where(goes, left[here], right[here])
            inner[at] = feature[node[at]] >= 0
        return node


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)


@dataclass(frozen=True)
class ForestRule:
    trees: int = 100
    depth: int = 16
    least: int = 20
    seed: int = 1701
    most_cells: int = 4_000_000
    most_nodes: int = 400_000


class Counts:
    """Counts (outputs x classes) of a grown tree's leaves, by node; inner nodes and leaves without rows have none."""

    def __init__(self, values: list, shape: tuple[int, int]):
        have = [i for i, v in enumerate(values) if v is not None]
        self.place = np.full(len(values), -1, np.int32)
        self.place[have] = np.arange(len(have))
        self.counts = np.array([*(values[i] for i in have), np.zeros(shape)], np.int32)  # the last one stands for -1

    def __getitem__(self, node: int) -> np.ndarray:
        return self.counts[self.place[node]]

    def shares(self, nodes: np.ndarray) -> np.ndarray:
        each = self.counts / np.maximum(self.counts.sum(axis=2, keepdims=True), 1)
        return each[self.place[nodes]]


@dataclass
class Forest:
    """Extremely randomised trees whose leaves hold counts of each output's classes.

    The trees lie in files of the shared folder, some in each: neither the
    driver nor a task holds more of them than those of one file.
    """

    bins: Bins
    classes: list[int]
    n_trees: int
    files: list[str] = field(default_factory=list)

    @property
    def trees(self) -> list[Tree]:
        """All of them, with plain lists: for a look at small forests."""
        lists = lambda tree: {c: getattr(tree, c).tolist() for c in ("feature", "cut", "left", "right", "depth")}
        return [replace(tree, **lists(tree)) for file in self.files for tree in _trees_of(file)]

    def shares(self, bins: np.ndarray) -> np.ndarray:
        """rows x outputs x classes."""
        total = np.zeros((len(bins), len(self.classes), max(self.classes)))
        for file in self.files:
            for tree in _trees_of(file):
                total += tree.value.shares(tree.leaves(bins))
        return total / self.n_trees


def _trees_of(file: str) -> list[Tree]:
    found, path = filesystem(file)
    with found.open_input_file(path) as f:
        return pickle.loads(f.read())


def _saved(spark: SparkSession, trees: list[Tree]) -> str:
    """Trees as a new file of the shared folder."""
    file = fresh_path(spark, "trees")
    found, path = filesystem(file)
    found.create_dir(path.rpartition("/")[0], recursive=True)
    with found.open_output_stream(path) as f:
        f.write(pickle.dumps(trees))
    return file


def _drawn(seed: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([seed, *key])


def _counted(trees: dict[int, Tree], open_nodes: list[tuple[int, int]], picks: dict, shape: tuple[int, int, int]):
    """Histograms (open node x picked feature x bin x output x class) of a batch."""
    width, outputs, classes = shape
    k = len(next(iter(picks.values())))
    features_of = np.array([picks[n] for n in open_nodes])
    spans: dict[int, tuple[int, int]] = {}  # nodes of a tree stand together
    for i, (t, _) in enumerate(open_nodes):
        spans[t] = (spans.get(t, (i, 0))[0], i + 1)

    def fold(state, batch):
        out = np.zeros((len(open_nodes), k, width, outputs, classes), np.int64) if state is None else state
        bins, labels = _ints(batch, "bins"), _ints(batch, "labels")
        for t, (a, b) in spans.items():
            slot = np.full(len(trees[t].feature), -1)
            slot[[n for _, n in open_nodes[a:b]]] = np.arange(b - a)
            at = slot[trees[t].leaves(bins)]
            rows = np.flatnonzero(at >= 0)
            features, mine = features_of[a:b][at[rows]], out[a:b].reshape(-1)
            for j in range(k):
                cell = (at[rows] * k + j) * width + bins[rows, features[:, j]]
                code = (cell[:, None] * outputs + np.arange(outputs)) * classes + labels[rows]
                mine += np.bincount(code.ravel(), minlength=len(mine))
        return out

    return fold


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Sum of 1 - sum of squared shares over outputs, times the rows; over the last two axes (outputs, classes)."""
    n = counts.sum(axis=-1)
    return (n - (counts.astype(float) ** 2).sum(axis=-1) / np.maximum(n, 1)).sum(axis=-1)


def _record(columns: int, outputs: int, width: int) -> np.dtype:
    """A row of a small node: tree, node, bins and labels."""
    small = np.uint8 if width <= 256 else np.uint16
    return np.dtype([("tree", np.int32), ("node", np.int32), ("bins", small, (columns,)), ("labels", small, (outputs,))])


def _dealt(held: DataFrame, trees: dict[int, Tree], blocks: dict[int, np.ndarray], kind: np.dtype) -> DataFrame:
    """The rows of the open small nodes (``blocks``: the block of each node of a tree, -1 for others), packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, labels = _ints(batch, "bins"), _ints(batch, "labels")
            found, to = [], []
            for t, of in blocks.items():
                node = trees[t].leaves(bins)
                rows = np.flatnonzero(of[node] >= 0)
                mine = np.empty(len(rows), kind)
                mine["tree"], mine["node"], mine["bins"], mine["labels"] = t, node[rows], bins[rows], labels[rows]
                found.append(mine)
                to.append(of[node[rows]])
            every, block = np.concatenate(found), np.concatenate(to)
            order = np.argsort(block, kind="stable")
            every, (each, first) = every[order], np.unique(block[order], return_index=True)
            if len(each):
                packed = [x.tobytes() for x in np.split(every, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array(packed, pa.binary())], names=["block", "rows"])

    return held.mapInArrow(run, "block int, rows binary")


def _splits(columns: int, shape: tuple[int, int, int], kind: np.dtype, bins: Bins, rule: ForestRule):
    """Best random cuts of the nodes of a block."""
    width, outputs, classes = shape
    k = max(1, int(np.sqrt(columns)))

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("rows")])
        nodes, at = np.unique(rows["tree"].astype(np.int64) << 32 | rows["node"], return_inverse=True)
        pairs = [(int(n >> 32), int(n & 0xFFFFFFFF)) for n in nodes]
        picks = np.array([_drawn(rule.seed, t, n).permutation(columns)[:k] for t, n in pairs])
        counts = np.zeros(len(nodes) * k * width * outputs * classes, np.int64)
        for j in range(k):
            cell = (at * k + j) * width + rows["bins"][np.arange(len(rows)), picks[at, j]]
            code = (cell[:, None] * outputs + np.arange(outputs)) * classes + rows["labels"]
            counts += np.bincount(code.ravel(), minlength=len(counts))
        out = []
        for (t, n), mine, pick in zip(pairs, counts.reshape(len(nodes), k, *shape), picks, strict=True):
            best = _best_cut(t, n, mine, pick, bins, rule)
            if best is not None:
                f, cut, left, right = best
                out.append((t, n, f, cut, left.astype(np.int32).tobytes(), right.astype(np.int32).tobytes()))
        found = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(x, field.type) for x, field in zip(found, SPLIT, strict=True)], schema=SPLIT)

    return run


SPLIT = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("left_counts", pa.binary()), ("right_counts", pa.binary())])


def _blocks(trees: dict[int, Tree], nodes: list[tuple[int, int, int]], most: int) -> tuple[dict[int, np.ndarray], int]:
    """The block of each node (tree, node, rows) by tree and node, and how many blocks there are: of some ``BLOCK`` rows and at most ``most`` nodes."""
    out, block, rows, held = {}, 0, 0, 0
    for t, node, n in nodes:
        if held and (rows + n > BLOCK or held >= most):
            block, rows, held = block + 1, 0, 0
        if t not in out:
            out[t] = np.full(len(trees[t].feature), -1, np.int32)
        out[t][node] = block
        rows, held = rows + n, held + 1
    return out, block + 1


def grow_forest(rows: DataFrame, columns: list[str], outputs: list[str], classes: list[int], rule: ForestRule = ForestRule(), bins: int = 32) -> Forest:
    """``outputs`` (class numbers below ``classes``) from ``columns``; a node tries the root of the number of features, each with one random cut.

    Missing features take the training mode. Without rows the trees are single leaves without counts.
    """
    narrow = written(rows.select(*dict.fromkeys([*columns, *outputs])), "features")  # read several times
    spark, n_rows = narrow.sparkSession, narrow.count()
    fitted = fit_bins(narrow, columns, bins)
    binned = fitted.applied(narrow).select("bins", F.array(*[F.col(c).cast("int") for c in outputs]).alias("labels"))
    parts = max(1, min(n_rows // 10_000, 2 * spark.sparkContext.defaultParallelism))
    held = written(binned.repartition(parts), "binned")
    drop(spark, narrow.written_path)
    k = max(1, int(np.sqrt(len(columns))))
    shape = (fitted.width, len(outputs), max(classes))
    kind = _record(len(columns), len(outputs), max(fitted.width, *classes))
    small = k * int(np.prod(shape))  # nodes of fewer rows than cells are split where their rows meet
    size = max(1, rule.most_cells // small)
    # a leaf has ``least`` rows or more, which bounds the nodes of the trees that grow together
    most = min(2 * n_rows // max(rule.least, 1) + 1, 2 << rule.depth)
    together = max(1, rule.most_nodes // most)
    forest = Forest(fitted, classes, rule.trees)
    for first in range(0, rule.trees, together):
        trees = {t: Tree() for t in range(first, min(first + together, rule.trees))}
        todo = [(t, 0, n_rows) for t in trees]
        while todo and n_rows:
            found = {}
            large = [(t, n) for t, n, count in todo if n == 0 or count >= small]
            for a in range(0, len(large), size):
                nodes = large[a : a + size]
                picks = {(t, n): _drawn(rule.seed, t, n).permutation(len(columns))[:k] for t, n in nodes}
                bare = {t: replace(trees[t], value=[]) for t, _ in nodes}  # tasks need no counts
                every = gathered(held, _counted(bare, nodes, picks, shape), lambda x, y: y if x is None else x if y is None else x + y, large=True)
                for (t, n), counts in zip(nodes, every, strict=True):
                    if n == 0:
                        trees[t].value[0] = counts[0].sum(axis=0).astype(np.int32)
                    if n > 0 or _may_split(trees[t].value[0], 0, rule):
                        found[t, n] = _best_cut(t, n, counts, picks[t, n], fitted, rule)
            rest = [x for x in todo if x[1] > 0 and x[2] < small]
            if rest:
                blocks, n_blocks = _blocks(trees, rest, max(1, size // 4))
                dealt = _dealt(held, {t: replace(trees[t], value=[]) for t in blocks}, blocks, kind)
                n_parts = min(n_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
                each = dealt.repartition(n_parts, "block").groupBy("block").applyInArrow(_splits(len(columns), shape, kind, fitted, rule), "tree int, node int, feature int, cut int, left_counts binary, right_counts binary")
                for batch in each.toArrow().to_batches():
                    t, n, f, cut, *sides = (x.to_pylist() for x in batch.columns)
                    left, right = (np.frombuffer(b"".join(x), np.int32).reshape(-1, *shape[1:]) for x in sides)
                    found.update(zip(zip(t, n, strict=True), zip(f, cut, left, right, strict=True), strict=True))
            grown: list[tuple[int, int, int]] = []
            for t, n, _ in todo:
                if (best := found.get((t, n))) is not None:
                    grown += _grown(trees[t], t, n, best, rule)
            todo = grown
        for tree in trees.values():
            tree.value = Counts(tree.value, shape[1:])
        forest.files.append(_saved(spark, list(trees.values())))
    drop(spark, held.written_path)
    return forest


def _may_split(counts: np.ndarray, depth: int, rule: ForestRule) -> bool:
    return bool(depth < rule.depth and counts[0].sum() >= 2 * rule.least and _impurity(counts) > 0)


def _best_cut(t: int, node: int, counts: np.ndarray, picks: np.ndarray, bins: Bins, rule: ForestRule) -> tuple | None:
    """The best of a node's random cuts, if one gains: feature, cut, and the counts of both children."""
    total = counts[0].sum(axis=0)
    whole = _impurity(total)
    rng, best = _drawn(rule.seed, t, node, 1), (0.0, None)
    for j, f in enumerate(picks.tolist()):
        there = np.flatnonzero(counts[j, :, 0].sum(axis=1))
        cuts = bins.cuts[f]
        if len(there) < 2:
            continue
        low, high = there[0], there[-1]
        # a value between the least and the greatest bin, at the resolution of the bins
        place = np.append(cuts, cuts[-1] + 1)
        cut = min(max(int(np.searchsorted(cuts, rng.uniform(place[low], place[high]), "right")) - 1, low), high - 1)
        left = counts[j, : cut + 1].sum(axis=0)
        right = total - left
        if min(left[0].sum(), right[0].sum()) < rule.least:
            continue
        gain = float(whole - _impurity(left) - _impurity(right))
        if gain > best[0] + 1e-12:
            best = gain, (f, int(cut), left, right)
    return best[1]


def _grown(tree: Tree, t: int, node: int, best: tuple, rule: ForestRule) -> list[tuple[int, int, int]]:
    """Splits a node; of its children (tree, node, rows) those that may be split on."""
    f, cut, *sides = best
    tree.value[node] = None
    sides = tuple(x.astype(np.int32) for x in sides)
    children = tree.split(node, f, cut, sides)
    return [(t, child, int(x[0].sum())) for child, x in zip(children, sides, strict=True) if _may_split(x, tree.depth[child], rule)]


def forest_shares(forest: Forest, rows: DataFrame, name: str = "shares") -> DataFrame:
    """``rows`` with the shares of each output's classes."""
    names = rows.columns
    binned = forest.bins.applied(rows, "bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and len(batch):
                held.append(batch)
            if held and (batch is None or sum(map(len, held)) >= ROWS):  # files of trees are read once for all of these
                p = forest.shares(np.concatenate([_ints(x, "bins") for x in held]))
                for one in held:
                    mine, p = p[: len(one)], p[len(one) :]
                    out = [[x[:c].tolist() for x, c in zip(row, forest.classes, strict=True)] for row in mine]
                    yield pa.RecordBatch.from_arrays([*(one.column(one.schema.get_field_index(c)) for c in names), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=[*names, name])
                held = []

    return binned.mapInArrow(run, rows.select("*", F.lit(None).cast("array<array<double>>").alias(name)).schema)


@dataclass(frozen=True)
class BoostRule:
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    least: int = 20
    ridge: float = 1e-3
    most_cells: int = 4_000_000


@dataclass
class Boosted:
    """A sum of trees on the logit of ``chosen``; ``history`` has the mean log loss before each tree."""

    bins: Bins
    start: float
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaves(bins)]
        return out


def _with_logits(held: DataFrame, tree: Tree | None, start: float) -> DataFrame:
    """``held`` with the logits so far: ``start`` at first, then each tree added to them once."""
    if tree is None:
        return written(held.withColumn("logit", F.lit(start)), "logits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                logit = batch.column(2).to_numpy(zero_copy_only=False) + np.array(tree.value)[tree.leaves(_ints(batch, "bins"))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logit)], names=["bins", "y", "logit"])

    return written(held.select("bins", "y", "logit").mapInArrow(run, held.schema), "logits")


def _slopes(tree: Tree, nodes: list[int], width: int):
    """Sums of gradient, curvature and rows (open node x feature x bin) of a batch, in units of 2^-20; and its log loss."""

    def fold(state, batch):
        bins = _ints(batch, "bins")
        y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)
        logit = batch.column(batch.schema.get_field_index("logit")).to_numpy(zero_copy_only=False)
        p = 1 / (1 + np.exp(-logit))
        parts = (np.rint((p - y) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64), np.ones(len(y), np.int64))
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        at = slot[tree.leaves(bins)]
        rows = np.flatnonzero(at >= 0)
        out = np.zeros((3, len(nodes) * bins.shape[1] * width), np.int64)
        for f in range(bins.shape[1]):
            cell = (at[rows] * bins.shape[1] + f) * width + bins[rows, f]
            for part, into in zip(parts, out, strict=True):
                # integers of up to 2^20 are summed exactly as doubles within a batch
                into += np.bincount(cell, part[rows].astype(float), minlength=out.shape[1]).astype(np.int64)
        loss = np.array([int(np.rint((np.logaddexp(0, logit) - y * logit) * UNIT).sum()), len(y)], object)
        mine = (out, loss)
        return mine if state is None else (state[0] + out, state[1] + loss)

    return fold


@dataclass
class _Open:
    """A node's sums, and its best split if it has one."""

    sums: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = 0


def _best_split(sums: np.ndarray, rule: BoostRule) -> _Open:
    """``sums``: (gradient, curvature, rows) x feature x bin; the first of equal splits."""
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    worth = lambda s: (s[0] / UNIT) ** 2 / (s[1] / UNIT + rule.ridge)
    gain = worth(left.astype(float)) + worth(right.astype(float)) - worth(total.astype(float))
    gain = np.where((left[2] >= rule.least) & (right[2] >= rule.least), gain, 0.0)
    if not gain.size or gain.max() <= 1e-9:
        return _Open(total)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return _Open(total, float(gain[f, cut]), int(f), int(cut))


def grow_boosted(rows: DataFrame, columns: list[str], chosen: str, rule: BoostRule = BoostRule(), bins: int = 64) -> Boosted:
    """The log odds of ``chosen`` (0 or 1) as a sum of trees of at most ``leaves``, each grown best split first.

    Best-first growth is replayed with the gains that are known; whenever it
    comes to nodes without one, a job computes all of those. Every row is used.
    """
    narrow = written(rows.select(*dict.fromkeys([*columns, chosen])), "features")  # read several times
    fitted = fit_bins(narrow, columns, bins)
    held = written(fitted.applied(narrow).select("bins", F.col(chosen).cast("int").alias("y")), "binned")
    drop(narrow.sparkSession, narrow.written_path)
    share, n = held.agg(F.avg("y"), F.count(F.lit(1))).first()
    model = Boosted(fitted, 0.0)
    if not n or share in (0.0, 1.0):
        drop(held.sparkSession, held.written_path)
        raise ValueError("chosen and other candidates are needed")
    model.start = float(np.log(share / (1 - share)))
    width, binned = fitted.width, held
    held = _with_logits(binned.repartition(max(1, min(n // 10_000, 2 * held.sparkSession.sparkContext.defaultParallelism))), None, model.start)
    drop(binned.sparkSession, binned.written_path)
    for _ in range(rule.rounds):
        full, known = Tree(), {}

        def measure(nodes: list[int], full=full, known=known, held=held):
            size = max(1, rule.most_cells // (3 * len(columns) * width))
            for a in range(0, len(nodes), size):
                part = nodes[a : a + size]
                found, loss = gathered(held, _slopes(full, part, width), lambda x, y: y if x is None else x if y is None else (x[0] + y[0], x[1] + y[1]))
                found = found.reshape(3, len(part), len(columns), width)
                for i, node in enumerate(part):
                    known[node] = _best_split(found[:, i], rule)
            return loss

        loss = measure([0])
        model.history.append(float(loss[0] / UNIT / loss[1]))
        while True:
            kept, unknown = _replayed(full, known, rule.leaves)
            if not unknown:
                break
            measure(unknown)
        tree = _cut_down(full, known, kept, rule)
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        if len(model.trees) < rule.rounds:
            before, held = held, _with_logits(held, tree, model.start)
            drop(before.sparkSession, before.written_path)
    drop(held.sparkSession, held.written_path)
    return model


def _replayed(full: Tree, known: dict[int, _Open], leaves: int) -> tuple[set[int], list[int]]:
    """Best-first splits as far as gains are known: the split nodes, and the nodes whose gain is needed next.

    Nodes that the growth splits get children in ``full`` when they are first reached.
    """
    heap, split, unknown = [(-known[0].gain, 0)], set(), []
    while heap and len(split) + 1 < leaves:
        gain, node = heapq.heappop(heap)
        if gain >= 0:
            continue
        split.add(node)
        if full.feature[node] < 0:
            full.split(node, known[node].feature, known[node].cut, (None, None))
        for child in (full.left[node], full.right[node]):
            if child in known:
                heapq.heappush(heap, (-known[child].gain, child))
            else:
                unknown.append(child)
    return split, unknown


def _cut_down(full: Tree, known: dict[int, _Open], split: set[int], rule: BoostRule) -> Tree:
    """The tree of the split nodes with the steps of its leaves."""
    tree, place = Tree(), {0: 0}
    step = lambda o: float(-rule.rate * (o.sums[0] / UNIT) / (o.sums[1] / UNIT + rule.ridge))
    tree.value[0] = step(known[0])
    for node in sorted(split):
        left, right = full.left[node], full.right[node]
        place[left], place[right] = tree.split(place[node], full.feature[node], full.cut[node], (step(known[left]), step(known[right])))
    return tree


def boosted_shares(model: Boosted, rows: DataFrame, row: str = "row_id", name: str = "p") -> DataFrame:
    """Candidates with their scores as shares of their row."""
    names = rows.columns
    binned = model.bins.applied(rows, "bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = np.maximum(1 / (1 + np.exp(-model.logits(_ints(batch, "bins")))), 1e-8)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(p)], names=[*names, "score"])

    scored = binned.mapInArrow(run, rows.select("*", F.lit(0.0).alias("score")).schema)
    total = scored.groupBy(row).agg(F.sum("score").alias("total"))
    return scored.join(total, row).select(*names, (F.col("score") / F.col("total")).alias(name))
