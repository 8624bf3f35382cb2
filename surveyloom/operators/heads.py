"""Heads over the options of an item, fitted by mini-batch descent on all executors.

A head is a small set of matrices. Each step sums the gradients of a mini-batch
over the tasks that hold it, merges them as a tree, and changes the matrices on
the driver. Rows never leave the executors, and every row is in one batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions import probs
from surveyloom.operators.gather import gathered
from surveyloom.sources.scratch import drop, fresh_path, written

Parameters = dict[str, np.ndarray]
#: Rows whose arrays are computed at once; a batch has more.
ROWS = 500


@dataclass
class Rows:
    """A block of rows as padded arrays; ``mask`` tells valid options."""

    n: int
    mask: np.ndarray
    options: np.ndarray
    target: np.ndarray | None
    z: np.ndarray | None = None
    log_prior: np.ndarray | None = None
    direct: np.ndarray | None = None
    codes: np.ndarray | None = None
    question: list | None = None


def _padded(lists: pa.Array, width: int, fill: float) -> np.ndarray:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if size.max(initial=0) > width:
        raise ValueError("a row has more options than the head")
    out = np.full((len(lists), width), fill)
    out[np.arange(width) < size[:, None]] = pc.fill_null(pc.list_flatten(lists).cast(pa.float64()), fill).to_numpy(zero_copy_only=False)
    return out


def _matrix(lists: pa.Array) -> np.ndarray:
    return pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _slices(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    return [batch.slice(at, ROWS) for at in range(0, len(batch), ROWS)]


def rows_of(batch: pa.RecordBatch, max_options: int) -> Rows:
    """Arrays of the columns that the batch has: options (a vector for each), answer_index, z, log_prior, direct, codes, question_key."""
    names = batch.schema.names
    get = lambda name, f: f(batch.column(name)) if name in names else None
    options = batch.column("options")
    size = pc.list_value_length(options).to_numpy(zero_copy_only=False)
    if size.min(initial=1) < 1 or size.max(initial=1) > max_options:
        raise ValueError("every row needs from one to max_options options")
    mask = np.arange(max_options) < size[:, None]
    flat = _matrix(pc.list_flatten(options))
    padded = np.zeros((len(batch), max_options, flat.shape[1]))
    padded[mask] = flat
    target = get("answer_index", lambda c: c.to_numpy(zero_copy_only=False).astype(np.int64))
    return Rows(
        len(batch), mask, padded, target, get("z", _matrix), get("log_prior", lambda c: _padded(c, max_options, 0.0)),
        get("direct", lambda c: _padded(c, max_options, 0.0)), get("codes", lambda c: _matrix(c).astype(np.int64)), get("question_key", lambda c: c.to_pylist()),
    )


def masked_log_softmax(scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Log shares of valid options; minus infinity for the others."""
    s = np.where(mask, scores, -np.inf)
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def softplus(x):
    return np.logaddexp(0.0, x)


def unplus(y: float) -> np.ndarray:
    return np.array(np.log(np.expm1(y)))


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def ranked_loss(shares: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranked probability score of each row, and its gradient by the scores under a softmax."""
    n = np.maximum(mask.sum(axis=1), 2)
    cuts = np.arange(mask.shape[1]) < (n - 1)[:, None]
    gap = np.where(cuts, np.cumsum(shares, axis=1) - (np.arange(mask.shape[1]) >= target[:, None]), 0.0)
    by_share = 2 * np.cumsum(gap[:, ::-1], axis=1)[:, ::-1] / (n - 1)[:, None]
    return (gap**2).sum(axis=1) / (n - 1), shares * (by_share - (shares * by_share).sum(axis=1, keepdims=True))


@dataclass
class OptionHead:
    """A head that scores options: ``scores`` with what ``backward`` needs, and the gradient from that of the scores."""

    max_options: int = 11
    rank_weight: float = 0.0  # of the ranked probability score beside the log loss
    seed: int = 1701

    def start(self) -> Parameters:
        raise TypeError("an option head has scores of its own")

    def shares(self, p: Parameters, rows: Rows) -> np.ndarray:
        return np.exp(masked_log_softmax(self.scores(p, rows)[0], rows.mask))

    def losses(self, p: Parameters, rows: Rows) -> np.ndarray:
        log_shares = masked_log_softmax(self.scores(p, rows)[0], rows.mask)
        return -np.maximum(log_shares[np.arange(rows.n), rows.target], np.log(probs.FLOOR))

    def loss_and_gradient(self, p: Parameters, rows: Rows, extra=None) -> tuple[float, Parameters]:
        """Sums over the rows."""
        scores, kept = self.scores(p, rows)
        log_shares = masked_log_softmax(scores, rows.mask)
        shares = np.exp(log_shares)
        at = np.arange(rows.n), rows.target
        loss = -log_shares[at].sum()
        by_score = shares.copy()
        by_score[at] -= 1
        if self.rank_weight:
            ranked, more = ranked_loss(shares, rows.target, rows.mask)
            loss, by_score = loss + self.rank_weight * ranked.sum(), by_score + self.rank_weight * more
        return float(loss), self.backward(p, rows, kept, by_score)

    def _normal(self, rng, *shape: int) -> np.ndarray:
        return rng.normal(size=shape) / np.sqrt(shape[0])

    def _position_gradient(self, rows: Rows, by_score: np.ndarray) -> np.ndarray:
        out = np.zeros((self.max_options + 1, self.max_options))
        np.add.at(out, rows.mask.sum(axis=1), by_score)
        return out


@dataclass
class OptionDecoder(OptionHead):
    """Bilinear scores of respondent and option vectors over a temperature, with a bias by scale length and position and a weighted log prior."""

    z_dim: int = 64
    o_dim: int = 64
    width: int = 8
    temperature: float = 1.0
    prior_weight: float = 0.5
    learn_prior_weight: bool = False

    def start(self) -> Parameters:
        rng = np.random.default_rng(self.seed)
        position = np.zeros((self.max_options + 1, self.max_options))
        return {"z": self._normal(rng, self.z_dim, self.width), "o": self._normal(rng, self.o_dim, self.width), "position": position, "temperature": unplus(self.temperature), "prior": unplus(max(self.prior_weight, 1e-3))}

    def _summary(self, rows: Rows) -> np.ndarray:
        return rows.z

    def _direct(self, rows: Rows) -> np.ndarray | None:
        """Scores that are divided by the temperature beside, not within, the bilinear form."""

    def scores(self, p: Parameters, rows: Rows):
        left, right = self._summary(rows) @ p["z"], rows.options @ p["o"]
        form, direct = np.einsum("np,ncp->nc", left, right), self._direct(rows)
        t = softplus(p["temperature"]) + 1e-4
        scores = form / t if direct is None else direct / t + form
        scores = scores + p["position"][rows.mask.sum(axis=1)] + softplus(p["prior"]) * rows.log_prior
        return scores, (left, right, form if direct is None else direct, t)

    def backward(self, p: Parameters, rows: Rows, kept, by_score: np.ndarray) -> Parameters:
        left, right, heated, t = kept
        by_form = by_score / t if self._direct(rows) is None else by_score
        by_left = np.einsum("nc,ncp->np", by_form, right)
        by_right = by_form[:, :, None] * left[:, None, :]
        return {
            "z": self._summary(rows).T @ by_left,
            "o": np.einsum("nco,ncp->op", rows.options, by_right),
            "position": self._position_gradient(rows, by_score),
            "temperature": np.array(-(by_score * heated).sum() / t**2 * sigmoid(p["temperature"])),
            "prior": np.array((by_score * rows.log_prior).sum() * sigmoid(p["prior"]) * self.learn_prior_weight),
        }


@dataclass
class DirectCalibrator(OptionDecoder):
    """The same on a reader's own shares (``direct``): their logs over a temperature, corrected by a bilinear form of a summary (logs and entropy) and the options."""

    def __post_init__(self):
        self.z_dim = self.max_options + 1

    def _logs(self, rows: Rows) -> np.ndarray:
        p = np.maximum(rows.direct, probs.FLOOR) * rows.mask
        return np.log(np.maximum(p / np.maximum(p.sum(axis=1, keepdims=True), probs.FLOOR), probs.FLOOR))

    def _summary(self, rows: Rows) -> np.ndarray:
        logs = self._logs(rows)
        return np.column_stack([logs, -(np.exp(logs) * logs * rows.mask).sum(axis=1)])

    def _direct(self, rows: Rows) -> np.ndarray:
        return self._logs(rows)


@dataclass
class DemographicBase(OptionHead):
    """A respondent is a mean vector plus a learned one for each demographic code (0: unknown, no vector); options score by dot product."""

    cards: tuple[int, ...] = ()
    dim: int = 64
    penalty: float = 1e-3

    def start(self) -> Parameters:
        rng = np.random.default_rng(self.seed)
        tables = {f"table{j}": self._known(rng.normal(size=(c, self.dim))) for j, c in enumerate(self.cards)}
        return {"mean": np.zeros(self.dim), "position": np.zeros(self.max_options), **tables}

    @staticmethod
    def _known(table: np.ndarray) -> np.ndarray:
        table[0] = 0
        return table

    def state(self, p: Parameters, codes: np.ndarray) -> np.ndarray:
        return p["mean"] + sum(p[f"table{j}"][codes[:, j]] for j in range(len(self.cards)))

    def scores(self, p: Parameters, rows: Rows):
        state = self.state(p, rows.codes)
        return np.einsum("ncd,nd->nc", rows.options, state) + p["position"], None

    def backward(self, p: Parameters, rows: Rows, kept, by_score: np.ndarray) -> Parameters:
        by_state = np.einsum("nc,ncd->nd", by_score, rows.options)
        out = {"mean": by_state.sum(axis=0), "position": by_score.sum(axis=0)}
        for j, c in enumerate(self.cards):
            table = np.zeros((c, self.dim))
            np.add.at(table, rows.codes[:, j], by_state)
            out[f"table{j}"] = self._known(table)
        return out

    def penalised(self, p: Parameters) -> Parameters:
        """The gradient of the squared size of all vectors, which is added once a step."""
        return {k: 2 * self.penalty * v for k, v in p.items() if k != "position"}


@dataclass
class Aligner:
    """Projects respondents next to the options they chose: a linear map plus a gated two-layer one, by contrast with the item's
    other options and with what the other rows of the batch chose.

    Options that others chose are one catalogue with counts, so a row is compared with all of its batch wherever the rows are.
    """

    z_dim: int = 64
    o_dim: int = 64
    width: int = 8
    hidden: int = 16
    temperature: float = 0.1
    across: bool = True
    max_options: int = 11
    seed: int = 1701

    def start(self) -> Parameters:
        rng = np.random.default_rng(self.seed)
        normal = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
        return {
            "line": normal(self.z_dim, self.width), "in": normal(self.z_dim, self.hidden), "in_bias": np.zeros(self.hidden), "out": normal(self.hidden, self.width),
            "out_bias": np.zeros(self.width), "gate": np.array(0.0), "o": normal(self.o_dim, self.width), "temperature": unplus(self.temperature),
        }

    def project(self, p: Parameters, z: np.ndarray) -> np.ndarray:
        return z @ p["line"] + p["gate"] * (_gelu(z @ p["in"] + p["in_bias"])[0] @ p["out"] + p["out_bias"])

    def losses(self, p: Parameters, rows: Rows, extra=None) -> np.ndarray:
        return self._forward(p, rows, extra)[0]

    def _forward(self, p: Parameters, rows: Rows, extra):
        pre = rows.z @ p["in"] + p["in_bias"]
        act, slope = _gelu(pre)
        second = act @ p["out"] + p["out_bias"]
        raw = rows.z @ p["line"] + p["gate"] * second
        u, u_size = _unit(raw)
        v, v_size = _unit(rows.options @ p["o"])
        t = softplus(p["temperature"]) + 1e-4
        within = np.where(rows.mask, np.einsum("nm,ncm->nc", u, v) / t, -np.inf)
        at = np.arange(rows.n), rows.target
        if extra is not None and self.across:
            keys, anchors, counts = extra
            w, w_size = _unit(anchors @ p["o"])
            others = counts - (np.array([keys[q, a] for q, a in zip(rows.question, rows.target.tolist(), strict=True)])[:, None] == np.arange(len(counts)))
            cross = np.where(others > 0, u @ w.T / t + np.log(np.maximum(others, 1)), -np.inf)
        else:
            w = w_size = None
            cross = np.full((rows.n, 0), -np.inf)
        both = np.concatenate([within, cross], axis=1)
        top = both.max(axis=1, keepdims=True)
        e = np.exp(both - top)
        total = e.sum(axis=1, keepdims=True)
        loss = -(within[at] - top[:, 0] - np.log(total[:, 0]))
        return loss, (act, slope, second, u, u_size, v, v_size, w, w_size, t, within, e / total)

    def loss_and_gradient(self, p: Parameters, rows: Rows, extra=None) -> tuple[float, Parameters]:
        loss, (act, slope, second, u, u_size, v, v_size, w, w_size, t, within, shares) = self._forward(p, rows, extra)
        c = rows.mask.shape[1]
        by_within, by_cross = shares[:, :c].copy(), shares[:, c:]
        by_within[np.arange(rows.n), rows.target] -= 1
        by_u = np.einsum("nc,ncm->nm", by_within, v) / t
        heat = (by_within * np.where(rows.mask, within, 0.0)).sum()
        by_o = np.einsum("nco,ncm->om", rows.options, _through_unit(by_within[:, :, None] * u[:, None, :] / t, v, v_size))
        if w is not None:
            by_u += by_cross @ w / t
            heat += (by_cross * (u @ w.T / t)).sum()
            by_o += extra[1].T @ _through_unit(by_cross.T @ u / t, w, w_size)
        by_raw = _through_unit(by_u, u, u_size)
        by_second = p["gate"] * by_raw
        by_pre = (by_second @ p["out"].T) * slope
        return float(loss.sum()), {
            "line": rows.z.T @ by_raw, "in": rows.z.T @ by_pre, "in_bias": by_pre.sum(axis=0), "out": act.T @ by_second, "out_bias": by_second.sum(axis=0),
            "gate": np.array((by_raw * second).sum()), "o": by_o, "temperature": np.array(-heat / t * sigmoid(p["temperature"])),
        }


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times the normal distribution function, by its hyperbolic tangent form, and the slope."""
    a = np.sqrt(2 / np.pi)
    h = np.tanh(a * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + h), 0.5 * (1 + h) + 0.5 * x * (1 - h**2) * a * (1 + 3 * 0.044715 * x**2)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), probs.FLOOR)
    return x / size, size


def _through_unit(by: np.ndarray, unit: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (by - unit * (by * unit).sum(axis=-1, keepdims=True)) / size


@dataclass(frozen=True)
class Descent:
    """Adam over ``epochs`` of ``batches`` mini-batches; stops ``patience`` epochs after the best validation loss and returns the best."""

    epochs: int = 12
    batches: int = 3
    rate: float = 0.02
    first: float = 0.9
    second: float = 0.999
    decay: float = 1e-4
    patience: int = 4
    most_anchors: int = 100_000


@dataclass
class Fitted:
    parameters: Parameters
    history: list[tuple[float, float]] = field(default_factory=list)  # mean training and validation loss of each epoch


def batch_of(key: Column, batches: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches)).cast("int")


def adam(p: Parameters, gradient: Parameters, memory: dict, rule: Descent) -> Parameters:
    """One step; ``memory`` has the running moments and the number of steps."""
    step = memory["step"] = memory.get("step", 0) + 1
    out = {}
    for k, v in p.items():
        g = gradient[k] + rule.decay * v
        m = memory["m", k] = rule.first * memory.get(("m", k), 0.0) + (1 - rule.first) * g
        s = memory["s", k] = rule.second * memory.get(("s", k), 0.0) + (1 - rule.second) * g * g
        out[k] = v - rule.rate * (m / (1 - rule.first**step)) / (np.sqrt(s / (1 - rule.second**step)) + 1e-8)
    return out


def _sum_losses(rows: DataFrame, head, p: Parameters) -> float:
    def fold(state, batch):
        for part in _slices(batch):
            block = rows_of(part, head.max_options)
            found = (float(head.losses(p, block).sum()), block.n)
            state = found if state is None else (state[0] + found[0], state[1] + found[1])
        return state

    total = gathered(rows, fold)
    return total[0] / total[1] if total else float("nan")


def _anchors(rows: DataFrame, batch: int, most: int):
    """The options that rows of a batch chose: place by (question, option), vectors, counts."""
    chosen = rows.where(F.col("batch") == batch).groupBy("question_key", "answer_index").agg(F.count(F.lit(1)).alias("n"), F.first(F.get("options", F.col("answer_index").cast("int"))).alias("v"))
    found = chosen.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("more chosen options than most_anchors: align without comparisons across rows")
    found.sort(key=lambda r: (r["question_key"], r["answer_index"]))
    return {(r["question_key"], r["answer_index"]): i for i, r in enumerate(found)}, np.array([r["v"] for r in found], float), np.array([r["n"] for r in found])


def descend(head, rows: DataFrame, validation: DataFrame | None, key: str, rule: Descent = Descent()) -> Fitted:
    """Fit ``head`` to rows with options (array of vectors), answer_index and what the head reads.

    Rows are dealt to batches by the hash of ``key``, so a run can be repeated.
    Without rows the start is returned; without validation rows the last epoch is.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "batches")
    rows.withColumn("batch", batch_of(F.col(key), rule.batches, 1701)).write.partitionBy("batch").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    dealt = spark.read.schema(schema).parquet(path)
    if validation is not None:
        validation = written(validation, "validation")
    p, memory, history = head.start(), {}, []
    best, best_loss, stale = p, np.inf, 0
    extras = [_anchors(dealt, b, rule.most_anchors) if getattr(head, "across", False) else None for b in range(rule.batches)]
    for _ in range(rule.epochs):
        total, seen = 0.0, 0
        for b in range(rule.batches):

            def fold(state, batch, p=p, extra=extras[b]):
                for part in _slices(batch):
                    block = rows_of(part, head.max_options)
                    loss, gradient = head.loss_and_gradient(p, block, extra)
                    mine = {"loss": loss, "n": block.n, **gradient}
                    state = mine if state is None else {k: state[k] + v for k, v in mine.items()}
                return state

            found = gathered(dealt.where(F.col("batch") == b), fold)
            if found is None:
                continue
            loss, n = found.pop("loss"), found.pop("n")
            gradient = {k: v / n for k, v in found.items()}
            for k, v in getattr(head, "penalised", lambda _: {})(p).items():
                gradient[k] = gradient[k] + v
            p = adam(p, gradient, memory, rule)
            total, seen = total + loss, seen + n
        if not seen:
            break
        score = _sum_losses(validation, head, p) if validation is not None else np.nan
        history.append((total / seen, score))
        if np.isnan(score):
            best = p
        elif score < best_loss - 1e-6:
            best, best_loss, stale = p, score, 0
        else:
            stale += 1
            if stale >= rule.patience:
                break
    drop(spark, path)
    drop(spark, validation.written_path if validation is not None else None)
    return Fitted(best, history)


def _with_array(rows: DataFrame, name: str, compute) -> DataFrame:
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            values = pa.array(compute(batch), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*columns, name])

    return rows.mapInArrow(run, schema)


def predict(head: OptionHead, p: Parameters, rows: DataFrame, name: str = "p") -> DataFrame:
    """``rows`` with the head's shares of each row's options."""

    def shares(batch):
        block = rows_of(batch, head.max_options)
        return [s[m].tolist() for s, m in zip(head.shares(p, block), block.mask, strict=True)]

    return _with_array(rows, name, shares)


def aligned(head: Aligner, p: Parameters, rows: DataFrame, name: str = "aligned") -> DataFrame:
    """``rows`` with the projection of ``z``."""
    return _with_array(rows, name, lambda batch: head.project(p, _matrix(batch.column("z"))).tolist())
