"""Choice models with a trait for each respondent, fitted by turns.

Answers are held as one row a respondent (items, answers), cut into blocks. A
respondent's trait depends on the items' parameters only, so it is updated
where the respondent is; items' parameters depend on sums over respondents,
which are merged as a tree. Every step maximises a quadratic lower bound of
the penalised likelihood (the curvature of a softmax is at most one half), so
the likelihood never falls. The items' parameters pass through the driver and
travel with the functions; ``most_items`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.operators.gather import gathered
from surveyloom.operators.joins import require_unique
from surveyloom.sources.scratch import drop, written

BLOCK = 1000  # respondents whose arrays are held at a time


@dataclass(frozen=True)
class TraitRule:
    dims: int = 2
    rounds: int = 20
    inner: int = 3
    precision: float = 1.0
    ridge: float = 1.0
    settle: float = 1e-5
    spread: float = 0.5
    seed: int = 1701
    most_items: int = 200_000


@dataclass
class TraitModel:
    """``loadings``: items x options x (1 + dims), the intercept first; ``weights``: features x dims, the expected trait of a feature."""

    items: dict[str, int]
    sizes: np.ndarray
    loadings: np.ndarray
    weights: np.ndarray
    rule: TraitRule
    history: list[float] = field(default_factory=list)

    def log_shares(self, theta: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Log shares of options: theta (n x dims), item (n x m) to n x m x options."""
        a = self.loadings[item]
        s = a[..., 0] + np.einsum("nmcd,nd->nmc", a[..., 1:], theta)
        s = np.where(np.arange(s.shape[-1]) < self.sizes[item][..., None], s, -np.inf)
        s -= s.max(axis=-1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=-1, keepdims=True))

    def expected(self, codes: np.ndarray) -> np.ndarray:
        """The trait that features (n x k codes, negative: none) let expect."""
        known = codes >= 0
        return np.where(known[..., None], self.weights[np.maximum(codes, 0)], 0.0).sum(axis=1) if codes.shape[1] else np.zeros((len(codes), self.rule.dims))


def catalogue(rows: DataFrame, most: int) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the items by name, and their numbers of options."""
    found = rows.groupBy("question_key").agg(F.max("n_options").alias("n")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} items")
    found.sort(key=lambda r: r["question_key"])
    return {r["question_key"]: i for i, r in enumerate(found)}, np.array([r["n"] for r in found], np.int64)


def numbered(rows: DataFrame, items: dict[str, int]) -> DataFrame:
    """``item`` of each row; an unknown question fails."""
    spark = rows.sparkSession
    known = spark.createDataFrame(list(items.items()), "question_key string, item int")
    missing = F.raise_error(F.concat(F.lit("no parameters for "), F.coalesce("question_key", F.lit("a null question"))))
    return rows.join(known, "question_key", "left").withColumn("item", F.coalesce("item", missing.cast("int")))


def by_respondent(rows: DataFrame, items: dict[str, int], codes: list[str]) -> DataFrame:
    """panel_id, items, answers, codes: a row a respondent; a repeated answer fails, so rows are as long as the catalogue at most."""
    kept = require_unique(numbered(rows, items), ["panel_id", "question_key"])
    pairs = F.array_sort(F.collect_list(F.struct("item", F.col("answer_index").cast("int").alias("a"))))
    features = F.array(*[F.coalesce(F.first(c).cast("int"), F.lit(-1)) for c in codes]) if codes else F.array().cast("array<int>")
    out = kept.groupBy("panel_id").agg(pairs.alias("p"), features.alias("codes"))
    return out.select("panel_id", F.col("p.item").alias("items"), F.col("p.a").alias("answers"), "codes")


def _block(batch: pa.RecordBatch):
    """Padded items and answers, a mask, and codes of up to BLOCK respondents."""
    items, answers, codes = (batch.column(batch.schema.get_field_index(c)) for c in ("items", "answers", "codes"))
    size = pc.list_value_length(items).to_numpy(zero_copy_only=False)
    mask = np.arange(max(1, size.max(initial=0))) < size[:, None]
    item, answer = np.zeros(mask.shape, np.int64), np.zeros(mask.shape, np.int64)
    item[mask], answer[mask] = pc.list_flatten(items).to_numpy(), pc.list_flatten(answers).to_numpy()
    return mask, item, answer, pc.list_flatten(codes).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)


def _traits(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("theta"))
    return pc.list_flatten(column).to_numpy().reshape(len(batch), -1)


def _improved(model: TraitModel, theta: np.ndarray, mask, item, answer, codes, steps: int) -> np.ndarray:
    """Traits after ``steps`` bounded Newton steps."""
    rule, prior = model.rule, model.expected(codes)
    a = model.loadings[item][..., 1:]
    valid = (np.arange(a.shape[2]) < model.sizes[item][..., None]) & mask[..., None]
    a = np.where(valid[..., None], a, 0.0)
    centred = np.where(valid[..., None], a - a.sum(axis=2, keepdims=True) / np.maximum(valid.sum(axis=2), 1)[..., None, None], 0.0)
    bound = 0.5 * np.einsum("nmcd,nmce->nde", centred, centred) + rule.precision * np.eye(rule.dims)
    chosen = np.take_along_axis(a, answer[..., None, None], axis=2)[:, :, 0]
    for _ in range(steps):
        p = np.where(valid, np.exp(model.log_shares(theta, item)), 0.0)
        g = chosen.sum(axis=1) - np.einsum("nmc,nmcd->nd", p, a) - rule.precision * (theta - prior)
        theta = theta + np.linalg.solve(bound, g[..., None])[..., 0]
    return theta


def with_traits(blocks: DataFrame, model: TraitModel, steps: int, start: bool = False) -> DataFrame:
    """``blocks`` with ``theta`` improved by ``steps``, from what their features let expect if ``start``."""
    names = [c for c in blocks.columns if c != "theta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                mask, item, answer, codes = _block(part)
                theta = _improved(model, model.expected(codes) if start else _traits(part), mask, item, answer, codes, steps)
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(theta.tolist(), pa.list_(pa.float64()))], names=[*names, "theta"])

    return blocks.mapInArrow(run, blocks.select(*names, F.lit(None).cast("array<double>").alias("theta")).schema)


def _item_sums(model: TraitModel):
    """What the items' step needs of a batch: penalised likelihood, gradients, trait products, and products with features."""

    def fold(state, batch):
        rule = model.rule
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            mask, item, answer, codes = _block(part)
            theta = _traits(part)
            n, options = len(theta), model.loadings.shape[1]
            f = np.column_stack([np.ones(n), theta])
            logs = model.log_shares(theta, item)
            likelihood = np.take_along_axis(logs, answer[..., None], axis=2)[..., 0][mask].sum()
            gap = theta - model.expected(codes)
            rest = -np.exp(logs)
            np.put_along_axis(rest, answer[..., None], np.take_along_axis(rest, answer[..., None], axis=2) + 1, axis=2)
            who, at_item = np.nonzero(mask)[0], item[mask]
            g = np.zeros((len(model.sizes), options, rule.dims + 1))
            s = np.zeros((len(model.sizes), rule.dims + 1, rule.dims + 1))
            np.add.at(g, at_item, rest[mask][:, :, None] * f[who][:, None, :])
            np.add.at(s, at_item, f[who][:, :, None] * f[who][:, None, :])
            hot = np.zeros((n, len(model.weights)))
            for k in range(codes.shape[1]):
                known = codes[:, k] >= 0
                hot[known.nonzero()[0], codes[known, k]] += 1
            mine = (likelihood - 0.5 * rule.precision * (gap**2).sum(), g, s, hot.T @ hot, hot.T @ theta)
            state = mine if state is None else tuple(a + b for a, b in zip(state, mine, strict=True))
        return state

    return fold


def _items_step(model: TraitModel, sums) -> TraitModel:
    rule = model.rule
    _, g, s, xx, xt = sums
    g = g - rule.ridge * model.loadings
    bound = 0.5 * s + rule.ridge * np.eye(rule.dims + 1)
    step = np.linalg.solve(bound, np.swapaxes(g, 1, 2))
    valid = np.arange(model.loadings.shape[1]) < model.sizes[:, None]
    loadings = np.where(valid[..., None], model.loadings + np.swapaxes(step, 1, 2), 0.0)
    weights = np.linalg.solve(rule.precision * xx + rule.ridge * np.eye(len(xx)), rule.precision * xt) if len(xx) else model.weights
    return TraitModel(model.items, model.sizes, loadings, weights, rule, model.history)


def penalty(model: TraitModel) -> float:
    return 0.5 * model.rule.ridge * ((model.loadings**2).sum() + (model.weights**2).sum())


def fit_traits(rows: DataFrame, rule: TraitRule = TraitRule(), codes: list[str] | None = None, features: int = 0) -> tuple[TraitModel, DataFrame]:
    """L9 with ``codes`` (columns of feature numbers below ``features``), L8 without: the model and its respondents with ``theta``.

    ``rows``: panel_id, question_key, answer_index, n_options. Rounds go on until the penalised likelihood
    (``history``) grows by less than a share of ``settle``. Traits start at hashed numbers, as zeros would stay zeros.
    """
    codes = codes or []
    items, sizes = catalogue(rows, rule.most_items)
    model = TraitModel(items, sizes, np.zeros((len(sizes), int(sizes.max(initial=1)), rule.dims + 1)), np.zeros((features, rule.dims)), rule)
    unit = lambda d: (F.pmod(F.xxhash64(F.lit(rule.seed), F.lit(d), F.col("panel_id")), F.lit(1 << 20)).cast("double") + 0.5) / (1 << 20) - 0.5
    start = by_respondent(rows, items, codes).withColumn("theta", F.array(*[unit(d) * 2 * rule.spread for d in range(rule.dims)]))
    held = written(start, "traits")
    for _ in range(rule.rounds):
        sums = gathered(held, _item_sums(model))
        if sums is None:
            break
        model.history.append(float(sums[0] - penalty(model)))
        if len(model.history) > 2 and model.history[-1] - model.history[-2] <= rule.settle * abs(model.history[-2]):
            break
        model = _items_step(model, sums)
        after = written(with_traits(held, model, rule.inner), "traits")
        drop(held.sparkSession, held.written_path)
        held = after
    return model, held


def trait_shares(targets: DataFrame, traits: DataFrame, model: TraitModel, name: str = "p") -> DataFrame:
    """``targets`` (panel_id, question_key) with the shares of their options; an unknown question or respondent fails."""
    known = numbered(targets, model.items).join(traits.select("panel_id", "theta"), "panel_id", "left")
    missing = F.raise_error(F.concat(F.lit("no trait for "), F.coalesce(F.col("panel_id").cast("string"), F.lit("a null panel")))).cast("array<double>")
    known = known.withColumn("theta", F.coalesce("theta", missing))
    names = [c for c in known.columns if c not in ("theta", "item")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            item = batch.column(batch.schema.get_field_index("item")).to_numpy().astype(np.int64)
            p = np.exp(model.log_shares(_traits(batch), item[:, None])[:, 0])
            shares = [x[:n].tolist() for x, n in zip(p, model.sizes[item].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(shares, pa.list_(pa.float64()))], names=[*names, name])

    return known.mapInArrow(run, known.select(*names, F.lit(None).cast("array<double>").alias(name)).schema)


def held_out(rows: DataFrame, seed: int) -> DataFrame:
    """``place`` of each answer of a respondent by hash, from 1."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), "panel_id", "question_key"), 256)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("panel_id").orderBy(order, "question_key")))


@dataclass(frozen=True)
class PersonaRule:
    personas: int = 4
    rounds: int = 25
    inner: int = 4
    decay: float = 1.0
    patience: int = 4
    seed: int = 1701
    most_items: int = 200_000


@dataclass
class PersonaHead:
    """A mixture of personas over items with option vectors: theta (personas x rank), bias by position, shares of personas."""

    items: dict[str, int]
    sizes: np.ndarray
    vectors: np.ndarray
    theta: np.ndarray
    bias: np.ndarray
    mixture: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)

    def conditionals(self) -> np.ndarray:
        """Log shares of options: items x personas x options."""
        s = np.einsum("icr,mr->imc", self.vectors, self.theta) + self.bias
        s = np.where((np.arange(s.shape[2]) < self.sizes[:, None])[:, None], s, -np.inf)
        s -= s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))


def _posterior(logs: np.ndarray, mixture: np.ndarray, mask, item, answer) -> tuple[np.ndarray, np.ndarray]:
    """Shares of personas of each respondent, and the log likelihood of the answers; ``mixture`` is one for all or one for each."""
    each = np.where(mask[..., None], logs[item, :, answer], 0.0).sum(axis=1) + np.log(mixture)
    top = each.max(axis=1, keepdims=True)
    total = np.exp(each - top).sum(axis=1, keepdims=True)
    return np.exp(each - top) / total, (top + np.log(total))[:, 0]


def _expected_counts(head: PersonaHead, logs: np.ndarray):
    def fold(state, batch):
        for at in range(0, len(batch), BLOCK):
            mask, item, answer, _ = _block(batch.slice(at, BLOCK))
            share, likelihood = _posterior(logs, head.mixture, mask, item, answer)
            counts = np.zeros((*head.vectors.shape[:2], len(head.mixture)))
            np.add.at(counts, (item[mask], answer[mask]), share[np.nonzero(mask)[0]])
            mine = (likelihood.sum(), counts, share.sum(axis=0), len(mask))
            state = mine if state is None else tuple(a + b for a, b in zip(state, mine, strict=True))
        return state

    return fold


def _persona_step(head: PersonaHead, counts: np.ndarray, shares: np.ndarray, rule: PersonaRule) -> PersonaHead:
    """Raises the expected likelihood of the counts (items x options x personas) by bounded Newton steps."""
    n = np.swapaxes(counts, 1, 2)
    total = n.sum(axis=2)
    valid = np.arange(head.vectors.shape[1]) < head.sizes[:, None]
    x = np.where(valid[..., None], head.vectors, 0.0)
    centred = np.where(valid[..., None], x - x.sum(axis=1, keepdims=True) / np.maximum(valid.sum(axis=1), 1)[:, None, None], 0.0)
    bound = 0.5 * np.einsum("im,icr,ics->mrs", total, centred, centred) + rule.decay * np.eye(x.shape[2])
    theta, bias = head.theta, head.bias
    for _ in range(rule.inner):
        now = PersonaHead(head.items, head.sizes, head.vectors, theta, bias, head.mixture)
        rest = n - total[..., None] * np.exp(now.conditionals())
        theta = theta + np.linalg.solve(bound, (np.einsum("imc,icr->mr", rest, x) - rule.decay * theta)[..., None])[..., 0]
        now = PersonaHead(head.items, head.sizes, head.vectors, theta, bias, head.mixture)
        rest = n - total[..., None] * np.exp(now.conditionals())
        bias = bias + (rest.sum(axis=(0, 1)) - rule.decay * bias) / (0.5 * total.sum() + rule.decay)
    mixture = (shares + 1) / (shares.sum() + len(shares))
    return PersonaHead(head.items, head.sizes, head.vectors, theta, bias, mixture, head.history)


def persona_posteriors(head: PersonaHead, known: DataFrame, name: str = "posterior") -> DataFrame:
    """panel_id and the shares of personas that its answers speak for."""
    logs = head.conditionals()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                share, _ = _posterior(logs, head.mixture, *_block(part)[:3])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(share.tolist(), pa.list_(pa.float64()))], names=["panel_id", name])

    return by_respondent(known, head.items, []).mapInArrow(run, f"panel_id string, {name} array<double>")


def mixed_shares(head: PersonaHead, known: DataFrame, targets: DataFrame, name: str = "p", priors: DataFrame | None = None) -> DataFrame:
    """``targets`` with shares of options mixed by the personas that the answers in ``known`` speak for; without answers by the prior.

    ``priors`` (panel_id, prior: a share for each persona) stands for the mixture where a panel has one. Personas that a prior leaves out keep a share of 1e-6.
    """
    logs, personas = head.conditionals(), len(head.mixture)
    blocks = by_respondent(known, head.items, [])
    wanted = numbered(targets, head.items).join(blocks.select("panel_id", "items", "answers", "codes"), "panel_id", "left")
    empty = F.array().cast("array<int>")
    wanted = wanted.withColumns({c: F.coalesce(c, empty) for c in ("items", "answers", "codes")})
    mixture = F.array(*[F.lit(float(x)) for x in head.mixture])
    if priors is not None:
        wanted = wanted.join(require_unique(priors.select("panel_id", F.col("prior").alias("_prior")), ["panel_id"]), "panel_id", "left")
        given = F.transform(F.sequence(F.lit(0), F.lit(personas - 1)), lambda i: F.greatest(F.coalesce(F.get("_prior", i), F.lit(0.0)), F.lit(1e-6)))
        mixture = F.when(F.col("_prior").isNull(), mixture).otherwise(given)
    wanted = wanted.withColumn("_mixture", mixture)
    names = targets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                mask, item, answer, _ = _block(part)
                prior = pc.list_flatten(part.column(part.schema.get_field_index("_mixture"))).to_numpy().reshape(len(part), -1)
                share, _ = _posterior(logs, prior, mask, item, answer)
                asked = part.column(part.schema.get_field_index("item")).to_numpy().astype(np.int64)
                p = np.einsum("nm,nmc->nc", share, np.exp(logs[asked]))
                p /= p.sum(axis=1, keepdims=True)
                out = [x[:k].tolist() for x, k in zip(p, head.sizes[asked].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, name])

    return wanted.mapInArrow(run, targets.select("*", F.lit(None).cast("array<double>").alias(name)).schema)


def fit_personas(rows: DataFrame, options: DataFrame, rule: PersonaRule = PersonaRule(), validation: tuple[DataFrame, DataFrame] | None = None) -> PersonaHead:
    """Expectation and maximisation by turns; ``options``: question_key, options (a vector for each).

    ``history`` has the penalised training likelihood and the validation loss of each round. ``validation`` is a pair of
    known answers and targets; the round of least loss is returned, ``patience`` rounds after it nothing more is tried.
    """
    items, sizes = catalogue(rows, rule.most_items)
    wanted = options.join(options.sparkSession.createDataFrame([(k,) for k in items], "question_key string"), "question_key", "left_semi")
    vectors = {r["question_key"]: r["options"] for r in wanted.collect()}  # as many as items
    rank = len(next(iter(vectors.values()))[0]) if vectors else 1
    x = np.zeros((len(items), int(sizes.max(initial=1)), rank))
    for key, i in items.items():
        if key not in vectors or len(vectors[key]) < sizes[i]:
            raise ValueError(f"no vectors for the options of {key}")
        x[i, : sizes[i]] = vectors[key][: sizes[i]]
    rng = np.random.default_rng(rule.seed)
    head = PersonaHead(items, sizes, x, 0.1 * rng.normal(size=(rule.personas, rank)), np.zeros(x.shape[1]), np.full(rule.personas, 1 / rule.personas))
    blocks = written(by_respondent(rows, items, []), "answers")
    if validation is not None:
        validation = tuple(written(v, "validation") for v in validation)
    best, least, stale = head, np.inf, 0
    for _ in range(rule.rounds):
        sums = gathered(blocks, _expected_counts(head, head.conditionals()))
        if sums is None:
            break
        likelihood, counts, shares, _ = sums
        likelihood += np.log(head.mixture).sum() - 0.5 * rule.decay * ((head.theta**2).sum() + (head.bias**2).sum())
        loss = np.nan
        if validation is not None:
            shown = mixed_shares(head, *validation)
            loss = shown.agg(F.avg(-F.log(F.greatest(F.get("p", F.col("answer_index").cast("int")), F.lit(probs.FLOOR))))).first()[0]
            loss = np.nan if loss is None else loss
        head.history.append((float(likelihood), float(loss)))
        if np.isnan(loss):
            best = head
        elif loss < least - 1e-6:
            best, least, stale = head, loss, 0
        else:
            stale += 1
            if stale >= rule.patience:
                break
        head = _persona_step(head, counts, shares, rule)
    drop(blocks.sparkSession, blocks.written_path)
    for v in validation or ():
        drop(v.sparkSession, v.written_path)
    return head if np.isinf(least) else PersonaHead(best.items, best.sizes, best.vectors, best.theta, best.bias, best.mixture, head.history)
