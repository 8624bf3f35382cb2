"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans.

A word's score for a language is the sum of log probabilities of its character
n-grams (2 to 4, with word ends), from hashed counts over labelled documents.
Languages that hardly use the word's script are no candidates for it. Over the
words of a document the best path pays ``switch`` for each change of language;
its runs are the labelled spans, and the language of most letters is the
document's.

Most documents need no walk: let G be the largest sum by which any stretch of
words prefers some language to the document's best one. A path of m runs gains
at most m G over staying and pays (m - 1) switches, so with G at most half a
switch staying is the best path. That is tested for all documents of a block at
once; only the others are walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.shared import released, table

#: First code points of script ranges and the script that begins there (fixed values of the Unicode standard, coarse).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3130, "hangul"), (0x3190, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS], np.int64)


#: Scripts that are written without spaces; their runs are cut into words of up to four letters.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"


@dataclass(frozen=True)
class LanguageRule:
    """``train_docs`` bounds the labelled sample that the counts come from (whole texts, chosen by hash of the id)."""

    train_docs: int = 20_000
    bits: int = 17
    switch: float = 24.0
    smoothing: float = 0.5
    script_share: float = 0.005


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # [2 ** bits, languages]
    allowed: np.ndarray  # [scripts, languages]
    prior: int
    rule: LanguageRule = field(default_factory=LanguageRule)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Words:
    """The distinct words of a block of texts: n-gram buckets, letters, and the words of each text."""

    def __init__(self, texts: pa.Array, bits: int):
        low = pc.utf8_lower(texts.fill_null(""))
        if pc.any(pc.match_substring_regex(low, UNSPACED)).as_py():
            low = pc.replace_substring_regex(low, f"({UNSPACED}{{1,4}})", r" \1 ")
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(low))
        sizes = pc.list_value_length(split).to_numpy()
        coded = pc.list_flatten(split).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.word = coded.indices.to_numpy()
        self.words_of = sizes.astype(np.int64)
        unique = coded.dictionary
        self.n = len(unique)
        lengths = pc.utf8_length(unique).to_numpy().astype(np.int64) if self.n else np.zeros(0, np.int64)
        points = np.frombuffer("".join(unique.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        of = np.repeat(np.arange(self.n), lengths)
        self.letters = np.bincount(of, letter, self.n).astype(np.int64)
        script = _SCRIPT[np.searchsorted(_STARTS, points, "right") - 1]
        first = np.full(self.n, -1, np.int64)
        at = np.flatnonzero(letter)[::-1]
        first[of[at]] = script[at]
        self.script = first
        # each word between two boundaries; whatever is no letter is a boundary too
        padded = np.zeros(len(points) + 2 * self.n, np.uint64)
        padded[np.arange(len(points)) + 2 * of + 1] = np.where(letter, points, 0)
        of = np.repeat(np.arange(self.n), lengths + 2)
        buckets, owners = [], []
        h = padded + np.uint64(1)
        for k in (2, 3, 4):
            m = len(padded) - k + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + padded[k - 1 :] + np.uint64(k)
            some = (of[:m] == of[k - 1 :]) & ~((padded[:m] == 0) & (padded[1 : m + 1] == 0))
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(64 - bits))[some].astype(np.int64))
            owners.append(of[:m][some])
        self.bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)


def train(labelled: DataFrame, rule: LanguageRule = LanguageRule(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel | None:
    """Counts over labelled rows (at most about ``rule.train_docs``, chosen by hash); None if there are none.

    The counts are summed by Spark; at most 2 ** bits numbers for each language
    and script reach the driver.
    """
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.select(F.count(F.lit(1))).first()[0]
    if not n:
        return None
    if n > rule.train_docs:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit("train"), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * rule.train_docs / n) + 1)
    size = 1 << rule.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in released(batches):
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs):
                    words = Words(part.column(1).filter(pa.array(langs == lang)), rule.bits)
                    often = np.bincount(words.word, minlength=words.n).astype(np.float64)
                    sums = total.setdefault(lang, np.zeros(size + len(_NAMES)))
                    sums[:size] += np.bincount(words.bucket, often[words.owner], size)
                    known = words.script >= 0
                    sums[size:] += np.bincount(words.script[known], (often * words.letters)[known], len(_NAMES))
        for lang, sums in total.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["lang", "slot", "n"])

    sums = labelled.select(lang_col, text_col).mapInArrow(count, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(sums.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    if not languages:
        return None
    table_ = np.zeros((size + len(_NAMES), len(languages)))
    table_[sums.column("slot").to_numpy(), np.searchsorted(languages, names.astype(str))] = sums.column("n").to_numpy()
    grams = table_[:size] + rule.smoothing
    logp = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    scripts = table_[size:]
    allowed = scripts >= rule.script_share * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(languages, logp, allowed, int(np.argmax(scripts.sum(axis=0))), rule)


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels of least cost over words, each change of label costing ``switch``."""
    n, k = scores.shape
    back = np.empty((n, k), np.int16)
    best = scores[0].astype(np.float64).copy()
    own = np.arange(k)
    for t in range(1, n):
        top = int(np.argmax(best))
        stay = best >= best[top] - switch
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - switch) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _weights(totals: np.ndarray, n: int) -> np.ndarray:
    """Shares of the languages by the sums of ``n`` words' scores."""
    logits = totals * min(1.0, 20.0 / n)
    weight = np.exp(logits - logits.max())
    return weight / weight.sum()


def label(texts: pa.Array, model: LanguageModel | None) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text; spans are {start, end, lang} over its words."""
    return [(lang, score, spans) for lang, score, spans, _ in _fitted(texts, model)]


def _fitted(texts: pa.Array, model: LanguageModel | None) -> list[tuple[str, float, list[dict], float]]:
    """What ``label`` gives, and the fit: the mean over letters of how surely each span is of its own language.

    A text of one span has its score; several languages in a text take nothing away.
    """
    if model is None:
        return [("und", 0.0, [], 0.0)] * len(texts)
    words = Words(texts, model.rule.bits)
    k = len(model.languages)
    score = np.zeros((words.n, k))
    for j in range(k):
        score[:, j] = np.bincount(words.owner, model.logp[words.bucket, j], words.n) if words.n else 0
    # languages that do not use a word's script fall behind by as much as a switch; if none uses it, the word says nothing
    use = np.where(words.script[:, None] >= 0, model.allowed[words.script], False)
    score *= 0.5
    low = np.where(use, score, np.inf).min(axis=1, initial=np.inf, where=use)
    some = use.any(axis=1)
    score = np.where(use, score, np.where(some, low - model.rule.switch, 0)[:, None])
    score[~some] = 0
    score -= score.max(axis=1, keepdims=True) if words.n else 0
    n_docs, sizes = len(words.words_of), words.words_of
    doc = np.repeat(np.arange(n_docs), sizes)
    s, letters = score[words.word], words.letters[words.word]
    totals = np.stack([np.bincount(doc, s[:, j], n_docs) for j in range(k)], axis=1)
    best = np.where((totals == totals.max(axis=1, keepdims=True))[:, model.prior], model.prior, totals.argmax(axis=1))
    n_letters = np.bincount(doc, letters, n_docs)
    # the largest gain of a stretch of words in another language than the best
    gain = np.zeros(n_docs)
    filled = np.flatnonzero(sizes)
    cuts = (np.cumsum(sizes) - sizes)[filled]
    if len(doc):
        mine = s[np.arange(len(doc)), best[doc]]
        far = np.arange(n_docs)[doc] * 1e7
        for j in range(k):
            d = s[:, j] - mine
            after = np.cumsum(d)
            lowest = np.minimum.accumulate(after - d - far) + far
            gain[filled] = np.maximum(gain[filled], np.maximum.reduceat(after - lowest, cuts))
    out = []
    first = np.cumsum(sizes) - sizes
    for i in range(n_docs):
        n = int(sizes[i])
        if not n_letters[i]:
            out.append(("und", 0.0, [], 0.0))
            continue
        weight = _weights(totals[i], n)
        if gain[i] <= model.rule.switch / 2:
            lang, share = int(best[i]), 1.0
            spans = [{"start": 0, "end": n, "lang": model.languages[lang]}]
            fit = weight[lang]
        else:
            at = slice(first[i], first[i] + n)
            path = best_path(s[at], model.rule.switch)
            held = np.bincount(path, letters[at], k)
            lang = int(best[i]) if held[best[i]] == held.max() else int(held.argmax())
            share = held[lang] / n_letters[i]
            cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), n]
            spans = [{"start": a, "end": b, "lang": model.languages[path[a]]} for a, b in zip(cut, cut[1:], strict=False)]
            fit = sum(_weights(s[at][a:b].sum(axis=0), b - a)[path[a]] * letters[at][a:b].sum() for a, b in zip(cut, cut[1:], strict=False)) / n_letters[i]
        out.append((model.languages[lang], float(min(1.0, max(0.0, weight[lang] * share if lang == best[i] else share * 0.5))), spans, float(fit)))
    return out


_ROWS = pa.schema(
    [("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]
)
_DDL = "id bigint, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``lang_pred`` (``und`` without letters or without a model), ``score`` and ``spans``.

    The model (a table of fixed size) is sent to the workers once. Null texts
    have no letters; null and repeated ids are labelled like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for i in range(0, len(batch), 400):
                part = batch.slice(i, 400)
                langs, scores, spans = zip(*label(part.column(1), shared.value), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, f.type) for x, f in zip((langs, scores, spans), list(_ROWS)[1:], strict=True)]], schema=_ROWS)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, _DDL)


def identified(docs: DataFrame, model: LanguageModel | None, least: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of no language (``und``) or whose spans fit their languages below ``least``; no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for i in range(0, len(batch), 400):
                part = batch.slice(i, 400)
                yield part.filter(pa.array([lang != "und" and fit >= least for lang, _, _, fit in _fitted(part.column(at), shared.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "spans")
