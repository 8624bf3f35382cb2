"""Substring deduplication by words: super-k-mers to buckets, where sorting counts windows exactly.

A window is ``WINDOW`` consecutive words of one document. Runs of windows that
share a minimiser (of ``GRAM`` words) travel as one packed string to the bucket
of the minimiser. There every window is hashed, sorted, and compared word by
word with the first of its run, so that a window is removed only if its words
really start in a document of smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from surveyloom.llm import superkmers as sk
from surveyloom.llm.shared import table

WINDOW = 13
GRAM = 3
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs_of_block(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """Super-k-mers of a block of documents; see superkmers.removed_ranges."""
    inside = ~_separators(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = offsets[:-1][np.diff(offsets) > 0]
    first[opens] = inside[opens]
    at = np.flatnonzero(first)
    n = len(at)
    empty = [np.zeros(0, np.int64)] * 7 + [data[:0]]
    if n < window:
        return empty
    doc = np.searchsorted(offsets, at, "right") - 1
    # the words once more, each followed by one space
    byte_word = np.cumsum(first)[inside] - 1
    low = np.flatnonzero(first[inside]) + np.arange(n)
    block = np.full(len(byte_word) + n, 32, np.uint8)
    block[np.arange(len(byte_word)) + byte_word] = data[inside]
    high = np.concatenate([low[1:], [len(block)]])
    h = sk.range_hashes(block, low, high)
    grams = sk.mix(h[: n - 2] * _ONE + h[1 : n - 1] * _TWO + h[2:])
    bits = max(20, int(n).bit_length())
    mask = np.uint64((1 << bits) - 1)
    keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    least = (sk.least_in_windows(keys, window - GRAM + 1) & mask).astype(np.int64)
    valid = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(valid):
        return empty
    new = np.flatnonzero(np.diff(least[valid], prepend=-1))
    start = valid[new]
    windows = np.diff(np.append(new, len(valid)))
    word0 = np.searchsorted(doc, np.arange(len(ids)))
    where = doc[start]
    gram = grams[least[start]]
    return where, start - word0[where], windows, low[start], high[start + windows + window - 2], gram, ((gram >> np.uint64(32)) & np.uint64(255)).astype(np.uint8), block


def _copies(ids, keys, start, windows, lengths, data, window: int):
    """Ranges of words whose window starts in a smaller document; records ascending by id."""
    ends = np.flatnonzero(data == 32)
    low = np.concatenate([[0], ends[:-1] + 1])
    high = ends + 1
    words = windows.astype(np.int64) + window - 1
    word0 = np.cumsum(words) - words
    many = windows.astype(np.int64)
    rec = np.repeat(np.arange(len(ids)), many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + word0[rec]
    h = sk.range_hashes(sk.range_hashes(data, low, high), at, at + window)
    order = np.argsort(h, kind="stable")
    run = np.cumsum(np.diff(h[order], prepend=~h[order[:1]]) != 0) - 1
    head = order[np.searchsorted(run, np.arange(run[-1] + 1))] if len(run) else order
    of = np.empty(len(order), np.int64)
    of[order] = head[run]
    dup = np.flatnonzero(ids[rec] > ids[rec[of]])
    if not len(dup):
        return None
    used = np.zeros(len(low) + 1, np.int32)
    for x in (at[dup], at[of[dup]]):
        np.add.at(used, x, 1)
        np.add.at(used, x + window, -1)
    used = np.flatnonzero(np.cumsum(used)[:-1])
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(np.append(low, high[-1]).astype(np.int64)), pa.py_buffer(data)])
    word = np.full(len(low), -1, np.int32)
    word[used] = every.take(pa.array(used)).dictionary_encode().indices.to_numpy()
    same = np.ones(len(dup), bool)
    for j in range(window):
        same &= word[at[dup] + j] == word[at[of[dup]] + j]
    if not same.all():  # different windows of equal hash: settle those hashes by their words
        firsts: dict[bytes, int] = {}
        odd = np.flatnonzero(np.isin(h, h[dup[~same]]))
        text = lambda i: data[low[at[i]] : high[at[i] + window - 1]].tobytes()
        for i in odd:
            firsts.setdefault(text(i), int(ids[rec[i]]))
        dup = np.concatenate([dup[~np.isin(dup, odd)], np.array([i for i in odd if ids[rec[i]] > firsts[text(i)]], np.int64)])
    r = rec[dup]
    row = np.cumsum((np.diff(ids, prepend=ids[:1]) != 0) | (np.diff(keys, prepend=keys[:1]) != 0))
    a = start[r] + at[dup] - word0[r]
    row0 = np.searchsorted(row, np.arange(row[-1] + 1))
    d, s, e = sk.merged(row[r], a, a + window)
    return ids[row0[d]], keys[row0[d]], s, e


def _windows_of(columns, data, low, window: int):
    """(run, place, 1, byte start, bytes, hash) of each window; see superkmers.turns."""
    lengths, many = columns[5], columns[3].astype(np.int64)
    data = sk.gather(data, low, lengths)
    ends = np.flatnonzero(data == 32) + 1
    begins = np.concatenate([[0], ends[:-1]])
    words = many + window - 1
    word0 = np.cumsum(words) - words
    run = np.repeat(np.arange(len(low)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at = word0[run] + within
    h = sk.range_hashes(sk.range_hashes(data, begins, ends), at, at + window)
    packed0 = np.cumsum(lengths) - lengths
    return run, within, np.ones(len(run), np.uint8), begins[at] - packed0[run] + low[run], ends[at + window - 1] - begins[at], h


def copies_of_bucket(blobs: list[bytes], window: int = WINDOW) -> Iterator[tuple]:
    for (ids, keys, start, windows, _, lengths), data in sk.turns(blobs, lambda c, d, low: c[4], lambda c, d, low: _windows_of(c, d, low, window)):
        found = _copies(ids, keys, start, windows, lengths, data, window)
        if found:
            yield found


def _result(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
    words = data.tobytes().split()
    if not len(start):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    kept, reach = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        if s > reach:
            kept += words[reach:s]
        reach = max(reach, e)
    kept += words[reach:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: words, removed words, and the digest of the words that stay.

    Null and empty texts have no words. Rows of one id never remove each
    other's words, whatever their texts. An empty table gives no rows; other
    columns are not read.
    """
    return sk.removed_ranges(
        docs, id_col, text_col, lambda i, d, o: runs_of_block(i, d, o, window), lambda b: copies_of_bucket(b, window), _result, window, _DDL, _ARROW
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that 13-word windows of smaller documents cover are removed."""
    return dedup_windows(table(spark, sf_dir, "documents"))
