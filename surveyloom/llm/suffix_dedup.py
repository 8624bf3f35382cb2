"""Substring deduplication by bytes: longest previous factors from the order of suffixes.

Equal 50-byte strings are first brought together by minimiser (superkmers).
Within a part of a bucket, suffixes whose first 50 bytes share their hash with
no other document cannot match and are left out. The others are put in suffix
order by prefix doubling (4, 8, 16, 32 bytes, then two overlapping 32-byte ranks
for 50). In that order a suffix's longest earlier match is the longer one of its
common prefixes with the previous and the next suffix of a smaller document.
Only matches of 50 bytes or more remove anything, so suffixes are ordered by 50
bytes, and a smaller neighbour counts if nothing between shares less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from surveyloom.llm import superkmers as sk
from surveyloom.llm.shared import table

U = np.uint64
WINDOW = 50
GRAM = 8


def _ranked(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each in order differs from the one before) of keys of ``bits`` bits; ties keep their order."""
    n = len(keys)
    low = max(1, n.bit_length())
    if bits + low <= 64:  # key and index fit one number: sorting numbers is far cheaper than sorting indices
        both = np.sort(keys << U(low) | np.arange(n, dtype=U))
        order, keys = (both & U((1 << low) - 1)).astype(np.int64), both >> U(low)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, new


def suffix_order(text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start ``at``, in the order of their first ``window`` (32 to 64) bytes, by prefix doubling.

    Ties keep the order of ``at``. The second array says where fewer than
    ``window`` bytes are shared with the suffix before. ``at + window`` lies
    within the text.
    """
    rank = np.zeros(max(len(text) - 3, 0), U)
    for j in range(4):
        rank = rank << U(8) | text[j : j + len(rank)]
    bits = 32
    for k in (4, 8, 16, 32):
        order, new = _ranked(rank, bits)
        number = (np.cumsum(new) - 1).astype(U)
        rank = np.empty(len(order), U)
        rank[order] = number
        width = max(1, int(number[-1]).bit_length()) if len(number) else 1
        step = k if k < 32 else window - 32
        if k == 32:
            return _ranked(rank[at] << U(width) | rank[at + step], 2 * width)
        rank = rank[: len(rank) - step] << U(width) | rank[step:]
        bits = 2 * width
    raise AssertionError


def previous_smaller(value: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one of smaller value in its segment (first places flagged), or -1.

    All that lies between a place and its pointer is at least as large as its
    own value, so a pointer may follow the pointer of where it points.
    """
    to = np.arange(-1, len(value) - 1)
    to[segment] = -1
    open_ = np.flatnonzero(to >= 0)
    while len(open_ := open_[value[to[open_]] >= value[open_]]):
        to[open_] = to[to[open_]]
        open_ = open_[to[open_] >= 0]
    return to


def next_smaller(value: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """As previous_smaller, towards the end; len(value) if there is none."""
    last = np.append(segment[1:], True)
    return len(value) - 1 - previous_smaller(value[::-1], last[::-1])[::-1]


def longest_previous(text: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For every suffix, the length of its longest match in a smaller document, cut at ``window``; shorter ones count as 0.

    ``owner`` is the document of each suffix. The longest earlier match of a
    suffix is the longer one of its common prefixes with the previous and the
    next suffix of a smaller document in suffix order.
    """
    order, apart = suffix_order(text, at, window)
    value = owner[order]
    found = previous_smaller(value, apart) >= 0
    # ties come in the order of the documents if ``at`` does; then no smaller document follows in a segment
    if ((value[1:] < value[:-1]) & ~apart[1:]).any():
        found |= next_smaller(value, apart) < len(value)
    length = np.zeros(len(at), np.int64)
    length[order[found]] = window
    return length


def runs_of_block(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """Super-k-mers of a block of documents; see superkmers.removed_ranges."""
    n = len(data)
    empty = [np.zeros(0, np.int64)] * 7 + [data[:0]]
    if n < window:
        return empty
    # GRAM bytes as numbers by doubling: 1, 2, 4, 8; then hashed
    h = data.astype(U)
    for k in (1, 2, 4):
        h = h[:-k] << U(8 * k) | h[k:]
    grams, m = sk.mix(h), n - GRAM + 1
    bits = max(20, n.bit_length())
    mask = np.uint64((1 << bits) - 1)
    least = (sk.least_in_windows((grams & ~mask) | np.arange(m, dtype=np.uint64), window - GRAM + 1) & mask).astype(np.int64)
    size = np.diff(offsets)
    many = np.maximum(size - window + 1, 0)
    valid = np.repeat(offsets[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    if not len(valid):
        return empty
    new = np.flatnonzero(np.diff(least[valid], prepend=-1))
    start = valid[new]
    windows = np.diff(np.append(new, len(valid)))
    doc = np.searchsorted(offsets, start, "right") - 1
    gram = grams[least[start]]
    return doc, start - offsets[doc], windows, start, start + windows + window - 1, gram, least[start] - start, data


def _shared(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the hashes that several owners have (high bits of the hash decide: a few more may come along)."""
    low = max(1, len(h).bit_length())
    mask = U((1 << low) - 1)
    both = np.sort((h & ~mask) | np.arange(len(h), dtype=U))
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = (both[1:] ^ both[:-1]) > mask
    many = ~(new[:-1] & new[1:])
    place, first = (both[many] & mask).astype(np.int64), np.flatnonzero(new[:-1][many])
    if not len(place):
        return place
    who = owner[place]
    several = np.minimum.reduceat(who, first) < np.maximum.reduceat(who, first)
    return np.sort(place[np.repeat(several, np.diff(np.append(first, len(place))))])


def _copies(ids, keys, start, windows, lengths, data, window: int):
    """Ranges of bytes covered by strings that start in a smaller document; records ascending by id.

    Only suffixes whose first ``window`` bytes have a hash in common with
    another document enter the suffix order; the others have no match of
    that length.
    """
    low, windows = np.cumsum(lengths) - lengths, windows.astype(np.int64)
    rec = np.repeat(np.arange(len(ids), dtype=np.int32), windows)
    at = np.repeat(low - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0, dtype=np.int32)
    keep = _shared(sk.range_hashes(data, at, at + window), owner[rec])
    if not len(keep):
        return None
    at, rec = at[keep], rec[keep]
    # their bytes, once: windows that touch are one stretch
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] > at[:-1] + 1
    head = np.flatnonzero(begins)
    tail = np.append(head[1:], len(at)) - 1
    size = at[tail] - at[head] + window
    text = sk.gather(data, at[head], size)
    stretch = np.cumsum(begins) - 1
    place = at - at[head][stretch] + (np.cumsum(size) - size)[stretch]
    dup = np.flatnonzero(longest_previous(text, place, owner[rec], window) >= window)
    if not len(dup):
        return None
    r = rec[dup]
    row = np.cumsum((np.diff(ids, prepend=ids[:1]) != 0) | (np.diff(keys, prepend=keys[:1]) != 0))
    row0 = np.searchsorted(row, np.arange(row[-1] + 1))
    a = start[r] + at[dup] - low[r]
    d, s, e = sk.merged(row[r], a, a + window)
    return ids[row0[d]], keys[row0[d]], s, e


def _slot_of(columns, data, low) -> np.ndarray:
    """A number of the minimiser's bytes."""
    at = low + columns[4]
    gram = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        gram = (gram << np.uint64(8)) | data[at + j]
    return (sk.mix(gram) >> np.uint64(20)) & np.uint64(4095)


def _windows_of(columns, data, low, window: int):
    """(run, place, 1, byte start, bytes, hash) of each window; see superkmers.turns."""
    lengths, many = columns[5], columns[3].astype(np.int64)
    run = np.repeat(np.arange(len(low)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    packed = sk.gather(data, low, lengths)
    at = (np.cumsum(lengths) - lengths)[run] + within
    return run, within, np.ones(len(run), np.uint8), low[run] + within, np.full(len(run), window, np.int64), sk.range_hashes(packed, at, at + window)


def _finer(columns, data, low, window: int):
    """Stretches of windows that have the same gram of least second hash, as _windows_of.

    The runs of a slot share the gram of least first hash; a second one tells
    them apart, and a stretch still holds its bytes once and not for each window.
    """
    lengths, many = columns[5], columns[3].astype(np.int64)
    packed = sk.gather(data, low, lengths)
    h = packed.astype(U)
    for k in (1, 2, 4):
        h = h[:-k] << U(8 * k) | h[k:]
    grams = sk.mix(sk.mix(h) ^ U(0x5851F42D4C957F2D))
    mask = U((1 << 20) - 1)  # a few thousand runs have fewer bytes
    least = (sk.least_in_windows((grams & ~mask) | np.arange(len(grams), dtype=U), window - GRAM + 1) & mask).astype(np.int64)
    run = np.repeat(np.arange(len(low)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    place = least[(np.cumsum(lengths) - lengths)[run] + within]
    new = np.flatnonzero((within == 0) | (np.diff(place, prepend=-1) != 0))
    windows = np.diff(np.append(new, len(run)))
    run, within = run[new], within[new]
    return run, within, windows, low[run] + within, windows + window - 1, grams[place[new]]


def copies_of_bucket(blobs: list[bytes], window: int = WINDOW) -> Iterator[tuple]:
    for (ids, keys, start, windows, _, lengths), data in sk.turns(blobs, _slot_of, lambda c, d, low: _windows_of(c, d, low, window), lambda c, d, low: _finer(c, d, low, window)):
        found = _copies(ids, keys, start, windows, lengths, data, window)
        if found:
            yield found


def _result(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    if not len(start):
        return len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest()
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    a, b = start[at], reach[np.append(at[1:], len(start)) - 1]
    kept, last = hashlib.sha256(), 0
    for s, e in zip(a.tolist(), b.tolist(), strict=True):
        kept.update(data[last:s].tobytes())
        last = e
    kept.update(data[last:].tobytes())
    return len(data), int((b - a).sum()), len(a), kept.hexdigest()


_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: UTF-8 bytes, removed bytes and runs, and the digest of the bytes that stay.

    ``window`` may be 32 to 64. Null texts are empty. Rows of one id never
    remove each other's bytes, whatever their texts. An empty table gives no
    rows; other columns are not read.
    """
    if not 32 <= window <= 64:
        raise ValueError("window must be 32 to 64 bytes")
    return sk.removed_ranges(
        docs, id_col, text_col, lambda i, d, o: runs_of_block(i, d, o, window), lambda b: copies_of_bucket(b, window), _result, window, _DDL, _ARROW
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of smaller documents cover are removed."""
    return dedup_bytes(table(spark, sf_dir, "documents"))
