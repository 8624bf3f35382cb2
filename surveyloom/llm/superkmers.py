"""Windows of long sequences, brought together by minimiser.

Shared by the two substring operators. A *super-k-mer* is a run of consecutive
windows of one document that have the same minimiser: the k-gram of least hash
in the window, leftmost on ties. Equal windows have equal minimisers, so all of
them reach one bucket. The run travels once, as one packed string, instead of
window by window.

Everything moves as compressed blobs of one bucket from one block of documents
(a few MB of text). Within a block, equal super-k-mers are combined before the
shuffle: all but those of the smallest document are copies, and are settled on
the spot. A passage that a third of all documents holds thus reaches its
bucket once per block, not once per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.shared import n_partitions, released

U = np.uint64
BLOCK_BYTES = 2 << 20
#: Input bytes of a shuffle partition, where the session has too few of them.
PARTITION_BYTES = 128 << 20
#: Unpacked bytes that are sorted at once, and of a bucket that is kept unpacked meanwhile.
TURN_BYTES, KEPT_BYTES = 3 << 20, 64 << 20
#: Runs that are cut finer: how many times their bytes the cuts may have, and packs that are filled at once.
SPREAD, PIECES = 4, 64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for many ranges, from one running sum."""
    n = len(values)
    sums = np.zeros(n + 1, U)
    np.cumsum((values.astype(U) + U(1)) * _power("p", _P, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("q", _P_INVERSE, n + 1)[starts] + (ends - starts).astype(U))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The concatenation of data[start:start+length] for many ranges, about ``step`` bytes at a time."""
    ends = np.cumsum(lengths, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(step, len(out), step)), [len(ends)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=False):
        first = int(ends[a] - lengths[a])
        at = np.arange(first, int(ends[b - 1]), dtype=np.int64)
        at += np.repeat(starts[a:b].astype(np.int64) - (ends[a:b] - lengths[a:b]), lengths[a:b])
        out[first : first + len(at)] = data[at]
    return out


def least_in_windows(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive keys."""
    have, least = 1, keys
    while have * 2 <= w:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = w - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, keys, bytes, offsets) of about ``limit`` bytes of text, documents ascending by id; larger texts stand alone."""
    for batch in released(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        text = batch.column(2)
        text = text.cast(pa.large_binary()) if not pa.types.is_large_binary(text.type) else text
        if not len(text):
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(text)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            order = np.argsort(ids[a:b], kind="stable") + a
            size = lengths[order]
            packed = data[offsets[a] : offsets[b]] if np.array_equal(order, np.arange(a, b)) else gather(data, offsets[order], size)
            yield ids[order], keys[order], packed, np.concatenate([[0], np.cumsum(size)])


class Packed:
    """Columns and a byte string, as one compressed blob."""

    @staticmethod
    def dump(columns: list[np.ndarray], data: np.ndarray, level: int = 3) -> bytes:
        head = b"".join([np.array([len(columns), len(columns[0])], np.int64).tobytes(), *[c.dtype.str.encode().ljust(4) for c in columns], *[c.tobytes() for c in columns]])
        return zstandard.ZstdCompressor(level=level).compress(np.int64(len(head)).tobytes() + head + data.tobytes())

    @staticmethod
    def load(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        size, many, n = np.frombuffer(raw, np.int64, 3)
        kinds = [raw[24 + 4 * i : 28 + 4 * i].decode().strip() for i in range(many)]
        at, columns = 24 + 4 * int(many), []
        for kind in kinds:
            columns.append(np.frombuffer(raw, np.dtype(kind), int(n), at))
            at += int(n) * np.dtype(kind).itemsize
        return columns, np.frombuffer(raw, np.uint8, offset=8 + int(size))


BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
BLOB_DDL = "bucket int, kind tinyint, blob binary"


def _loaded(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    columns, data = Packed.load(blob)
    lengths = columns[5].astype(np.int64)
    return [np.cumsum(columns[0]), *columns[1:5], lengths], data, np.cumsum(lengths) - lengths


def turns(blobs: list[bytes], slot_of: Callable, windows_of: Callable, finer: Callable | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The runs of a bucket in parts of bounded size, ascending by document; equal windows are in one part.

    A part holds whole slots (hashes of minimisers). The runs of a slot too
    large for a part are cut finer and dealt by the cuts' own hash (_split).
    ``blobs`` is used up. ``slot_of(columns, data, low)`` numbers the runs from
    0 to 4095; ``windows_of(columns, data, low)`` gives (run, first window in
    it, windows, byte start, bytes, hash) of their single windows, ``finer`` of
    longer stretches of windows, so that equal windows have equal hashes.
    Columns: ids, keys, start, windows, extra, lengths.
    """
    total = sum(zstandard.frame_content_size(x) for x in blobs)
    kept = [_loaded(x) for x in blobs] if total <= KEPT_BYTES else None
    slots, sizes = [], np.zeros(4096, np.int64)
    for columns, data, low in kept if kept is not None else map(_loaded, blobs):
        slots.append(slot_of(columns, data, low).astype(np.int16))
        sizes += np.bincount(slots[-1], columns[5], 4096).astype(np.int64)
    part = np.cumsum(sizes) // TURN_BYTES
    dealt = _dealt(blobs, slots, part) if kept is None else {}
    for turn in np.unique(part[sizes > 0]):
        mine = part == turn
        if kept is not None:
            own = [(columns, data, low, np.flatnonzero(mine[slot])) for (columns, data, low), slot in zip(kept, slots, strict=True)]
        runs = (lambda own=own: own) if kept is not None else (lambda packs=dealt.pop(int(turn)): ((*found, np.arange(len(found[2]))) for found in map(_loaded, packs)))
        if (size := int(sizes[mine].sum())) > 2 * TURN_BYTES:
            yield from _split(runs, size, [f for f in (finer, windows_of) if f])
        else:
            yield _part([([c[x] for c in columns], gather(data, low[x], columns[5][x])) for columns, data, low, x in runs()])


def _part(found: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*[c for c, _ in found], strict=True)]
    data, lengths = np.concatenate([d for _, d in found]), columns[5]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns], gather(data, (np.cumsum(lengths) - lengths)[order], lengths[order])


def _split(runs: Callable, size: int, ways: list[Callable]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Runs cut by the first of ``ways`` and packed by hash, PIECES at a time; a pack that stays large is cut by the next.

    The number of packs allows for cuts of SPREAD times the bytes. What is
    unpacked at once does not grow with the bucket, and runs are cut once
    for each PIECES packs.
    """
    pieces = -(-SPREAD * size // TURN_BYTES)
    for first in range(0, pieces, PIECES):
        packs: dict[int, list[bytes]] = {}
        for columns, data, low, x in runs():
            for i in range(0, len(x), 4096):
                y = x[i : i + 4096]
                run, within, windows, at, length, h = ways[0]([c[y] for c in columns], data, low[y])
                piece = ((h >> U(24)) % U(pieces)).astype(np.int64) - first
                z = np.flatnonzero((piece >= 0) & (piece < PIECES))
                z = z[np.argsort(piece[z], kind="stable")]
                cuts = np.flatnonzero(np.diff(piece[z], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(z)], strict=False):
                    w = z[a:b]
                    r = y[run[w]]
                    cut = [steps_of(columns[0][r]), columns[1][r], columns[2][r] + within[w], windows[w].astype(np.uint8), columns[4][r] - within[w], length[w]]
                    packs.setdefault(int(piece[w[0]]), []).append(Packed.dump(cut, gather(data, at[w], length[w]), 1))
        for piece in sorted(packs):
            mine = packs.pop(piece)
            bytes_ = sum(int(_loaded(x)[0][5].sum()) for x in mine)
            if bytes_ > 2 * TURN_BYTES and len(ways) > 1:
                yield from _split(lambda mine=mine: ((*found, np.arange(len(found[2]))) for found in map(_loaded, mine)), bytes_, ways[1:])
            else:
                yield _part([(columns, data) for columns, data, _ in map(_loaded, mine)])


def _dealt(blobs: list[bytes], slots: list[np.ndarray], part: np.ndarray) -> dict[int, list[bytes]]:
    """The runs of large buckets packed anew by turn, so that each is unpacked three times however many turns there are.

    A few MB are dealt at a time; the blobs are given up one by one.
    """
    out: dict[int, list[bytes]] = {}
    group: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
    size = 0
    for i, slot in enumerate(slots):
        columns, data, _ = _loaded(blobs[i])
        blobs[i] = b""
        group.append((columns, data, part[slot]))
        size += len(data)
        if size < 2 * TURN_BYTES and i + 1 < len(slots):
            continue
        columns = [np.concatenate(c) for c in zip(*[g[0] for g in group], strict=True)]
        data, turn = np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group])
        low = np.cumsum(columns[5]) - columns[5]
        order = np.lexsort((columns[0], turn))
        cuts = np.flatnonzero(np.diff(turn[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
            x = order[a:b]
            packed = Packed.dump([steps_of(columns[0][x]), *[c[x] for c in columns[1:]]], gather(data, low[x], columns[5][x]), 1)
            out.setdefault(int(turn[x[0]]), []).append(packed)
        group, size = [], 0
    return out


def blob_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blobs, pa.binary())], schema=BLOB)


def steps_of(ids: np.ndarray) -> np.ndarray:
    """Differences of ascending ids, for packing; np.cumsum undoes it."""
    return np.diff(ids, prepend=np.int64(0)) if len(ids) else ids


def combine(ids: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal super-k-mers in a block (ascending by document): which must travel, and which copy a smaller document.

    Equality is decided on the bytes; the hash only brings candidates together.
    """
    n = len(starts)
    order = np.argsort(h := range_hashes(data, starts, ends), kind="stable")
    new = np.ones(n, bool)
    new[1:] = h[order][1:] != h[order][:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # first of its hash, in sorted order
    of = np.empty(n, np.int64)
    of[order] = first
    lengths = ends - starts
    copy = (ids > ids[of]) & (lengths == lengths[of])
    many = np.flatnonzero(copy)
    if len(many):
        size = lengths[many]
        differs = gather(data, starts[many], size) != gather(data, starts[of[many]], size)
        wrong = np.add.reduceat(differs, np.cumsum(size) - size) > 0
        copy[many[wrong]] = False
    return ~copy, copy


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges, document by document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, start, end
    span = int(end.max()) + 2
    lift = np.cumsum(np.concatenate([[0], np.diff(doc) != 0])).astype(np.int64) * span
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], start[at], reach[last] - lift[at]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Blobs of one bucket after another, from rows sorted by bucket."""
    current, held = None, {}
    for batch in released(batches):
        for bucket, kind, blob in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if bucket != current:
                if current is not None:
                    yield current, held
                current, held = bucket, {}
            held.setdefault(kind, []).append(blob)
    if current is not None:
        yield current, held


#: Kinds of blobs.
RUNS, SETTLED, TEXTS = 0, 1, 2


def settled_blobs(ids, keys, start, end, n_final: int) -> list[tuple[int, int, bytes]]:
    """Removed ranges, dealt to the bucket that writes their document."""
    to = (mix(ids.astype(U)) % U(n_final)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        at = order[a:b]
        out.append((int(to[at[0]]), SETTLED, Packed.dump([ids[at].astype(np.int64), keys[at].astype(np.int32), start[at].astype(np.int32), (end - start)[at].astype(np.int32)], np.zeros(0, np.uint8))))
    return out


def removed_ranges(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    runs_of_block: Callable,
    copies_of_bucket: Callable,
    result_of_doc: Callable,
    width: int,
    result_schema: str,
    result_arrow: pa.Schema,
) -> DataFrame:
    """Windows that start in a document of smaller id, found bucket by bucket, then one result per document.

    ``runs_of_block(ids, data, offsets)`` gives arrays (document index, first
    item, windows, byte start, byte end, minimiser hash, extra byte) and the
    bytes that they point into. ``copies_of_bucket(blobs)`` yields (ids, keys,
    start, end) of copied items. ``result_of_doc(data, starts, ends)`` gives a
    row without the id. Documents of null id neither remove nor lose anything.
    """
    spark = docs.sparkSession
    held = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(n_partitions(spark), -(-held // PARTITION_BYTES))
    n_runs, n_final = 2 * parts, 2 * parts
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    # rows of one id but different texts are told apart by a hash of the text, where there are such rows
    key = F.hash(F.col(text_col)) if twice else F.lit(0)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), key.cast("int").alias("k"), text.alias("t"))

    def split(batches):
        for ids, keys, data, offsets in blocks(batches):
            doc, start, windows, low, high, least, extra, block = runs_of_block(ids, data, offsets)
            if not len(doc):
                continue
            stays, copy = combine(ids[doc], block, low, high)
            rows = []
            if copy.any():
                d, s, e = merged(doc[copy], start[copy], (start + windows)[copy])
                rows += [(b, SETTLED, x) for b, _, x in settled_blobs(ids[d], keys[d], s, e + width - 1, n_final)]
            at = np.flatnonzero(stays)
            bucket = (mix(least[at]) % U(n_runs)).astype(np.int64)
            at = at[order := np.argsort(bucket, kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=False):
                x = at[a:b]
                columns = [steps_of(ids[doc[x]].astype(np.int64)), keys[doc[x]].astype(np.int32), start[x].astype(np.int32), windows[x].astype(np.uint8), extra[x].astype(np.uint8), (high - low)[x].astype(np.int32)]
                rows.append((int(bucket[order[a]]), RUNS, Packed.dump(columns, gather(block, low[x], (high - low)[x]))))
            yield blob_rows(rows)

    def settle(batches):
        for bucket, held in by_bucket(batches):
            if SETTLED in held:
                yield blob_rows([(bucket, SETTLED, x) for x in held[SETTLED]])
            for ids, keys, start, end in copies_of_bucket(held[RUNS]) if RUNS in held else ():
                if len(ids):
                    yield blob_rows(settled_blobs(ids, keys, start, end, n_final))

    def texts(batches):
        for ids, keys, data, offsets in blocks(batches):
            to = (mix(ids.astype(U)) % U(n_final)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            size = np.diff(offsets)
            yield blob_rows(
                [
                    (int(to[order[a]]), TEXTS, Packed.dump([ids[x].astype(np.int64), keys[x].astype(np.int32), size[x].astype(np.int64)], gather(data, offsets[x], size[x])))
                    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False)
                    for x in [order[a:b]]
                ]
            )

    def finish(batches):
        for _, held in by_bucket(batches):
            columns = [Packed.load(x)[0] for x in held.get(SETTLED, [])]
            ids, keys, start, size = [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [np.zeros(0, np.int64)] * 4
            order = np.lexsort((start, keys, ids))
            ids, keys, start, end = ids[order], keys[order], start[order].astype(np.int64), (start + size)[order].astype(np.int64)
            for blob in held.get(TEXTS, []):
                (doc, key, length), data = Packed.load(blob)
                offsets = np.concatenate([[0], np.cumsum(length)])
                low, high = np.searchsorted(ids, doc, "left"), np.searchsorted(ids, doc, "right")
                out = []
                for i in range(len(doc)):
                    a, b = low[i], high[i]
                    mine = slice(a, b)
                    s, e = start[mine], end[mine]
                    if a < b and (keys[mine] != key[i]).any():
                        same = keys[mine] == key[i]
                        s, e = s[same], e[same]
                    out.append((int(doc[i]), *result_of_doc(data[offsets[i] : offsets[i + 1]], s, e)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), result_arrow, strict=True)], schema=result_arrow)

    def nameless(batches):
        for batch in batches:
            out = [(None, *result_of_doc(np.frombuffer(t or b"", np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) for t in batch.column(2).to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), result_arrow, strict=True)], schema=result_arrow)

    named = source.where("id is not null")
    runs = named.mapInArrow(split, BLOB_DDL).repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    ranges = runs.mapInArrow(settle, BLOB_DDL)
    whole = named.mapInArrow(texts, BLOB_DDL)
    final = ranges.unionByName(whole).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(finish, result_schema)
    return final.unionByName(source.where("id is null").mapInArrow(nameless, result_schema))
