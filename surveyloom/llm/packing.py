"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Tasks encode their documents and pack the pieces by best fit, largest first.
Nearly full bins are final. The others are the items of the next round: groups
of tasks are merged, as in a tree, and packed again, until one group is left.
A bin is one row that holds its members (at most ``capacity``, as none is
empty), so merging two bins joins their lists and no table is joined. Each
round is written to the shared folder.

Encoding: the tokenizer drops white space and never joins characters across
it, so each distinct run of other characters is encoded once by the library
and its ids are put in place by array indexing.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm.shared import by_bytes, free_name, released, staged, table
from surveyloom.sources.shipping import ship


@dataclass(frozen=True)
class PackRule:
    """``slack``: free tokens of a nearly full bin. A bin with more than ``loose`` free is taken apart for the next round.

    A task packs at most ``block_rows`` items or ``block_bytes`` of them at a
    time; ``fan_in`` tasks meet in one of the next round.
    """

    capacity: int = 4096
    end_id: int = 1
    slack: int = 16
    loose: int = 512
    block_rows: int = 100_000
    block_bytes: int = 64 << 20
    fan_in: int = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space; equal to the library's on the whole text."""

    #: Words remembered, and bytes of text taken at a time.
    REMEMBERED, STEP = 600_000, 4 << 20
    TAILS = ".,"

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        self.tails = [self._ids([c])[0] for c in self.TAILS]
        self._forget()

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def _core_spans(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.REMEMBERED or len(self.flat) > 8 * self.REMEMBERED:
            self._forget()
        new = [w for w in cores if w not in self.known]
        for word, ids in zip(new, self._ids(new), strict=True):
            self.known[word] = len(self.ends) - 1
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        at = np.fromiter(map(self.known.__getitem__, cores), np.int64, len(cores))
        ends = np.frombuffer(self.ends, np.int64)
        return ends[at], ends[at + 1] - ends[at]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and the bounds of the texts (one more than texts)."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = pc.list_flatten(split).dictionary_encode()
        unique = words.dictionary
        # a full stop or comma after a plain letter is a token of its own; ASCII words are lower-cased by the tokenizer
        tail = pc.match_substring_regex(unique, "[A-Za-zà-öø-ÿ][.,]$")
        core = pc.if_else(tail, pc.utf8_slice_codeunits(unique, 0, -1), unique)
        core = pc.if_else(pc.match_substring_regex(core, "^[A-Za-z]+$"), pc.ascii_lower(core), core)
        tail = tail.to_numpy(zero_copy_only=False)
        comma = pc.ends_with(unique, ",").to_numpy(zero_copy_only=False)
        core = core.dictionary_encode()
        start, length = self._core_spans(core.dictionary.to_pylist())
        of = core.indices.to_numpy()
        start, length = start[of], length[of]
        # ids of the distinct words, one after another, and the end id as the last word
        sizes = np.append(length + np.where(tail, np.where(comma, len(self.tails[1]), len(self.tails[0])), 0), 1)
        ends = np.cumsum(sizes)
        ids = np.empty(int(ends[-1]), np.uint32)
        known = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        ids[_spread(ends[:-1] - sizes[:-1], length)] = known[_spread(start, length)]
        for kind, tail_ids in ((tail & ~comma, self.tails[0]), (tail & comma, self.tails[1])):
            for k, i in enumerate(reversed(tail_ids)):
                ids[ends[:-1][kind] - 1 - k] = i
        ids[-1] = end_id
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        order = np.insert(words.indices.to_numpy().astype(np.int64), offsets[1:], len(unique))
        out = ids[_spread((ends - sizes)[order], sizes[order])]
        total = np.concatenate([[0], np.cumsum(sizes[order])])
        return out, total[np.append(0, offsets[1:] + np.arange(1, len(texts) + 1))]


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] numbers), start[1], ..."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


_encoders: dict[int, WordEncoder] = {}


def _encoder(data: str) -> WordEncoder:
    key = zlib.crc32(data.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(data)
    return _encoders[key]


def token_pieces(docs: DataFrame, rule: PackRule = PackRule(), tokenizer_path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids`` array<int>): each document's ids and the end id, cut at ``capacity``.

    Null and empty texts have the end id only. Rows of null or repeated ids
    are encoded like any other; other columns are not read.
    """
    ship(docs.sparkSession)
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        data = file.read()  # a vocabulary file: under 2 MB, and it does not grow
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, most = _encoder(data), rule.capacity
        for batch in released(batches):
            texts = batch.column(1)
            for at, size in by_bytes(texts, WordEncoder.STEP):
                ids, bounds = encoder.encode(texts.slice(at, size), rule.end_id)
                lengths = np.diff(bounds)
                cuts = -(-lengths // most)
                of = np.repeat(np.arange(size), cuts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * most
                length = np.minimum(lengths[of] - start, most)
                low = bounds[:-1][of] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
                columns = [batch.column(0).slice(at, size).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, ids.size), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    return source.mapInArrow(encode, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest item first, each into the open bin that it leaves least free."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at, bins = 0, []  # bit f of open_at: some bin has f free
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = open_at >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_at ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        free -= size
        if free:
            by_free[free].append(b)
            open_at |= 1 << free
    return bins


def _joined(rows: pa.Table, bins: list[list[int]], done: list[bool]) -> pa.RecordBatch:
    """A row for each bin: the members of its rows, one after another."""
    members = rows.column("members").combine_chunks()
    members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
    lengths = pc.list_value_length(members).to_numpy()
    order = np.array([i for b in bins for i in b], np.int64)
    ends = np.cumsum([0, *map(len, bins)])
    counts = np.concatenate([[0], np.cumsum(lengths[order])])[ends]
    used = np.concatenate([[0], np.cumsum(rows.column("used").to_numpy()[order])])
    merged = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pc.list_flatten(members.take(pa.array(order))), type=members.type)
    return pa.RecordBatch.from_arrays([pa.array(np.diff(used[ends]), pa.int32()), merged, pa.array(done, pa.bool_())], names=["used", "members", "done"])


def _apart(rows: pa.Table, length_at: int) -> pa.Table:
    """Each member as a bin of its own."""
    flat = pc.list_flatten(rows.column("members")).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    one = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1), pa.int32()), flat, type=rows.schema.field("members").type)
    used = pc.struct_field(flat, [length_at]).cast(pa.int32())
    return pa.table({"used": used, "members": one})


def _round(rows: DataFrame, rule: PackRule, length_at: int, last: bool) -> DataFrame:
    """Best fit within each task; ``done`` tells final bins (all in the last round)."""

    def pack(held: pa.Table, ending: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        bins = best_fit(held.column("used").to_pylist(), rule.capacity)
        used = held.column("used").to_numpy()
        free = [rule.capacity - int(used[b].sum()) for b in bins]
        full = [b for b, f in zip(bins, free, strict=True) if f <= rule.slack or last and ending]
        loose = [] if last else [i for b, f in zip(bins, free, strict=True) for i in b if f > rule.loose]
        if len(loose) > rule.block_rows // 4:  # too many to carry on one by one
            loose = []
        close = [b for b, f in zip(bins, free, strict=True) if f > rule.slack and (f <= rule.loose or not loose)]
        if last and ending:
            return _joined(held, full, [True] * len(full)), held.slice(0, 0)
        rest = [_apart(held.take(loose), length_at)] if loose else []
        if close:
            rest.append(pa.Table.from_batches([_joined(held, close, [False] * len(close))]).drop_columns(["done"]))
        return (_joined(held, full, [True] * len(full)) if full else None), pa.concat_tables(rest) if rest else held.slice(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, volume = [], 0, 0
        for batch in released(batches):
            outside = pc.equal(batch.column("used"), 0)
            if pc.any(outside).as_py():
                yield from passed(pa.Table.from_batches([batch.filter(outside)]), True)
                batch = batch.filter(pc.invert(outside))
            held.append(pa.Table.from_batches([batch]))
            size, volume = size + len(batch), volume + batch.nbytes
            if size >= rule.block_rows or volume >= rule.block_bytes:
                out, rest = pack(pa.concat_tables(held), False)
                if out is not None:
                    yield out
                held, size, volume = [rest], len(rest), rest.nbytes
                if 2 * size >= rule.block_rows or 2 * volume >= rule.block_bytes:  # hardly anything fits together: pass it on
                    yield from passed(rest, last)
                    held, size, volume = [], 0, 0
        if size:
            out, rest = pack(pa.concat_tables(held), True)
            if out is not None:
                yield out
            yield from passed(rest, False)

    def passed(rest: pa.Table, done: bool) -> Iterator[pa.RecordBatch]:
        for b in rest.to_batches():
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([done] * len(b), pa.bool_())], names=["used", "members", "done"])

    schema = T.StructType([*rows.schema.fields, T.StructField("done", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def pack(items: DataFrame, rule: PackRule = PackRule(), length_col: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, gapless from offset 0.

    Items whose length is null, under 1 or above the capacity are in no
    sequence: both columns are null. Columns of these names in any case give
    the new ones an underscore at the end. Runs a job for each round.
    """
    ship(items.sparkSession)
    names = items.columns
    fits = F.col(length_col).between(1, rule.capacity)
    length_at = names.index(length_col)
    rows = items.select(F.when(fits, F.col(length_col)).otherwise(0).cast("int").alias("used"), F.array(F.struct(*[F.col(f"`{c}`") for c in names])).alias("members"))
    parts, tasks, before, last = [], None, 0, False
    while True:
        packed = staged(_round(rows, rule, length_at, last), "packed")
        rest = packed.where("not done").select("used", "members")
        n, found = rest.select(F.input_file_name().alias("f")).groupBy("f").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
        if not n:
            parts.append(packed)
            break
        groups = max(-(-found // rule.fan_in), -(-n // rule.block_rows))
        parts.append(packed)
        # each group meets others than in the round before; when hardly anything fits together any more, the round is the last
        last = groups == 1 or tasks is not None and groups >= tasks and n > 0.99 * before
        rows, tasks, before = rest.repartition(groups), groups, n
    out = None
    for packed in parts:
        bins = packed.where("done").select("used", "members")
        out = bins if out is None else out.unionByName(bins)
    # a bin is one row of a written table, so its number holds for all its members
    return _unpacked(out.select(F.monotonically_increasing_id().alias("id"), "used", "members"), items, length_at)


def _unpacked(bins: DataFrame, items: DataFrame, length_at: int) -> DataFrame:
    """A row for each member, with its bin and its place there."""
    names = [*items.columns, *(free_name(items.columns, c) for c in ("sequence_id", "offset"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            if not len(batch):
                continue
            members, outside = batch.column(2), batch.column(1).to_numpy() == 0
            counts = pc.list_value_length(members).to_numpy()
            columns = pc.list_flatten(members).flatten()
            lengths = np.where(np.repeat(outside, counts), 0, pc.fill_null(columns[length_at], 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(lengths)])
            offset = before[:-1] - np.repeat(before[np.cumsum(counts) - counts], counts)
            alone = np.repeat(outside, counts)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(batch.column(0).to_numpy(), counts), mask=alone), pa.array(offset, mask=alone)], names=names)

    fields = items.select("*", *[F.lit(None).cast("bigint").alias(c) for c in names[-2:]]).schema
    return bins.mapInArrow(run, fields)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, starts: the ids of each sequence (``placed``: packed pieces with their ids), and where its documents begin.

    At most ``capacity`` ids meet in a group.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = placed.where("sequence_id is not null").groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: its place in the packed sequences.

    An empty table has no pieces; repeated rows are packed each.
    """
    return pack(token_pieces(table(spark, sf_dir, "documents"), with_ids=False))
