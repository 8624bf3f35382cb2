"""WARC archives: a deterministic sharded writer and a reader.

Records are cut into ranges of the page id and sorted in them; each range
writes gzip members, one for each record, into files that roll when their
compressed size passes a limit. A payload of ``least`` bytes or more that an
earlier page has is written as a revisit. Files are written under temporary
names that no other attempt uses, and only those named by the tasks that
succeeded are moved to their final names, listed with sizes and digests in a
manifest. What lost or repeated attempts leave is removed. The same pages give
the same files, byte for byte.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.shared import bucket_of, filesystem, fresh_path, n_partitions, range_bounds, table

#: Payloads from this many bytes on are written once.
LEAST = 100
#: Payload bytes of a range of ids, which one task sorts and writes.
RANGE_BYTES = 1 << 30
_DATE = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """``roll_bytes`` of compressed records end a file; ``level`` is gzip's."""

    roll_bytes: int = 256 << 20
    level: int = 4
    least: int = LEAST


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; all headers follow from the page."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {(url or 'about:blank').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that opens a file; it follows from the file's name."""
    block = b"software: surveyloom\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>", f"WARC-Date: {_DATE}", f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_FILES = pa.schema(
    [("name", pa.string()), ("held", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first", pa.int64()), ("last", pa.int64())]
)
_FILES_DDL = "name string, held string, records bigint, bytes bigint, sha256 string, first bigint, last bigint"


class _Roller:
    """Writes the files of one range under temporary names."""

    def __init__(self, root: str, rule: Archive):
        self.rule, self.out, self.done = rule, None, []
        self.fs, self.root = filesystem(root)
        self.bucket, self.turn = None, 0

    def put(self, bucket: int, page_id: int | None, data: bytes) -> None:
        if bucket != self.bucket:
            self.close()
            self.bucket, self.turn = bucket, 0
        if self.out is None:
            self.held = f"{self.root}/_temporary/{uuid.uuid4().hex}.warc.gz"
            self.out, self.hash = self.fs.open_output_stream(self.held), hashlib.sha256()
            self.records, self.bytes, self.first = 0, 0, page_id
            self._write(member(info(self.name()), self.rule.level))
        packed = member(data, self.rule.level)
        self._write(packed)
        self.records, self.last = self.records + 1, page_id
        if self.bytes >= self.rule.roll_bytes:
            self.close()

    def name(self) -> str:
        return f"part-{self.bucket:06d}-{self.turn:05d}.warc.gz"

    def _write(self, packed: bytes) -> None:
        self.out.write(packed)
        self.hash.update(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name(), self.held, self.records, self.bytes, self.hash.hexdigest(), self.first, self.last))
            self.out, self.turn = None, self.turn + 1


def write_archives(pages: DataFrame, root: str, rule: Archive = Archive()) -> list[dict]:
    """Write pages (page_id, url, html) to WARC files under ``root``; returns the manifest.

    Null payloads are empty. Of rows with one id and payload the first is the
    response, if the id is the payload's smallest. Null ids come first and are
    always responses. The manifest has one entry for each file.
    """
    spark = pages.sparkSession
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    # ranges of ids, one a task: as many as the session shuffles to, more where they would exceed RANGE_BYTES
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    bounds = range_bounds(rows.select("page_id"), "page_id", max(n_partitions(spark), -(-size // RANGE_BYTES)))
    narrow = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= rule.least)).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = narrow.join(groups, "digest").distinct().select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "least")
    # the word on a page's payload travels with the page and is read just before it
    both = rows.withColumn("least", F.lit(None).cast("bigint")).unionByName(again)
    both = both.select(bucket_of(F.col("page_id"), bounds).cast("int").alias("bucket"), "page_id", "digest", F.col("html").isNotNull().alias("page"), "url", "html", "least")
    both = both.repartitionById(len(bounds) + 1, F.col("bucket") + 1).sortWithinPartitions("bucket", F.col("page_id").asc_nulls_first(), "digest", "page", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, word, seen = _Roller(root, rule), None, None
        for batch in batches:
            for bucket, page_id, key, page, url, html, least in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not page:
                    word = (page_id, key, least)
                    continue
                refers = word[2] if word is not None and word[:2] == (page_id, key) else None
                revisit = refers is not None and (refers != page_id or seen == (page_id, key))
                seen = (page_id, key)
                roller.put(bucket, page_id, record(page_id, url, html.encode(), key, refers, revisit))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*roller.done, strict=True), _FILES, strict=True)], schema=_FILES)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        for batch in batches:
            for held, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(held).type.name != "NotFound":  # a task that is run again finds its file in place
                    fs.move(held, f"{path}/{name}")
            yield batch

    fs, path = filesystem(root)
    fs.create_dir(f"{path}/_temporary", recursive=True)
    files = sorted((r.asDict() for r in both.mapInArrow(write, _FILES_DDL).collect()), key=lambda f: f["name"])  # one entry for each file
    if files:
        moves = spark.createDataFrame([(f.pop("held"), f["name"]) for f in files], "held string, name string")
        moves.repartition(max(1, min(len(files), n_partitions(spark)))).mapInArrow(rename, "held string, name string").count()
    with fs.open_output_stream(f"{path}/_manifest.json.tmp") as out:
        out.write(json.dumps({"files": files}, indent=1, sort_keys=True).encode())
    fs.move(f"{path}/_manifest.json.tmp", f"{path}/manifest.json")
    fs.delete_dir(f"{path}/_temporary")
    # files of an earlier archive in the same place
    kept = {f["name"] for f in files}
    for info in fs.get_file_info(FileSelector(path)):
        if info.base_name.startswith("part-") and info.base_name not in kept:
            fs.delete_file(info.path)
    return files


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped WARC stream."""
    unpack, held = zlib.decompressobj(31), bytearray()

    def record_of(raw: bytes):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if len(rest) != size + 4:
            raise ValueError("a record is cut short")
        return headers, rest[:size]

    for chunk in data:
        while chunk:
            held += unpack.decompress(chunk)
            chunk = b""
            if unpack.eof:
                chunk = unpack.unused_data
                yield record_of(bytes(held))
                unpack, held = zlib.decompressobj(31), bytearray()
    if held:
        raise ValueError("a file is cut short")


_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_PAGES_DDL = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """Records of the files in the manifest under ``root``; digests of responses are computed anew and must agree."""
    fs, path = filesystem(root)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    listed = spark.createDataFrame([(f["name"],) for f in files], "name string").repartition(max(1, min(len(files), 4 * n_partitions(spark))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        rows: list[tuple] = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES, strict=True)], schema=_PAGES)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{name}") as f:
                    for headers, block in parse(iter(lambda f=f: f.read(1 << 20), b"")):
                        if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"the block of {headers['WARC-Record-ID']} was changed")
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
                        number = lambda key, headers=headers: int(headers[key]) if key in headers else None
                        rows.append((number("Page-ID"), headers["WARC-Target-URI"], number("Payload-Length"), digest, kind, number("Refers-To-Page-ID"), payload if payloads and kind == "response" else None))
                        if len(rows) >= 500:
                            yield batch_of()
                            rows.clear()
        if rows:
            yield batch_of()

    return listed.mapInArrow(read, _PAGES_DDL)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives to the shared folder and read back."""
    root = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), root)
    return read_archives(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
