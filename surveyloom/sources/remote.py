"""Sources outside the lake: downloads, readers behind an HTTP interface, PDF pages and configuration files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Answers of a server after which another try makes sense.
PASSING = (429, 500, 502, 503, 504)


def asked(url: str, body: bytes | None = None, headers: dict | None = None, check: Callable = lambda r: r.read(), tries: int = 5, timeout: float = 120, pause: Callable[[float], None] = time.sleep):
    """What ``check`` makes of the response; faults that may pass, and replies that ``check`` finds faulty (ValueError), are tried again after 1, 2, 4... seconds."""
    for turn in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers or {}), timeout=timeout) as response:
                return check(response)
        except urllib.error.HTTPError as e:
            if e.code not in PASSING or turn == tries - 1:
                raise RuntimeError(f"{url}: status {e.code}") from e
        except (urllib.error.URLError, TimeoutError, ValueError):
            if turn == tries - 1:
                raise
        pause(2.0**turn)
    raise ValueError("tries must be 1 or more")


def fetched(url: str, path: str, md5: str | None = None, step: int = 1 << 20, **how) -> dict:
    """A file by HTTP, under a temporary name until it is whole and its MD5 is right; its size and SHA-256.

    A file that is there already and has the MD5 is not fetched again.
    """

    def digests(source, sink=None) -> dict:
        one, two, size = hashlib.md5(), hashlib.sha256(), 0
        while block := source.read(step):
            one.update(block)
            two.update(block)
            size += len(block)
            if sink is not None:
                sink.write(block)
        return {"md5": one.hexdigest(), "sha256": two.hexdigest(), "n_bytes": size}

    if md5 and os.path.exists(path):
        with open(path, "rb") as f:
            found = digests(f)
        if found["md5"] == md5:
            return found

    def keep(response) -> dict:
        with open(part, "wb") as f:
            found = digests(response, f)
        if md5 and found["md5"] != md5:
            raise ValueError(f"{url}: MD5 {found['md5']} instead of {md5}")
        return found

    part = f"{path}.{os.getpid()}.part"
    try:
        found = asked(url, check=keep, **how)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return found


def fetched_files(listing: DataFrame, folder: str, **how) -> DataFrame:
    """The files of a listing (name, url, md5) into a mounted folder that all executors share; name, md5, sha256 and size of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"name": n, **fetched(u, os.path.join(folder, os.path.basename(n)), m, **how)} for n, u, m in zip(pdf["name"], pdf["url"], pdf["md5"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "md5", "sha256", "n_bytes"])

    return listing.select("name", "url", "md5").mapInPandas(run, "name string, md5 string, sha256 string, n_bytes bigint")


def label_shares(reply: dict, labels: list[str]) -> list[float]:
    """The shares of the labels, from the log-probabilities of the first token of a chat reply; a missing label is a fault."""
    try:
        tokens = reply["choices"][0]["logprobs"]["content"][0]["top_logprobs"]
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError("the reply has no log-probabilities") from e
    best: dict[str, float] = {}
    for t in tokens:
        label = str(t.get("token", "")).strip()
        best[label] = max(best.get(label, float("-inf")), float(t["logprob"]))
    absent = [x for x in labels if x not in best]
    if absent:
        raise ValueError(f"the reply lacks the labels {absent}")
    z = np.exp(np.array([best[x] for x in labels]) - max(best[x] for x in labels))
    return (z / z.sum()).tolist()


def http_reader(base: str, model: str, key: str = "", threads: int = 8, settings: dict | None = None, **how) -> Callable:
    """A reader for ``read_prompts`` that asks a chat server for one token; options are the labels 1, 2, ...

    ``settings`` are further fields of the request. Each task has up to
    ``threads`` requests under way.
    """
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

    def one(prompt: str, n: int) -> list[float]:
        labels = [str(i + 1) for i in range(n)]
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": 1, "logprobs": True, "top_logprobs": 20, "stream": False} | (settings or {})
        return asked(f"{base.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers, lambda r: label_shares(json.load(r), labels), **how)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pdf.assign(p=list(pool.map(one, pdf["prompt"], [int(n) for n in pdf["n_options"]])))

    return read


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects of a PDF file by number, those in compressed object streams too; of one number the last."""
    found = {int(m[1]): m[2] for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm", body.split(b"stream", 1)[0]):
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            inner = _stream(body)
            head = [int(x) for x in inner[:first].split()[: 2 * n]]
            ends = [*head[3::2], len(inner) - first]
            for number, start, end in zip(head[::2], head[1::2], ends, strict=True):
                found.setdefault(number, inner[first + start : first + end])
    return found


def _stream(body: bytes) -> bytes:
    head, _, rest = body.partition(b"stream")
    raw = rest.removeprefix(b"\r").removeprefix(b"\n").rsplit(b"endstream", 1)[0]
    return zlib.decompressobj().decompress(raw) if b"FlateDecode" in head else raw


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>"
_SHOWN = re.compile(rb"(\[(?:" + _STRING + rb"|[^\]()<>])*\]|" + _STRING + rb")\s*(TJ|Tj|'|\")|(?<![\w/])(T\*|T[dDm]|ET)(?!\w)", re.S)


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        return bytes.fromhex(token[1:-1].decode() + ("0" if len(b"".join(token[1:-1].split())) % 2 else "")).decode("latin-1")
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S).decode("latin-1")


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page, a line for each text position.

    Streams may be plain or deflated. Characters are taken as Latin-1: fonts
    with an encoding of their own, and encrypted files, are not read.
    """
    objects = _objects(data)
    refs = lambda body, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b"", b""])[1])]
    catalog = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    if catalog is None:
        raise ValueError("not a PDF file with a catalogue")
    pages, waiting, seen = [], refs(catalog, b"Pages"), set()
    while waiting:
        number = waiting.pop(0)
        if number in seen or number not in objects:
            continue
        seen.add(number)
        kids = refs(objects[number], b"Kids")
        if kids:
            waiting = kids + waiting
            continue
        if not re.search(rb"/Type\s*/Page\b(?!s)", objects[number]):
            continue
        out: list[str] = []
        for content in refs(objects[number], b"Contents"):
            for shown, how, move in _SHOWN.findall(_stream(objects.get(content, b""))):
                if move or how in (b"'", b'"'):
                    out.append("\n")
                if shown:
                    out += [_string(x) for x in re.findall(_STRING, shown, re.S)]
        pages.append("".join(out))
    return pages


def read_pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """File, page, line (both from 1) and text of the lines of PDF files, white space collapsed, empty lines left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for page, text in enumerate(pdf_pages(content), 1):
                    lines = [t for t in (" ".join(x.split()) for x in text.split("\n")) if t]
                    rows += [(name, page, i, t) for i, t in enumerate(lines, 1)]
                yield pd.DataFrame(rows, columns=["file", "page", "line", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "content").mapInPandas(run, "file string, page int, line int, text string")


def read_config(path: str, root: str | None = None, make: bool = False) -> dict:
    """A mapping from a JSON or YAML file; its ``paths`` become absolute below ``root`` (the folder above the file's) and are made if asked for."""
    with open(path, encoding="utf-8") as f:
        written = f.read()
    if path.endswith(".json"):
        config = json.loads(written)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need the yaml package; JSON files do not") from e
        config = yaml.safe_load(written)
    if not isinstance(config, dict):
        raise ValueError(f"{path} does not hold a mapping")
    root = os.path.abspath(os.path.expanduser(root or os.path.dirname(os.path.dirname(os.path.abspath(path)))))
    places = {k: os.path.join(root, os.path.expanduser(str(v))) for k, v in (config.get("paths") or {}).items()}
    if make:
        for p in places.values():
            os.makedirs(p, exist_ok=True)
    return config | {"paths": places, "root": root}
