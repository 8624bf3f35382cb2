"""Downloads, HTTP readers, PDF pages and configuration, against a server on this machine."""

import hashlib
import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from surveyloom.operators.vectors import read_prompts
from surveyloom.sources import remote

FILE = bytes(range(256)) * 9000


@pytest.fixture(scope="module")
def server():
    faults = {"n": 0}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, code, body=b""):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/sometimes":
                faults["n"] += 1
                self.answer(503) if faults["n"] < 3 else self.answer(200, b"at last")
            elif self.path == "/file":
                self.answer(200, FILE)
            else:
                self.answer(404)

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            n = len(asked["messages"][0]["content"])
            tokens = [{"token": f" {i}", "logprob": -float(i == 1 + n % 2)} for i in range(1, 6)] + [{"token": "1", "logprob": -9.0}]
            self.answer(200, json.dumps({"choices": [{"logprobs": {"content": [{"top_logprobs": tokens}]}}]}).encode())

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}"
    running.shutdown()


def test_faults_that_pass_are_tried_again(server):
    waits = []
    assert remote.asked(f"{server}/sometimes", pause=waits.append) == b"at last" and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="404"):
        remote.asked(f"{server}/none", pause=waits.append)
    assert len(waits) == 2


def test_fetched_files(spark, server, tmp_path):
    right = hashlib.md5(FILE).hexdigest()
    listing = spark.createDataFrame([("a.bin", f"{server}/file", right), ("b.bin", f"{server}/file", None)], "name string, url string, md5 string")
    for _ in range(2):
        got = {r["name"]: r for r in remote.fetched_files(listing, str(tmp_path)).collect()}
    assert {n: (r["md5"], r["sha256"], r["n_bytes"]) for n, r in got.items()} == {n: (right, hashlib.sha256(FILE).hexdigest(), len(FILE)) for n in ("a.bin", "b.bin")}
    assert (tmp_path / "a.bin").read_bytes() == FILE
    with pytest.raises(ValueError, match="MD5"):
        remote.fetched(f"{server}/file", str(tmp_path / "c.bin"), "0" * 32, tries=2, pause=lambda _: None)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "b.bin"]


def test_http_reader(spark, server):
    prompts = spark.createDataFrame([(1, "ab", 2), (2, "abc", 3)], "id int, prompt string, n_options int")
    got = {r["id"]: r["p"] for r in read_prompts(prompts, remote.http_reader(server, "any")).collect()}
    low = 2.718281828459045**-1
    assert got[1] == pytest.approx([low / (1 + low), 1 / (1 + low)])
    assert got[2] == pytest.approx([1 / (2 + low), low / (2 + low), 1 / (2 + low)])
    for reply in ({}, {"choices": []}, {"choices": [{"logprobs": {"content": [{"top_logprobs": [{"token": "1", "logprob": 0}]}]}}]}):
        with pytest.raises(ValueError):
            remote.label_shares(reply, ["1", "2"])


def pdf(*pages: bytes, packed: bool = True) -> bytes:
    stream = lambda b: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b) + b"\nendstream" if packed else b"<< >>\nstream\n" + b + b"\nendstream"
    kids = [b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))]
    out = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [" + b" ".join(kids) + b"] >> endobj"]
    for i, p in reversed(list(enumerate(pages))):
        out += [b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj" % (10 + 2 * i, 11 + 2 * i), b"%d 0 obj " % (11 + 2 * i) + stream(p) + b" endobj"]
    return b"%PDF-1.4\n" + b"\n".join(out)


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_lines(spark, tmp_path, packed):
    first = b"BT /F1 12 Tf 72 700 Td (CC20_1  Do you \\(or not\\)) Tj 0 -14 Td [(1 = y) -20 (es)] TJ T* <32203D206E6F> Tj ET"
    (tmp_path / "q.pdf").write_bytes(pdf(first, b"", b"BT (caf\\351) Tj ET", packed=packed))
    (tmp_path / "not.txt").write_bytes(b"x")
    got = sorted((r["file"], r["page"], r["line"], r["text"]) for r in remote.read_pdf_lines(spark, f"file://{tmp_path}").collect())
    assert got == [("q.pdf", 1, 1, "CC20_1 Do you (or not)"), ("q.pdf", 1, 2, "1 = yes"), ("q.pdf", 1, 3, "2 = no"), ("q.pdf", 3, 1, "café")]


def test_pdf_object_streams():
    inner = b"1 0 2 33 5 68 << /Type /Catalog /Pages 2 0 R >>"
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [5 0 R] >>", b"<< /Type /Page /Contents 6 0 R >>"]
    at, head = 0, b""
    for n, p in zip((1, 2, 5), parts, strict=True):
        head, at = head + b"%d %d " % (n, at), at + len(p) + 1
    inner = head + b" ".join(parts)
    body = b"7 0 obj << /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >>\nstream\n" % len(head) + zlib.compress(inner) + b"\nendstream endobj"
    assert remote.pdf_pages(b"%PDF-1.5\n" + body + b"\n6 0 obj << >>\nstream\nBT (deep) Tj ET\nendstream endobj") == ["deep\n"]
    with pytest.raises(ValueError):
        remote.pdf_pages(b"plain text")


def test_config(tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "a.json").write_text('{"k": 5, "paths": {"out": "made/here", "abs": "/tmp"}}')
    got = remote.read_config(str(tmp_path / "conf" / "a.json"), make=True)
    assert got["k"] == 5 and got["paths"] == {"out": f"{tmp_path}/made/here", "abs": "/tmp"} and (tmp_path / "made" / "here").is_dir()
    (tmp_path / "conf" / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        remote.read_config(str(tmp_path / "conf" / "b.json"))
