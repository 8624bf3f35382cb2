"""SentencePiece encoding and decoding of merge-type (BPE) models, without the library.

Encoding is exact and needs no priority queue. Adjacent tokens are *compatible*
if merging the characters of both gives the same two tokens again; a text has
exactly one cover by pairwise compatible tokens, and that is its encoding. It
is found by backtracking: take the longest token that starts here, fall back
to its next shorter prefix while the pair is not compatible, and step back when
none is left. A bitfield marks positions from which no cover exists, so that
none is tried twice. The longest tokens that start at each position come from
one Aho-Corasick pass over the reversed text: there they are the longest
matches that end at each position, and each state knows its own.

No piece of such a model has a word boundary inside, so words are encoded one
by one, and frequent ones are remembered.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.shared import by_bytes, free_name, released, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Keys of a state of the automaton beside its characters, and the most entries that steps over suffix links fill it up to.
SUFFIX, LONGEST, STEPS = 0, 1, 256
#: Words that a worker remembers.
REMEMBERED = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size = varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _automaton(tokens: set[str]) -> dict:
    """The start of an Aho-Corasick automaton over the reversed tokens.

    A state is a table from characters to states; beside them it holds the
    state of its longest proper suffix and the longest token that ends here.
    ``_next`` adds the steps over suffix links when they are first taken, so a
    character of a text costs one look, however many tokens end at it.
    """
    start: dict = {SUFFIX: None, LONGEST: None}
    for token in tokens:
        state = start
        for c in reversed(token):
            state = state.setdefault(c, {})
        state[LONGEST] = token
    level = [(start, c, child) for c, child in start.items() if c not in (SUFFIX, LONGEST)]
    while level:  # breadth first: the suffix of a state is finished before it
        below = []
        for parent, c, state in level:
            below += [(state, k, child) for k, child in state.items() if k != LONGEST]
            suffix = parent[SUFFIX]
            while suffix is not None and c not in suffix:
                suffix = suffix[SUFFIX]
            state[SUFFIX] = start if suffix is None else suffix[c]
            state.setdefault(LONGEST, state[SUFFIX][LONGEST])
        level = below
    return start


def _next(state: dict, c: str) -> dict:
    """The state after a character without a step of its own: that of the nearest suffix that has one, else the start."""
    suffix = state
    while suffix[SUFFIX] is not None and c not in suffix:
        suffix = suffix[SUFFIX]
    found = suffix.get(c, suffix)
    if len(state) < STEPS:
        state[c] = found
    return found


class PieceModel:
    """A merge-type model, read from the bytes of its file."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type (BPE) model")
        if normalizer.get(2) or any(kind == USER for *_, kind in pieces) or trainer.get(24, 0):
            raise ValueError("models with a character map, user symbols or word-end marks are not supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.pieces = pieces
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.known = {p for p in self.id if len(p) == 1}
        known = f"[{re.escape(''.join(sorted(self.known)))}]"
        self.runs = re.compile(f"{known}+|(?:(?!{known}).)+" if self.known else ".+", re.DOTALL)
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        # tokens that merging can reach, the two parts of each one's last merge, and its longest proper prefix that is a token
        self.tokens, self.parts = set(), {}
        for p in self.id:
            merges = [("", "")]
            if len(p) == 1 or self.merge(p, merges) == [p]:
                self.tokens.add(p)
                self.parts[p] = merges[-1]
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.tokens), None) for p in self.tokens}
        self.start = _automaton(self.tokens)
        self.fits: dict[str, dict[str, str | None]] = {}
        self.n_fits = 0
        self.words: dict[str, tuple[int, ...]] = {}
        self.digits = [str(i) for i in range(len(pieces))]

    def merge(self, text: str, merges: list[tuple[str, str]] | None = None) -> list[str]:
        """Tokens by merging: always the pair of best score, the leftmost on ties. ``merges`` collects the pairs."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            if merges is not None:
                merges.append((parts[best], parts[best + 1]))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of both gives the two tokens again.

        The merges inside both are taken back, the latest first, and after
        each step the parts that then meet are looked at: had their merge come
        before the one just taken back (on a tie: had it stood further left),
        it would have joined them.
        """
        score, parts = self.score, self.parts
        none = float("-inf")
        x, y, limit, tie = a, b, none, True
        while True:
            joined = score.get(x + y)
            if joined is not None and (joined > limit or (tie and joined == limit)):
                return False
            sx = score[x] if len(x) > 1 else float("inf")
            sy = score[y] if len(y) > 1 else float("inf")
            if len(x) == 1 and len(y) == 1:
                return True
            # of two merges of one score the left one came first, so the right one is taken back first
            if sx < sy:
                x, limit, tie = parts[x][1], sx, False
            else:
                y, limit, tie = parts[y][0], sy, True

    def cover(self, text: str) -> list[str]:
        """The one cover of a text (of known characters) by pairwise compatible tokens."""
        if text in self.tokens:
            return [text]
        n = len(text)
        longest: list[str | None] = []  # the longest token that starts at each position, from the last one
        state = self.start
        for c in reversed(text):
            state = state.get(c) or _next(state, c)
            longest.append(state[LONGEST])
        longest.reverse()
        fits, shorter = self.fits, self.shorter
        dead = bytearray((n >> 3) + 1)  # bit p: no cover goes on from p
        out: list[str] = []
        at, last = 0, ""
        token = longest[0]
        while True:
            row = fits.get(last)
            while token is not None:
                try:
                    token = row[token]  # incompatible ones are passed over at once
                except (KeyError, TypeError):
                    token = self._fitting(last, token)
                    row = fits[last]
                if token is None:
                    break
                end = at + len(token)
                if not dead[end >> 3] >> (end & 7) & 1:
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at, last = end, token
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else ""

    def _fitting(self, last: str, token: str | None) -> str | None:
        """The longest of a token and its shorter prefixes that may follow ``last`` (empty: any may), if there is one; remembered."""
        if self.n_fits >= REMEMBERED:
            self.fits.clear()
            self.n_fits = 0
        row = self.fits.setdefault(last, {})
        first = token
        while last and token is not None and not self.compatible(last, token):
            token = self.shorter[token]
        row[first] = token
        self.n_fits += 1
        return token

    def _word(self, word: str) -> tuple[int, ...]:
        if self.known.issuperset(word):
            ids = tuple([self.id[p] for p in self.cover(word)])
        else:
            found: list[int] = []
            for run in self.runs.findall(word):
                if run[0] in self.known:
                    found += [self.id[p] for p in self.cover(run)]
                else:
                    found += [self.bytes[b] for b in run.encode()] if self.byte_fallback else [self.unknown] * len(run)
            ids = tuple(found)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(word) <= 64:  # longer ones are rare and would fill the memory
            self.words[word] = ids
        return ids

    def _split(self, text: str) -> list[str]:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if self.by_word else [text]

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for w in self._split(text):
            out += words.get(w) or self._word(w)
        return out

    def encode_with_text(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same in decimal, comma-joined."""
        ids = self.encode(text)
        return ids, ",".join([self.digits[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as UTF-8 (each faulty byte as U+FFFD), word marks as spaces, without the first."""
        out, raw = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                at += size
            raw.clear()

        first = True
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                raw.append(self.byte_of[i])
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            else:
                if first and self.dummy_prefix and piece.startswith(SPACE):
                    piece = piece[1:]
                out.append(piece.replace(SPACE, " "))
            first = False
        flush()
        return "".join(out)


_loaded: dict[bytes, tuple] = {}


def load_model(data: bytes) -> tuple[PieceModel, object]:
    """The model and the library's processor of the same file, once for each worker."""
    import sentencepiece

    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded[key] = PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    return _loaded[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def with_pieces(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int>, the encoding of each text (null: of the empty text).

    A column of that name in any case gives the new one an underscore at the end.
    """
    data = open(model_path or default_model(), "rb").read()  # a vocabulary file: under a MB, and it does not grow
    names, added = docs.columns, free_name(docs.columns, "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = load_model(data)
        for batch in released(batches):
            for at, size in by_bytes(batch.column(names.index(text_col)), 4 << 20):
                part = batch.slice(at, size)
                ids = [model.encode(t or "") for t in part.column(names.index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, added])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(added, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(encode, schema)


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def piece_digests(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number and digest of its ids, and the digest of the text that they decode to.

    Null and empty texts have no ids and decode to the empty text. Rows of
    null or repeated ids are encoded like any other; other columns are not read.
    """
    data = open(model_path or default_model(), "rb").read()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, library = load_model(data)
        for batch in released(batches):
            out = []
            for text in batch.column(1):
                ids, written = model.encode_with_text(text.as_py() or "")
                decoded = library.decode(ids) if ids else ""
                out.append((len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=_ROWS)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    return source.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document."""
    return piece_digests(table(spark, sf_dir, "documents"))
