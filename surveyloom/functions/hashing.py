"""Deterministic hashing: three named schemes that must not be mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json_part(part) -> Column:
    if isinstance(part, Column):
        text = part.cast("string")
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit('"'), text, F.lit('"'))
    if isinstance(part, str):
        return F.lit('"' + part.replace("\\", "\\\\").replace('"', '\\"') + '"')
    return F.lit(str(part))


def json_payload(*parts) -> Column:
    """The text of a JSON array; columns count as strings, which must be ASCII, and numbers stay numbers."""
    joined = []
    for i, part in enumerate(parts):
        joined += [F.lit(", ")] * bool(i) + [_json_part(part)]
    return F.concat(F.lit("["), *joined, F.lit("]"))


def stable_hex(*parts) -> Column:
    """I8 as 16 hex digits: in string order they sort like the 64-bit number."""
    return F.substring(F.sha2(json_payload(*parts), 256), 1, 16)


def stable_number(*parts) -> Column:
    """I8 as a number (decimal(20,0))."""
    return F.conv(stable_hex(*parts), 16, 10).cast("decimal(20,0)")


def seeded_digest(seed: int, *parts: Column) -> Column:
    """SHA-256 hex of ``seed|part|part...``."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def little_endian_bucket(value: Column, seed: int, modulus: int = 10) -> Column:
    """The first eight digest bytes of ``seed|value``, least byte first, modulo ``modulus``."""
    digest = seeded_digest(seed, value)
    turned = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.pmod(F.conv(turned, 16, 10).cast("decimal(20,0)"), F.lit(modulus)).cast("int")


def big_endian_bucket(value: Column, seed: int, modulus: int = 10) -> Column:
    """The same with the greatest byte first."""
    head = F.conv(F.substring(seeded_digest(seed, value), 1, 16), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(modulus)).cast("int")


def content_key(*parts: Column) -> Column:
    """A digest of fields in fixed order."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"f{i}") for i, p in enumerate(parts)])), 256)


def split_of(bucket: Column) -> Column:
    """Buckets 0-5 train, 6-7 validation, 8-9 test."""
    return F.when(bucket <= 5, "train").when(bucket <= 7, "validation").otherwise("test")


def hash_order(seed: int, row: Column, n: Column) -> Column:
    """A permutation of 0..n-1, fixed by seed and row."""
    ranked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), row, i.cast("string")), 256).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(ranked), lambda x: x["i"])
