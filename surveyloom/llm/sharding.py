"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: a
start and a step from its name. The shards take turns, and each claims its most
preferred slot that is free, until none is. Every shard holds the same number
of slots but for one, and when a shard leaves, few other slots move. Placing a
key is one hash and one lookup; the table has a fixed size and is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.shared import table

#: A prime well above a hundred times the usual number of shards.
SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, and named differently")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime not below the number of shards")
    draw = lambda name, what: int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")
    at = [draw(s, "start") % slots for s in shards]
    step = [draw(s, "step") % (slots - 1) + 1 for s in shards]
    held = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for i in range(len(shards)):
            while held[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            held[at[i]] = i
            left -= 1
            if not left:
                break
    return held


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; columns of these names in ``rows`` are replaced.

    Null keys and equal keys go to one slot each, whatever else the rows hold;
    an empty table gives no rows.

    The lookup table has ``slots`` rows, which bounds what is broadcast.
    """
    spark = rows.sparkSession
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(shards, slots).tolist())], "slot int, shard string")
    others = [F.col(c) for c in rows.columns if c not in ("slot", "shard")]
    return rows.select(*others, slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(lookup), "slot", "left")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, of 64 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", [f"shard-{i:03d}" for i in range(64)]).select("doc_id", "slot", "shard")
