"""Helpers used by several operators: shared storage, sizes and ordering buckets."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.sources.scratch import filesystem, fresh_path  # noqa: F401
from surveyloom.sources.shipping import ship

#: The C library's way to give freed memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
#: Characters that separate words: space, tab and the ASCII line breaks.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete staged tables whose readers have all been written or staged themselves."""
    for df in tables:
        path = df.__dict__.pop("staged_path", None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(batches: Iterator) -> Iterator:
    """The batches of a task; what the work on one has freed goes back to the system before the next comes.

    Workers live on between stages, so memory that they keep is missing elsewhere.
    """
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Start and length of slices of at most ``most`` bytes (a longer text stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to - at
        at, before = to, int(ends[to - 1])


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as make it differ from ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` ascending values of an integer column that cut it into ranges of similar size.

    The values come from the data, and the smallest is the first of them. Only
    ``parts`` numbers reach the driver.
    """
    quantiles = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]) if parts > 1 else F.array(F.lit(0.5))
    low, cuts = df.agg(F.min(column), F.percentile_approx(column, quantiles, 10_000)).first()
    if low is None:
        return []
    return sorted({low, *(cuts or [])})


def bucket_of(column: Column, bounds: list[int]) -> Column:
    """Index of the last bound that is not above ``column`` (-1: none), by bisection."""
    if not bounds:
        return F.lit(-1)
    steps = max(1, len(bounds).bit_length())
    cuts = F.lit(bounds).cast("array<bigint>")
    start = F.struct(F.lit(-1).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        done = acc["hi"] - acc["lo"] <= 1
        right = F.get(cuts, F.greatest(mid, F.lit(0))) <= column
        return F.struct(
            F.when(done | ~right, acc["lo"]).otherwise(mid).alias("lo"),
            F.when(done | right, acc["hi"]).otherwise(mid).alias("hi"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda acc: acc["lo"])
    return F.when(column.isNull(), F.lit(-1)).otherwise(found)
