"""Document fingerprints by winnowing.

A text is cut into tokens; every run of ``k`` tokens is a gram, hashed to 32
bits. Of every ``window`` consecutive grams the smallest hash is chosen, the
rightmost one on ties, and chosen grams keep their positions. Two texts that
share ``k + window - 1`` consecutive tokens therefore share a chosen gram.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm.shared import bucket_of, free_name, n_partitions, range_bounds, table

K = 3
WINDOW = 4
_ALONE = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
#: A token is up to 24 Latin characters, one character of a script written without spaces, or up to 24 others that are
#: no white space. The Latin ranges stand first, as plain comparisons, because most tokens end there.
TOKEN = f"[\\x21-\\x7E\\u00A1-\\u024F]{{1,24}}|[{_ALONE}]|[^\\s\\x21-\\x7E\\u00A1-\\u024F{_ALONE}]{{1,24}}"
_LOW = (1 << 31) - 1


def chosen_grams(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Chosen grams of a text as array<bigint>, in text order.

    Each element packs the 32-bit hash above 31 bits that count positions
    downwards, so that the least element is the least hash and, on ties, the
    rightmost one. Null and empty texts, and texts without tokens, give an
    empty array. A text of fewer than ``k`` tokens is one gram; one of fewer
    than ``window`` grams is one window.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    ids = F.transform(tokens, lambda t: F.xxhash64(t))

    def grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - (k - 1), F.least(F.size(h), F.lit(1)))

        def packed(x: Column, i: Column) -> Column:
            whole = F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])
            return F.shiftleft(F.shiftrightunsigned(whole, 32), 31).bitwiseOR((F.lit(_LOW) - i).cast("bigint"))

        return F.slice(F.transform(h, packed), F.lit(1), n)

    def winnowed(g: Column) -> Column:
        least, step = g, 1
        while step < window:
            tail = F.slice(least, F.lit(1 + step), F.greatest(F.size(least) - step, F.lit(0)))
            least = F.zip_with(least, tail, lambda a, b: F.least(a, b))
            step *= 2
        windows = F.greatest(F.size(g) - (window - 1), F.least(F.size(g), F.lit(1)))
        return F.array_distinct(F.slice(least, F.lit(1), windows))

    # get(transform(array(x), f), 0) names an intermediate value, so that it is computed once
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bind(bind(ids, grams), winnowed)


def gram_hashes(chosen: Column) -> Column:
    """The distinct 32-bit hashes of chosen grams."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, 31)))


def gram_positions(chosen: Column) -> Column:
    """Token positions of chosen grams, ascending."""
    return F.transform(chosen, lambda x: (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW).cast("bigint"))).cast("int"))


def fingerprint_text(chosen: Column) -> Column:
    """``position:hash`` pairs (decimal, eight hex digits), comma-joined."""
    return F.array_join(
        F.transform(
            chosen,
            lambda x: F.concat(
                (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW).cast("bigint"))).cast("string"),
                F.lit(":"),
                F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 31)), 8, "0")),
            ),
        ),
        ",",
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_fingerprint(df: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``chosen`` (packed), ``positions`` and ``hashes`` of the chosen grams to every row."""
    out = df.withColumn("chosen", chosen_grams(F.col(text), k, window))
    return out.withColumn("positions", gram_positions(F.col("chosen"))).withColumn("hashes", gram_hashes(F.col("chosen")))


def with_next(df: DataFrame, id_col: str = "doc_id", value_cols: tuple[str, ...] = ("text",), make=None) -> DataFrame:
    """Add ``next_<column>`` from the row that follows by ascending id (after the last: the first).

    Rows are cut into ranges of the id; the first row of each range is also
    sent to the range before it, so that no task sees more than its range.
    Rows of equal id follow by the columns' values; null ids come first.
    ``make`` may add columns after the shuffle, which ``value_cols`` may name.
    """
    spark = df.sparkSession
    at_, b_, g_ = (free_name(df.columns, x) for x in ("_at", "_b", "_g"))
    parts = 4 * n_partitions(spark)
    bounds = range_bounds(df, id_col, parts)
    here = bucket_of(F.col(id_col), bounds)
    last = len(bounds) - 1
    has_null = bool(df.where(F.col(id_col).isNull()).limit(1).count()) if df.schema[id_col].nullable else False
    first = -1 if has_null else 0
    # a row that opens a range is a guest in the range before; the first of all is a guest in the last
    before = F.when(F.col(b_) == first, F.lit(last)).otherwise(F.col(b_) - 1)
    opens = F.col(b_).isin(-1) if not bounds else (
        (F.col(b_) == -1) | (F.get(F.lit(bounds).cast("array<bigint>"), F.greatest(F.col(b_), F.lit(0))) == F.col(id_col))
    )
    keep = [c for c in df.columns]
    rows = df.withColumn(b_, here)
    at = F.when(opens, F.array(F.struct(F.col(b_).alias("b"), F.lit(0).alias("g")), F.struct(before.alias("b"), F.lit(1).alias("g")))).otherwise(
        F.array(F.struct(F.col(b_).alias("b"), F.lit(0).alias("g")))
    )
    rows = rows.withColumn(at_, F.explode(at)).select(*keep, F.col(f"{at_}.b").alias(b_), F.col(f"{at_}.g").alias(g_))
    rows = rows.repartition(n_partitions(spark), b_)
    if make is not None:
        rows = make(rows)
    w = Window.partitionBy(b_).orderBy(g_, F.col(id_col).asc_nulls_first(), *[F.col(c) for c in keep if c != id_col])
    rows = rows.select(*rows.columns, *[F.lead(c).over(w).alias(f"next_{c}") for c in value_cols])
    return rows.where(F.col(g_) == 0).drop(b_, g_)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Null and empty texts have the empty fingerprint; two empty fingerprints are
    alike to 1, an empty and another one to 0. The only document of a table is
    its own next.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = lambda d: d.withColumn("chosen", chosen_grams(F.col("text")))
    rows = with_next(docs, "doc_id", ("text", "chosen"), made)
    n = F.char_length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars").cast("int") - half)), F.substring(F.col("next_text"), F.lit(1), half))
    )
    rows = rows.withColumn("edited_chosen", chosen_grams(F.col("edited")))
    mine = gram_hashes(F.col("chosen"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("chosen")).alias("fingerprint"),
        fingerprint_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(mine, gram_hashes(F.col("edited_chosen"))).alias("near_edited"),
        likeness(mine, gram_hashes(F.col("next_chosen"))).alias("near_next"),
    )
