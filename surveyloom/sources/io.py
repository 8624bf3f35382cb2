"""Readers and writers of survey files, prediction sets and representation caches."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions import hashing, text
from surveyloom.operators.joins import anti, duplicate_keys
from surveyloom.operators.ranking import keep_last
from surveyloom.sources.commits import Commits, committed

QUESTIONS = "question_id string, question string, answer map<string,string>"
RESPONDENTS = "person_id bigint, attributes map<string,string>, questions_answer map<string,string>"


def read_domain(spark: SparkSession, repo: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """A1: the question file and the respondent file of a domain; a missing file fails."""
    name = "".join(c for c in domain.lower() if c.isalnum())
    read = lambda kind, schema: spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{repo}/{name}_{kind}.json")
    return read("questions", QUESTIONS), read("respondents", RESPONDENTS)


def flatten(questions: DataFrame, respondents: DataFrame, domain: str, ordinal_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """One row per valid answered item, and the counts of dropped answers by reason."""
    q = questions.select(
        F.lower("question_id").alias("question_id"), "question", F.col("answer").alias("_labels"), text.option_order(F.map_keys("answer")).alias("option_codes")
    )
    q = q.withColumn("options", F.transform("option_codes", lambda c: F.col("_labels")[c])).withColumn("is_ordinal", text.is_ordinal(F.col("question"), F.col("options")))
    canonical = text.canonical_attributes(F.col("attributes"))
    people = respondents.select(
        F.col("person_id").cast("string").alias("person_id"), *[c.alias(n) for n, c in canonical.items()], text.survey_weight(F.col("attributes")).alias("survey_weight"), F.explode("questions_answer").alias("question_id", "answer_code")
    ).withColumn("question_id", F.lower("question_id"))
    rows = people.join(q.drop("_labels"), "question_id", "left")
    index = F.array_position("option_codes", F.col("answer_code")) - 1
    reason = F.when(F.col("question").isNull(), "unknown question").when(F.coalesce(index, F.lit(-1)) < 0, "invalid answer").when(F.lit(ordinal_only) & ~F.col("is_ordinal"), "not ordinal")
    rows = rows.withColumn("reason", reason).withColumn("domain", F.lit(domain))
    dropped = rows.where("reason is not null").groupBy("domain", "reason").agg(F.count(F.lit(1)).alias("n"))
    panel, key = F.concat_ws("::", "domain", "person_id"), F.concat_ws("::", "domain", "question_id")
    kept = rows.where("reason is null").select(
        F.concat_ws("::", panel, "question_id").alias("row_id"), panel.alias("panel_id"), "person_id", "domain", "question_id", key.alias("question_key"), "question", "option_codes", "options",
        F.size("options").alias("n_options"), "answer_code", index.cast("int").alias("answer_index"), F.get("options", index.cast("int")).alias("answer_text"), "is_ordinal", "survey_weight",
        text.profile_text({n: F.col(n) for n in canonical}).alias("demographic_text"), *canonical,
    )
    if not kept.limit(1).count():
        raise ValueError(f"{domain}: no valid answer")
    if duplicate_keys(kept, ["row_id"]).limit(1).count():
        raise ValueError(f"{domain}: repeated row_id")
    return kept, dropped


def read_predictions(spark: SparkSession, folder: str, keys: list[str], exclude: tuple[str, ...] = ("perm_",)) -> DataFrame:
    """Parquet files and tables below a folder but for excluded names; of rows of one key the last (by name, then place) stays."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(folder)
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.substring_index(F.col("_metadata.file_path"), f"/{base}/", -1)
    rows = rows.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    for prefix in exclude:
        rows = rows.where(~F.col("_file").startswith(prefix))
    return keep_last(rows, keys, [F.col("_file"), F.col("_row")]).drop("_file", "_row")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None, where: Column | None = None, pattern: str | None = None) -> DataFrame:
    """A CSV with header; only the asked columns (by name or pattern) are parsed."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if pattern:
        import re

        columns = [c for c in df.columns if re.search(pattern, c)]
    df = df if columns is None else df.select(*columns)
    return df if where is None else df.where(where)


def read_jsonl(spark: SparkSession, path: str, key: str | list[str], schema: str, valid: str | None = None) -> DataFrame:
    """Records by line; blank lines are skipped, of one key the last line (by time of its file, then place) stays, then invalid ones go."""
    keys = [key] if isinstance(key, str) else list(key)
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_modification_time").alias("_t"), F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"))
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "_t", "_f", "_n").select("r.*", "_t", "_f", "_n")
    rows = keep_last(rows, keys, [F.col("_t"), F.col("_f"), F.col("_n")]).drop("_t", "_f", "_n")
    return rows if valid is None else rows.where(F.col(valid))


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Adds records to a log; earlier files stay as they are."""
    rows.write.mode("append").json(path)


def save_manifest(spark: SparkSession, path: str, payload) -> str:
    """A JSON document, whole or not at all, in any file system; returns the digest of its canonical text."""
    import hashlib

    digest = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    jvm = spark._jvm.org.apache.hadoop.fs
    to, held = jvm.Path(path), jvm.Path(f"{path}.tmp")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(held, True)
    out.write(bytearray(json.dumps({**payload, "manifest_sha256": digest}, indent=1, sort_keys=True).encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(held, to):
        raise OSError(f"cannot write {path}")
    return digest


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The document that save_manifest wrote; a changed one fails."""
    import hashlib

    payload = json.loads(spark.read.text(path, wholetext=True).first()[0])
    digest = payload.pop("manifest_sha256")
    if hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != digest:
        raise ValueError(f"{path} was changed")
    return payload


def save_folds(folds: DataFrame, path: str) -> str:
    """Item folds (domain, question_key, fold; null: calibration) as a manifest. Items are a catalogue, a few for each domain."""
    found: dict[str, dict[str, int | None]] = {}
    for r in folds.select("domain", "question_key", "fold").toLocalIterator():
        found.setdefault(r["domain"], {})[r["question_key"]] = r["fold"]
    return save_manifest(folds.sparkSession, path, {"folds": found})


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    """A12"""
    found = load_manifest(spark, path)["folds"]
    return spark.createDataFrame([(d, q, f) for d, items in found.items() for q, f in items.items()], "domain string, question_key string, fold int")


def save_prior(prior: dict[str, DataFrame], folder: str) -> None:
    """The tables of a fitted prior."""
    for name, df in prior.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_prior(spark: SparkSession, folder: str, names: tuple[str, ...] = ("question", "country", "position")) -> dict[str, DataFrame]:
    """A12"""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_option_vectors(options: DataFrame, path: str) -> None:
    """A10: (question_key, option_index, vector), sorted by question within files; vectors of differing widths fail."""
    if options.select(F.size("vector").alias("n")).distinct().limit(2).count() > 1:
        raise ValueError("vectors of several widths")
    options.select("question_key", F.col("option_index").cast("int").alias("option_index"), F.col("vector").cast("array<float>").alias("vector")).sortWithinPartitions("question_key", "option_index").write.mode("overwrite").parquet(path)


def load_option_vectors(spark: SparkSession, path: str, questions: list[str] | None = None) -> DataFrame:
    """A10: all vectors, or those of some questions (pushed to the scan)."""
    rows = spark.read.parquet(path)
    return rows if questions is None else rows.where(F.col("question_key").isin(*questions))


def save_predictions(rows: DataFrame, path: str, column: str = "p") -> None:
    """The probability array as JSON text, for interchange."""
    rows.withColumn(column, F.to_json(column)).write.mode("overwrite").parquet(path)


def load_predictions(spark: SparkSession, path: str, column: str = "p") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn(column, F.from_json(column, "array<double>"))


def write_tables(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet",)) -> None:
    """B1, B2: each table in each format."""
    for name, df in tables.items():
        for kind in formats:
            writer = df.write.mode("overwrite")
            (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{folder}/{name}.{kind}")


def review_report(items: DataFrame, title: str) -> DataFrame:
    """Numbered lines of a Markdown review of items (position, item, page, coverage, flags, snippet), to be written as text."""
    part = F.array(
        F.concat(F.lit("## "), F.col("item")), F.concat(F.lit("- Page: "), F.coalesce(F.col("page").cast("string"), F.lit("not found"))), F.concat(F.lit("- Coverage: "), F.format_number("coverage", 4)),
        F.concat(F.lit("- Automated flags: "), F.when(F.size("flags") == 0, "none").otherwise(F.array_join("flags", ", "))), F.lit("- Manual decision: PENDING"), F.coalesce("snippet", F.lit("")),
    )
    body = items.select(F.col("position"), F.posexplode(part).alias("line", "text"))
    head = items.sparkSession.createDataFrame([(-1, 0, f"# {title}")], "position int, line int, text string")
    return head.unionByName(body.select(F.col("position").cast("int"), "line", "text"))


def load_config(path: str, root: str | None = None) -> dict:
    """A JSON configuration with its ``paths`` made absolute against ``root`` (or the file's folder), each of them created."""
    with open(path) as f:
        config = json.load(f)
    base = root or os.path.dirname(os.path.abspath(path))
    config["paths"] = {k: v if os.path.isabs(v) or "://" in v else os.path.join(base, v) for k, v in config.get("paths", {}).items()}
    for v in config["paths"].values():
        if "://" not in v:
            os.makedirs(v, exist_ok=True)
    return config


def write_json(path: str, payload) -> None:
    """A driver-side JSON file, whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w") as f:
        json.dump(payload, f, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.tmp", path)


#: Partition columns of cached representations; a scan of one run reads one folder.
CACHE_KEYS = ("protocol", "split", "k", "option_seed", "family")


def write_cache(rows: DataFrame, folder: str) -> None:
    """Rows under one folder for each protocol, split, k, option seed and family."""
    rows.write.mode("append").partitionBy(*CACHE_KEYS).parquet(folder)


def read_cache(spark: SparkSession, folder: str, **wanted) -> DataFrame:
    """The rows of a run; only its folders are listed for reading."""
    rows = spark.read.parquet(folder)
    for key, value in wanted.items():
        if key not in CACHE_KEYS:
            raise ValueError(f"{key} is no partition column")
        rows = rows.where(F.col(key) == value)
    return rows


def fingerprint(settings: dict) -> str:
    """A digest of settings in sorted order."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


class VectorCache:
    """Rows with vectors and logits, appended by row id, under one fingerprint.

    A vector and its row are one record, so they cannot fall out of step. Writers that append at the same time find out
    by the log of commits: of two with a common id exactly one succeeds, and of two without both do.
    """

    names = ("row_id", "panel_id", "k", "vector", "logits")
    schema = "row_id string, panel_id string, k int, vector array<float>, logits array<float>"

    def __init__(self, spark: SparkSession, folder: str, settings: dict, overwrite: bool = False):
        self.spark, self.folder, self.fingerprint = spark, folder, fingerprint(settings)
        self.log = Commits(spark, folder)
        while True:
            entries = self.log.read()
            held = next((e["fingerprint"] for e in reversed(entries) if "fingerprint" in e), None)
            if held not in (None, self.fingerprint) and not overwrite:
                raise ValueError("the cache holds rows of other settings")
            if not (held is None or overwrite) or self.log.put(len(entries) + 1, {"fingerprint": self.fingerprint}):
                break

    def _entries(self) -> tuple[int, list[dict]]:
        """The last commit's number, and what was appended since the settings were last set; other settings since then fail."""
        entries = self.log.read()
        start = max(i for i, e in enumerate(entries) if "fingerprint" in e)
        if entries[start]["fingerprint"] != self.fingerprint:
            raise ValueError("the cache holds rows of other settings")
        return len(entries), entries[start:]

    def read(self) -> DataFrame:
        return committed(self.spark, self._entries()[1], self.schema)

    def missing(self, rows: DataFrame) -> DataFrame:
        """M1: rows that are not cached yet."""
        return anti(rows, self.read(), ["row_id"])

    def append(self, rows: DataFrame) -> None:
        """Repeated ids, in the rows or with the cache, and rows without a vector fail before anything is committed."""
        path = self.log.write(rows.select(*self.names), "rows")
        mine = self.spark.read.schema(self.schema).parquet(path)
        if duplicate_keys(mine, ["row_id"]).limit(1).count():
            raise ValueError("repeated row_id")
        if mine.where("vector is null").limit(1).count():
            raise ValueError("a row has no vector")
        checked: set[str] = set()
        while True:
            last, entries = self._entries()
            # what others have committed since the last look
            new = [e for e in entries if e.get("folder") and e["folder"] not in checked]
            if new and mine.join(committed(self.spark, new, self.schema).select("row_id"), "row_id", "left_semi").limit(1).count():
                raise ValueError("repeated row_id")
            checked |= {e["folder"] for e in new}
            if self.log.put(last + 1, {"folder": path}):
                return

    def validate(self) -> dict[str, int]:
        """Counts of rows, vectors and logits; repeated ids fail."""
        got = self.read().agg(F.count(F.lit(1)).alias("rows"), F.count("vector").alias("vectors"), F.count("logits").alias("logits"), F.countDistinct("row_id").alias("ids")).first()
        if got["rows"] != got["ids"] or got["rows"] != got["vectors"]:
            raise ValueError("rows, ids and vectors differ in number")
        return {k: got[k] for k in ("rows", "vectors", "logits")}


def synthetic_panels(spark: SparkSession, panels: int, items: int, domains: tuple[str, ...] = ("Environment", "Role of Government"), seed: int = 0) -> DataFrame:
    """Answers on five options from a hashed latent normal of panel and item; for tests."""
    base = spark.range(panels).withColumn("domain", F.explode(F.array(*[F.lit(x) for x in domains]))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(items - 1))))
    u = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)).cast("double") + 1) / float((1 << 30) + 1)
    z = F.sqrt(-2 * F.log(u("id", F.lit("a")))) * F.cos(2 * 3.141592653589793 * u("id", F.lit("b"))) + 0.5 * (u("id", "i", "domain") - 0.5)
    cuts = F.array(*[F.lit(c) for c in (-0.84, -0.25, 0.25, 0.84)])
    return base.select(
        F.concat_ws("::", "domain", F.col("id").cast("string")).alias("panel_id"), "domain", F.concat(F.lit("v"), F.col("i").cast("string")).alias("question_id"),
        F.concat_ws("::", "domain", F.concat(F.lit("v"), F.col("i").cast("string"))).alias("question_key"), F.size(F.filter(cuts, lambda c: c < z)).alias("answer_index"), F.lit(5).alias("n_options"),
        hashing.split_of(hashing.little_endian_bucket(F.col("id"), 1701)).alias("split"),
    )


def save_index(rows: DataFrame, name: str, path: str, key: str = "panel_id", buckets: int = 16) -> DataFrame:
    """A3: ``rows`` as a table of ``buckets`` files, each with whole keys in order; joins and counts by ``key`` of such tables need no shuffle.

    The table is registered as ``name`` in the session's catalogue; one of that name is replaced.
    """
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)
