"""Item catalogues: finding items in questionnaires, labels, structured records, splits and audits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import text
from surveyloom.operators.metrics import rank_correlation
from surveyloom.sources.scratch import written

# Kinds of items and of scales in structured records, in the order of their features.
ITEM_TYPES = ["attitude", "behavior", "factual_knowledge", "perception", "identity", "demographic", "other"]
SCALE_TYPES = ["binary", "ordinal", "nominal", "multi_select_binary", "numeric", "other"]


def usable_items(catalogue: DataFrame, waves: list[str], coverage: float = 0.85, entropy: float = 0.25) -> DataFrame:
    """Found items of the waves with a text of their own that is not dynamic, of enough coverage and entropy; null flags count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return catalogue.where(
        F.col("wave").isin(*waves) & flag("found") & flag("item_specific_text") & ~flag("dynamic_text") & (F.col("paired_coverage") >= coverage) & (F.col("entropy_nats") >= entropy)
    )


def locate_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """I16: where each item (item, family) is first defined in pages (page, text), the lines around it, and its risks.

    On a page lines that begin with the item, bare or in brackets, count before
    lines that only mention it. The snippet runs from the last line of the
    item's family before (or eight lines above) to fifteen lines below. Items
    that no page mentions come back with ``found`` false.
    """
    lined = pages.select("page", F.split("text", "\n").alias("lines"))
    lines = lined.select("page", F.posexplode("lines").alias("i", "line"))
    names = items.select("item", F.lower("item").alias("low"))
    low = F.lower("line")
    bare = F.substring(low, F.char_length("low") + 1, F.lit(1))
    begins = (F.startswith(low, F.concat(F.lit("["), F.col("low"), F.lit("]"))) & F.substring(low, F.char_length("low") + 3, F.lit(1)).rlike(r"^\s?$")) | (F.startswith(low, F.col("low")) & bare.rlike(r"^[-\s]?$"))
    hits = lines.join(names, F.contains(low, F.col("low"))).select("item", "page", "i", begins.alias("exact"))
    on_page = hits.groupBy("item", "page").agg(
        F.coalesce(F.min(F.when(F.col("exact"), F.col("i"))), F.min("i")).alias("i"), F.coalesce(F.nullif(F.sum(F.col("exact").cast("int")), F.lit(0)), F.count(F.lit(1))).alias("n")
    )
    first = on_page.groupBy("item").agg(F.min(F.struct("page", "i")).alias("at"), F.sum("n").alias("definitions")).select("item", "at.page", "at.i", "definitions")
    both = items.select("item", "family").join(first, "item", "left").join(lined, "page", "left")
    head = F.slice("lines", F.lit(1), F.col("i") + 1)
    kin = F.concat(F.lit(r"(?i)(?:^|\[)"), F.col("family"), F.lit(r"(?:grid|\]|-|\s|$)"))
    last = F.array_max(F.filter(F.transform(head, lambda x, j: F.when(F.regexp_like(x, kin), j)), lambda j: j.isNotNull()))
    start = F.coalesce(last, F.greatest(F.col("i") - 8, F.lit(0)))
    end = F.least(F.size("lines"), F.col("i") + 16)
    snippet = F.coalesce(F.array_join(F.slice("lines", start + 1, end - start), " "), F.lit(""))
    rows = both.select("item", "family", F.col("page").isNotNull().alias("found"), "page", F.coalesce("definitions", F.lit(0)).alias("definitions"), snippet.alias("snippet"))
    has = lambda *words: text.contains_any(F.lower("snippet"), words)
    proxy = F.regexp_replace("snippet", r"(?i)\b(Questionnaire|Page:)\b[^\[]*", " ")
    proxy = text.collapse_spaces(F.regexp_replace(proxy, r"(?i)\b(varlabel|required|displaymax|collapsible|width):?\s*\w*", " "))
    return rows.select(
        "*", has("show if", "askvote").alias("branch_risk"), has("random").alias("randomized"), has("multiple", "check all").alias("multiple_select"), F.contains("snippet", F.lit("$")).alias("dynamic_text"), proxy.alias("proxy_text")
    )


def completed_labels(items: DataFrame) -> DataFrame:
    """``labels`` (map of code to label) completed by the longest label of the family; ``missing`` observed codes; ``retained`` if none is missing.

    ``items``: item, family, observed (codes), labels.
    """
    items = written(items, "items")  # labels may be dear to read from snippets, and are used several times
    each = items.select("family", "item", F.explode("labels").alias("code", "label"))
    longest = each.groupBy("family", "code").agg(F.min_by("label", F.struct(-F.char_length("label"), F.col("item"))).alias("label"))
    kin = longest.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("code", "label"))).alias("_kin"))
    rows = items.join(kin, "family", "left")
    own = F.coalesce("labels", F.create_map().cast("map<int,string>"))
    spare = F.map_filter(F.coalesce("_kin", F.create_map().cast("map<int,string>")), lambda k, _: ~F.map_contains_key(own, k))
    rows = rows.withColumn("labels", F.map_concat(spare, own)).drop("_kin")
    rows = rows.withColumn("missing", F.filter("observed", lambda c: ~F.map_contains_key(F.col("labels"), c)))
    return rows.withColumn("retained", F.size("missing") == 0)


def _first_object(value: str | None) -> str | None:
    decoder, at = json.JSONDecoder(), -1
    while value is not None and (at := value.find("{", at + 1)) >= 0:
        try:
            found, _ = decoder.raw_decode(value, at)
        except json.JSONDecodeError:
            continue
        return json.dumps(found, sort_keys=True, separators=(",", ":"))
    return None


def first_json(prose: Column) -> Column:
    """The first JSON object in a text, in canonical form; null if there is none. Nested braces are no regular language, hence Python."""

    @F.pandas_udf("string")
    def parse(values: pd.Series) -> pd.Series:
        return values.map(_first_object)

    return parse(prose)


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    return F.array(*[(F.coalesce(value, F.lit("")) == v).cast("double") for v in vocabulary])


def option_features(domains: list[str], constructs: list[str]) -> Column:
    """Item features from item_type, scale_type, domains, constructs (name, relevance) and global_uncertainty.

    Vocabularies are fitted values; names outside them have no feature.
    """
    weight = lambda name: F.coalesce(F.try_element_at(F.filter(F.transform("constructs", lambda c: F.when(c["name"] == name, c["relevance"])), lambda x: x.isNotNull()), F.lit(-1)), F.lit(0.0))
    listed = F.coalesce(F.col("domains"), F.array().cast("array<string>"))
    return F.concat(
        one_hot(F.col("item_type"), ITEM_TYPES), one_hot(F.col("scale_type"), SCALE_TYPES), F.array(*[F.array_contains(listed, d).cast("double") for d in domains]),
        F.array(*[F.when(F.size("constructs") > 0, weight(c)).otherwise(0.0) for c in constructs]) if constructs else F.array().cast("array<double>"), F.array(F.coalesce(F.col("global_uncertainty"), F.lit(0.0))),
    )


def structured_matrix(asked: DataFrame, records: DataFrame, domains: list[str], constructs: list[str], templates: tuple[str, str] = ("v1", "v2")) -> DataFrame:
    """``features`` of each (item, option_code): four of the option, then the item's; zeros, and ``known`` false, without a record.

    The record of the first template is taken, else of the second. ``records``:
    item, template, item columns of option_features, options (code, stance_direction, behavior_intensity, is_neutral, uncertainty).
    """
    first = records.where(F.col("template").isin(*templates))
    # records are sorted by item: a task gets some 20,000 of them, however small their files are
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), first.count() // 20_000)
    first = first.withColumn("_f", option_features(domains, constructs)).repartition(n, "item")
    first = first.groupBy("item").agg(F.min_by(F.struct("_f", "options"), F.when(F.col("template") == templates[0], 0).otherwise(1)).alias("r")).select("item", "r._f", "r.options")
    own = F.get(F.filter("options", lambda o: o["code"] == F.col("option_code")), F.lit(0))
    four = F.array(own["stance_direction"], own["behavior_intensity"], F.coalesce(own["is_neutral"], F.lit(False)).cast("double"), own["uncertainty"])
    width = 4 + len(ITEM_TYPES) + len(SCALE_TYPES) + len(domains) + len(constructs) + 1
    rows = asked.join(first.hint("merge"), "item", "left")  # records grow with the items: they are never broadcast
    known = F.coalesce(own["code"].isNotNull(), F.lit(False))
    return rows.select(*asked.columns, F.when(known, F.concat(four, F.col("_f"))).otherwise(F.array_repeat(F.lit(0.0), width)).alias("features"), known.alias("known"))


#: Two wordings that ask for the structure of an item; {item}, {question}, {options} and {schema} are filled in.
ITEM_TEMPLATES = {
    "v1": "Describe what this survey item measures. Say nothing about who might answer it.\n\nItem: {item}\nQuestion: {question}\nOptions:\n{options}\n\nAnswer with one JSON object of this schema:\n{schema}\n",
    "v2": "Code this questionnaire variable for a measurement model. Do not guess how often an answer is given.\n\nVariable: {item}\nWording: {question}\nChoices:\n{options}\n\nJSON of this schema only:\n{schema}\n",
}


def item_prompts(items: DataFrame, options: DataFrame, schema: str, templates: dict[str, str] = ITEM_TEMPLATES) -> DataFrame:
    """A prompt of each template for each item (item, question), with a key that follows from item, wording and template.

    ``options``: item, position, code, label.
    """
    listed = options.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("position", "code", "label"))).alias("o"))
    lines = F.array_join(F.transform("o", lambda x: F.concat(F.lit("- ["), x["code"].cast("string"), F.lit("] "), x["label"])), "\n")
    rows = items.join(listed, "item").select("item", "question", lines.alias("options"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("wording")) for k, v in templates.items()]))
    rows = rows.select("*", kinds.alias("t")).select("item", "question", "options", "t.*")
    prompt = F.col("wording")
    for name, value in (("schema", F.lit(schema)), ("item", F.col("item")), ("options", F.col("options")), ("question", F.col("question"))):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), value)
    key = F.sha2(F.concat_ws("\x1f", "item", "question", "options", "template"), 256)
    return rows.select("item", "template", key.alias("cache_key"), prompt.alias("prompt"))


def agreement_audit(records: DataFrame, valid_rate: float = 0.9, stance: float = 0.5) -> DataFrame:
    """How far the records of two templates agree (item, template, valid, item_type, scale_type, options); one row.

    Rank correlations of options that both have; fewer than three count as 0.
    """
    sizes = records.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.col("valid").cast("int")), F.lit(0)).alias("valid_records"))
    good = records.where("valid")
    side = lambda t, x: good.where(F.col("template") == t).select("item", F.struct("item_type", "scale_type", "options").alias(x))
    both = side("v1", "a").join(side("v2", "b"), "item")
    same = both.agg(
        F.count(F.lit(1)).alias("paired_items"), F.coalesce(F.avg((F.col("a.item_type") == F.col("b.item_type")).cast("double")), F.lit(0.0)).alias("item_type_agreement"),
        F.coalesce(F.avg((F.col("a.scale_type") == F.col("b.scale_type")).cast("double")), F.lit(0.0)).alias("scale_type_agreement"),
    )
    options = lambda x: both.select("item", F.explode(f"{x}.options").alias("o")).select("item", "o.code", F.col("o.stance_direction").alias(f"s{x}"), F.col("o.behavior_intensity").alias(f"i{x}"))
    pairs = options("a").join(options("b"), ["item", "code"])
    rho = lambda x, y, name: rank_correlation(pairs, x, y).select(F.when(F.col("n") >= 3, F.coalesce("rho", F.lit(0.0))).otherwise(0.0).alias(name))
    ranks = rho("sa", "sb", "option_stance_spearman").crossJoin(rho("ia", "ib", "option_intensity_spearman"))
    rate = F.col("valid_records") / F.greatest("records", F.lit(1))
    out = sizes.crossJoin(same).crossJoin(ranks).withColumn("valid_rate", rate)  # one row each
    return out.withColumn("stable_enough", (F.col("valid_rate") >= valid_rate) & (F.col("option_stance_spearman") >= stance))


def pretest_respondents(wide: DataFrame, unit: str, targets: list[str], sources: list[str], least: int, n: int) -> DataFrame:
    """C11: the first ``n`` units by id that answered all targets and enough sources; fewer fail."""
    given = sum((F.col(c).isNotNull().cast("int") for c in sources), F.lit(0))
    found = wide.dropna(subset=targets).withColumn("history_count", given).where(F.col("history_count") >= min(least, len(sources))).orderBy(unit).limit(n)
    if found.count() < n:
        raise ValueError(f"fewer than {n} respondents pass the filters")
    return found


def locked_split(catalogue: DataFrame, n_targets: int, seed: int, least_sources: int = 40, least_targets: int = 10, coverage: float = 0.95) -> dict:
    """Source items and one target item of each family, as a document to be saved with its digest (sources.io.save_manifest).

    Only item names reach the driver; a catalogue has hundreds.
    """
    good = catalogue.where("eligible")
    sources = sorted(r["item"] for r in good.where("wave = 'source_pre'").select("item").collect())
    order = [F.desc("paired_coverage"), F.desc("entropy_nats"), F.asc("item")]
    targets = good.where((F.col("wave") == "target_post") & (F.col("paired_coverage") >= coverage))
    best = targets.withColumn("_r", F.row_number().over(Window.partitionBy("family").orderBy(*order))).where("_r = 1")
    chosen = best.orderBy(F.desc("paired_coverage"), F.desc("entropy_nats"), F.asc("family")).limit(n_targets).select("item", "family").collect()
    if len(sources) < least_sources or len(chosen) < least_targets:
        raise ValueError("too few items are left after the selection by family")
    return {"seed": seed, "source_items": sources, "target_items": [r["item"] for r in chosen], "target_families": [r["family"] for r in chosen]}


def deviating_questions(tables: DataFrame, population: DataFrame, catalogue: DataFrame, n: int = 3, cluster: str = "cluster") -> DataFrame:
    """for each persona the questions whose shares ``p`` differ most from ``pq`` at any option, with the modal answer, as a text.

    ``catalogue``: question_key, question, options.
    """
    gap = F.array_max(F.zip_with("p", "pq", lambda a, b: F.abs(a - b)))
    rows = tables.join(population, "question_key").withColumn("gap", F.round(gap, 12))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("gap"), "question_key"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= n).join(catalogue, "question_key")
    line = F.concat(F.col("question"), F.lit(" -> "), F.get("options", (F.array_position("p", F.array_max("p")) - 1).cast("int")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "; ")
    return rows.groupBy(cluster).agg(F.concat(F.lit("Persona tendencies (calibration only): "), listed).alias("persona"))


def strongest_loadings(loadings: DataFrame, n: int) -> DataFrame:
    """the ``n`` largest and the ``n`` smallest loadings of each factor (factor, feature, loading), ties by feature."""
    side = lambda name, key: loadings.withColumn("rank", F.row_number().over(Window.partitionBy("factor").orderBy(key, "feature"))).where(F.col("rank") <= n).withColumn("side", F.lit(name))
    return side("positive", F.desc("loading")).unionByName(side("negative", F.asc("loading")))


def fitted_vocabulary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A number from 1 on for each value of each column, in order of the values: (column, value, code)."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null").distinct()
    return each.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("value")))


def encoded_columns(rows: DataFrame, vocabulary: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_code`` of each column; values outside the vocabulary are 0."""
    for c in columns:
        codes = vocabulary.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        rows = rows.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(0)))
    return rows


def padded_options(options: Column, width: int, pad) -> tuple[Column, Column]:
    """An array filled up to ``width``, and a mask of the places that are real; longer ones fail."""
    short = F.greatest(F.lit(width) - F.size(options), F.lit(0))
    whole = F.when(F.size(options) > width, F.raise_error(F.lit(f"more than {width} options")).cast("array<double>")).otherwise(F.concat(options, F.array_repeat(F.lit(pad), short)))
    return whole, F.concat(F.transform(options, lambda _: F.lit(1.0)), F.array_repeat(F.lit(0.0), short))
