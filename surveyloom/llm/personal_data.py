"""Personal data: fixed patterns, and terms that give a protected entity away.

Entities are the distinct values that the patterns find. Terms count where they
stand outside of all spans that the patterns find, so a name is judged alike
whether or not the addresses hold it. Over the corpus of N documents, with
df(x) the documents that hold x and j the documents that hold both term t and a
mention of entity e, wherever they stand,

    disclosure(t, e) = PMI(t; e) / IC(e) = ln(N j / (df(t) df(e))) / ln(N / df(e)),

which is 1 if every document with t also mentions e, and 0 if t tells nothing.
In all of a document that mentions e, a term of disclosure ``generalise`` or
more is generalised to its kind and one of ``remove`` or more is removed.
Copies of one passage are no evidence: the pair must occur in at least
``support`` different contexts. The contexts of a pair in a document are the
texts around those mentions that the term is near to; if it is near to none,
the document counts as one context, that of its mention of least hash.
Documents without an entity are left as they are.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.shared import free_name, staged, table

#: Order of kinds in every list of spans.
KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain patterns, in linear time: a run of characters is entered at its start (or where the
# last match ended) and never given back.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TERM = "\\p{L}{3,}"
CONTEXT = 100


@dataclass(frozen=True)
class Disclosure:
    """Thresholds: shares of an entity's information, and contexts that a pair needs."""

    generalise: float = 0.8
    remove: float = 0.95
    support: int = 3


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join) -> Column:
    """Inclusive running ``join`` over an array of numbers, in log2(n) passes."""
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values).cast("double"))).cast("int"), F.lit(0)))

    def one(acc: Column, s: Column) -> Column:
        shift = F.least(F.pow(F.lit(2.0), s).cast("int"), F.size(acc))
        moved = F.concat(F.array_repeat(F.lit(None).cast("int"), shift), F.slice(acc, F.lit(1), F.size(acc) - shift))
        return F.zip_with(acc, moved, lambda a, b: F.when(b.isNull(), a).otherwise(join(a, b)))

    return F.when(F.size(values) == 0, values).otherwise(F.aggregate(passes, values, one))


_SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code point offsets (end exclusive)."""

    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        steps = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)),
            F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))),
            lambda g, before: F.char_length(g) + F.char_length(before),
        )
        at = _running(steps, lambda a, b: a + b)
        return F.zip_with(found, at, lambda m, s: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("value")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _bind(
        found,
        lambda f: F.when(F.size(f) == 0, F.array().cast(_SPAN)).otherwise(
            _bind(F.struct(f.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    if kind == "card":
        return _bind(_digits(value), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns as array<struct<kind, start, end, value>>, by kind as listed, then start."""
    digit = text.rlike("[0-9]")
    screens = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def of(kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        found = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(screens[kind], found).otherwise(none)

    return F.concat(*[of(kind) for kind in KINDS])


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _row_key(id_col: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(text, F.lit("again"))))


_WORDS = "array<struct<term:string,start:int,end:int>>"


def outside_terms(text: Column, base: Column) -> Column:
    """The terms of a text that touch none of its spans, by start, in the order of n log n."""
    event = lambda start, end, kind, term: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), term.alias("term"))
    spans = F.transform(base, lambda b: event(b["start"], b["end"], 0, F.lit("")))
    words = F.transform(matches(text, TERM), lambda m: event(m["start"], m["end"], 1, F.lower(m["value"])))

    def swept(events: Column) -> Column:
        # how far the spans before reach, and where the next span starts
        reach = _running(F.transform(events, lambda e: F.when(e["kind"] == 0, e["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        ahead = F.reverse(_running(F.reverse(F.transform(events, lambda e: F.when(e["kind"] == 0, e["start"]).otherwise(2**31 - 1))), lambda a, b: F.least(a, b)))
        kept = lambda x: (x["e"]["kind"] == 1) & (x["reach"] <= x["e"]["start"]) & (x["ahead"] >= x["e"]["end"])
        placed = F.filter(F.arrays_zip(events.alias("e"), reach.alias("reach"), ahead.alias("ahead")), kept)
        return F.transform(placed, lambda x: F.struct(x["e"]["term"].alias("term"), x["e"]["start"].alias("start"), x["e"]["end"].alias("end")))

    return _bind(F.array_sort(F.concat(spans, words)), swept)


def _not_above(sorted_numbers: Column, value: Column) -> Column:
    """How many of the ascending numbers are at most ``value``, by bisection."""
    n = F.size(sorted_numbers)
    steps = F.sequence(F.lit(0), F.ceil(F.log2((n + 1).cast("double"))).cast("int"))

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        done, below = acc["lo"] >= acc["hi"], F.coalesce(F.get(sorted_numbers, mid) <= value, F.lit(False))
        return F.struct(F.when(~done & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(done | below, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), half, lambda acc: acc["lo"])


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``key`` (of id and text), ``base`` spans, ``near``: each mention's entity and the terms near
    it, and ``words``: the terms of the whole text outside the spans, if there are spans.

    Null texts count as empty. Repeated rows share a key and a result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), _row_key(F.col(id_col), text).alias("key"), text.alias("_t"), base_spans(text).alias("base"))
    rows = rows.withColumn("words", F.when(F.size("base") > 0, outside_terms(F.col("_t"), F.col("base"))).otherwise(F.array().cast(_WORDS)))

    def mentions(words: Column) -> Column:
        once = F.struct(F.transform(words, lambda w: w["start"]).alias("starts"), F.char_length("_t").alias("length"))

        def mention(b: Column, from_: Column, length: Column) -> Column:
            low = F.greatest(b["start"] - CONTEXT, F.lit(0))
            high = F.least(b["end"] + CONTEXT, length)
            around = F.regexp_replace(F.substring(F.col("_t"), low + 1, high - low), "[^\\p{L}]+", " ")
            # a word that touches an edge may be cut there
            first = F.when(low == 0, F.lit(0)).otherwise(_not_above(from_, low))
            near = F.filter(F.slice(words, first + 1, F.greatest(_not_above(from_, high) - first, F.lit(0))), lambda w: (w["end"] < high) | (high == length))
            return F.struct(_entity(b).alias("entity"), F.xxhash64(around).alias("context"), F.array_distinct(F.transform(near, lambda w: w["term"])).alias("terms"))

        return _bind(once, lambda o: F.transform(F.col("base"), lambda b: mention(b, o["starts"], o["length"])))

    near = F.when(F.size("base") > 0, _bind(F.col("words"), mentions)).otherwise(F.array().cast("array<struct<entity:string,context:bigint,terms:array<string>>>"))
    return rows.select(id_col, "key", "base", near.alias("near"), "words")


def risky_pairs(docs: DataFrame, found: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text") -> DataFrame:
    """Pairs of entity and term whose disclosure reaches a threshold: entity, term, disclosure, action.

    ``found`` is the (staged) result of find_base over ``docs``. Document
    counts are taken over all documents and whole texts.
    """
    mentions = found.where(F.size("near") > 0).select("key", F.explode("near").alias("m")).select("key", "m.entity", "m.context", "m.terms")
    n = docs.count()
    # a pair has no more contexts than its entity, and an entity of every document tells nothing
    entities = mentions.groupBy("entity").agg(F.countDistinct("key").alias("df_e"), F.countDistinct("context").alias("contexts"))
    entities = staged(entities.where((F.col("contexts") >= rule.support) & (F.col("df_e") < n)).select("entity", "df_e"), "entities")
    mentions = mentions.join(entities.select("entity"), "entity", "left_semi")
    near = mentions.select("entity", F.explode("terms").alias("term"), "key", F.col("context").alias("near"), F.lit(None).cast("bigint").alias("far"))
    least = mentions.groupBy("key", "entity").agg(F.min("context").alias("far"))
    whole = found.where(F.size("near") > 0).select("key", F.array_distinct(F.transform("words", lambda w: w["term"])).alias("terms"))
    far = least.join(whole, "key").select("entity", F.explode("terms").alias("term"), "key", F.lit(None).cast("bigint").alias("near"), "far")
    per_doc = near.unionByName(far).groupBy("entity", "term", "key").agg(F.collect_set("near").alias("near"), F.min("far").alias("far"))
    pairs = per_doc.select("entity", "term", "key", F.explode(F.when(F.size("near") > 0, F.col("near")).otherwise(F.array("far"))).alias("context"))
    joint = pairs.groupBy("entity", "term").agg(F.countDistinct("key").alias("j"), F.countDistinct("context").alias("contexts"))
    joint = staged(joint.where(F.col("contexts") >= rule.support).select("entity", "term", "j"), "pairs")
    schema = "entity string, term string, disclosure double, action string"
    if not joint.limit(1).count():
        return docs.sparkSession.createDataFrame([], schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # as in j, a term within a span does not count
    texts = docs.select(text.alias("t"), base_spans(text).alias("b"))
    terms = F.when(F.size("b") == 0, F.transform(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), lambda w: F.lower(w))).otherwise(F.transform(outside_terms(F.col("t"), F.col("b")), lambda w: w["term"]))
    words = texts.select(F.explode(F.array_distinct(terms)).alias("term"))
    # counted before the inner join, which unlike a semi join is not pushed below the counts: what leaves a task is a row
    # for each of its words, however frequent
    df_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    scored = joint.join(df_t, "term").join(entities, "entity")
    ic = F.log(F.lit(float(n)) / F.col("df_e"))
    pmi = F.log(F.lit(float(n)) * F.col("j") / (F.col("df_t") * F.col("df_e")))
    scored = scored.withColumn("disclosure", pmi / ic)
    action = F.when(F.col("disclosure") >= rule.remove, "removed").when(F.col("disclosure") >= rule.generalise, "generalised")
    return scored.withColumn("action", action).where("action is not null").select("entity", "term", "disclosure", "action")


def find_spans(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key, ``base`` spans and ``more``: spans of risky terms, by start.

    Empty tables give no rows; other columns of ``docs`` are not read.
    """
    found = staged(find_base(docs, id_col, text_col), "personal")
    risky = staged(risky_pairs(docs, found, rule, text_col), "risky")
    mentioned = found.select("key", F.array_distinct(F.transform("near", lambda m: m["entity"])).alias("e"), "words").select("key", F.explode("e").alias("entity"), "words")
    mentioned = mentioned.join(risky.select("entity").distinct(), "entity", "left_semi")
    spans = mentioned.select("key", "entity", F.explode("words").alias("t")).select("key", "entity", "t.*").distinct()
    hits = spans.join(risky, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max("action").alias("action"))
    more = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("more"))
    empty = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.drop("near", "words").join(more, "key", "left").withColumn("more", F.coalesce("more", empty))


def all_spans() -> Column:
    """Base and added spans of find_spans as one array of (kind, start, end); added kinds are term_generalised and term_removed."""
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    added = lambda a: F.transform(
        F.filter("more", lambda m: m["action"] == a),
        lambda m: F.struct(F.lit(f"term_{a}").alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
    )
    return F.concat(base, added("generalised"), added("removed"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced by their kind, risky terms by ``[TERM]`` or nothing; the columns stay as they are.

    Null texts stay null, repeated rows change alike, an empty table stays empty.
    """
    key, found = free_name(docs.columns, "_key"), free_name(docs.columns, "_s")
    spans = find_spans(docs, rule, id_col, text_col).select(F.col("key").alias(key), all_spans().alias(found)).where(F.size(found) > 0).dropDuplicates([key])
    text = F.col(text_col)
    rows = docs.withColumn(key, _row_key(F.col(id_col), F.coalesce(text, F.lit("")))).join(spans, key, "left")
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def rebuilt(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: -x["less"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0)), reach)

        def piece(x: Column, at: Column) -> Column:
            label = F.when(x["kind"] == "term_removed", "").when(x["kind"] == "term_generalised", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
            gap = F.substring(text, at + 1, F.greatest(x["start"] - at, F.lit(0)))
            return F.concat(gap, F.when(x["start"] >= at, label).otherwise(""))

        pieces = F.zip_with(s, F.slice(before, F.lit(1), F.size(s)), piece)
        tail = F.substring(text, F.element_at(before, -1) + 1, F.char_length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    new = F.when(F.col(found).isNull() | text.isNull(), text).otherwise(_bind(ordered, rebuilt))
    return rows.withColumn(text_col, new).select(*docs.columns)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and added spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_spans(docs)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        listed(all_spans()).alias("spans"),
        F.size("more").cast("bigint").alias("n_term"),
    )
