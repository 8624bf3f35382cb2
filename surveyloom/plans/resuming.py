"""Streams that resume, and tables that joins need not shuffle, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.plans.catalogue import register
from surveyloom.plans.panel import sql
from surveyloom.plans.scores import rounded
from surveyloom.sources import io
from surveyloom.sources.scratch import fresh_path
from surveyloom.sources.tables import people, responses, table
from surveyloom.streaming.resume import ScoredStream

EVENTS = "event_id bigint, user_id bigint, value double, props string"
SCORED = "event_id bigint, user_id bigint, score double"


def _score(rows):
    return rows.select("event_id", "user_id", F.round(F.col("value") * (1 + F.get_json_object("props", "$.k").cast("double")), 6).alias("score"))


def event_files(s, d, files: int = 8) -> str:
    """The events as a folder of files, for streams."""
    source = fresh_path(s, "events")
    table(s, d, "events").select("event_id", "user_id", "value", "props").repartition(files, "event_id").write.parquet(source)
    return source


def _streamed(s, d):
    """The events as a stream of eight files in batches of three; the second run finds nothing new."""
    source, sink, mark = event_files(s, d), fresh_path(s, "scored"), fresh_path(s, "mark")
    for _ in range(2):
        stream = ScoredStream(s, sink, SCORED, "event_id", _score)
        stream.run(source, EVENTS, mark, 3)
    return rounded(stream.read(), 5)


register("streamed_scores", _streamed, "SELECT event_id, user_id, round(round(value * (1 + json_extract_string(props, '$.k')::DOUBLE), 6), 5) AS score FROM events")


def _indexed(s, d):
    """History counts of training respondents from two tables in buckets of panels."""
    name = lambda x: f"{x}_{fresh_path(s, x)[-12:]}"
    rows = io.save_index(responses(s, d).select("panel_id", "question_key", "answer_index"), name("answers"), fresh_path(s, "answers"))
    panels = io.save_index(people(s, d).select("panel_id", "domain", "split"), name("panels"), fresh_path(s, "panels"))
    both = panels.where("split = 'train'").hint("merge").join(rows, "panel_id")
    return both.groupBy("panel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("answer_index").alias("total"))


register("indexed_history", _indexed, sql("SELECT panel_id, count(*) AS n, sum(answer_index)::BIGINT AS total FROM responses WHERE split = 'train' GROUP BY 1"))
