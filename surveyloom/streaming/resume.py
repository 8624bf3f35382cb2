"""M1 as a stream: new row files are scored once each, whatever breaks in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from surveyloom.operators.joins import anti
from surveyloom.sources.commits import Commits, committed


def incremental(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Files that appear under ``source`` pass ``score`` and are appended to ``sink``; a restart goes on where it ended."""
    rows = spark.readStream.schema(schema).parquet(source)
    return score(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


class ScoredStream:
    """Rows of a stream of files, scored and committed once by key.

    A batch writes its data, then claims the next commit with its number. After a crash Spark runs the batch again: if
    its number is in the log nothing happens, else it is written anew and the first data are never read. Rows whose key
    is committed are not scored again, so a sink may be filled by several streams of one name each, one after another.
    """

    def __init__(self, spark: SparkSession, sink: str, schema: str, key: str, score: Callable[[DataFrame], DataFrame], name: str = "scores"):
        self.spark, self.schema, self.key, self.score, self.name = spark, schema, key, score, name
        self.log = Commits(spark, sink)

    def read(self) -> DataFrame:
        return committed(self.spark, self.log.read(), self.schema)

    def commit(self, rows: DataFrame, batch: int) -> bool:
        """Whether the batch was committed now; False if it had been. Of rows of one key in a batch one is kept; rows without a key fail."""
        path, known = None, -1
        while True:
            entries = self.log.read()
            if any((e["stream"], e["batch"]) == (self.name, batch) for e in entries):
                return False
            if len(entries) != known:  # others have committed: their rows are no longer wanted
                wanted = anti(rows.dropDuplicates([self.key]), committed(self.spark, entries, self.schema), [self.key])
                path, known = self.log.write(self.score(wanted), f"{self.name}-{batch}"), len(entries)
            if self.log.put(known + 1, {"stream": self.name, "batch": batch, "folder": path}):
                return True

    def run(self, source: str, source_schema: str, checkpoint: str, files: int = 1000) -> None:
        """Everything that is under ``source`` now, at most ``files`` files a batch."""
        rows = self.spark.readStream.schema(source_schema).option("maxFilesPerTrigger", files).parquet(source)
        query = rows.writeStream.foreachBatch(lambda df, batch: self.commit(df, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
