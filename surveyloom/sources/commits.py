"""A folder's log of numbered commits, each written by one writer only.

A commit's number is claimed by creating its file, which fails if the file is
there: whoever comes second reads what was committed and decides anew. Data
are written before they are committed, under names of their own, so what a
crash leaves behind is never read.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class Commits:
    """Entries (dictionaries) in order of their numbers, from 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._dir = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits")
        self._fs = self._dir.getFileSystem(spark._jsc.hadoopConfiguration())
        self._seen: list[dict] = []

    def _path(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._dir, f"{number:012d}.json")

    def read(self) -> list[dict]:
        """All entries; only those that are new since the last call are read."""
        while self._fs.exists(path := self._path(len(self._seen) + 1)):
            stream = self._fs.open(path)
            try:
                self._seen.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return list(self._seen)

    def put(self, number: int, entry: dict) -> bool:
        """Whether the entry became commit ``number``; False if another one did."""
        self._fs.mkdirs(self._dir)
        path, content = self._path(number), json.dumps(entry, sort_keys=True)
        if self._fs.getUri().getScheme() == "file":
            # Hadoop's local files are looked for and then created; a hard link is made at once or not at all
            target = path.toUri().getPath()
            draft = f"{target}.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                f.write(content)
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(content.encode()))
        stream.close()
        return True

    def write(self, rows: DataFrame, name: str) -> str:
        """Data under a name that no other writer has; nothing reads them before an entry names them."""
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path


def committed(spark: SparkSession, entries: list[dict], schema) -> DataFrame:
    """The rows of all entries' folders."""
    folders = [e["folder"] for e in entries if e.get("folder")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
