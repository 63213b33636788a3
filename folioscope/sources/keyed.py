"""A table whose keys are created once, whoever writes at the same time.

Rows lie in folders, one for each write; `log` holds one numbered file for each
write that counts, with the name of its folder. A writer makes its rows over the
state it has read, then creates the next number. Only one writer can create a
number: one that comes late has lost the race, so it reads what the other wrote,
takes the keys that are there now as they are, and tries the next number with
what is still missing. Creating a file that must not be there is atomic on HDFS
and on local disks; stores without that need a lock beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self._log = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self._files = self._log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._log)

    def folders(self) -> list[str]:
        """The folders of the writes that count, in order."""
        found = {int(f.getPath().getName()): f for f in self._files.listStatus(self._log)}
        return [self._named(found[n].getPath()) for n in sorted(found)]

    def _named(self, path) -> str:
        stream = self._files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, folders: list[str] | None = None) -> DataFrame:
        own = self.folders() if folders is None else folders
        if not own:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in own])

    def _count(self, number: int, folder: str) -> bool:
        """Whether this write is the one of a number."""
        try:
            stream = self._files.create(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{number:010d}"), False)
        except Py4JJavaError:
            return False
        stream.write(bytearray(folder.encode()))
        stream.close()
        return True

    def get_or_create(self, wanted: DataFrame, before_write: Callable[[int], None] | None = None, **defaults: Column) -> DataFrame:
        """Each wanted key once: its row, and whether this call created it. Null keys are left out.

        before_write(attempt) is called between the reading and the writing of
        each attempt; tests write something else there.
        """
        asked = wanted.select(*self.keys).dropna().distinct()
        attempt = 0
        while True:
            held = self.folders()
            new = asked.join(self.read(held).select(*self.keys), self.keys, "left_anti")
            folder = f"rows-{uuid.uuid4().hex}"
            rows = new.withColumns(defaults).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            rows.write.parquet(f"{self.path}/{folder}")
            if before_write:
                before_write(attempt)
            if self._count(len(held), folder):
                own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select(*self.keys, F.lit(True).alias("_own"))
                there = self.read([*held, folder]).join(asked, self.keys, "left_semi")
                return there.join(own, self.keys, "left").withColumn("created", F.coalesce("_own", F.lit(False))).drop("_own")
            attempt += 1
