"""Routed work queues as a Python data source for Structured Streaming.

A queue is a folder of numbered segments, each a Parquet write that counts once
it is whole. `publish` routes messages to queues; the source `work_queue` reads
any of them, some segments of each at a time (prefetch). The offset is the next
segment of each queue. A segment is acknowledged, and deleted, only when the
engine has committed the batch that held it: a query that is killed finds it
again at its next start, and with the sink's own checkpoint no message is lost
or written twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

WHOLE = "_SUCCESS"


@dataclass
class Part(InputPartition):
    """One file of a segment."""

    queue: str
    file: str

    def __init__(self, queue: str, file: str):
        super().__init__((queue, file))
        self.queue, self.file = queue, file


class Segments:
    """The segments of some queues in a folder, by any address that pyarrow reads."""

    def __init__(self, path: str, queues: list[str]):
        self.files, self.root = fs.FileSystem.from_uri(path)
        self.queues = queues

    def _names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found)

    def first(self, queue: str) -> int:
        """The oldest segment that isn't acknowledged; queues that were worked off go on where they ended."""
        numbers = [int(n) for n in self._names(f"{self.root}/{queue}") if n.isdigit()]
        return min(numbers, default=self.acknowledged().get(queue, 0))

    def end(self, queue: str, start: int, most: int | None) -> int:
        """After the whole segments from start on, so many at most."""
        at = start
        while (most is None or at < start + most) and self.files.get_file_info(f"{self.root}/{queue}/{at:010d}/{WHOLE}").type == fs.FileType.File:
            at += 1
        return at

    def parts(self, queue: str, start: int, end: int) -> list[Part]:
        return [Part(queue, f"{self.root}/{queue}/{n:010d}/{f}") for n in range(start, end) for f in self._names(f"{self.root}/{queue}/{n:010d}") if f.endswith(".parquet")]

    def acknowledged(self) -> dict[str, int]:
        if self.files.get_file_info(f"{self.root}/acknowledged").type != fs.FileType.File:
            return {}
        with self.files.open_input_stream(f"{self.root}/acknowledged") as f:
            return json.loads(f.read())

    def acknowledge(self, ends: dict[str, int]) -> None:
        said = json.dumps(self.acknowledged() | ends).encode()
        with self.files.open_output_stream(f"{self.root}/acknowledged.new") as f:
            f.write(said)
        self.files.move(f"{self.root}/acknowledged.new", f"{self.root}/acknowledged")
        for queue, end in ends.items():
            for name in self._names(f"{self.root}/{queue}"):
                if name.isdigit() and int(name) < end:
                    self.files.delete_dir(f"{self.root}/{queue}/{name}")


class WorkQueueReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields if f.name != "queue"]
        self.place = [f.name for f in schema.fields].index("queue") if "queue" in schema.names else None
        self.path, self.queues = options["path"], [q for q in options["queues"].split(",") if q]
        self.prefetch = int(options["prefetch"]) if options.get("prefetch") else None
        self.told: dict[str, int] | None = None

    def _segments(self) -> Segments:
        return Segments(self.path, self.queues)

    def initialOffset(self) -> dict:
        held = self._segments()
        return {q: held.first(q) for q in self.queues}

    def latestOffset(self) -> dict:
        """All that is whole, or so many segments of each queue as prefetch says.

        The engine acknowledges a batch when it makes the next one, so twice
        as many segments as prefetch says may be open; a first batch can hold
        them all. An answer that the engine has had already goes on from there.
        A trigger that works off what is there asks once and takes the answer
        for all there is, so prefetch is for queries that go on.
        """
        held = self._segments()
        most = None if self.prefetch is None else 2 * self.prefetch
        answer = {q: held.end(q, held.first(q), most) for q in self.queues}
        if answer == self.told:
            answer = {q: held.end(q, answer[q], self.prefetch) for q in self.queues}
        self.told = answer
        return answer

    def partitions(self, start: dict, end: dict) -> list[Part]:
        held = self._segments()
        return [p for q in self.queues for p in held.parts(q, start[q], end[q])]

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.columns):
                arrays = [batch.column(c) for c in self.columns]
                names = list(self.columns)
                if self.place is not None:
                    arrays.insert(self.place, pa.array([partition.queue] * batch.num_rows))
                    names.insert(self.place, "queue")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    def commit(self, end: dict) -> None:
        self._segments().acknowledge(end)

    def stop(self) -> None:
        pass


class WorkQueue(DataSource):
    """spark.readStream.format("work_queue").schema(...).option("path", ...).option("queues", "a,b").load(); a column `queue` tells where a message was."""

    @classmethod
    def name(cls) -> str:
        return "work_queue"

    def schema(self) -> str:
        return "queue string"

    def streamReader(self, schema: StructType) -> WorkQueueReader:
        return WorkQueueReader(schema, self.options)


def publish(messages: DataFrame, path: str, route: Column, queues: list[str]) -> dict[str, int]:
    """Append messages to the queues that route names, one segment each; gives the segments' numbers. Others go nowhere."""
    held, out = Segments(path, queues), {}
    for queue in queues:
        n = held.first(queue)
        while held.files.get_file_info(f"{held.root}/{queue}/{n:010d}").type != fs.FileType.NotFound:
            n += 1
        messages.where(route == queue).write.parquet(f"{path}/{queue}/{n:010d}")
        out[queue] = n
    return out


def consume(spark: SparkSession, path: str, queues: list[str], schema: str, prefetch: int | None = None) -> DataFrame:
    """A stream of the queues' messages, with the name of each one's queue."""
    if not all(re.fullmatch(r"\w+", q) for q in queues):
        raise ValueError("names of queues are of letters, digits and _")
    spark.dataSource.register(WorkQueue)
    return spark.readStream.format("work_queue").schema(f"queue string, {schema}").option("path", path).option("queues", ",".join(queues)).option("prefetch", prefetch or "").load()
