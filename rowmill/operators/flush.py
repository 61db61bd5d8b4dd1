"""A sink that transforms rows and publishes what is done every so many completions, while its task goes on."""

from __future__ import annotations

import base64
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from rowmill.operators.transform import RowJob, as_batch, keyed_items, output_schema, slide
from rowmill.sources.stores import opened, publish


@dataclass
class Flushed(WriterCommitMessage):
    partition: int
    rows: int
    kept: int


def part_name(partition: int, attempt: str, number: int, rows: int) -> str:
    """A part says whose it is and how many rows it has, so that progress is read from names."""
    return f"p{partition:06d}-{attempt}-{number:06d}-{rows}.parquet"


def rows_of(name: str) -> int:
    return int(name.rsplit("-", 1)[1].removesuffix(".parquet"))


class Parts:
    """What a task has published of its partition below ``folder``, or of a shard of it."""

    def __init__(self, folder: str, partition: int):
        self.fs, self.folder = opened(folder)
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, recursive=True, allow_not_found=True))
        self.files = [x.path for x in found if x.base_name.startswith(f"p{partition:06d}-")]

    def ids(self, key: str) -> set:
        """Ids in the parts of earlier attempts: as many as the partition has rows at most."""
        return {x for f in self.files for x in pq.read_table(f, columns=[key], filesystem=self.fs).column(0).to_pylist()}


class FlushWriter(DataSourceArrowWriter):
    """Input: id, item[, folder]. Each task runs the job over its rows and publishes every ``every`` completions of a folder.

    A task that is tried again reads which ids its partition has published and goes on after them, so a lost
    worker costs at most ``every`` calls a task and folder, and a row that was paid for is kept.
    """

    def __init__(self, job: RowJob, schema: T.StructType, folder: str, seq: int, every: int):
        self.job, self.schema, self.folder, self.seq, self.every = job, schema, folder, seq, every

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Flushed:
        partition, attempt, number, written, last = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0, 0, 0
        arrow = to_arrow_schema(self.schema)
        done = Parts(self.folder, partition).ids(self.schema.names[0])
        waiting: dict[str, list[tuple]] = {}

        def rows() -> Iterator[tuple]:
            for batch in iterator:
                where = batch.column(2).to_pylist() if batch.num_columns > 2 else [""] * batch.num_rows
                for (key, item), folder in zip(keyed_items([batch]), where, strict=True):
                    if key not in done:
                        yield (key, folder), item

        def flush(folder: str) -> None:
            nonlocal number, written
            some = waiting.pop(folder)
            table = pa.Table.from_batches([as_batch([k for k, _, _ in some], [got for _, got, _ in some], arrow)])
            table = table.append_column("_seq", pa.array([self.seq] * len(some), pa.int64())).append_column("_pos", pa.array([at for _, _, at in some], pa.int64()))
            publish(table, f"{self.folder}/{folder}".rstrip("/"), part_name(partition, attempt, number, len(some)))
            number, written = number + 1, written + len(some)

        try:
            for _, (key, folder), got in slide(self.job, rows()):
                last = max(last + 1, time.time_ns())  # what completes later wins, also over an earlier attempt
                waiting.setdefault(folder, []).append((key, got, last))
                if len(waiting[folder]) >= self.every:
                    flush(folder)
        finally:
            for folder in list(waiting):
                flush(folder)
        return Flushed(partition, written, len(done))


class FlushSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowmill_flush"

    def writer(self, schema: T.StructType, overwrite: bool) -> FlushWriter:
        job = cloudpickle.loads(base64.b64decode(self.options["job"]))
        output = T.StructType.fromJson(json.loads(self.options["output"]))
        return FlushWriter(job, output, self.options["folder"], int(self.options["seq"]), int(self.options["every"]))


def flush_rows(rows: DataFrame, job: RowJob, folder: str, seq: int, every: int) -> None:
    """Run ``job`` over rows (id, item[, folder]) in one Spark job; its parts appear below ``folder`` as they are done.

    ``folder`` must be one that tasks can open through pyarrow. Of a job that is stopped, all parts that were published count.
    """
    if every < 1:
        raise ValueError("a part holds at least one row")
    rows.sparkSession.dataSource.register(FlushSink)
    text = base64.b64encode(cloudpickle.dumps(job)).decode()
    output = output_schema(job, rows.schema[0]).json()
    rows.write.format("rowmill_flush").option("job", text).option("output", output).option("folder", folder).option("seq", seq).option("every", every).mode("append").save()
