"""The whole run: id, resume, transform with results published as they are done, merge, join back."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators import joins
from rowmill.operators.checkpoint import Checkpoint
from rowmill.operators.flush import flush_rows
from rowmill.operators.ids import ensure_id, free_name, index_shards, shard_of
from rowmill.operators.transform import RowJob, map_rows, output_schema
from rowmill.sources.files import first_rows
from rowmill.sources.memory import as_table
from rowmill.sources.memory import backend as known_backend
from rowmill.sources.scratch import written


class OutputMode(str, Enum):
    APPEND = "append"
    REPLACE = "replace"
    IO_ONLY = "io_only"


def joined(df: DataFrame, out: DataFrame, key: str, input_column: str, mode: OutputMode) -> DataFrame:
    """append: all inputs and outputs; io_only: id, input (and inputs that share an output's name) and outputs; replace: stored outputs."""
    names = [c for c in out.columns if c != key]
    if mode == OutputMode.REPLACE:
        return out.select(key, *names)
    if mode == OutputMode.IO_ONLY:
        df = df.select(*dict.fromkeys([key, input_column, *[c for c in names if c in df.columns]]))
    return joins.attach(df, out, key)


class Watch:
    """Calls ``heard(rows done, rows)`` while a job runs, whenever more of its rows have been published, and once at its end."""

    def __init__(self, store: Checkpoint, seq: int, total: int, heard: Callable[[int, int], None], every: float = 0.5):
        self.store, self.seq, self.total, self.heard, self.every = store, seq, total, heard, every
        self.over, self.last, self.thread = threading.Event(), -1, threading.Thread(target=self._look, daemon=True)

    def _tell(self) -> None:
        now = self.store.published(self.seq)
        if now != self.last:
            self.last = now
            self.heard(now, self.total)

    def _look(self) -> None:
        while not self.over.wait(self.every):
            self._tell()

    def __enter__(self) -> Watch:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()
        self._tell()


def run(
    df: DataFrame | Any, job: RowJob, id_column: str | None = None, mode: OutputMode | str = OutputMode.APPEND, checkpoint: str | None = None,
    resume: bool = True, limit: int | None = None, drop_stray: bool = False, compact: bool = False,
    flush_every: int = 10_000, strict: bool = False, sort: bool = False, once: bool = False, on_progress: Callable[[int, int], None] | None = None, spark: SparkSession | None = None, backend: str | None = None,
) -> DataFrame:
    """Transform ``df[job.input_column]`` and join the results back.

    ``df`` is a DataFrame, or a pandas or Arrow table (whose index is the id where no id is named).
    With ``checkpoint`` (a folder that all executors reach, also through pyarrow) ids with a stored output are passed over
    and all others run in one Spark job, whose tasks publish every ``flush_every`` completions: a run that is killed
    loses at most so many a task, and no task waits for another. ``resume=False`` writes the outputs of all rows again;
    the newest wins. Without ``checkpoint`` the outputs are written to a scratch table, so that reading the result twice calls nothing twice.
    Null ids match null ids. ``limit`` takes rows once, whichever come first. ``strict`` requires unique ids and the
    input that the checkpoint was begun with. ``sort`` orders the result by id. With ``once`` rows that
    repeat an id are transformed once, from whichever of them comes first, and share the output; else
    each is, and the output written last is all of theirs. ``on_progress`` hears (rows done, rows) while the job runs.
    ``backend``: a name of an engine that callers know; all known ones mean this one, others are errors.
    """
    mode = OutputMode(mode)
    known_backend(backend)
    df, key = _prepared(df, job, id_column, limit, spark)
    if checkpoint is None:
        if not resume:
            raise ValueError("resume=False needs a checkpoint")
        at = free_name(df, "_pos")
        todo = df.dropDuplicates([key]) if once else df
        out = written(map_rows(todo, job, key).withColumn(at, F.monotonically_increasing_id()), "outputs")
        out = joined(df, joins.latest(out, key, at).drop(at), key, job.input_column, mode)
        return out.orderBy(key) if sort else out
    store = Checkpoint(df.sparkSession, checkpoint, key, output_schema(job, df.schema[key]))
    store.require_columns()
    if strict:
        store.verify(df, job.input_column)
    todo = joins.pending_narrow(df, store.done(), key) if resume and store.folders() else df
    todo = todo.select(key, job.input_column)
    _transformed(store, todo.dropDuplicates([key]) if once else todo, job, flush_every, on_progress)
    if compact:
        store.compact()
    out = store.latest()
    if drop_stray:
        out = joins.known(out, df, key)
    out = joined(df, out, key, job.input_column, mode)
    return out.orderBy(key) if sort else out


def _prepared(df: DataFrame | Any, job: RowJob, id_column: str | None, limit: int | None, spark: SparkSession | None) -> tuple[DataFrame, str]:
    df, id_column = as_table(df, id_column, spark)
    if limit:
        df = written(first_rows(df, limit), "limited")
    df, key = ensure_id(df, id_column)
    if job.input_column not in df.columns:
        raise ValueError(f"input column {job.input_column!r} is not in the input")
    return df, key


def _transformed(store: Checkpoint, todo: DataFrame, job: RowJob, flush_every: int, on_progress: Callable[[int, int], None] | None) -> None:
    seq = store.begin()
    if on_progress is None:
        store.transform(todo, job, flush_every, seq)
        return
    todo = written(todo, "pending")
    with Watch(store, seq, todo.count(), on_progress):
        store.transform(todo, job, flush_every, seq)


class Sharded(Checkpoint):
    """A checkpoint whose rows to do say in their third column which shard is theirs; each shard's outputs are a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType):
        super().__init__(spark, path, key, schema, sharded=True)

    def transform(self, rows: DataFrame, job: RowJob, every: int, seq: int | None = None) -> int:
        seq = self.begin() if seq is None else seq
        name = f"flush={seq}-{uuid.uuid4().hex[:8]}"
        key, item, shard = rows.columns
        flush_rows(rows.select(key, item, F.concat(F.lit("shard="), F.col(shard).cast("string"), F.lit(f"/{name}"))), job, self.path, seq, every)
        self.commit(seq)
        return seq


def run_sharded(
    df: DataFrame | Any, job: RowJob, id_column: str | None = None, mode: OutputMode | str = OutputMode.APPEND, checkpoint: str | None = None,
    nshards: int = 1, shard_mode: str = "id", output: str | None = None, resume: bool = True, limit: int | None = None, flush_every: int = 10_000,
    strict: bool = False, once: bool = False, on_progress: Callable[[int, int], None] | None = None, spark: SparkSession | None = None,
) -> DataFrame | None:
    """``run`` over shards by id hash or by index, each with outputs of its own, ``shard=<i>`` under ``checkpoint``.

    One Spark job runs all shards; its tasks publish every ``flush_every`` completions of a shard. An id
    counts as done in whichever shard it is stored, so a run resumes with another number of
    shards too. With ``output`` the joined rows are written as ``shard=<i>`` folders under it, of as many
    files as their size asks for, and nothing is returned; else the shards are merged, the newest row of an id winning.
    Other arguments are those of ``run``.
    """
    mode = OutputMode(mode)
    if shard_mode not in ("id", "index"):
        raise ValueError(f"shards are by id or by index, not by {shard_mode!r}")
    if nshards < 1 or (not checkpoint and (nshards > 1 or output)):
        raise ValueError("shards and their output need a checkpoint")
    if checkpoint is None:
        return run(df, job, id_column, mode, limit=limit, once=once, spark=spark)
    df, key = _prepared(df, job, id_column, limit, spark)
    spark, shard = df.sparkSession, free_name(df, "_shard")
    rows = df.withColumn(shard, shard_of(key, nshards)) if shard_mode == "id" else index_shards(df, key, nshards, shard)
    store = Sharded(spark, checkpoint, key, output_schema(job, df.schema[key]))
    store.require_columns()
    if strict:
        store.verify(df, job.input_column)
    todo = joins.pending_narrow(rows, store.done(), key) if resume and store.folders() else rows
    todo = todo.select(key, job.input_column, shard)
    _transformed(store, todo.dropDuplicates([key]) if once else todo, job, flush_every, on_progress)
    out = store.latest()
    if output is None:
        return joined(df, out, key, job.input_column, mode)
    name = free_name(df, "shard")
    rows = joined(rows.withColumnRenamed(shard, name), out, key, job.input_column, OutputMode.APPEND)
    keep = [c for c in joined(df, out, key, job.input_column, mode).columns if c in rows.columns]
    rows = rows if mode == OutputMode.APPEND else rows.select(*keep, name)
    rows.hint("rebalance", F.col(name)).write.mode("overwrite").partitionBy(name).parquet(output)
    return None
