"""User-written row transforms: asynchronous, with bounded concurrency and retries, across Arrow batches."""

from __future__ import annotations

import asyncio
import inspect
import itertools
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowmill.sources.memory import batch_size


class RowJob:
    """Subclass and write ``transform_items(items) -> list`` (plain or async), one result per item, in order.

    ``schema`` declares the output columns. ``max_concurrency`` items of a task run at a time; each is
    tried ``retries`` times with growing pauses before its error ends the run.
    """

    schema: str = "result string"
    #: Results in a batch, where the job has a wish of its own.
    batch: int | None = None

    def __init__(self, input_column: str = "messages", max_concurrency: int = 2, retries: int = 5, pause: float = 4.0, longest_pause: float = 10.0, **extra: Any):
        self.input_column, self.max_concurrency, self.retries = input_column, max_concurrency, retries
        self.pause, self.longest_pause, self.extra = pause, longest_pause, extra

    def transform_items(self, items: list[Any]) -> list[Any]:
        raise NotImplementedError

    async def call_one(self, item: Any) -> Any:
        for attempt in range(1, self.retries + 1):
            try:
                got = self.transform_items([item])
                got = await got if inspect.isawaitable(got) else got
                break
            except Exception:
                if attempt == self.retries:
                    raise
                await asyncio.sleep(min(self.longest_pause, self.pause * 2 ** (attempt - 1)))
        if not isinstance(got, list) or len(got) != 1:
            raise RuntimeError("transform_items must return a list with one result for one item")
        return got[0]

    def call_all(self, items: list[Any]) -> list[Any]:
        """Results of all items, in their order."""
        return [got for _, got in in_order(slide(self, ((None, x) for x in items)))]


def slide(job: RowJob, rows: Iterable[tuple[Any, Any]]) -> Iterator[tuple[int, Any, Any]]:
    """(place, key, result) of each (key, item), as they complete.

    One event loop serves them all, so a client keeps its connections. ``max_concurrency`` items run at a time,
    and a free slot takes the next row at once, whichever batch it comes from: a slow item holds up
    nothing but itself. Once one fails for good, those that still run are cancelled.
    """
    loop, running, rows, place = asyncio.new_event_loop(), {}, iter(rows), 0
    try:
        while True:
            while len(running) < max(1, job.max_concurrency) and (row := next(rows, None)) is not None:
                running[loop.create_task(job.call_one(row[1]))] = place, row[0]
                place += 1
            if not running:
                return
            done, _ = loop.run_until_complete(asyncio.wait(running, return_when=asyncio.FIRST_COMPLETED))
            ended = sorted(((running.pop(t), t) for t in done), key=lambda x: x[0][0])
            broken = next((t for _, t in ended if t.exception()), None)
            for (at, key), t in ended:
                if not t.exception():
                    yield at, key, t.result()
            if broken:
                raise broken.exception()
    finally:
        for t in running:
            t.cancel()
        if running:
            loop.run_until_complete(asyncio.gather(*running, return_exceptions=True))
        loop.run_until_complete(loop.shutdown_asyncgens())
        loop.close()


def in_order(results: Iterable[tuple[int, Any, Any]]) -> Iterator[tuple[Any, Any]]:
    """(key, result) by place: what completes early waits in a buffer for those before it."""
    waiting, due = {}, 0
    for at, key, got in results:
        waiting[at] = key, got
        while due in waiting:
            yield waiting.pop(due)
            due += 1


def shaped(results: list[Any], names: list[str] | None) -> tuple[list[str], list[dict]]:
    """Column names and rows; the first result decides how all are read.

    One name: dict by key, 1-tuple unwrapped, scalars as they are. Several: dicts by key, tuples by
    place, scalars are errors. None: dict keys (sorted), scalars as ``output``, tuples are errors.
    """
    if not results:
        return list(names or []), []
    first = results[0]
    sequence = isinstance(first, tuple | list)
    if not names:
        if sequence:
            raise ValueError("tuples need named output columns")
        if isinstance(first, dict):
            keys = sorted({k for r in results for k in r})
            return keys, [{k: r.get(k) for k in keys} for r in results]
        return ["output"], [{"output": r} for r in results]
    if isinstance(first, dict):
        return list(names), [{k: r.get(k) for k in names} for r in results]
    if sequence and (len(names) > 1 or isinstance(first, tuple)):
        if any(len(r) != len(names) for r in results):
            raise ValueError(f"results must have {len(names)} values")
        return list(names), [dict(zip(names, r, strict=True)) for r in results]
    if len(names) > 1:
        raise ValueError(f"a single value cannot fill {len(names)} columns")
    return list(names), [{names[0]: r} for r in results]


def output_schema(job: RowJob, key: T.StructField) -> T.StructType:
    return T.StructType([key, *T._parse_datatype_string(job.schema).fields])


def as_batch(keys: list[Any], results: list[Any], arrow: pa.Schema) -> pa.RecordBatch:
    """Keys and results as the columns of ``arrow``, the key's first."""
    names = arrow.names[1:]
    _, rows = shaped(results, names)
    return pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), *[pa.array([r[n] for r in rows], arrow.field(n).type) for n in names]], schema=arrow)


def keyed_items(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Any]]:
    """(first column, second column) of all rows of all batches."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def map_rows(df: DataFrame, job: RowJob, key: str, ordered: bool = True, rows: int | None = None) -> DataFrame:
    """(key, outputs): only the id and the input column go to Python, in Arrow batches.

    Results come in the order of their rows, or as they complete if not ``ordered``; a batch holds ``rows`` of them, or as many as the job wishes.
    """
    rows = batch_size(rows, job.batch)
    if job.input_column not in df.columns:
        raise ValueError(f"input column {job.input_column!r} is not in the input")
    schema = output_schema(job, df.schema[key])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = slide(job, keyed_items(batches))
        found = in_order(found) if ordered else ((key, got) for _, key, got in found)
        while some := list(itertools.islice(found, rows)):
            yield as_batch([k for k, _ in some], [got for _, got in some], arrow)

    return df.select(key, job.input_column).mapInArrow(run, schema)
