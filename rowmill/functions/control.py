"""Column functions on requests, deadlines, resources and names of a control table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Request settings that never reach a model server (fixed values).
NOT_SENT = (
    "api_version", "checkpoint_interval", "client", "client_kwargs", "default_output_cols", "endpoint", "input_column_name", "max_concurrency", "model",
    "name", "output_cols", "output_column_name", "output_mode", "provider", "retries", "results", "system_prompt", "timeout",
)


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sent_settings(settings: str | Column, hidden: tuple[str, ...] = NOT_SENT) -> Column:
    """The entries of a map that go out with a request: none whose key begins with ``_`` or is ``hidden``."""
    return F.map_filter(_col(settings), lambda k, _: ~(k.startswith("_") | k.isin(*hidden)))


def expires_at(started: str | Column, seconds: str | Column) -> Column:
    """ISO time ``seconds`` after ``started``, a wall-clock time in UTC; null if either is unknown."""
    end = F.timestamp_add("SECOND", _col(seconds).cast("int"), _col(started).cast("timestamp_ntz"))
    return F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def endpoint_status(state: str | Column) -> Column:
    """Job status from the state of a hosted job: stopped ones failed, ready ones run, others are done."""
    c = _col(state)
    return F.when(c.isin("Stopped", "Stopping"), "FAILED").when(c == "Ready", "RUNNING").otherwise("SUCCEEDED")


def log_verdict(tail: str | Column, no_room: str) -> tuple[Column, Column]:
    """(reason, retryable) from the end of a log: lack of capacity is final, anything else a time-out."""
    full = F.coalesce(F.contains(_col(tail), F.lit(no_room)), F.lit(False))
    return F.when(full, "ray_pg_insufficient_capacity").otherwise("unhealthy_timeout"), ~full


def layout(replicas: Column, per_replica: Column, per_node: Column, cpus: int = 32) -> tuple[Column, Column, Column, Column]:
    """(replicas on a node, nodes, CPUs of a task, whether a replica spans nodes) from counts of GPUs.

    The first is null where a replica needs more than a node.
    """
    on_node = F.when(per_replica <= per_node, F.least(F.floor(per_node / per_replica), replicas)).cast("long")
    nodes = F.coalesce(F.ceil(replicas / on_node), F.ceil(replicas * per_replica / per_node)).cast("long")
    return on_node, nodes, F.coalesce(F.greatest(F.lit(1), F.floor(F.lit(cpus) / on_node)), F.lit(cpus)).cast("long"), (per_replica > per_node) & (nodes > 1)


def layout_error(replicas: Column, per_replica: Column, per_node: Column) -> Column:
    """What is wrong with counts of GPUs, or null."""
    nodes = layout(replicas, per_replica, per_node)[1]
    unfit = (per_replica > per_node) & (nodes > 1) & (per_replica % per_node != 0)
    return F.when((replicas < 1) | (per_replica < 1) | (per_node < 1), "counts must be at least 1").when(unfit, "a replica that spans nodes must fill them")


def key_union(maps: str | Column) -> Column:
    """Aggregate: the sorted distinct keys of a map column; it holds one entry for each set of keys that occurs."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.map_keys(_col(maps)))))))


def escaped_like(text: str | Column) -> Column:
    """``text`` with a backslash before each sign that LIKE treats specially."""
    return F.regexp_replace(_col(text), r"([\\%_])", r"\\$1")
