"""Replica health as a stream: JSON messages in, latest states out, and a health state machine per replica."""

from __future__ import annotations

import json
import os
import random
import socket
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.window import Window

from rowmill.operators.buckets import BucketTable
from rowmill.operators.ids import free_name
from rowmill.sources import stores


FIELDS = ("swarm_id", "replica_id", "node", "port", "pid", "state", "http_ready", "exit_code", "exit_signal", "fail_reason", "agent_version")


def _field(name: str, kind: str) -> str:
    return f"try_variant_get(_x_{name}, '$', '{kind}')"


def _kind(name: str) -> str:
    """What stands under a key: STRING, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, VOID, ARRAY<..> or OBJECT<..>; null where the key is absent."""
    return f"_k_{name}"


def _whole(name: str) -> Column:
    """Whole numbers, numbers cut at the point, booleans as 0 and 1, texts of digits; null for anything else."""
    digits = f"if({_field(name, 'string')} rlike '^\\\\s*[+-]?[0-9]+\\\\s*$', try_cast(trim({_field(name, 'string')}) as int), null)"
    return F.expr(f"case when {_kind(name)} = 'STRING' then {digits} when {_kind(name)} = 'BOOLEAN' then cast({_field(name, 'boolean')} as int) else try_cast({_field(name, 'double')} as int) end")


def _filled(name: str) -> str:
    """Not absent, null, false, 0 or empty; texts such as 'false' and '0' are filled."""
    text, kind = _field(name, "string"), _kind(name)
    return (
        f"coalesce(case when {kind} = 'STRING' then {text} <> '' when {kind} = 'BOOLEAN' then {_field(name, 'boolean')} when {kind} = 'VOID' then false"
        f" when {kind} like 'ARRAY%' or {kind} like 'OBJECT%' then to_json(_x_{name}) not in ('[]', '{{}}') else {_field(name, 'double')} <> 0 end, false)"
    )


def normalized(messages: DataFrame, column: str = "value") -> DataFrame:
    """One row per valid message. Empty, broken or non-object JSON and messages without swarm_id or a whole replica_id go.

    Numbers that do not parse become null. http_ready counts by what it is, not by its text: "false" is
    a text, and so ready; an absent state is 'unknown', a null one the text 'None'.
    """
    m = messages.withColumn("_v", F.try_parse_json(column)).where("schema_of_variant(_v) like 'OBJECT%'")
    m = m.withColumns({f"_x_{f}": F.expr(f"variant_get(_v, '$.{f}', 'variant')") for f in FIELDS})  # each field is looked up once
    m = m.withColumns({f"_k_{f}": F.expr(f"schema_of_variant(_x_{f})") for f in FIELDS})
    text = lambda k: F.expr(_field(k, "string"))
    state = F.expr(f"case when {_kind('state')} is null then 'unknown' when {_kind('state')} = 'VOID' then 'None' when {_kind('state')} = 'BOOLEAN' then initcap({_field('state', 'string')}) else {_field('state', 'string')} end")
    out = m.where(_filled("swarm_id")).select(
        *[c for c in messages.columns if c != column],
        text("swarm_id").alias("swarm_id"), _whole("replica_id").alias("replica_id"), text("node").alias("node"), _whole("port").alias("port"), _whole("pid").alias("pid"),
        state.alias("state"), F.expr(_filled("http_ready")).alias("http_ready"), _whole("exit_code").alias("exit_code"), _whole("exit_signal").alias("exit_signal"),
        text("fail_reason").alias("fail_reason"), F.when(F.expr(_filled("agent_version")), text("agent_version")).otherwise("unknown").alias("agent_version"),
    )
    return out.where("swarm_id is not null and replica_id is not null")


def state_table(spark: SparkSession, folder: str, keys: list[str], order: tuple[str, ...] = ()) -> BucketTable:
    return BucketTable(spark, folder, keys, order, stamp="last_seen")


def maintain(stream: DataFrame, folder: str, keys: list[str], checkpoint: str, order: tuple[str, ...] = ()) -> StreamingQuery:
    """Keep the newest row of each key under ``folder``, with the time it was ``last_seen`` here.

    The newest is the last to arrive, or that with the largest ``order``. Each batch is a commit of a
    ``BucketTable``: it rewrites the buckets it touches, once, however often it is run. The table outlives its
    streams: one with a fresh ``checkpoint`` goes on with the rows that are there, and several may write at once.
    """
    table = state_table(stream.sparkSession, folder, keys, order)
    mark = f"{checkpoint.rstrip('/')}/table-writer"
    stores.claim(stream.sparkSession, mark, uuid.uuid4().hex)
    writer = stores.text_of(stream.sparkSession, mark)

    def step(batch: DataFrame, number: int) -> None:
        table.upsert(batch, (writer, number))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the newest commit, in the columns of ``schema``; an empty table where there is none."""
    rows = BucketTable(spark, folder, []).read()
    empty = spark.createDataFrame([], schema)
    return empty if rows is None else rows.select(*empty.columns)


def failure_runs(probes: DataFrame, keys: list[str], order: list[str], ok: str = "ok") -> DataFrame:
    """Length of the run of failures that each probe ends; a success resets it to 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = free_name(probes, "_island")
    islands = probes.withColumn(island, F.sum(F.col(ok).cast("int")).over(w))
    run = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(*keys, island).orderBy(*order))
    return islands.withColumn("failures", F.when(F.col(ok), F.lit(0)).otherwise(run)).drop(island)


def changes(rows: DataFrame, keys: list[str], order: list[str], watched: list[str]) -> DataFrame:
    """Only rows whose ``watched`` columns differ from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = free_name(rows, "_before")
    now = F.struct(*watched)
    return rows.withColumn(before, F.lag(now).over(w)).where(F.col(before).isNull() | ~F.expr(f"struct({', '.join(watched)}) <=> `{before}`")).drop(before)


@dataclass(frozen=True)
class Care:
    """threshold: failed probes in a row; patience: seconds unhealthy before it fails; grace: seconds after a start in which
    failed probes do not count; silence: seconds without any probe (by the clock) after which a replica fails, None for never;
    policy, restarts: when and how often an ended replica starts again; backoff: seconds before it does (``watched``).
    """

    threshold: int = 3
    patience: float = 600.0
    grace: float = 0.0
    silence: float | None = None
    policy: str = "on-failure"
    restarts: int = 0
    backoff: float = 0.0


@dataclass
class Replica:
    failures: int = 0
    since: float = -1.0
    started: float = -1.0
    ready: bool = False
    restarts: int = 0
    over: bool = False

    def probe(self, at: float, ok: bool, care: Care) -> str:
        """The state after a probe: running, unhealthy, or failed once unhealthy for too long."""
        if self.over:
            return "failed"
        self.started = at if self.started < 0 else self.started
        self.ready |= ok
        excused = not ok and not self.ready and at - self.started < care.grace
        self.failures = 0 if ok else self.failures + (not excused)
        if self.failures < care.threshold:
            self.since = -1.0
            return "starting" if excused else "running"
        self.since = at if self.since < 0 else self.since
        return self.end(at, 1, care) if at - self.since >= care.patience and care.restarts else "failed" if at - self.since >= care.patience else "unhealthy"

    def end(self, at: float, code: int, care: Care) -> str:
        """The state after the process ended: an exit with 0 of a replica that was ever ready is a failure too."""
        code = 1 if code == 0 and self.ready else code
        again = code != 190 and care.policy != "never" and not (care.policy == "on-failure" and code == 0) and self.restarts < care.restarts
        if again:
            self.__init__(started=at, restarts=self.restarts + 1)
            return "restarting"
        self.over = True
        return "failed" if code else "exited"


def health(probes: DataFrame, care: Care = Care()) -> DataFrame:
    """States from probes (swarm_id, replica_id, at double seconds, ok boolean[, exit_code int, node_ok boolean]).

    A probe with an exit_code says that the process ended; one whose node is not ok counts as failed.
    Works on batches and streams; time is that of the probes, but for ``silence``, which is the clock's.
    A replica's probes are judged in the order of their times within a batch of the stream, for which they are held together;
    those of one time count together, successes first and ends last, and all but ends show the state after them.
    """
    schema = "swarm_id string, replica_id int, at double, state string, failures int"
    columns = ["swarm_id", "replica_id", "at", "state", "failures"]
    node = F.col("node_ok") if "node_ok" in probes.columns else F.lit(True)
    code = F.col("exit_code") if "exit_code" in probes.columns else F.lit(None)
    ok, code = F.coalesce(F.col("ok") & node, F.lit(False)), F.coalesce(code.cast("double"), F.lit(float("nan")))
    rows = probes.select("swarm_id", "replica_id", "at", ok.alias("ok"), code.alias("exit_code"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r, last = (Replica(*state.get[:-1]), state.get[-1]) if state.exists else (Replica(), -1.0)
        if state.hasTimedOut:
            r.over = True
            state.update((*astuple(r), last))
            yield pd.DataFrame([(*key, last + care.silence, "failed", r.failures)], columns=columns)
            return
        # an Arrow batch may end inside a replica's rows, so one frame need not be all of them, nor the earliest
        at, ok, code = (np.concatenate(x) for x in zip(*[(f["at"].to_numpy(float), f["ok"].to_numpy(bool), f["exit_code"].to_numpy(float)) for f in frames], strict=True))
        order = np.lexsort((~ok, ~np.isnan(code), at))
        at, ok, code = at[order], ok[order], code[order]
        name, failures = np.empty(len(at), object), np.empty(len(at), int)
        parts = [slice(i, i + 10_000) for i in range(0, len(at), 10_000)]
        for p in parts:
            taken = zip(at[p].tolist(), ok[p].tolist(), code[p].tolist(), strict=True)
            name[p], failures[p] = zip(*[(r.probe(x, good, care) if c != c else r.end(x, int(c), care), r.failures) for x, good, c in taken], strict=True)
        alone, instant = ~np.isnan(code) | (name == "restarting"), np.searchsorted(at, at)
        first = np.append(True, (instant[1:] != instant[:-1]) | alone[1:] | alone[:-1]).cumsum()
        after = np.searchsorted(first, first, side="right") - 1
        for p in parts:
            yield pd.DataFrame({"swarm_id": key[0], "replica_id": key[1], "at": at[p], "state": name[after[p]], "failures": failures[after[p]]}, columns=columns)
        state.update((*astuple(r), float(at[-1])))
        if care.silence is not None and not r.over:
            state.setTimeoutDuration(int(care.silence * 1000))

    kept = "failures int, since double, started double, ready boolean, restarts int, over boolean, last double"
    timer = "NoTimeout" if care.silence is None else "ProcessingTimeTimeout"
    return rows.groupBy("swarm_id", "replica_id").applyInPandasWithState(step, schema, kept, "append", timer)


class Watchdog(StatefulProcessor):
    """A replica's state with timers in event time: silence, and the pause before a restart."""

    KEPT = "failures int, since double, started double, ready boolean, restarts int, over boolean, last double, resume double"

    def __init__(self, care: Care):
        self.care = care

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("replica", self.KEPT)

    def _load(self) -> tuple[Replica, float, float]:
        if not self.kept.exists():
            return Replica(), -1.0, -1.0
        *fields, last, resume = self.kept.get()
        return Replica(*fields), last, resume

    def _due(self, r: Replica, last: float, resume: float) -> list[float]:
        """When the timers of this state go off."""
        if r.over:
            return []
        silence = [max(last, resume) + self.care.silence] if self.care.silence is not None and last >= 0 else []
        return [resume] if resume >= 0 else silence

    def _until(self, now: float, r: Replica, last: float, resume: float) -> tuple[list[tuple], float, float]:
        """What the timers before ``now`` say, and the state after them."""
        out = []
        while (due := [x for x in self._due(r, last, resume) if x < now or (x == now and x == resume)]) and not r.over:
            if due[0] == resume:
                out.append((resume, "starting", r.failures, r.restarts))
                last, resume = resume, -1.0
            else:
                r.over = True
                out.append((due[0], "failed", r.failures, r.restarts))
        return out, last, resume

    def _save(self, key: tuple, out: list[tuple], r: Replica, last: float, resume: float) -> Iterator[pd.DataFrame]:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        for x in self._due(r, last, resume):
            self.handle.registerTimer(int(x * 1000) + 1)
        self.kept.update((*astuple(r), last, resume))
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=["swarm_id", "replica_id", "at", "state", "failures", "restarts"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        r, last, resume = self._load()
        out: list[tuple] = []
        for at, ok, code, node in pd.concat(list(rows)).sort_values("at", kind="stable")[["at", "ok", "exit_code", "node_ok"]].itertuples(index=False):
            before, last, resume = self._until(at, r, last, resume)
            out += before
            if resume >= 0:
                continue  # it is down until then
            if not pd.isna(code) and not r.over:
                state = r.end(at, int(code), self.care)
                resume = at + self.care.backoff if state == "restarting" else -1.0
            else:
                state = r.probe(at, bool(ok) and bool(node), self.care)
                resume = at + self.care.backoff if state == "restarting" else -1.0
            last = at
            out.append((at, state, r.failures, r.restarts))
        yield from self._save(key, out, r, last, resume)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        r, last, resume = self._load()
        out, last, resume = self._until(timerValues.getCurrentWatermarkInMs() / 1000, r, last, resume)
        yield from self._save(key, out, r, last, resume)


def watched(probes: DataFrame, care: Care = Care(), late: str = "0 seconds") -> DataFrame:
    """``health`` of a stream with timers in event time: (swarm_id, replica_id, at, state, failures, restarts).

    Silence ends a replica and the pause before a restart ends (``starting``) when the watermark, ``late`` behind the newest probe of
    all replicas, has passed that time, also where the replica sends nothing any more; what comes during the pause is passed over. Needs the RocksDB state store.
    """
    spark = probes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    extra = {"exit_code": F.lit(None).cast("int"), "node_ok": F.lit(True)}
    rows = probes.select("swarm_id", "replica_id", "at", "ok", *[F.col(c) if c in probes.columns else x.alias(c) for c, x in extra.items()])
    rows = rows.withColumn("_ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("_ts", late)
    schema = "swarm_id string, replica_id int, at double, state string, failures int, restarts int"
    return rows.groupBy("swarm_id", "replica_id").transformWithStateInPandas(Watchdog(care), schema, "Append", "EventTime")


class Collector(threading.Thread):
    """A TCP source: one JSON payload a connection. Each lands as a file of ``folder``, which ``messages`` reads as a stream.

    A payload counts once it is whole: it is written beside and moved. Empty ones are ignored here, broken ones by ``normalized``.
    """

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0):
        super().__init__(daemon=True)
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        self.server = socket.create_server((host, port))
        self.port = self.server.getsockname()[1]

    def run(self) -> None:
        while True:
            try:
                link, _ = self.server.accept()
            except OSError:
                return  # closed
            with link:
                data = b"".join(iter(lambda: link.recv(1 << 16), b"")).strip()  # noqa: B023
            if data:
                name = f"{self.folder}/{time.time_ns()}-{uuid.uuid4().hex[:8]}"
                with open(f"{self.folder}/.{uuid.uuid4().hex}", "wb") as f:
                    f.write(b" ".join(data.splitlines()))
                os.replace(f.name, f"{name}.json")

    def close(self) -> None:
        self.server.close()


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads that collectors put into ``folder``, as a stream (value string)."""
    return spark.readStream.text(f"{folder}/*.json")


def send(payload: dict, host: str, port: int, attempts: int = 5, pause: float = 0.1) -> bool:
    """One payload to a collector; after each failure the pause doubles. False once all attempts failed."""
    for n in range(attempts):
        try:
            with socket.create_connection((host, port), timeout=5) as link:
                link.sendall(json.dumps(payload).encode())
            return True
        except OSError:
            time.sleep(pause * 2**n * (1 + random.random() / 10))
    return False
