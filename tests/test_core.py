import asyncio
import math
import os
import signal
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmill import OutputMode, RowJob, run
from rowmill.functions import metrics as M
from rowmill.operators import ids, jobs, joins
from rowmill.operators.checkpoint import Checkpoint, Fenced
from rowmill.operators.transform import shaped
from rowmill.plans.run import run_sharded
from rowmill.sources import files, memory
from rowmill.streaming import health


@pytest.mark.parametrize(
    ("pattern", "paths"),
    [
        ("part{098..101}.csv", ["part098.csv", "part099.csv", "part100.csv", "part101.csv"]),
        ("{2..9..3}", ["2", "5", "8"]),
        ("{12..9}", ["12", "11", "10", "09"]),
        ("t{-2..0}", ["t-2", "t-1", "t0"]),
        ("y{7..8}/m{1..2}", ["y7/m1", "y7/m2", "y8/m1", "y8/m2"]),
        ("q{r}s{1..x}", ["q{r}s{1..x}"]),
        ("{u{4..5}}", ["{u4}", "{u5}"]),
        ("open{1..2", ["open{1..2"]),
    ],
)
def test_ranges(pattern, paths):
    assert files.expand_ranges(pattern) == paths


def test_range_errors():
    with pytest.raises(ValueError):
        files.expand_ranges("a{1..101}b{1..100}")
    with pytest.raises(ValueError):
        files.expand_ranges("{4..6..0}")


def test_shard_names_and_counts():
    assert files.shard_names(2) == ["data-0.parquet", "data-1.parquet"]
    assert files.shard_names(11)[0] == "data-00.parquet"
    assert [files.shard_count(3), files.shard_count(None, {"n_shards": "2"}), files.shard_count("x"), files.shard_count()] == [3, 2, 1, 1]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "col1 long, col2 string")
    for suffix in ("x.parquet", "x.csv", "x.jsonl", "folder"):
        files.write_dataset(df, f"{tmp_path}/{suffix}")
        got = files.read_dataset(spark, f"{tmp_path}/{suffix}")
        assert sorted((r.col1, r.col2) for r in got.collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="Unsupported"):
        files.read_dataset(spark, "x.xml")
    with pytest.raises(FileNotFoundError):
        files.read_dataset(spark, f"{tmp_path}/none-{{1..2}}-*.parquet")
    assert files.read_dataset(spark, f"{tmp_path}/x.parquet", limit=0).count() == 2
    assert files.read_dataset(spark, f"{tmp_path}/x.parquet", limit=1).count() == 1


@pytest.mark.parametrize(
    ("results", "names", "want"),
    [
        (["x", "y"], ["c"], [{"c": "x"}, {"c": "y"}]),
        ([("x",)], ["c"], [{"c": "x"}]),
        ([(1, 2)], ["a", "b"], [{"a": 1, "b": 2}]),
        ([{"a": 1}], ["a", "b"], [{"a": 1, "b": None}]),
        ([{"b": 1}, {"a": 2}], None, [{"a": None, "b": 1}, {"a": 2, "b": None}]),
        ([5], None, [{"output": 5}]),
        ([], ["c"], []),
    ],
)
def test_shaped(results, names, want):
    assert shaped(results, names)[1] == want


@pytest.mark.parametrize(("results", "names"), [([(1, 2)], ["c"]), ([(1,)], ["a", "b"]), (["x"], ["a", "b"]), ([(1,)], None)])
def test_shaped_errors(results, names):
    with pytest.raises(ValueError):
        shaped(results, names)


class Tag(RowJob):
    schema = "result string"

    async def transform_items(self, items):
        await asyncio.sleep(0)
        return [f"t{x}" for x in items]


class Guard(RowJob):
    schema = "result string"

    def transform_items(self, items):
        if items[0] < 4:
            raise RuntimeError("computed again")
        return [f"t{items[0]}"]


def table(spark, n, **more):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("messages"))


def test_resume_computes_new_ids_only(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    run(table(spark, 4), Tag(), "doc_id", checkpoint=folder)
    out = run(table(spark, 6), Guard(retries=1), "doc_id", checkpoint=folder, compact=True)
    assert sorted((r.doc_id, r.result) for r in out.collect()) == [(i, f"t{i}") for i in range(6)]
    again = run(table(spark, 6), Guard(retries=1), "doc_id", checkpoint=folder)
    assert again.count() == 6


def test_failure_keeps_what_was_published(spark, tmp_path):
    folder = f"file://{tmp_path}/c"

    class Fail(RowJob):
        schema = "result string"

        def transform_items(self, items):
            if items[0] == 7:
                raise RuntimeError("no")
            with open(f"{tmp_path}/calls", "a") as f:
                f.write(f"{items[0]}\n")
            return ["x"]

    with pytest.raises(Exception, match="no"):
        run(table(spark, 40).coalesce(1), Fail(retries=1, max_concurrency=1), "doc_id", checkpoint=folder, flush_every=3)
    out = run(table(spark, 40), Tag(), "doc_id", checkpoint=folder)
    assert {r.doc_id for r in out.where("result = 'x'").collect()} == set(map(int, (tmp_path / "calls").read_text().split())) and out.count() == 40


class Killed(RowJob):
    """Its process is killed at a call, once."""

    schema = "result string"

    def __init__(self, marker, at, **more):
        super().__init__(**more)
        self.marker, self.at = marker, at

    def transform_items(self, items):
        with open(f"{self.marker}-{os.getpid()}", "a+") as f:
            f.write(f"{items[0]}\n")
            f.seek(0)
            calls = len(f.readlines())
        if calls == self.at and not os.path.exists(self.marker):
            open(self.marker, "w").close()
            os.kill(os.getpid(), signal.SIGKILL)
        return [f"t{items[0]}"]


def test_a_killed_worker_loses_less_than_a_flush(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    with pytest.raises(Exception):
        run(table(spark, 100).coalesce(1), Killed(f"{tmp_path}/k", 57), "doc_id", checkpoint=folder, flush_every=10)
    parts = [f for f in Path(f"{tmp_path}/c").rglob("p*.parquet")]
    assert len(parts) == 5 and all(f.name.endswith("-10.parquet") for f in parts)
    out = run(table(spark, 100).coalesce(1), Killed(f"{tmp_path}/k", 57), "doc_id", checkpoint=folder, flush_every=10)
    assert sorted((r.doc_id, r.result) for r in out.collect()) == [(i, f"t{i}") for i in range(100)]
    calls = [int(x) for f in tmp_path.glob("k-*") for x in f.read_text().split()]
    assert len(calls) <= 100 + 10 and set(calls) == set(range(100))


def test_a_task_that_is_tried_again_goes_on_after_its_parts(spark, tmp_path):
    from rowmill.operators.flush import Parts
    from rowmill.sources.stores import publish

    import pyarrow as pa

    publish(pa.table({"doc_id": [1, 2, None]}), f"{tmp_path}/shard=1/flush=0-a", "p000003-x-000000-3.parquet")
    publish(pa.table({"doc_id": [9]}), f"{tmp_path}/shard=1/flush=0-a", "p000004-x-000000-1.parquet")
    assert Parts(f"file://{tmp_path}", 3).ids("doc_id") == {1, 2, None} and Parts(f"{tmp_path}/none", 3).ids("doc_id") == set()


def test_one_job_scans_the_input_once_and_tells_its_progress(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    df = table(spark, 100).withColumn("messages", counted("messages"))
    run(df, Tag(), "doc_id", "replace", checkpoint=f"file://{tmp_path}/c").collect()
    assert read.value == 100

    class Slow(RowJob):
        schema = "result string"

        async def transform_items(self, items):
            await asyncio.sleep(0.05)
            return ["x"]

    heard = []
    run(table(spark, 100).coalesce(1), Slow(), "doc_id", checkpoint=f"file://{tmp_path}/d", flush_every=5, on_progress=lambda *x: heard.append(x))
    assert heard[-1] == (100, 100) and len(heard) > 3 and [x for x, _ in heard] == sorted({x for x, _ in heard})


def test_a_slow_item_does_not_idle_the_other_slots():
    import pyarrow as pa

    from rowmill.operators.transform import in_order, keyed_items, slide

    running, most, order = set(), [0], []

    class Uneven(RowJob):
        async def transform_items(self, items):
            running.add(items[0])
            most[0] = max(most[0], len(running))
            await asyncio.sleep(0.4 if items[0] == 3 else 0)
            running.discard(items[0])
            order.append(items[0])
            return [items[0] * 2]

    batches = [pa.record_batch({"k": list(range(a, a + 100)), "v": list(range(a, a + 100))}) for a in range(0, 2000, 100)]
    got = list(slide(Uneven(max_concurrency=8), keyed_items(batches)))
    assert sorted(got) == [(i, i, 2 * i) for i in range(2000)] and most[0] == 8
    assert order.index(3) > 1000  # the others went on, over many batches
    assert list(in_order(got)) == [(i, 2 * i) for i in range(2000)]


def test_a_failure_cancels_what_still_runs():
    from rowmill.operators.transform import slide

    ended = []

    class Broken(RowJob):
        async def transform_items(self, items):
            try:
                if items[0] == 2:
                    raise ValueError("two")
                await asyncio.sleep(30)
            except asyncio.CancelledError:
                ended.append(items[0])
                raise

    with pytest.raises(ValueError, match="two"):
        list(slide(Broken(max_concurrency=3, retries=1), ((i, i) for i in range(9))))
    assert sorted(ended) == [0, 1]


def test_two_runs_take_two_generations_and_a_closed_one_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string")
    a, b = (Checkpoint(spark, f"file://{tmp_path}/c", "k", rows.schema) for _ in range(2))
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda x: x.begin(), [a, b] * 8))
    assert sorted(taken) == list(range(16))
    a.append(rows, 3)
    b.compact()
    with pytest.raises(Fenced, match="generation 5"):
        a.append(rows.withColumn("v", F.lit("late")), 5)
    assert sorted(map(tuple, a.latest().collect())) == [(1, "a"), (2, "a")]
    assert a.append(rows.where("k = 1").withColumn("v", F.lit("b"))) == 17
    assert sorted(map(tuple, b.latest().collect())) == [(1, "b"), (2, "a")]


def test_columns_of_every_folder_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    store = Checkpoint(spark, f"file://{tmp_path}/c", "k", rows.schema)
    store.append(rows)
    Checkpoint(spark, f"file://{tmp_path}/c", "k", rows.select("k").schema).append(spark.createDataFrame([(2,)], "k long"))
    with pytest.raises(ValueError, match="no column v in wave=1"):
        store.require_columns()


def test_strict_resume(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    run(table(spark, 9), Tag(), "doc_id", checkpoint=folder, strict=True)
    run(table(spark, 9).orderBy(F.desc("doc_id")), Tag(), "doc_id", checkpoint=folder, strict=True)
    with pytest.raises(ValueError, match="another input"):
        run(table(spark, 10), Tag(), "doc_id", checkpoint=folder, strict=True)
    with pytest.raises(ValueError, match="occurs 2 times"):
        run(table(spark, 9).union(table(spark, 1)), Tag(), "doc_id", checkpoint=folder, strict=True)

    class More(Tag):
        schema = "result string, more string"

    with pytest.raises(ValueError, match="no column more"):
        run(table(spark, 9), More(), "doc_id", checkpoint=folder)


def test_limit_is_taken_once(spark, tmp_path):
    out = run(table(spark, 1000).repartition(7), Tag(), "doc_id", checkpoint=f"file://{tmp_path}/c", limit=30, sort=True).collect()
    assert len(out) == 30 and all(r.result == f"t{r.doc_id}" for r in out) and [r.doc_id for r in out] == sorted(r.doc_id for r in out)


def test_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    assert run_sharded(table(spark, 20), Tag(), "doc_id", checkpoint=folder, nshards=3).count() == 20
    again = run_sharded(table(spark, 20), Guard(retries=1), "doc_id", checkpoint=folder, nshards=2)
    assert sorted((r.doc_id, r.result) for r in again.collect()) == [(i, f"t{i}") for i in range(20)]
    assert run_sharded(table(spark, 20), Tag(), "doc_id", mode="replace", checkpoint=folder, nshards=4, shard_mode="index", output=f"{tmp_path}/out") is None
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(got.columns) == ["doc_id", "result", "shard"] and sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [5, 5, 5, 5]
    for bad in ({"shard_mode": "name", "checkpoint": folder}, {"nshards": 2}, {"output": "x"}, {"nshards": 0, "checkpoint": folder}):
        with pytest.raises(ValueError):
            run_sharded(table(spark, 3), Tag(), "doc_id", **bad)


def test_memory_tables(spark):
    import pandas as pd
    import pyarrow as pa

    table_ = pd.DataFrame({"messages": [1, 2, 3]}, index=[7, 8, 9])
    out = run(table_, Tag(), spark=spark)
    assert sorted((r["_row_id"], r.result) for r in out.collect()) == [(7, "t1"), (8, "t2"), (9, "t3")]
    assert run(pa.table({"doc_id": [1], "messages": [5]}), Tag(), "doc_id", spark=spark).first().result == "t5"
    with pytest.raises(memory.BackendError):
        run([1, 2], Tag(), spark=spark)
    assert memory.backend(" Pandas ") == memory.backend() == "spark"
    with pytest.raises(memory.BackendError):
        memory.backend("duck")
    with pytest.raises(memory.BackendError):
        run(table_, Tag(), spark=spark, backend="duck")
    assert run(table_, Tag(), spark=spark, backend="Pandas").count() == 3
    assert [memory.batch_size(3, 4), memory.batch_size(None, 4), memory.batch_size()] == [3, 4, 1000]
    assert memory.columns_of(spark.range(1)) == {"id": "bigint"}


def test_rows_side_by_side(spark):
    a, b = spark.range(50).select("id", (-F.col("id")).alias("v")), spark.range(100, 150).select(F.col("id").alias("w"), "id")
    rows = joins.side_by_side(a, b, ("id",), ("w",)).collect()
    assert [(r.id_x, r.v, r.w, r.id_y) for r in rows] == [(i, -i, 100 + i, 100 + i) for i in range(50)]
    with pytest.raises(ValueError, match="beside"):
        joins.side_by_side(a, b.limit(3), ("id",), ("w",))


def test_modes_and_suffixes(spark):
    df = spark.createDataFrame([(0, "a", "orig", 1)], "doc_id long, messages string, result string, extra int")
    assert run(df, Tag(), "doc_id").columns == ["doc_id", "messages", "result_x", "extra", "result_y"]
    assert run(df, Tag(), "doc_id", OutputMode.IO_ONLY).columns == ["doc_id", "messages", "result_x", "result_y"]
    assert run(df, Tag(), "doc_id", "replace").columns == ["doc_id", "result"]
    with pytest.raises(ValueError, match="id column"):
        run(df, Tag(), "nope")
    with pytest.raises(ValueError, match="input column"):
        run(df, Tag(input_column="nope"), "doc_id")


def test_empty_input_and_null_ids(spark, tmp_path):
    assert run(table(spark, 0), Tag(), "doc_id", checkpoint=f"file://{tmp_path}/e").collect() == []
    df = spark.createDataFrame([(None, 1), (2, 2)], "doc_id long, messages long")
    folder = f"file://{tmp_path}/n"
    for _ in range(2):
        out = run(df, Tag(), "doc_id", checkpoint=folder)
    assert {(r.doc_id, r.result) for r in out.collect()} == {(None, "t1"), (2, "t2")}


def test_checkpoint_base_and_parts(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a"), (1, "a")], "k long, v string")
    store = Checkpoint(spark, f"file://{tmp_path}/c", "k", rows.schema)
    store.append(rows)
    store.append(rows.where("k = 1").withColumn("v", F.lit("b")))
    store.compact()
    store.append(spark.createDataFrame([(2, "c")], "k long, v string"))
    assert sorted(tuple(r) for r in store.latest().collect()) == [(0, "a"), (1, "b"), (2, "c")]
    store.compact()
    assert sorted(tuple(r) for r in store.latest().collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_union_is_strict(spark):
    a = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(TypeError):
        joins.union_parts([a, a.select(F.col("k").cast("double").alias("k"))])
    assert joins.union_parts([a, spark.createDataFrame([("x",)], "v string")]).columns == ["k", "v"]


def test_dense_index_of_wide_rows_over_many_parts(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        wide = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), "id", F.col("id").cast("string").alias("_mono"), (F.col("id") % 7).alias("_part"))
        ids.dense_index(wide, "n", "k").write.parquet(f"{tmp_path}/x")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.read.parquet(f"{tmp_path}/x")
    row = got.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()
    assert tuple(row) == (1_000_000, 1_000_000, 0, 999_999, 1_000_000) and got.columns == ["n", *wide.columns]
    assert got.orderBy("n").limit(1000).toPandas()["k"].is_monotonic_increasing


def test_named_shards_keep_all_rows(spark, tmp_path):
    df = spark.range(10_000).select("id", (F.col("id") * 2).alias("_shard"), F.col("id").cast("string").alias("_at"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1000")
    try:
        names = files.write_named_shards(df, f"{tmp_path}/x", 3, "id")
        lone = files.write_named_shards(df, f"{tmp_path}/y", 1, "id")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert names == files.shard_names(3) and lone == ["data.parquet"]
    got = files.read_dataset(spark, f"{tmp_path}/x/data-{{0..2}}.parquet")
    assert got.columns == df.columns and got.select("id").distinct().count() == got.count() == 10_000
    assert [spark.read.parquet(f"{tmp_path}/x/{n}").count() for n in names] == [3334, 3334, 3332]
    assert files.write_named_shards(df.limit(2), f"{tmp_path}/z", 3, "id") == files.shard_names(3)[:2]
    assert files.write_named_shards(df.limit(0), f"{tmp_path}/e", 3, "id") == ["data-0.parquet"] and spark.read.parquet(f"{tmp_path}/e").count() == 0


def test_limit_in_file_order(spark, tmp_path):
    for suffix, kind in (("csv", "csv"), ("jsonl", "json"), ("parquet", "parquet")):
        path = f"{tmp_path}/x.{suffix}"
        spark.range(1000).repartition(5, F.col("id") % 5).sortWithinPartitions("id").write.format(kind).option("header", True).save(path)
        all_rows = [r.id for f in sorted(spark.read.format(kind).option("header", True).load(path).inputFiles()) for r in spark.read.schema("id long").format(kind).option("header", True).load(f).collect()]
        assert [r.id for r in files.read_dataset(spark, path, limit=333).collect()] == all_rows[:333]


def test_shards_cover_all_rows(spark):
    df = table(spark, 103)
    for n in (1, 4, 7):
        sizes = [r["count"] for r in ids.index_shards(df, "doc_id", n).groupBy("shard").count().orderBy("shard").collect()]
        assert sizes == [103 // n + (i < 103 % n) for i in range(n)]
        assert ids.ceil_chunks(df, "doc_id", n).count() == 103
    assert df.select(ids.shard_of("doc_id", 5).alias("s")).where("s between 0 and 4").count() == 103


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-20, 0), max_size=60))
def test_perplexity_matches_python(logs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    row = spark.createDataFrame([(logs,)], "l array<double>").select(M.perplexity("l"), M.bottom_perplexity("l", 3)).first()
    want = [jobs.perplexity(logs), jobs.perplexity(sorted(logs)[:3])]
    for got, right in zip(row, want, strict=True):
        assert got == right or math.isclose(got, right, rel_tol=1e-9)


def test_multi_turn():
    turns = [{"role": r, "content": c} for r, c in [("system", "s"), ("user", "a"), ("assistant", "old"), ("user", "b")]]
    out = jobs.MultiTurnJob(jobs.EchoClient()).one(turns)
    assert [(m["role"], m["content"]) for m in out] == [("system", "s"), ("user", "a"), ("assistant", "echo:a"), ("user", "b"), ("assistant", "echo:b")]
    with pytest.raises(ValueError):
        jobs.MultiTurnJob(jobs.EchoClient()).one(turns[:1])


def test_retry_and_contract():
    calls = []

    class Flaky(RowJob):
        def transform_items(self, items):
            calls.append(1)
            if len(calls) == 1:
                raise OSError
            return items

    assert Flaky(pause=0).call_all([1, 2, 3]) == [1, 2, 3]

    class Two(RowJob):
        def transform_items(self, items):
            return [1, 2]

    with pytest.raises(RuntimeError):
        Two().call_all([1])


def test_messages(spark):
    raw = ['{"swarm_id":"s","replica_id":"2","port":"9000","http_ready":true}', "", "x", "[1]", '{"replica_id":1}', '{"swarm_id":"s","replica_id":"a"}', '{"swarm_id":"s","replica_id":3,"state":null}']
    rows = health.normalized(spark.createDataFrame([(x,) for x in raw], "value string")).collect()
    assert [(r.replica_id, r.port, r.http_ready, r.state, r.agent_version) for r in rows] == [(2, 9000, True, "unknown", "unknown"), (3, None, False, "None", "unknown")]


def test_names_and_strict_status(spark):
    one = spark.range(1)
    name = one.select(M.generated_name(F.lit("My  Swarm!"), 30)).first()[0]
    assert name.startswith("my-swarm-") and len(name) == 19
    assert one.select(M.coerce_status(F.lit(" running "), None)).first()[0] == "RUNNING"
    with pytest.raises(Exception, match="no job status: odd"):
        one.select(M.coerce_status(F.lit("odd"), None)).collect()


def test_fail_reason(spark):
    df = spark.createDataFrame([(137, "SIGKILL", 1, 3, None), (None, None, None, None, "Cannot provide a placement group"), (None,) * 5], "c int, s string, a int, m int, t string")
    text, retry = M.fail_reason(F.col("c"), F.col("s"), F.col("a"), F.col("m"), F.col("t"))
    got = [(r[0], r[1]) for r in df.select(text, retry).collect()]
    assert got[0] == ("exit_code=137 | (likely OOM / SIGKILL) | signal=SIGKILL | restart_attempt=1/3", True)
    assert got[1][0].startswith("ray_pg_insufficient_capacity | log_tail:") and got[1][1] is False
    assert got[2] == ("unknown failure", True)


def test_fingerprint(spark):
    df = table(spark, 20)
    assert ids.fingerprint(df, "doc_id", "messages") == ids.fingerprint(df.orderBy(F.desc("doc_id")), "doc_id", "messages")
    assert ids.fingerprint(df, "doc_id", "messages") != ids.fingerprint(df.union(df), "doc_id", "messages")
    two = lambda rows: ids.fingerprint(spark.createDataFrame(rows, "k long, v string"), "k", "v")
    assert len({two([(1, "x"), (1, "x")]), two([(2, "y"), (2, "y")]), two([(1, None)]), two([(1, "")]), two([])}) == 5
    assert ids.fingerprint(df, "doc_id", "messages") != ids.fingerprint(df.withColumn("messages", F.col("messages") + 1), "doc_id", "messages")


def test_health_machine(spark, tmp_path):
    probes = [("s", 1, float(i), ok) for i, ok in enumerate([True, False, False, False, False, True, False])]
    spark.createDataFrame(probes, "swarm_id string, replica_id int, at double, ok boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("swarm_id string, replica_id int, at double, ok boolean").parquet(f"{tmp_path}/in")
    query = health.health(stream, health.Care(threshold=2, patience=2.0)).writeStream.format("memory").queryName("health").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("select state, failures from health order by at").collect()
    assert [tuple(r) for r in rows] == [("running", 0), ("running", 1), ("unhealthy", 2), ("unhealthy", 3), ("failed", 4), ("running", 0), ("running", 1)]


def judged(spark, tmp_path, probes, care, frame):
    """Health of probes (at, ok, exit_code) of one replica that lie in one file in this order, in frames of so many rows."""
    schema = "swarm_id string, replica_id int, at double, ok boolean, exit_code int"
    spark.createDataFrame([("s", 1, *p) for p in probes], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frame)
    try:
        out = health.health(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), care).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        out.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return sorted((r["at"], r.state, r.failures) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_health_takes_frames_of_a_replica_together(spark, tmp_path):
    probes = [(float(i), ok, None) for i, ok in enumerate([True, False, False, False, False, True, False])]
    want = [(0, "running", 0), (1, "running", 1), (2, "unhealthy", 2), (3, "unhealthy", 3), (4, "failed", 4), (5, "running", 0), (6, "running", 1)]
    assert judged(spark, tmp_path, probes[::-1], health.Care(threshold=2, patience=2.0), 2) == want


def test_health_of_probes_at_one_time(spark, tmp_path):
    care = health.Care(threshold=2, patience=2.0, restarts=1)
    probes = [(1.0, False, None), (0.0, False, None), (1.0, True, None), (2.0, False, None), (2.0, False, None), (3.0, False, 5), (3.0, True, None), (3.0, True, None)]
    want = [(0, "running", 1), (1, "running", 1), (1, "running", 1), (2, "unhealthy", 3), (2, "unhealthy", 3), (3, "restarting", 0), (3, "running", 0), (3, "running", 0)]
    for n, x in enumerate([probes, probes[::-1]]):
        assert judged(spark, tmp_path / str(n), x, care, 3) == want


def test_replica_care():
    care = health.Care(threshold=2, patience=10, grace=5, policy="on-failure", restarts=1)
    r = health.Replica()
    assert [r.probe(at, ok, care) for at, ok in [(0, False), (3, False), (6, True), (7, False), (8, False), (18, False)]] == ["starting", "starting", "running", "running", "unhealthy", "restarting"]
    assert [r.probe(19, True, care), r.end(20, 0, care), r.probe(21, True, care)] == ["running", "failed", "failed"]
    assert health.Replica().end(0, 0, care) == "exited" and health.Replica().end(0, 190, care) == "failed"
    assert health.Replica().end(0, 3, health.Care(policy="never", restarts=3)) == "failed"


def test_collector(spark, tmp_path):
    assert not health.send({}, "127.0.0.1", 1, attempts=2, pause=0)
    source = health.Collector(f"{tmp_path}/in")
    source.start()
    for n, at in ((1, 1), (2, 2), (1, 3)):
        assert health.send({"swarm_id": "s", "replica_id": n, "state": f"at{at}"}, "127.0.0.1", source.port)
    deadline = time.time() + 10
    while len(list((tmp_path / "in").glob("*.json"))) < 3 and time.time() < deadline:
        time.sleep(0.05)
    source.close()
    stream = health.normalized(health.messages(spark, f"{tmp_path}/in"))
    for _ in range(2):  # the second run finds nothing new
        health.maintain(stream, f"{tmp_path}/state", ["swarm_id", "replica_id"], f"{tmp_path}/offsets", ("state",)).awaitTermination()
    rows = health.snapshot(spark, f"{tmp_path}/state", "swarm_id string, replica_id int, state string, last_seen timestamp").collect()
    assert {(r.replica_id, r.state) for r in rows} == {(1, "at3"), (2, "at2")} and all(r.last_seen for r in rows)
    assert health.snapshot(spark, f"{tmp_path}/none", "swarm_id string").count() == 0


def test_job_specs(spark, tmp_path):
    from rowmill.operators import specs

    job = specs.load_job("rowmill.catalogue:WordCount", '{"retries": 2}', retries=9, input_column="text")
    assert (job.retries, job.input_column) == (2, "text")
    for name, settings, error in [("WordCount", None, "module:Class"), ("no.such:X", None, "no module"), ("rowmill.catalogue:Nope", None, "has no"), ("rowmill.catalogue:WordCount", "[1]", "object"), ("rowmill.catalogue:WordCount", "{", "not JSON")]:
        with pytest.raises(ValueError, match=error):
            specs.load_job(name, settings)
    for name in ("rowmill.operators.transform:RowJob", "json:JSONDecoder"):
        with pytest.raises(TypeError, match="transform_items"):
            specs.load_job(name)
    folder = lambda **k: specs.checkpoint_folder(spark, "/c/", job, "/in", "/out", tag="t", **k)
    assert folder() == folder() == "/c/WordCount_t" and folder(resume=False) != folder(resume=False)
    assert folder(keep=False) is None
    with pytest.raises(ValueError, match="nothing to resume"):
        folder(keep=False, resume=False)


def test_command_line(spark, tmp_path):
    from rowmill.__main__ import main

    given = [(i, "x" * i) for i in range(7)]
    files.write_dataset(spark.createDataFrame(given, "k long, words string"), f"{tmp_path}/in")
    common = [f"{tmp_path}/in", f"{tmp_path}/out.csv", "--job", "rowmill.catalogue:Length", "--settings", '{"input_column": "words"}', "--id", "k", "--checkpoints", f"{tmp_path}/c"]
    first = main([*common, "--mode", "io_only", "--single"])
    assert sorted(map(tuple, files.read_dataset(spark, f"{tmp_path}/out.csv").select("k", "result").collect())) == [(i, i) for i in range(7)]
    assert main([*common, "--mode", "io_only", "--single"]) == first
    assert main([*common, "--no-resume", "--single"]) != first
    assert main([*common, "--no-checkpoint", "--single", "--limit", "3"]) is None
    assert files.read_dataset(spark, f"{tmp_path}/out.csv").count() == 3
    main([f"{tmp_path}/in", f"{tmp_path}/shards", *common[2:], "--shards", "2"])
    assert files.read_dataset(spark, f"{tmp_path}/shards").groupBy("shard").count().count() == 2
    for wrong in (["--shards", "2", "--single"], ["--no-checkpoint", "--strict"], ["--mode", "other"]):
        with pytest.raises(SystemExit):
            main([*common, *wrong])


def test_once_with_and_without_a_checkpoint(spark, tmp_path):
    given = spark.createDataFrame([(1, "a"), (1, "a"), (None, "bb"), (None, "bb"), (2, None)], "k long, words string")
    job = load_length()
    for folder in (None, f"{tmp_path}/c"):
        out = run(given, job, "k", checkpoint=folder, once=True)
        assert sorted(map(str, out.select("k", "result").collect())) == sorted(["Row(k=1, result=1)"] * 2 + ["Row(k=None, result=2)"] * 2 + ["Row(k=2, result=0)"])
    stored = spark.read.parquet(f"{tmp_path}/c/flush=*")
    assert stored.count() == 3


def load_length():
    from rowmill.operators import specs

    return specs.load_job("rowmill.catalogue:Length", input_column="words")


def test_a_late_resume_shuffles_ids_only(spark, tmp_path):
    wide = spark.range(1000).select(F.when(F.col("id") != 5, F.col("id")).alias("k"), F.repeat(F.lit("x"), 50).alias("text"))
    wide.write.parquet(f"{tmp_path}/in")
    wide = spark.read.parquet(f"{tmp_path}/in")
    for left in ("k >= 990", "k is null"):
        rows = joins.pending_narrow(wide, wide.where(f"not coalesce({left}, false)"), "k")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert sorted(map(str, rows.collect())) == sorted(map(str, wide.where(left).collect()))
    many = joins.pending_narrow(wide, wide.where("k < 10"), "k", most=10)
    assert many.count() == 991
