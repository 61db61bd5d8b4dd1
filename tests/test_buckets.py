"""Keyed tables under a commit log."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowmill.operators.buckets import BucketTable, Counts
from rowmill.streaming import health


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k int, v string, n int").coalesce(1)


def values(table):
    return sorted(map(tuple, table.read().select("k", "v", "n").collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, f"file://{tmp_path}/t", ["k"], buckets=8)


def test_counts_of_changes(spark, table):
    assert table.read() is None and table.delete(rows(spark, (1, "", 0))) == Counts(missing=1)
    assert table.upsert(rows(spark, (1, "a", 1), (2, "b", 2), (None, "c", 3), (1, "z", 9))) == Counts(inserted=3)
    assert values(table) == [(1, "z", 9), (2, "b", 2), (None, "c", 3)]
    assert table.upsert(rows(spark, (2, "bb", 1), (3, "d", 4))) == Counts(inserted=1, changed=1)
    assert table.patch(rows(spark, (2, None, 7), (9, "x", 1)).select("k", "v", "n")) == Counts(changed=1, missing=1)
    assert values(table) == [(1, "z", 9), (2, "bb", 7), (3, "d", 4), (None, "c", 3)]
    assert table.delete(rows(spark, (1, "", 0), (None, "", 0), (8, "", 0))) == Counts(deleted=2, missing=1)
    assert values(table) == [(2, "bb", 7), (3, "d", 4)]
    assert table.upsert(rows(spark)) == Counts() and table.upsert(rows(spark, (1, "again", 0))) == Counts(inserted=1)


def test_only_touched_buckets_are_written_and_changes_are_stamped(spark, table, tmp_path):
    table.upsert(spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v"), F.lit(1).alias("n")))
    before, old = table.entry()["files"], {r.k: r.update_dt for r in table.read().collect()}
    table.patch(rows(spark, (5, "w", None)).select("k", "v"))
    after, new = table.entry()["files"], {r.k: r.update_dt for r in table.read().collect()}
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert [k for k in old if new[k] != old[k]] == [5] and new[5] > old[5] and table.read().count() == 200
    for i in range(6):
        table.upsert(rows(spark, (5, str(i), i)))
    assert len(list(Path(f"{tmp_path}/t/log").glob("0*.json"))) == 3 and table.read().count() == 200


def test_order_and_arrival(spark, table, tmp_path):
    by = BucketTable(spark, f"{tmp_path}/by", ["k"], ("n",))
    for t, want in ((table, "late"), (by, "high")):
        t.upsert(rows(spark, (1, "high", 9)))
        t.upsert(rows(spark, (1, "early", 1), (1, "late", 2)))
        assert values(t)[0][1] == want


def test_writers_at_once_lose_nothing(spark, tmp_path):
    def write(i):
        return BucketTable(spark, f"{tmp_path}/t", ["k"], buckets=4).upsert(rows(spark, *[(100 * i + j, "x", i) for j in range(20)]))

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(write, range(6)))
    table = BucketTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    assert found == [Counts(inserted=20)] * 6 and table.read().count() == 120 and table.entry()["number"] == 5


def test_a_batch_that_is_run_again_changes_nothing(spark, table):
    assert table.upsert(rows(spark, (1, "a", 1)), ("s", 0)) == Counts(inserted=1)
    table.upsert(rows(spark, (1, "other", 1)), ("t", 0))
    assert table.upsert(rows(spark, (1, "a", 1)), ("s", 0)) == Counts() and values(table) == [(1, "other", 1)]
    assert table.upsert(rows(spark, (1, "b", 1)), ("s", 1)) == Counts(changed=1)


def test_a_stream_with_a_fresh_checkpoint_keeps_all_keys(spark, tmp_path):
    def send(name, ids, state):
        messages = [('{"swarm_id": "s", "replica_id": %d, "state": "%s"}' % (i, state),) for i in ids]
        spark.createDataFrame(messages, "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/{name}")

    def follow(name, offsets):
        stream = health.normalized(spark.readStream.text(f"{tmp_path}/{name}"))
        health.maintain(stream, f"{tmp_path}/state", ["swarm_id", "replica_id"], f"{tmp_path}/{offsets}").awaitTermination()
        return {r.replica_id: r.state for r in health.snapshot(spark, f"{tmp_path}/state", "replica_id int, state string").collect()}

    send("a", range(50), "one")
    assert follow("a", "o1") == dict.fromkeys(range(50), "one")
    send("b", range(45, 60), "two")
    want = dict.fromkeys(range(45), "one") | dict.fromkeys(range(45, 60), "two")
    assert follow("b", "o2") == want  # another stream, whose batches begin at 0 again
    assert follow("a", "o1") == want  # the first goes on and finds nothing new
    send("a", [3], "three")
    assert follow("a", "o1") == want | {3: "three"}
