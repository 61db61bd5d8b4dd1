"""Timers in event time against the same rules over plain lists."""

import random

from rowmill.streaming import health

SCHEMA = "swarm_id string, replica_id int, at double, ok boolean, exit_code int"
OUT = "swarm_id string, replica_id int, at double, state string, failures int, restarts int"


def follow(spark, tmp_path, care, *batches):
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = health.watched(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), care)
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True)
        q.foreachBatch(lambda df, _, n=n: df.write.mode("append").parquet(f"{tmp_path}/out{n}")).start().awaitTermination()
        out.append(sorted(map(tuple, spark.read.schema(OUT).parquet(f"{tmp_path}/out{n}").collect())))
    return out


def test_silence_and_restarts_over_batches(spark, tmp_path):
    care = health.Care(silence=10, restarts=1, backoff=5, policy="always")
    first = [("s", 1, 0.5, True, None), ("s", 1, 2.0, False, 3), ("s", 1, 4.0, True, None), ("s", 2, 1.0, True, None)]
    later = [("s", 1, 8.0, True, None), ("s", 1, 9.0, False, 1), ("s", 3, 40.0, True, None)]
    got = follow(spark, tmp_path, care, first, later)
    assert got[0] == [("s", 1, 0.5, "running", 0, 0), ("s", 1, 2.0, "restarting", 0, 1), ("s", 2, 1.0, "running", 0, 0)]
    assert got[1] == [("s", 1, 7.0, "starting", 0, 1), ("s", 1, 8.0, "running", 0, 1), ("s", 1, 9.0, "failed", 0, 1), ("s", 2, 11.0, "failed", 0, 0), ("s", 3, 40.0, "running", 0, 0)]


def test_batches_do_not_matter(spark, tmp_path):
    rng, at, rows = random.Random(2), 0.0, []
    for _ in range(120):
        at += rng.choice([0.5, 1.0, 1.5, 6.5])
        rows.append(("s", rng.randrange(4), at, rng.random() < 0.6, rng.choice([None, None, None, 0, 2])))
    care = health.Care(threshold=2, patience=3, silence=20.25, restarts=5, backoff=2.25)
    one = follow(spark, tmp_path / "a", care, rows)
    many = follow(spark, tmp_path / "b", care, rows[:50], rows[50:51], rows[51:])
    assert sorted(x for b in many for x in b) == one[0] and {r[3] for r in one[0]} >= {"running", "restarting", "starting", "failed"}
