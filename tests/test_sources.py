"""Digests by blocks and logs by byte ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rowmill.sources import blocks, logs


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    for name, n in (("part-00.txt", 10), ("part-01.txt", 5000), ("sub/part-02.txt", 0), ("sub/part-03.txt", 99_999)):
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_bytes(rng.randbytes(n))
    (tmp_path / "d" / "_SUCCESS").write_text("")
    return tmp_path / "d"


def by_hand(data, block):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    level = [sha(data[i : i + block]) for i in range(0, max(1, len(data)), block)]
    while len(level) > 1:
        groups = [level[i : i + blocks.FAN] for i in range(0, len(level), blocks.FAN)]
        level = [g[0] if len(g) == 1 else sha("".join(g).encode()) for g in groups]
    return level[0]


@pytest.mark.parametrize("block", [1 << 20, 1000, 7])
def test_file_digests_by_blocks(spark, folder, monkeypatch, block):
    monkeypatch.setattr(blocks, "FAN", 10)
    got = {r["name"]: (r.length, r.digest) for r in blocks.content_digest(spark, str(folder), block=block).collect()}
    files = {str(f.relative_to(folder)): f.read_bytes() for f in folder.rglob("*.txt")}
    assert got == {name: (len(data), by_hand(data, block)) for name, data in files.items()}


def test_other_algorithms(spark, folder):
    data = (folder / "part-01.txt").read_bytes()
    for name in ("sha512", "md5", "blake2b"):
        assert blocks.content_digest(spark, str(folder / "part-01.txt"), name).first().digest == hashlib.new(name, data).hexdigest()


def test_dataset_digests(spark, folder, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 2)
    now = lambda path=folder, **k: blocks.dataset_digest(spark, str(path), **k)
    whole, ends = now(), now(footers=True)
    pattern = f"{folder}/part-{{00..01}}.txt"
    two = now(pattern)
    assert len(whole) == 8 == len(ends) and now() == whole and len({whole, ends, two}) == 3
    assert now(f"{folder}/part-*.txt") == two and now(f"file://{folder}/part-0[01].txt") == two
    one = now(folder / "part-00.txt")
    assert one == hashlib.sha256((folder / "part-00.txt").read_bytes()).hexdigest()[:8] == by_hand((folder / "part-00.txt").read_bytes(), 99)[:8]
    data = bytearray((folder / "part-01.txt").read_bytes())
    data[2500] ^= 1
    (folder / "part-01.txt").write_bytes(data)
    assert now() != whole and now(pattern) != two
    data[2500] ^= 1
    (folder / "part-01.txt").write_bytes(data)
    (folder / "part-00.txt").rename(folder / "part-09.txt")
    assert now() != whole and now(footers=True) != ends and now(folder / "part-09.txt") == one
    with pytest.raises(FileNotFoundError):
        now(f"{folder}/none-*.txt")


def test_checkpoint_of_a_pattern_without_a_tag(spark, tmp_path):
    from rowmill.__main__ import main

    spark.range(6).select(F.col("id").alias("k"), F.col("id").cast("string").alias("words")).coalesce(1).write.parquet(f"{tmp_path}/a")
    for i in range(2):
        (tmp_path / f"in-{i:03d}.parquet").write_bytes(next((tmp_path / "a").glob("part-*.parquet")).read_bytes())
    given = [f"{tmp_path}/in-{{000..001}}.parquet", f"{tmp_path}/out", "--job", "rowmill.catalogue:Length", "--input-column", "words", "--id", "k", "--checkpoints", f"{tmp_path}/c"]
    first = main(given)
    assert main(given) == first and first.startswith(f"{tmp_path}/c/Length_")
    main([*given, "--identity", "footers"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


TEXT = b"one\ntwo\r\n\nfour \xff\n" + b"x" * 300 + b"\nlast"


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000])
def test_every_line_is_in_one_range(tmp_path, monkeypatch, size):
    monkeypatch.setattr(logs, "RANGE", size)
    (tmp_path / "x").write_bytes(TEXT)
    got = [row for r in logs.ranges(f"{tmp_path}/x", 0, len(TEXT)) for row in logs.lines_in(r)]
    want, at = [], 0
    for line in TEXT.split(b"\n"):
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    assert got == want
    assert [row for r in logs.ranges(f"{tmp_path}/x", 9, len(TEXT)) for row in logs.lines_in(r)] == want[2:]


def test_the_tail_reads_few_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "l").mkdir()
    with open(tmp_path / "l/big.log", "wb") as f:
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(b"\n" + b"".join(b"line %d\n" % i for i in range(50)))
    (tmp_path / "l/few.log").write_text("a\nb")
    (tmp_path / "l/none.log").write_text("")
    assert logs.last_lines(f"{tmp_path}/l/big.log", (tmp_path / "l/big.log").stat().st_size, 10) > 3 << 30
    got = logs.log_tail(spark, f"{tmp_path}/l", 3).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r["at"], r.line) for r in got) == [("big.log", 1, "line 47"), ("big.log", 2, "line 48"), ("big.log", 3, "line 49"), ("few.log", 1, "a"), ("few.log", 2, "b")]
    since = {f"{tmp_path}/l/few.log": 2, f"{tmp_path}/l/big.log": (tmp_path / "l/big.log").stat().st_size}
    assert [tuple(r)[1:] for r in logs.log_lines(spark, f"{tmp_path}/l", since).collect()] == [(2, "b")]


def test_a_stream_goes_on_at_its_offsets(spark, tmp_path):
    (tmp_path / "l").mkdir()

    def drain(n):
        q = logs.log_stream(spark, f"{tmp_path}/l").writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        q.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(f"{tmp_path}/out{n}")).start().awaitTermination()
        return sorted((r.file.rsplit("/", 1)[1], r["at"], r.line) for r in spark.read.schema("file string, at long, line string").parquet(f"{tmp_path}/out{n}").collect())

    (tmp_path / "l/a.log").write_text("1\n2\nhal")
    (tmp_path / "l/b.log").write_text("x\n")
    assert drain(1) == [("a.log", 0, "1"), ("a.log", 2, "2"), ("b.log", 0, "x")]
    with open(tmp_path / "l/a.log", "a") as f:
        f.write("f\n4\nopen")
    (tmp_path / "l/b.log").write_text("")
    (tmp_path / "l/c.log").write_text("new\n")
    assert drain(2) == [("a.log", 4, "half"), ("a.log", 9, "4"), ("c.log", 0, "new")]
    (tmp_path / "l/b.log").write_text("y\n")
    assert drain(3) == [("b.log", 0, "y")]
