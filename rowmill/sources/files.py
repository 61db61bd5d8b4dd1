"""Reading and writing datasets: numeric ranges and globs in paths, row limits, sharded files."""

from __future__ import annotations

import itertools
import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".parquet": "parquet", ".csv": "csv", ".jsonl": "json"}


def _numbers(body: str) -> list[str] | None:
    """What stands between braces as the numbers it means, or None where it is no range."""
    ends = [x.strip() for x in body.split("..")]
    if len(ends) not in (2, 3) or not all(x.isascii() and x.removeprefix("-").isdigit() for x in ends):
        return None
    first, last = int(ends[0]), int(ends[1])
    step = int(ends[2]) if len(ends) == 3 else (1 if last >= first else -1)
    if step == 0:
        raise ValueError(f"step 0 in {{{body}}}")
    width = max(len(x.removeprefix("-")) for x in ends[:2])
    stop = last + (1 if step > 0 else -1)
    return [f"{'-' * (n < 0)}{abs(n):0{width}d}" for n in range(first, stop, step)]


def _pieces(pattern: str) -> list[list[str]]:
    """The pattern as a row of choices; text between ranges is a choice of one."""
    out, at = [], 0
    while (opened := pattern.find("{", at)) >= 0:
        closed = pattern.find("}", opened)
        found = _numbers(pattern[opened + 1 : closed]) if closed >= 0 else None
        until = opened + 1 if found is None else opened
        out.append([pattern[at:until]])
        if found is not None:
            out.append(found)
        at = until if found is None else closed + 1
    return [*out, [pattern[at:]]]


def expand_ranges(pattern: str, max_expansions: int = 10_000) -> list[str]:
    """``{a..b}`` and ``{a..b..step}`` as all their numbers, zero-padded like the wider end, left to right.

    A range that runs down needs no sign on its step; step 0 is an error, other braces stay as they are.
    """
    choices = _pieces(pattern)
    if math.prod(map(len, choices)) > max_expansions:
        raise ValueError(f"{pattern} stands for more than {max_expansions} paths")
    return ["".join(picked) for picked in itertools.product(*choices)]


def has_ranges(pattern: str) -> bool:
    return expand_ranges(pattern) != [pattern]


def full_path(path: str) -> str:
    return os.path.expanduser(os.path.expandvars(path))


def _matches(spark: SparkSession, paths: list[str]) -> list[str]:
    """Existing files for paths and globs, in the order given (those of a glob by name) and without repeats, looked up through Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, None] = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found |= dict.fromkeys(sorted(status.getPath().toString() for status in path.getFileSystem(conf).globStatus(path) or ()))
    return list(found)


def read_dataset(spark: SparkSession, path: str, limit: int | None = None, **options) -> DataFrame:
    """A directory (Parquet), a pattern with numeric ranges or globs (Parquet), or one file by its suffix.

    ``limit`` None or 0 means all rows, else the first rows in file order: by file, and by place in it.
    """
    path = full_path(path)
    suffix = os.path.splitext(path)[1].lower()
    if any(c in path for c in "*?[") or has_ranges(path):
        files = _matches(spark, expand_ranges(path))
        if not files:
            raise FileNotFoundError(f"No files matched pattern {path}")
        df = spark.read.options(**options).parquet(*files)
    elif suffix in ("", ".parquet"):
        df = spark.read.options(**options).parquet(path)
    elif suffix == ".csv":
        df = spark.read.options(**{"header": True, "inferSchema": True} | options).csv(path)
    elif suffix == ".jsonl":
        df = spark.read.options(**options).json(path)
    else:
        raise ValueError(f"Unsupported file format: {suffix}")
    return _first_in_files(df, limit, "json" if suffix == ".jsonl" else "csv" if suffix == ".csv" else "parquet", options) if limit else df


def _first_in_files(df: DataFrame, limit: int, kind: str, options: dict) -> DataFrame:
    """Only as many files as hold ``limit`` rows are read: one, two, four and so on, counted until they suffice."""
    spark, files, n = df.sparkSession, sorted(df.inputFiles()), 1
    while True:
        some = spark.read.schema(df.schema).options(**({"header": True} | options if kind == "csv" else options)).format(kind).load(files[:n]) if files else df
        if n >= len(files) or some.count() >= limit:
            break
        n *= 2
    # the parts of a file are read by rising offset, and rows of a part get rising numbers
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    names = [f"__place_{i}" for i in range(3)]
    return some.select("*", *[c.alias(n) for c, n in zip(place, names, strict=True)]).orderBy(*names).limit(limit).select(*df.columns)


def first_rows(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` rows by ``order``, or any without one (``read_dataset`` has file order). None and 0 mean all."""
    if not limit:
        return df
    return (df.orderBy(*order) if order else df).limit(limit)


def shard_names(n: int) -> list[str]:
    width = max(1, len(str(n - 1)))
    return [f"data-{i:0{width}d}.parquet" for i in range(n)]


def shard_count(given: object = None, options: dict | None = None) -> int:
    """From the argument, else options ``nshards`` or ``n_shards``, else 1; what is no number counts as 1."""
    for x in (given, (options or {}).get("nshards"), (options or {}).get("n_shards")):
        if x is not None:
            try:
                return max(1, int(x))
            except (TypeError, ValueError):
                return 1
    return 1


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_dataset(df: DataFrame, path: str, nshards: int = 1, order: str | None = None, mode: str = "overwrite", single: bool = False, **options) -> None:
    """By suffix: Parquet, CSV or JSON lines. Each is a folder of part files that tasks write side by side.

    With ``nshards`` rows are cut by ``order`` into runs of equal size, each its own ``shard=i`` folder, whose
    files are as many as the sorted parts that the run spans; no task gathers a shard.
    ``single`` makes one file of that very name, written by one task: for tables of a size that a task can write.
    """
    path = full_path(path)
    suffix = os.path.splitext(path)[1].lower()
    if suffix and suffix not in FORMATS:
        raise ValueError(f"Unsupported file format: {suffix}")
    kind = FORMATS.get(suffix, "parquet")
    if kind == "csv":
        options = {"header": True} | options
    if single:
        if not suffix or nshards > 1:
            raise ValueError("a single file needs a suffix and holds one shard")
        _single(df.coalesce(1), path, kind, options)
        return
    writer = df.write
    if nshards > 1:
        from rowmill.operators.ids import ceil_chunks

        if not order:
            raise ValueError("sharded output needs a column to order by")
        writer = ceil_chunks(df, order, nshards, "shard").sortWithinPartitions("shard", order).write.partitionBy("shard")
    writer.format(kind).mode(mode).options(**options).save(path)


def _single(df: DataFrame, target: str, kind: str, options: dict) -> None:
    """``df`` (one part) written beside ``target`` and moved there."""
    base, _, name = target.rpartition("/")
    path, fs = _fs(df.sparkSession, base or ".")
    beside = f"{base or '.'}/_writing-{uuid.uuid4().hex}"
    df.write.format(kind).option("maxRecordsPerFile", 0).options(**options).save(beside)
    _move_one(path, fs, fs.globStatus(path(f"{beside}/part-*")) or (), target, name)
    fs.delete(path(beside), True)


def _move_one(path, fs, found, target: str, name: str) -> None:
    """The one file found takes the place of ``target``; several would lose rows, so they are an error."""
    found = list(found)
    if len(found) != 1:
        raise RuntimeError(f"{name} has {len(found)} part files, not one")
    fs.delete(path(target), False)
    if not fs.rename(found[0].getPath(), path(target)):
        raise RuntimeError(f"cannot move a part file to {target}")


def write_named_shards(df: DataFrame, folder: str, nshards: int, order: str, lone: str = "data.parquet") -> list[str]:
    """Runs of equal size by ``order`` as single files ``data-<i>.parquet``; fewer rows than shards give fewer files.

    One shard is named ``lone`` (``data-0.parquet`` is the other custom); an empty table is one empty
    file, the first shard's. One task writes each file, so a shard should be of a size that a task can write.
    """
    from rowmill.operators.ids import ceil_chunks, free_name

    spark, folder = df.sparkSession, full_path(folder).rstrip("/")
    names = shard_names(nshards) if nshards > 1 else [lone]
    path, fs = _fs(spark, folder)
    fs.mkdirs(path(folder))
    shard = free_name(df, "_shard")
    parts = ceil_chunks(df, order, nshards, shard)
    made = parts.select(shard).distinct().count()  # nshards rows at most
    if not made:
        _single(df.limit(0).coalesce(1), f"{folder}/{shard_names(nshards)[0]}", "parquet", {})
        return shard_names(nshards)[:1]
    beside = f"{folder}/_writing-{uuid.uuid4().hex}"
    parts.repartitionById(nshards, F.col(shard)).sortWithinPartitions(shard, order).write.option("maxRecordsPerFile", 0).partitionBy(shard).parquet(beside)
    for i, name in enumerate(names[:made]):
        _move_one(path, fs, fs.globStatus(path(f"{beside}/{shard}={i}/part-*.parquet")) or (), f"{folder}/{name}", name)
    fs.delete(path(beside), True)
    return names[:made]
