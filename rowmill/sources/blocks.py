"""What files are known by: digests of block ranges, hashed side by side and combined in order by a tree."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.sources import stores
from rowmill.sources.files import expand_ranges, full_path, has_ranges

BLOCK = 64 << 20
#: Children of a node of the tree; tasks of the hashing stage at most; bytes of a file's end that ``footers`` reads.
FAN, TASKS, FOOTER = 1024, 10_000, 64 << 10
PIECE = 4 << 20


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(file, name, length) of the files that ``path`` (a file, a folder, a pattern with ranges or globs) stands for, by name.

    Names are relative to the folder, or to what stands before a pattern's first special sign; a single file has none.
    Files and folders whose names begin with ``_`` or ``.`` are no data. A row a file is held in the driver, as Spark's own listing is.
    """
    path = full_path(path)
    special = has_ranges(path) or any(c in path for c in "*?[")
    roots = [f for p in expand_ranges(path) for f in stores.names(spark, p)] if special else [path]
    cls, fs = stores.hadoop(spark, roots[0] if roots else ".")
    found: dict[str, tuple[str, int]] = {}
    for root in dict.fromkeys(roots):
        status = fs.getFileStatus(cls(root))
        whole = status.getPath().toString()
        if status.isFile():
            found[whole] = (whole, status.getLen())
            continue
        files = fs.listFiles(cls(root), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if not any(x[:1] in "_." for x in name.removeprefix(whole).strip("/").split("/")):
                found[name] = (name, f.getLen())
    if not found:
        raise FileNotFoundError(f"no files under {path}")
    if not special and list(found) == [whole] and status.isFile():
        return [(whole, "", found[whole][1])]
    base = os.path.commonpath([os.path.dirname(f) for f in found]) if special else whole
    return sorted(((f, f.removeprefix(base).strip("/"), n) for f, n in found.values()), key=lambda x: x[1])


def _hashed(batches: Iterator[pa.RecordBatch], algorithm: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, start, size in zip(*[b.column(c).to_pylist() for c in ("path", "start", "size")], strict=True):
            fs, at = stores.opened(path)
            h = hashlib.new(algorithm)
            with fs.open_input_file(at) as f:
                f.seek(start)
                while size and (piece := f.read(min(size, PIECE))):
                    h.update(piece)
                    size -= len(piece)
            if size:
                raise OSError(f"{path} became shorter while it was read")
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(out, pa.string())], names=["file", "block", "digest"])


def combined(rows: DataFrame, keys: list[str], at: str, count: int, algorithm: str = "sha256") -> DataFrame:
    """(keys, digest) of each group's digests in the order of ``at`` (from 0, ``count`` at most), ``FAN`` of them a node; a single one is itself."""
    bits = {"sha256": 256, "sha512": 512}.get(algorithm, 256)
    while count > 1:
        node = rows.groupBy(*keys, F.expr(f"`{at}` div {FAN}").alias("_node")).agg(F.sort_array(F.collect_list(F.struct(at, "digest"))).alias("_of"))
        text = F.array_join(F.transform("_of", lambda x: x["digest"]), "")
        digest = F.when(F.size("_of") == 1, F.col("_of")[0]["digest"]).otherwise(F.sha2(text, bits))
        rows, count = node.select(*keys, F.col("_node").alias(at), digest.alias("digest")), -(-count // FAN)
    return rows.select(*keys, "digest")


def content_digest(spark: SparkSession, path: str, algorithm: str = "sha256", block: int = BLOCK, footers: bool = False) -> DataFrame:
    """path, name, length, digest of every file that ``path`` stands for. A file of one block has the plain digest of its bytes.

    Tasks hash blocks, so a file may have any size. ``footers`` reads no more than each file's length and last bytes,
    where Parquet keeps the places and ranges of its columns: far cheaper, and blind to bytes that change without either.
    """
    files = [(i, f, name, n) for i, (f, name, n) in enumerate(listed(spark, path))]
    table = spark.createDataFrame(files, "file long, path string, name string, length long")
    most = max(1, max(-(-n // block) for _, _, _, n in files))
    if footers:
        blocks, total, most = table.select("file", "path", F.lit(0).cast("long").alias("block"), F.greatest(F.lit(0), F.col("length") - FOOTER).alias("start"), F.least("length", F.lit(FOOTER)).alias("size")), len(files), 1
    else:
        at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(0L, (length - 1) div {block})")))
        blocks = table.select("file", "path", "length", at.alias("block")).withColumn("start", F.col("block") * block)
        blocks, total = blocks.withColumn("size", F.least(F.lit(block), F.col("length") - F.col("start"))), sum(max(1, -(-n // block)) for *_, n in files)
    dealt = blocks.select("file", "path", "block", "start", "size").repartition(min(TASKS, total), "file", "block")
    leaves = dealt.mapInArrow(lambda b: _hashed(b, algorithm), "file long, block long, digest string")
    return table.join(combined(leaves, ["file"], "block", most, algorithm), "file").select("file", "path", "name", "length", "digest")


def dataset_digest(spark: SparkSession, path: str, footers: bool = False) -> str:
    """First 8 signs of a hash over the names, lengths and digests of all files in the order of their names; of a single file's digest alone."""
    rows = content_digest(spark, path, footers=footers)
    names = listed(spark, path)
    if len(names) == 1 and not names[0][1] and not footers:
        return rows.first()["digest"][:8]
    leaves = rows.select(F.lit(0).alias("all"), "file", F.sha2(F.concat_ws("\n", "name", F.col("length").cast("string"), "digest"), 256).alias("digest"))
    return combined(leaves, ["all"], "file", len(names)).first()["digest"][:8]
