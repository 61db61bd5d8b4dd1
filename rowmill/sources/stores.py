"""File systems as the driver sees them (through Hadoop) and as tasks do (through pyarrow)."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, folder: str):
    """(Hadoop's Path class, the file system of ``folder``)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that tasks use and the path in it: ``file``, ``hdfs``, ``s3`` (also as ``s3a``), ``gs``, ``abfss``; a bare path is a local one."""
    path = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path
    if path.startswith("file:/"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create the file ``path``; False if it is there. Of several that try at once, one gets it.

    On a local disk and on HDFS this is atomic; object stores need a client whose ``create`` without overwriting is.
    """
    cls, fs = hadoop(spark, path)
    fs.mkdirs(cls(path).getParent())
    try:
        if fs.getScheme() == "file":
            jvm = spark.sparkContext._jvm
            nio = jvm.java.nio.file.Paths.get(cls(path).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            beside = nio.resolveSibling(f".{nio.getFileName().toString()}-{uuid.uuid4().hex}")
            jvm.java.nio.file.Files.writeString(beside, text, spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
            try:  # a link appears at once, with the text in it
                jvm.java.nio.file.Files.createLink(nio, beside)
            finally:
                jvm.java.nio.file.Files.delete(beside)
        else:
            with contextlib.closing(fs.create(cls(path), False)) as out:
                out.write(bytearray(text.encode()))
    except Exception:
        if fs.exists(cls(path)):
            return False
        raise
    return True


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths of a Hadoop glob, sorted."""
    cls, fs = hadoop(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(cls(pattern)) or ())


def text_of(spark: SparkSession, path: str) -> str:
    """A small file, read in the driver."""
    cls, fs = hadoop(spark, path)
    stream = fs.open(cls(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(table: pa.Table, folder: str, name: str) -> None:
    """Write ``folder/name`` as Parquet beside its place and move it there: readers see it whole or not at all."""
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    beside = f"{at}/_{uuid.uuid4().hex}"
    pq.write_table(table, beside, filesystem=fs, compression="zstd")
    fs.move(beside, f"{at}/{name}")
