"""Checkpoint tables: appended generations of output rows, merged so that the last write wins."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators.flush import flush_rows, rows_of
from rowmill.operators.ids import fingerprint, require_unique
from rowmill.operators.joins import latest
from rowmill.operators.transform import RowJob
from rowmill.sources import stores


class Fenced(RuntimeError):
    """A generation that a compaction has closed while its run went on."""


class Checkpoint:
    """Folder ``path`` holds generations of rows: ``base=<n>-..`` (compacted), ``wave=<n>-..`` and ``flush=<n>-..``.

    A generation's number is claimed by creating ``_generations/<n>``, which one of several runs can do, and it
    ends by creating ``_generations/<n>.end``: its own run says ``committed`` there, a compaction that goes past it
    ``fenced``; who comes first decides. Waves and bases, which Spark writes, count once they are committed; the
    parts of a flushed generation count as they appear, so what a killed run has published is kept.
    A fenced run hears of it at its end (``Fenced``); nothing it published before is lost.

    Every row carries ``_seq`` (generation) and ``_pos``, so order never depends on file names. With ``sharded``
    flushed generations lie in ``shard=<i>`` folders; numbers are those of ``path`` as a whole.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, sharded: bool = False):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.places = [self.path, f"{self.path}/shard=*"] if sharded else [self.path]
        self.output = schema
        self.schema = T.StructType([*schema.fields, T.StructField("_seq", T.LongType()), T.StructField("_pos", T.LongType())])

    def verify(self, df: DataFrame, input_column: str) -> None:
        """The input must be the one that this checkpoint was begun with (ids and values in any order), and its ids unique.

        The first call stores the input's fingerprint beside the generations; later ones compare.
        """
        require_unique(df, self.key)
        now = json.dumps({"column": input_column, "fingerprint": fingerprint(df, self.key, input_column)}, sort_keys=True)
        name = f"{self.path}/_input.json"
        if not stores.claim(self.spark, name, now) and stores.text_of(self.spark, name) != now:
            raise ValueError("the checkpoint was begun with another input")

    def require_columns(self) -> None:
        """Stored rows must have all output columns, in every folder; what lacks some would be read as nulls.

        Each folder's columns come from one of its footers.
        """
        for folder in self.folders():
            names = self.spark.read.parquet(folder).columns
            if missing := [c for c in self.schema.names if c not in names]:
                raise ValueError(f"the checkpoint has no column {', '.join(missing)} in {folder.rsplit('/', 1)[1]}")

    # generations

    def _ended(self) -> dict[int, str]:
        """What ended generations say; a small file each."""
        found = stores.names(self.spark, f"{self.path}/_generations/*.end")
        ended = [(f.rsplit("/", 1)[1], f) for f in found]
        return {int(name.split(".")[0]): stores.text_of(self.spark, f) for name, f in ended if name[0] != "."}

    def begin(self) -> int:
        """Claim the next generation: no other run gets its number."""
        number = self.next_seq()
        while not stores.claim(self.spark, f"{self.path}/_generations/{number:08d}"):
            number += 1
        return number

    def end(self, seq: int, word: str = "committed") -> str:
        """End a generation unless it has ended; what its end says."""
        name = f"{self.path}/_generations/{seq:08d}.end"
        return word if stores.claim(self.spark, name, word) else stores.text_of(self.spark, name)

    def commit(self, seq: int) -> None:
        if self.end(seq) != "committed":
            raise Fenced(f"generation {seq} was closed by a compaction; run again for the rows that are not stored")

    def next_seq(self) -> int:
        found = [f.rsplit("/", 1)[1] for f in stores.names(self.spark, f"{self.path}/_generations/*")]
        return 1 + max((int(f.split(".")[0]) for f in found if f[0] != "."), default=-1)

    def folders(self) -> list[str]:
        """The newest base and what was written after it."""
        ended, found = self._ended(), []
        for f in [f for place in self.places for f in stores.names(self.spark, f"{place}/*=*-*")]:
            kind = re.fullmatch(r"(base|wave|flush)=(\d+)-\w+", f.rpartition("/")[2])
            if kind and (kind[1] == "flush" or ended.get(int(kind[2])) == "committed"):
                found.append((int(kind[2]), kind[1] == "base", f))
        base = max((n for n, is_base, _ in found if is_base), default=-1)
        some = sorted((n, f) for n, is_base, f in found if n > base or (is_base and n == base))
        return [f for _, f in some if stores.names(self.spark, f"{f}/p*.parquet")]

    # rows

    def rows(self) -> DataFrame:
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def done(self) -> DataFrame:
        """Ids with an output: only the id column is read."""
        return self.rows().select(self.key).distinct()

    def append(self, df: DataFrame, seq: int | None = None) -> int:
        """``df`` (id, outputs) as a generation, with its number."""
        seq = self.begin() if seq is None else seq
        out = df.withColumn("_seq", F.lit(seq).cast("long")).withColumn("_pos", F.monotonically_increasing_id())
        out.select(*self.schema.names).write.parquet(f"{self.path}/wave={seq}-{uuid.uuid4().hex[:8]}")
        self.commit(seq)
        return seq

    def transform(self, rows: DataFrame, job: RowJob, every: int, seq: int | None = None) -> int:
        """Rows (id, item) run through ``job`` in one Spark job that publishes every ``every`` completions of a task."""
        seq = self.begin() if seq is None else seq
        flush_rows(rows, job, f"{self.path}/flush={seq}-{uuid.uuid4().hex[:8]}", seq, every)
        self.commit(seq)
        return seq

    def published(self, seq: int) -> int:
        """Rows that generation ``seq`` has published so far, told by the names of its parts; each counts once, however often its task was tried."""
        return sum(rows_of(f) for place in self.places for f in stores.names(self.spark, f"{place}/flush={seq}-*/p*.parquet"))

    def latest(self) -> DataFrame:
        return latest(self.rows(), self.key, "_seq", "_pos").drop("_seq", "_pos")

    def compact(self) -> None:
        """Write the merged rows as a new base; nothing that is being read is touched.

        Runs that have not ended by now are fenced: what they have published is merged, and they are told at their end.
        """
        seq = self.begin()
        for n in range(seq):
            self.end(n, "fenced")
        folders = self.folders()
        if folders:
            merged = latest(self.spark.read.schema(self.schema).parquet(*folders), self.key, "_seq", "_pos")
            merged.select(*self.schema.names).write.parquet(f"{self.path}/base={seq}-{uuid.uuid4().hex[:8]}")
        self.commit(seq)
