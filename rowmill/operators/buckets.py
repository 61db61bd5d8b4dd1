"""Keyed tables that change: rows in hash buckets, of which a change rewrites those it touches, under a commit log.

``log/<n>.json`` names the files of every bucket after commit ``n``. A commit creates its entry, which one of several
writers can do; the others merge again on top of it. An entry also names the batches that streams have come to, so a
batch that is run again changes nothing. Numbers are the log's own and only rise, whatever those of a stream do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.joins import latest
from rowmill.sources import stores
from rowmill.sources.scratch import written

#: The table's own columns: the commit that a row came with, its place there, and what that commit did to it.
COMMIT, PLACE, FATE = "_commit", "_place", "_fate"


@dataclass(frozen=True)
class Counts:
    """Keys of a change: new, replaced, deleted, and those to patch or to delete that were not there. Rows that lost to a newer one are not counted."""

    inserted: int = 0
    changed: int = 0
    deleted: int = 0
    missing: int = 0


GONE = ("deleted", "missing")


class BucketTable:
    """Rows by ``keys`` below ``folder``, in ``buckets`` buckets; null is a key like any other.

    ``order`` names columns whose largest values win among the rows of a key (null lowest); ties, and all rows where none
    is named, go by arrival: the later commit, and in it the later row. ``stamp`` is a column that keeps the time of a row's
    last change. Columns are those of the first upsert.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: tuple[str, ...] = (), buckets: int = 64, stamp: str | None = "update_dt"):
        self.spark, self.folder, self.keys, self.order, self.buckets, self.stamp = spark, folder.rstrip("/"), list(keys), tuple(order), buckets, stamp

    def _entries(self) -> list[str]:
        found = stores.names(self.spark, f"{self.folder}/log/*.json")
        return [f for f in found if not f.rsplit("/", 1)[1].startswith(".")]

    def entry(self) -> dict[str, Any]:
        """The newest entry of the log: number, at (the last batch of each stream), files (of each bucket), counts, schema."""
        found = self._entries()
        return json.loads(stores.text_of(self.spark, found[-1])) if found else {"number": -1, "at": {}, "files": {}, "counts": {}, "schema": None}

    def read(self, own: bool = False) -> DataFrame | None:
        """All rows, without the table's own columns unless ``own``; None before the first commit."""
        entry = self.entry()
        if entry["schema"] is None:
            return None
        rows = self._rows(entry, list(entry["files"]))
        return rows if own else rows.drop(COMMIT, PLACE)

    def _rows(self, entry: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.folder}/data/{entry['files'][b]}" for b in buckets if b in entry["files"]]
        if not paths:
            return self.spark.createDataFrame([], entry["schema"]).drop(FATE)
        return self.spark.read.schema(entry["schema"]).parquet(*paths).where(~F.coalesce(F.col(FATE).isin(*GONE), F.lit(False))).drop(FATE)

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Counts:
        """Of each key the newest row stays. ``batch``: the stream and the number of the batch that the rows are."""
        return self._commit(rows, self._upserted, batch)

    def patch(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Counts:
        """Non-null values of ``rows`` (keys and some columns, one row a key) take the places of those that are there."""
        return self._commit(rows, self._patched, batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> Counts:
        return self._commit(keys.select(*self.keys).distinct(), self._deleted, batch)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _beside(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """_old, _new: the rows of each key as structs, null where there is none."""
        a = old.select(F.struct(*old.columns).alias("_old"), *[F.col(k).alias(f"_a{i}") for i, k in enumerate(self.keys)])
        b = new.select(F.struct(*new.columns).alias("_new"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(self.keys)])
        return a.join(b, F.expr(" and ".join(f"_a{i} <=> _b{i}" for i in range(len(self.keys)))), "full").select("_old", "_new")

    def _upserted(self, old: DataFrame, new: DataFrame) -> DataFrame:
        order = [*self.order, COMMIT, PLACE]
        newest = latest(new.withColumn("_key", F.struct(*self.keys)), "_key", *order).select(*new.columns)
        place = lambda side: "struct(" + ", ".join(f"{side}.`{c}`" for c in order) + ")"
        wins = F.expr(f"_old is null or (_new is not null and {place('_new')} > {place('_old')})")
        pick = lambda c: F.when(wins, F.current_timestamp() if c == self.stamp else F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
        fate = F.when(F.expr("_old is null"), "inserted").when(wins, "changed")
        return self._beside(old, newest).select(*[pick(c) for c in old.columns], fate.alias(FATE))

    def _patched(self, old: DataFrame, new: DataFrame) -> DataFrame:
        values = [c for c in new.columns if c not in (*self.keys, COMMIT, PLACE)]

        def pick(c: str) -> Column:
            was = F.col(f"_old.{c}")
            if c == self.stamp:
                return F.when(F.expr("_new is null"), was).otherwise(F.current_timestamp()).alias(c)
            return (F.coalesce(F.col(f"_new.{c}"), was) if c in values else self._known(c)).alias(c)

        fate = F.when(F.expr("_old is null"), "missing").when(F.expr("_new is not null"), "changed")
        return self._beside(old, new).select(*[pick(c) for c in old.columns], fate.alias(FATE))

    def _deleted(self, old: DataFrame, new: DataFrame) -> DataFrame:
        fate = F.when(F.expr("_old is null"), "missing").when(F.expr("_new is not null"), "deleted")
        return self._beside(old, new).select(*[self._known(c).alias(c) for c in old.columns], fate.alias(FATE))

    def _known(self, c: str) -> Column:
        """A stored value; the key of one that is missing."""
        return F.when(F.expr("_old is null"), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) if c in self.keys else F.col(f"_old.{c}")

    def _commit(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None) -> Counts:
        stream, number = batch or (None, 0)
        rows = written(rows.withColumn(PLACE, F.monotonically_increasing_id()), "change")  # computed once, and in one order
        while True:
            entry = self.entry()
            if stream is not None and entry["at"].get(stream, -1) >= number:
                return Counts()
            if entry["schema"] is None:
                if merge != self._upserted:
                    return Counts(missing=rows.select(*self.keys).distinct().count())
                made = rows.limit(0).withColumn(COMMIT, F.lit(0).cast("long"))
                made = made.withColumn(self.stamp, F.current_timestamp()) if self.stamp else made
                made = made.withColumn(FATE, F.lit(None).cast("string"))
                entry["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
            new = rows.withColumn(COMMIT, F.lit(entry["number"] + 1).cast("long"))
            touched = [str(r[0]) for r in new.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
            if not touched:
                return Counts()
            version = f"v{entry['number'] + 1}-{uuid.uuid4().hex}"
            merged = merge(self._rows(entry, touched), new)
            merged = merged.withColumn("_bucket", self._bucket())
            merged.repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{version}")
            there = stores.names(self.spark, f"{self.folder}/data/{version}/_bucket=*")
            files = {f.rsplit("=", 1)[1]: f"{version}/{f.rsplit('/', 1)[1]}" for f in there}
            counts = {r[0]: r[1] for r in self.spark.read.schema(f"{FATE} string").parquet(*there).groupBy(FATE).count().collect()} if there else {}
            counts = {f.name: counts.get(f.name, 0) for f in fields(Counts)}
            kept = {b: f for b, f in entry["files"].items() if b not in touched}
            at = entry["at"] | ({} if stream is None else {stream: number})
            text = json.dumps({"number": entry["number"] + 1, "at": at, "files": kept | files, "counts": counts, "schema": entry["schema"]})
            if stores.claim(self.spark, f"{self.folder}/log/{entry['number'] + 1:012d}.json", text):
                self._sweep()
                return Counts(**counts)

    def _sweep(self, keep: int = 3) -> None:
        """Files that only older entries than the last ``keep`` name are removed, and those entries after them; what is being read by others stays for two commits."""
        entries = self._entries()
        known = {f: set(json.loads(stores.text_of(self.spark, f))["files"].values()) for f in entries[-keep - 2 :]}
        live = {x for f in entries[-keep:] for x in known[f]}
        cls, fs = stores.hadoop(self.spark, self.folder)
        for f in entries[:-keep]:
            for x in known.get(f) or set(json.loads(stores.text_of(self.spark, f))["files"].values()):
                if x not in live:
                    fs.delete(cls(f"{self.folder}/data/{x}"), True)
            fs.delete(cls(f), False)
