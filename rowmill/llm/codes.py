"""Vector codes by product quantisation, with codebooks from Lloyd rounds that rescan only what may have moved.

Vectors lie in blocks of a bucketed table, written once; what a round has to remember lies in a second
table with the same buckets, so that joining them shuffles nothing. For every entry of every codebook a
block holds a heap of its parts, keyed by slack: the lower bound of the distance to any other entry
minus the upper bound of that to the own one. An entry that moves, and others that move towards its
parts, eat slack; how much is summed up for each entry, so keys stay as they are. A round pops the parts
whose key the sum has reached, scans them exactly in whole numbers, and pushes them to the heap of their
entry. Heaps are kept as sorted arrays: popping cuts off a prefix, pushing merges.

Only sums of parts that changed their entry leave a block; a few thousand numbers reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowmill.llm.shared import cut, give_back, join_hot
from rowmill.sources.scratch import scratch

LONG = (1 << 63) - 1
LIMB = 32


@dataclass(frozen=True)
class Codes:
    """parts of a vector, entries of a part's codebook (256 at most), Lloyd rounds, scale of components; rows of a bucket."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    bucket: int = 1_000_000


def whole(x: np.ndarray, wide: bool) -> np.ndarray:
    """Whole-valued doubles as integers: 64-bit, or of any size where ``wide``."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape) if wide else x.astype(np.int64)


def root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class Heaps:
    """The parts of one position of a block: ``order`` lists them by entry and rising key, ``counts`` says how many each entry has."""

    def __init__(self, order: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.order, self.keys, self.counts = order, keys, counts

    @classmethod
    def unread(cls, n: int, entries: int) -> Heaps:
        """All parts under entry 0, with keys that any round pops."""
        return cls(np.arange(n, dtype=np.uint32), np.full(n, -np.inf, np.float32), np.array([n, *[0] * (entries - 1)], np.uint32))

    def entry(self) -> np.ndarray:
        """Of each part, by its number."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.counts)), self.counts)
        return out

    def pop(self, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the parts whose key is at most their entry's bar: the parts, and their entries."""
        starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        gone = np.zeros(len(self.order), bool)
        for e, bar in enumerate(bars):
            run = self.keys[starts[e] : starts[e + 1]]
            gone[starts[e] : starts[e] + np.searchsorted(run, bar, "right")] = True
        entry = np.repeat(np.arange(len(self.counts)), self.counts)
        found = self.order[gone], entry[gone]
        self.order, self.keys = self.order[~gone], self.keys[~gone]
        self.counts = np.bincount(entry[~gone], minlength=len(self.counts)).astype(np.uint32)
        return found

    def push(self, parts: np.ndarray, entry: np.ndarray, keys: np.ndarray) -> None:
        all_keys, all_entries = np.concatenate([self.keys, keys]), np.concatenate([np.repeat(np.arange(len(self.counts)), self.counts), entry])
        order = np.lexsort((all_keys, all_entries))
        self.order, self.keys = np.concatenate([self.order, parts])[order].astype(np.uint32), all_keys[order].astype(np.float32)
        self.counts = np.bincount(all_entries, minlength=len(self.counts)).astype(np.uint32)

    def tobytes(self) -> bytes:
        return self.counts.tobytes() + self.order.tobytes() + self.keys.tobytes()

    @classmethod
    def frombytes(cls, data: bytes, n: int, entries: int) -> Heaps:
        a, b = 4 * entries, 4 * entries + 4 * n
        return cls(np.frombuffer(data[a:b], np.uint32), np.frombuffer(data[b:], np.float32), np.frombuffer(data[:a], np.uint32))


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry (ties to the lower index) and its slack, rounded down."""
    d = np.stack([((x - b) ** 2).sum(1) for b in book], 1)
    entry = d.argmin(1) if len(d) else np.empty(0, np.int64)
    best = d[np.arange(len(d)), entry]
    if len(book) == 1:
        return entry, np.full(len(d), np.inf)
    d[np.arange(len(d)), entry] = d.max() if len(d) else 0
    return entry, root(d.min(1)) - root(best)


def below(keys: np.ndarray) -> np.ndarray:
    """As single floats that are no larger."""
    out = keys.astype(np.float32)
    return np.where(out > keys, np.nextafter(out, np.float32(-np.inf)), out)


def limbs(sums: np.ndarray, count: int) -> list[int]:
    """Whole numbers in base 2^32, the last place with the sign, so that their sums over all blocks fit a long."""
    out = []
    for v in map(int, sums.ravel()):
        out += [(v >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(count - 1)]
        out.append(v >> (LIMB * (count - 1)))
    return out


@dataclass
class Books:
    """values (parts, entries, width): the codebooks; used (parts, entries): slack eaten since the start."""

    values: Any
    used: np.ndarray

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """Each entry at the floor of its parts' mean; those without parts stay."""
        new = self.values.copy()
        for p, e in zip(*np.nonzero(counts), strict=True):
            new[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
        drift = np.sqrt(((new - self.values) ** 2).sum(2).astype(float))
        used = self.used.copy()
        for p in range(len(drift)):
            for e in range(drift.shape[1]):
                used[p, e] += drift[p, e] + max([0.0, *np.delete(drift[p], e)])
        return Books(new, used)


def kept(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): rows whose vector and all its components are there and finite; a table without ``label`` has null ones."""
    ok = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('Infinity'))"
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(ok).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").alias("v"))


def _blocks(rows: DataFrame, shape: tuple[int, int, int], c: Codes, wide: bool) -> DataFrame:
    """(block, vec_id, label, v): the vectors of a batch as one row. A block is named by its first row, so a task that runs again makes the same blocks."""
    parts, width, _ = shape
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(n, T.ArrayType(rows.schema[n].dataType)) for n in ("vec_id", "label")], T.StructField("v", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            flat, n = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            x = np.zeros((b.num_rows, parts * width))
            x[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
            x = np.floor(x * c.scale)
            one = [pa.array([b.column(k).to_pylist()], arrow.field(k).type) for k in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([b.column("row")[:1], *one, pa.array([x.astype(np.float64 if wide else np.int32).tobytes()], pa.binary())], schema=arrow)
        give_back()

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, schema)


class Tables:
    """Two tables with the same buckets: ``vectors`` and, for each round, ``heaps``."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.name, self.made = spark, buckets, f"codes_{uuid.uuid4().hex}", []

    def write(self, df: DataFrame, what: str) -> DataFrame:
        table = f"{self.name}_{what}"
        dealt = df.repartition(self.buckets, "block") if what == "vectors" else df
        dealt.write.bucketBy(self.buckets, "block").sortBy("block").option("path", scratch(self.spark, table)).option("compression", "zstd").saveAsTable(table)
        self.made.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        """The names go; files stay in the scratch folder, for results that are read later."""
        for table in self.made:
            self.spark.sql(f"drop table if exists {table}")


def compressed(vectors: DataFrame, c: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each row of ``vectors`` that is kept.

    Vectors (vec_id, embedding, label) that are null or hold null or non-finite components are dropped. Components
    become floor(scale * x); vectors shorter than the longest, or than a multiple of ``parts``, count as
    filled with zeros. Codebooks start from the ``entries`` smallest vec_ids (null last, ties by the vector), or from all
    rows where there are fewer. Repeated rows count each. Errors beyond a long are given as the largest
    long. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(kept(vectors), "codes")
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    n, longest, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(largest)).first()
    if not n:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-longest // c.parts))
    top = top * c.scale + 1
    wide = top >= 2.0**29 / max(1.0, width**0.5)  # squares and their sums stay within 63 bits below
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v", "row").limit(c.entries).select("v").collect()
    start = np.zeros((len(first), c.parts * width))
    for i, r in enumerate(first):
        start[i, : len(r.v)] = r.v
    entries = len(first)
    shape = (c.parts, width, entries)
    books = Books(whole(np.floor(start * c.scale), wide).reshape(entries, c.parts, width).transpose(1, 0, 2), np.zeros((c.parts, entries)))
    margin = 1e-9 + 1e-12 * top * width**0.5
    count = 2 + int(np.log2(top) + 24) // LIMB
    tables = Tables(spark, max(1, min(10_000, -(-n // c.bucket))))
    try:
        blocks = tables.write(_blocks(rows, shape, c, wide), "vectors")
        state = None
        sums, counts = np.zeros((c.parts, entries, width), object), np.zeros((c.parts, entries), object)
        for number in range(c.rounds):
            state = tables.write(_round(blocks, state, shape, books, margin, wide, count), f"round{number}")
            found = {r.at: r.total for r in state.select(F.posexplode("deltas").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("total")).collect()}
            flat = np.array([sum(int(found[i * count + k]) << (LIMB * k) for k in range(count)) for i in range(c.parts * entries * (width + 1))], object).reshape(c.parts, entries, width + 1)
            sums, counts = sums + flat[..., :width], counts + flat[..., width]
            books = books.moved(sums, counts)
        digest = hashlib.sha256(",".join(str(int(x)) for x in books.values.ravel()).encode()).hexdigest()
        coded = cut(_coded(blocks, state, shape, books, margin, wide, rows.schema["label"].dataType), "coded")
    finally:
        tables.drop()
    label = F.struct(F.col("label").isNull().alias("none"), "label")
    coded = coded.withColumn("__label", F.xxhash64(label))
    by = coded.groupBy("__label", "label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    by = cut(by.withColumn("label_error", F.least(F.col("total"), F.lit(LONG)).cast("long")).withColumnRenamed("label", "of"), "label-errors")
    hot = by.groupBy("__label").agg(F.sum("n").alias("n"))
    out = join_hot(coded, by.drop("total", "n"), "__label", "vec_id", hot).where("label <=> of")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _with_state(blocks: DataFrame, state: DataFrame | None, columns: list[str]) -> DataFrame:
    if state is None:
        return blocks.select("block", *columns, F.lit(None).cast("binary").alias("heaps"))
    return blocks.select("block", *columns).hint("merge").join(state.select("block", "heaps"), "block")


def _advanced(v: bytes, data: bytes | None, shape: tuple[int, int, int], books: Books, margin: float, wide: bool) -> tuple[np.ndarray, list[Heaps], list[tuple]]:
    """A block's vectors (n, parts, width), its heaps after a scan of what they give up, and (part numbers, old entries or None, new entries) of each position."""
    parts, width, entries = shape
    x = whole(np.frombuffer(v, np.float64), True) if wide else np.frombuffer(v, np.int32).astype(np.int64)
    x = x.reshape(-1, parts, width)
    n, step = len(x), 4 * entries + 8 * len(x)
    heaps, moves = [], []
    for p in range(parts):
        heap = Heaps.unread(n, entries) if data is None else Heaps.frombytes(data[p * step : (p + 1) * step], n, entries)
        popped, old = heap.pop(books.used[p] + margin)
        entry, slack = scanned(x[popped, p], books.values[p])
        heap.push(popped, entry, below(slack + books.used[p][entry]))
        heaps.append(heap)
        moves.append((popped, None if data is None else old, entry))
    return x, heaps, moves


def _round(blocks: DataFrame, state: DataFrame | None, shape: tuple[int, int, int], books: Books, margin: float, wide: bool, count: int) -> DataFrame:
    """(block, heaps, deltas, popped): the heaps after a scan with ``books``, what it changed in the sums, and how many parts it scanned."""
    parts, width, entries = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, v, data in zip(b.column("block"), b.column("v"), b.column("heaps"), strict=True):
                x, heaps, moves = _advanced(v.as_py(), data.as_py(), shape, books, margin, wide)
                deltas = np.zeros((parts, entries, width + 1), object)
                for p, (popped, old, new) in enumerate(moves):
                    changed = np.ones(len(popped), bool) if old is None else old != new
                    rows = x[popped[changed], p]
                    for sign, entry in ((1, new[changed]), *([] if old is None else [(-1, old[changed])])):
                        for e in np.unique(entry):
                            deltas[p, e, :width] += sign * rows[entry == e].sum(0)
                            deltas[p, e, width] += sign * int((entry == e).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()]), pa.array([b"".join(h.tobytes() for h in heaps)], pa.binary()), pa.array([limbs(deltas, count)], pa.list_(pa.int64())), pa.array([sum(len(m[0]) for m in moves)])],
                    names=["block", "heaps", "deltas", "popped"],
                )
        give_back()

    return _with_state(blocks, state, ["v"]).mapInArrow(run, "block long, heaps binary, deltas array<long>, popped long")


def _coded(blocks: DataFrame, state: DataFrame | None, shape: tuple[int, int, int], books: Books, margin: float, wide: bool, label: T.DataType) -> DataFrame:
    """vec_id, label, code, error by a last scan."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (v, data) in enumerate(zip(b.column("v"), b.column("heaps"), strict=True)):
                x, heaps, _ = _advanced(v.as_py(), data.as_py(), shape, books, margin, wide)
                entry = np.stack([h.entry() for h in heaps], 1)
                near = np.stack([books.values[p][entry[:, p]] for p in range(shape[0])], 1)
                error = [min(LONG, int(e)) for e in ((x - near) ** 2).sum(2).sum(1)]
                code = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id")[i].values, b.column("label")[i].values.cast(arrow.field("label").type), pa.array(code), pa.array(error, pa.int64())], schema=arrow)
        give_back()

    return _with_state(blocks, state, ["vec_id", "label", "v"]).mapInArrow(run, schema)
