"""Exact top-k inner products with a pivot-distance index.

Inner products become distances by one more coordinate (the root of the largest squared norm minus
the own one), so a larger score is a smaller distance. Vectors are keyed by nearest pivot and
distance to it; rings of a pivot are sorted annuli. A query visits annuli in the order of their
triangle-inequality bounds: the best one, then the next few, then many more at a time, and stops as
soon as its k-th best score so far rules out all that are left. Inside an annulus rows are sorted by
distance to the pivot; those around the query's own distance come first, and the score reached there
narrows the distances that are read at all.

Pivots are fitted on a bounded sample (``sample`` rows at most); every vector is indexed, and rings
are split into cells of about ``cell`` rows, so a very common vector cannot fill one task. Scores are
exact integers: doubles are used only where every partial sum has less than 53 bits, else 64-bit
integers, else integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.llm.shared import cut


LONG = (1 << 63) - 1


@dataclass(frozen=True)
class PivotIndex:
    k: int = 10
    pivots: int = 16
    rings: int = 4
    sample: int = 4096
    cell: int = 20_000
    queries: int = 2_000


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components times ``scale``, floored (beyond a long: the nearest long). Null vectors and those with null or non-finite parts are left out."""
    ok = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return vectors.where(ok).select("vec_id", F.expr(f"transform(embedding, x -> double(floor({scale} * double(x))))").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as a matrix; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(column.offsets.to_numpy()))
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))


def distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.column_stack([x, last])
    d2 = (full * full).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(0.0, d2))


def products(q: np.ndarray, base: np.ndarray, top: float) -> np.ndarray:
    """q @ base.T in exact integers; ``top`` bounds all squared norms, those of queries too, and so every partial sum."""
    if top < 2.0**52:
        return (q @ base.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ base.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)
    return whole(q) @ whole(base).T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def nearest_first(q: np.ndarray, d: np.ndarray, own: np.ndarray, floor: np.ndarray, base: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int, top: float, most: float, near: int = 2048) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, scores) of each query's best rows of a cell, which is sorted by ``r``, of scores from ``floor`` on.

    d: the queries' distances to the pivot; top: the largest squared norm of the rows, most: of rows and queries. The ``near`` rows around them are read first; the floors they
    give bound the distances of all other rows that can still count.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    q2 = (q * q).sum(1)
    slack = 1e-6 * (1 + d) + 1e-6 * np.sqrt(q2 + top)
    order = np.argsort(d, kind="stable")
    for start in range(0, len(q), 64):
        some = order[start : start + 64]
        a = max(0, min(int(np.searchsorted(r, np.median(d[some]))) - near // 2, len(r) - near))
        b = min(len(r), a + near)
        spans, got = [(a, b)], [products(q[some], base[a:b], most)]
        bars = []
        for i, row in zip(some.tolist(), got[0], strict=True):
            row = row[ids[a:b] != own[i]]
            bar = int(np.partition(row, len(row) - k)[len(row) - k]) if len(row) >= k else int(floor[i])
            bars.append(max(int(floor[i]), bar))
        reach = np.sqrt(np.maximum(0.0, q2[some] + top - 2 * np.array(bars, float))) + slack[some]
        lo, hi = np.searchsorted(r, d[some] - reach, "left").min(), np.searchsorted(r, d[some] + reach, "right").max()
        for x, y in ((lo, a), (b, hi)):
            if x < y:
                spans.append((x, y))
                got.append(products(q[some], base[x:y], most))
        at, block = np.concatenate([np.arange(x, y) for x, y in spans]), np.concatenate(got, 1)
        for i, row, bar in zip(some.tolist(), block, bars, strict=True):
            good = np.flatnonzero((row >= bar) & (ids[at] != own[i]))
            good = good[best(ids[at[good]], row[good], k)]
            out[i] = at[good], row[good]
    return out


def search(queries: DataFrame, vectors: DataFrame, index: PivotIndex = PivotIndex()) -> DataFrame:
    """queries, vectors (vec_id long, v array<double> of integers) -> query_id, rank, vec_id, score.

    Queries need not be among the vectors. A query's own row (equal vec_id) is no candidate. Vectors of unequal
    length, queries longer than all vectors too, count as filled with zeros. Rows that repeat an id and vector are candidates each on their own, a repeated query is
    asked once, and two vectors of one query_id have a list each. Scores beyond a long are ranked
    exactly (up to 38 digits) and given as the nearest long. Empty tables give an empty result.
    """
    spark, k = vectors.sparkSession, index.k
    schema = "query_id long, rank int, vec_id long, score long"
    size = [F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")), F.count("*")]
    shape, of_queries = vectors.agg(*size).first(), queries.agg(*size).first()
    if not shape[2] or not of_queries[2]:
        return spark.createDataFrame([], schema)
    width, top = max(shape[0], of_queries[0]), shape[1]
    most = max(top, of_queries[1])  # an inner product is no larger than the product of two norms
    kind, arrow, lowest = ("long", pa.int64(), -(1 << 62)) if most < 2.0**62 else ("decimal(38,0)", pa.decimal128(38), 1 - 10**38)
    lowest_column = F.lit(str(lowest)).cast(kind)
    picked = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(index.sample).select("v").toArrow()
    known = matrix(picked["v"], width)
    known_last = lifted(known, top)
    chosen = [0]
    full = np.column_stack([known, known_last])
    gap = ((full - full[0]) ** 2).sum(1)
    while len(chosen) < min(index.pivots, len(full)) and gap.max() > 0:  # farthest first
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((full - full[chosen[-1]]) ** 2).sum(1))
    pivots = full[chosen]
    near = distances(known, known_last, pivots)
    own = near.argmin(1)
    edges = np.stack([np.quantile(near[own == p, p], np.linspace(0, 1, index.rings + 1)[1:-1]) for p in range(len(pivots))])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), width)
            d = distances(x, lifted(x, top), pivots)
            p = d.argmin(1)
            r = d[np.arange(len(p)), p]
            ring = (r[:, None] >= edges[p]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(p.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(r)], names=["vec_id", "v", "pivot", "ring", "r"])

    data = cut(vectors.mapInArrow(keyed, "vec_id long, v array<double>, pivot int, ring int, r double"), "pivots")
    annuli = data.groupBy("pivot", "ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"))
    annuli = sorted(map(tuple, annuli.collect()))  # at most pivots * rings rows
    cells = [max(1, -(-a[4] // index.cell)) for a in annuli]
    grid = spark.createDataFrame([(a[0], a[1], c) for a, c in zip(annuli, cells, strict=True)], "pivot int, ring int, cells int")
    data = data.join(F.broadcast(grid), ["pivot", "ring"]).withColumn("cell", F.expr("cast(pmod(xxhash64(vec_id, r), cells) as int)")).drop("cells")
    pivot_of, cells_of = np.array([a[0] for a in annuli]), np.array(cells)
    low, high = np.array([a[2] for a in annuli]), np.array([a[3] for a in annuli])

    def spread(df: DataFrame, done: int, take: int) -> DataFrame:
        """Each query to the annuli at places done to done + take - 1 of its order, but for those its floor rules out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column("v"), width)
                q2 = (x * x).sum(1)
                d = distances(x, np.zeros(len(x)), pivots)[:, pivot_of]  # a query's own last coordinate is 0
                gap = np.maximum(0.0, np.maximum(d - high, low - d) - 1e-6 * (1 + d))
                bound = (q2[:, None] + top - gap * gap) / 2
                bound += 1e-3 + 1e-9 * (np.abs(bound) + top)
                order = np.argsort(-bound, 1, kind="stable")[:, done : done + take]
                floor = b.column("floor").to_numpy(zero_copy_only=False)
                at, place = np.nonzero(np.take_along_axis(bound, order, 1) >= floor[:, None].astype(float))
                which = order[at, place]
                cell = np.concatenate([np.arange(n) for n in cells_of[which]]) if len(which) else np.empty(0, np.int64)
                at, which = np.repeat(at, cells_of[which]), np.repeat(which, cells_of[which])
                keys = np.array([annuli[j][:2] for j in which], np.int32).reshape(-1, 2)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(rows) for c in ("query_id", "mark", "v", "floor")], pa.array(d[at, which]), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(cell.astype(np.int32))],
                    names=["query_id", "mark", "v", "floor", "d", "pivot", "ring", "cell"],
                )

        return df.mapInArrow(run, f"query_id long, mark long, v array<double>, floor {kind}, d double, pivot int, ring int, cell int")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("r", "ascending"), ("vec_id", "ascending")])
        ids, base, r = right["vec_id"].to_numpy(), matrix(right["v"], width), right["r"].to_numpy()
        qid, mark = left["query_id"].to_numpy(), left["mark"].to_numpy()
        found = nearest_first(matrix(left["v"], width), left["d"].to_numpy(), qid, left["floor"].to_numpy(), base, r, ids, k, top, most) if len(ids) and len(qid) else []
        n = [len(at) for at, _ in found]
        at = np.concatenate([at for at, _ in found]) if found else np.empty(0, np.int64)
        score = [max(lowest, min(-lowest, Decimal(int(x)))) if kind != "long" else int(x) for _, row in found for x in row]
        return pa.table({"query_id": np.repeat(qid[: len(n)], n), "mark": np.repeat(mark[: len(n)], n), "vec_id": ids[at], "score": pa.array(score, arrow)})

    def look(routed: DataFrame) -> DataFrame:
        """Only cells that are asked for move, and a cell asked by very many queries is copied for each ``index.queries`` of them."""
        keys = ["pivot", "ring", "cell"]
        parts = routed.groupBy(*keys).agg(F.ceil(F.count("*") / index.queries).cast("int").alias("parts"))
        a = routed.join(parts, keys).withColumn("part", F.expr("cast(pmod(xxhash64(query_id, mark), parts) as int)")).drop("parts")
        copies = parts.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "parts")])
        b = data.join(copies, [F.col(c) == F.col(f"_{c}") for c in keys]).withColumn("part", F.explode(F.expr("sequence(0, _parts - 1)")))
        b = b.select(*[F.col(c).alias(c) for c in (*keys, "part", "vec_id", "v", "r")])
        return a.groupBy(*keys, "part").cogroup(b.groupBy(*keys, "part")).applyInArrow(scored, f"query_id long, mark long, vec_id long, score {kind}")

    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    asked = cut(queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("mark"), "v").dropDuplicates(["query_id", "v"]), "asked")
    todo, found, done, take = asked.withColumn("floor", lowest_column), None, 0, 1
    while done < len(annuli):
        routed = cut(spread(todo, done, take), "routed")
        if routed.isEmpty():
            break
        got = look(routed)
        got = got if found is None else found.drop("rank").union(got)
        found = cut(got.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}"), "near")
        floors = found.groupBy("query_id", "mark").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest_column).alias("floor"))
        todo = asked.join(floors, ["query_id", "mark"], "left").withColumn("floor", F.coalesce("floor", lowest_column))
        todo = todo.select("query_id", "mark", "v", "floor")
        done, take = done + take, 4 * take
    if found is None:
        return spark.createDataFrame([], schema)
    score = F.greatest(F.lit(-LONG - 1), F.least(F.lit(LONG), F.col("score"))).cast("long")
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score"))
