"""Row ids, hash shards and index shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.sources.scratch import written

ALIASES = ("__index_level_0__", "index", "level_0")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def indexed(df: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
    """``dense_index`` and the number of rows.

    Sorted rows are written once, each with its part and its place in that part, and everything is
    read from what was written: a second evaluation of the sort would cut the parts elsewhere. No
    single task numbers all rows; what is joined back has one row a part.
    """
    mono, part = free_name(df, "_mono"), free_name(df, "_part")
    rows = (df.orderBy(*order) if order else df).withColumn(mono, F.monotonically_increasing_id())
    rows = written(rows, "index")
    rows = rows.withColumn(part, F.shiftright(mono, 33))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"), F.min(mono).alias("low")).orderBy(part).collect()  # a row a part
    before, table = 0, []
    for r in sizes:
        table.append((r[0], before - r["low"]))
        before += r["n"]
    shift, key = free_name(df, "_shift"), free_name(df, "_part_key")
    table = df.sparkSession.createDataFrame(table, f"`{key}` long, `{shift}` long")
    out = rows.join(F.broadcast(table), F.col(part) == F.col(key)).withColumn(name, F.col(mono) + F.col(shift))
    return out.select(name, *df.columns), before


def dense_index(df: DataFrame, name: str, *order: str) -> DataFrame:
    """0-based index without gaps, in the given order or in that of the input's parts."""
    return indexed(df, name, *order)[0]


def ensure_id(df: DataFrame, id_column: str | None = None, default: str = "_row_id", order: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``df`` with an id column, and its name. A named column must exist; legacy index columns are renamed."""
    if id_column is not None:
        if not isinstance(id_column, str) or not id_column.strip():
            raise ValueError("the id column's name must not be blank")
        if id_column not in df.columns:
            raise ValueError(f"id column {id_column!r} is not in the input")
        return df, id_column
    if default in df.columns:
        return df, default
    for alias in ALIASES:
        if alias in df.columns:
            return df.withColumnRenamed(alias, default), default
    return dense_index(df, default, *order), default


def shard_of(column: str | Column, n: int, compatible: bool = False) -> Column:
    """Shard number by id hash: ``xxhash64`` in the JVM, or the hash that ``pandas.util.hash_array`` gives."""
    if n <= 1:
        return F.lit(0)
    if not compatible:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    @F.pandas_udf("int")
    def hashed(ids: pd.Series) -> pd.Series:
        return pd.Series((pd.util.hash_array(ids.to_numpy()) % n).astype("int32"))

    return hashed(column)


def index_shards(df: DataFrame, order: str, n: int, name: str = "shard") -> DataFrame:
    """``n`` runs by order whose sizes differ by one at most, the longer first."""
    at = free_name(df, "_at")
    rows, total = indexed(df, at, order)
    q, r = divmod(total, n)
    cut = r * (q + 1)
    shard = F.expr(f"case when `{at}` < {cut} then `{at}` div {q + 1} else {r} + (`{at}` - {cut}) div {max(q, 1)} end")
    return rows.withColumn(name, shard.cast("int")).drop(at)


def ceil_chunks(df: DataFrame, order: str, n: int, name: str = "shard") -> DataFrame:
    """Runs of ceil(rows / n) rows by order; the last may be shorter, or missing."""
    at = free_name(df, "_at")
    rows, total = indexed(df, at, order)
    return rows.withColumn(name, F.expr(f"cast(`{at}` div {max(1, -(-total // n))} as int)")).drop(at)


def at_positions(df: DataFrame, positions: list[int], *order: str) -> DataFrame:
    """Rows by their place in the order (or in the input's parts)."""
    at, want = free_name(df, "_at"), free_name(df, "_want")
    wanted = df.sparkSession.createDataFrame([(int(p),) for p in positions], f"`{want}` long")
    return dense_index(df, at, *order).join(wanted, F.col(at) == F.col(want), "left_semi").drop(at)


def fingerprint(df: DataFrame, key: str, input_column: str) -> str:
    """A text that stands for the input's ids and values, the same for any order of rows, another where a row changes, goes, comes or repeats.

    The row count and the sums of two row hashes modulo 2^64; it aggregates before any shuffle.
    """
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(F.col(key).alias("k"), F.col(input_column).alias("v")))).cast("decimal(28,0)"))
    n, a, b = df.agg(F.count("*"), of(1), of(2)).first()
    return f"{n}-{int(a or 0) % (1 << 64):016x}{int(b or 0) % (1 << 64):016x}"


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> None:
    """Raises where an id occurs twice; one row at most reaches the driver."""
    twice = duplicates(df, key).limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0][0]!r} occurs {twice[0][1]} times in {key!r}")
