"""Joins on ids (null equals null), output modes, and unions that keep types strict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.operators.ids import free_name, indexed
from rowmill.sources.scratch import written


def _keyed(right: DataFrame, key: str, left: DataFrame) -> tuple[DataFrame, str]:
    """``right`` with its key under a name that ``left`` does not have."""
    name = free_name(left, "_right_key")
    return right.withColumnRenamed(key, name), name


def _matching(df: DataFrame, other: DataFrame, key: str, how: str) -> DataFrame:
    ids, name = _keyed(other.select(key), key, df)
    return df.join(ids, F.expr(f"`{key}` <=> `{name}`"), how)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not done; no id list ever reaches the driver."""
    return _matching(df, done, key, "left_anti")


def pending_narrow(df: DataFrame, done: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """``pending`` for wide rows of which few are left: only ids are shuffled, and rows are picked where they lie.

    The ids left are written and counted; more than ``most`` of them (some 100 MB at a task) are not broadcast but joined by a
    shuffle. ``df`` is read twice, the first time its id column alone.
    """
    ids = written(pending(df.select(key).distinct(), done, key), "pending-ids")
    left, name = _keyed(ids, key, df)
    return df.join(F.broadcast(left) if ids.count() <= most else left, F.expr(f"`{key}` <=> `{name}`"), "left_semi")


def known(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return _matching(df, ids, key, "left_semi")


def stray(stored: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Stored rows whose id the input no longer has."""
    return pending(stored, df, key)


def attach(df: DataFrame, out: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Left join of outputs by id. Names on both sides get ``_x`` (input) and ``_y`` (output). With ``order`` the rows come sorted by these input columns."""
    both = [c for c in out.columns if c != key and c in df.columns]
    left = df.withColumnsRenamed({c: f"{c}_x" for c in both})
    right, name = _keyed(out.withColumnsRenamed({c: f"{c}_y" for c in both}), key, left)
    rows = left.join(right, F.expr(f"`{key}` <=> `{name}`"), "left").drop(name)
    return rows.orderBy(*[f"{c}_x" if c in both else c for c in order]) if order else rows


def side_by_side(left: DataFrame, right: DataFrame, left_order: tuple[str, ...] = (), right_order: tuple[str, ...] = ()) -> DataFrame:
    """Row n of one beside row n of the other, by their orders; both must have as many rows. Equal names get ``_x`` and ``_y``."""
    at = free_name(left, free_name(right, "_at"))
    (a, n), (b, m) = indexed(left, at, *left_order), indexed(right, at, *right_order)
    if n != m:
        raise ValueError(f"{n} rows cannot stand beside {m}")
    return attach(a, b, at, (at,)).drop(at)


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns become null, a void column takes the others' type, other type changes are errors."""
    kinds: dict[str, str] = {}
    for df in parts:
        for name, kind in df.dtypes:
            if kind != "void" and kinds.setdefault(name, kind) != kind:
                raise TypeError(f"column {name} is {kinds[name]} in one part and {kind} in another")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last written row of each id: largest ``order`` values win. Aggregates before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])
