"""In-memory tables as input, the names of backends, batch sizes, and the columns of a table."""

from __future__ import annotations

from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Names under which other engines are known; all mean this one.
BACKENDS = ("spark", "pandas", "pd", "polars", "ray")


class BackendError(ValueError):
    """A backend that is not known, or an input that it cannot read."""


def backend(name: str | None = None) -> str:
    """``spark`` for every known name, in any case and with blanks around it, and for none."""
    found = (name or "spark").strip().lower()
    if found not in BACKENDS:
        raise BackendError(f"unknown backend {name!r}; known are {', '.join(BACKENDS)}")
    return "spark"


def as_table(data: Any, id_column: str | None = None, spark: SparkSession | None = None, default: str = "_row_id") -> tuple[DataFrame, str | None]:
    """(DataFrame, id column). A pandas table without an id column gets its index as one, under the index's name or ``default``."""
    if isinstance(data, DataFrame):
        return data, id_column
    spark = spark or SparkSession.getActiveSession()
    if isinstance(data, pd.DataFrame):
        if id_column is None and default not in data.columns:
            name = data.index.name if isinstance(data.index.name, str) and data.index.name not in data.columns else default
            return spark.createDataFrame(data.rename_axis(name).reset_index()), name
        return spark.createDataFrame(data), id_column
    if isinstance(data, pa.Table):
        return spark.createDataFrame(data), id_column
    raise BackendError(f"cannot read a table from {type(data).__name__}")


def columns_of(df: Any) -> dict[str, str]:
    """Column names and their types as text."""
    if isinstance(df, pa.Table):
        return {f.name: str(f.type) for f in df.schema}
    kinds = df.dtypes.items() if isinstance(df, pd.DataFrame) else df.dtypes
    return {name: str(kind) for name, kind in kinds}


def batch_size(asked: int | None = None, own: int | None = None, default: int = 1000) -> int:
    """The first that is given: the caller's, the job's own, the default."""
    found = next(x for x in (asked, own, default) if x is not None)
    if found < 1:
        raise ValueError("a batch holds at least one row")
    return found
