"""Resumable row-wise batch transforms of tabular datasets on Spark."""

from rowmill.operators.transform import RowJob
from rowmill.plans.run import OutputMode, run, run_sharded

__all__ = ["OutputMode", "RowJob", "run", "run_sharded"]
