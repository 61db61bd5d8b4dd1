"""A run from the command line: ``python -m rowmill INPUT OUTPUT --job module:Class``, or the same under ``spark-submit``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from rowmill.operators.specs import checkpoint_folder, load_job, settings_of
from rowmill.plans.run import OutputMode, run, run_sharded
from rowmill.sources.files import full_path, read_dataset, write_dataset
from rowmill.sources.scratch import shared_folder


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("rowmill", description="Transform a column of a dataset row by row, and go on where an earlier run stopped.")
    p.add_argument("input", help="a folder, a file, or a pattern with {a..b} or globs")
    p.add_argument("output", help="a folder, or a path that ends in .parquet, .csv or .jsonl")
    p.add_argument("--job", required=True, metavar="MODULE:CLASS")
    p.add_argument("--settings", metavar="JSON", help="arguments of the job")
    p.add_argument("--input-column", help="the column that the job reads; wins over --settings")
    p.add_argument("--id", dest="id_column")
    p.add_argument("--mode", choices=[m.value for m in OutputMode], default=OutputMode.APPEND.value)
    p.add_argument("--limit", type=int, help="only the first rows, in file order")
    p.add_argument("--checkpoints", metavar="FOLDER", help="where outputs are kept; by default below spark.checkpoint.dir")
    p.add_argument("--tag", help="name of the checkpoint; by default it belongs to the input's bytes and the output")
    p.add_argument("--identity", choices=("content", "footers"), default="content", help="know the input by all its bytes, or by its files' lengths and last bytes")
    p.add_argument("--no-resume", action="store_true", help="begin a fresh checkpoint")
    p.add_argument("--no-checkpoint", action="store_true")
    p.add_argument("--flush-every", type=int, default=10_000, metavar="ROWS")
    p.add_argument("--once", action="store_true", help="rows that repeat an id are transformed once")
    p.add_argument("--strict", action="store_true", help="ids must be unique and the input that of the checkpoint")
    p.add_argument("--sort", action="store_true", help="order the output by id")
    p.add_argument("--single", action="store_true", help="write one file")
    p.add_argument("--shards", type=int, default=1)
    p.add_argument("--shard-mode", choices=("id", "index"), default="id")
    p.add_argument("--backend", help="accepted for scripts that name an engine; all known names mean this one")
    p.add_argument("--read-options", metavar="JSON")
    p.add_argument("--write-options", metavar="JSON")
    return p


def main(argv: Sequence[str] | None = None) -> str | None:
    """Run and write; gives the checkpoint's folder, or nothing without one."""
    p = arguments()
    a = p.parse_args(argv)
    if a.shards > 1 and (a.no_checkpoint or a.single or a.sort):
        p.error("--shards goes with a checkpoint, and not with --single or --sort")
    if a.no_checkpoint and a.strict:
        p.error("--strict needs a checkpoint")
    spark = SparkSession.builder.appName("rowmill").getOrCreate()
    job = load_job(a.job, a.settings)
    if a.input_column:
        job.input_column = a.input_column
    base = full_path(a.checkpoints) if a.checkpoints else f"{shared_folder(spark)}/rowmill-runs"
    folder = checkpoint_folder(spark, base, job, a.input, a.output, a.tag, resume=not a.no_resume, keep=not a.no_checkpoint, footers=a.identity == "footers")
    df = read_dataset(spark, a.input, a.limit, **settings_of(a.read_options))
    options = settings_of(a.write_options)
    if a.shards > 1:
        run_sharded(df, job, a.id_column, a.mode, folder, a.shards, a.shard_mode, output=full_path(a.output), flush_every=a.flush_every, strict=a.strict, once=a.once)
    else:
        out = run(df, job, a.id_column, a.mode, folder, flush_every=a.flush_every, strict=a.strict, sort=a.sort, once=a.once, backend=a.backend)
        write_dataset(out, a.output, single=a.single, **options)
    return folder


if __name__ == "__main__":
    main()
