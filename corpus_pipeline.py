"""A training-data pipeline over ``documents``: every stage calls one operator of ``rowmill.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm import linededup, minhash, mixing, packing, toxicity
from rowmill.llm.queries import tokenizer_file
from rowmill.sources.scratch import scratch


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Null and empty texts are clean; repeated rows and equal texts go or stay together; texts of any length are scored whole; other columns, of any name and type, stay; an empty table stays empty."""
    return toxicity.keep_clean(docs, toxicity.read_labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut out; every document stays. Null and empty texts stay as they are; of rows that repeat id and text the first stays whole. Of equal chunks that of the smallest doc_id, then the earliest line, stays; texts may be of any length; only text and n_chars change, other columns stay."""
    return linededup.without_repeats(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8). Null texts and texts without words all stay; of repeated rows one does. The smallest doc_id stays, known before null; long texts count with all their shingles; all columns stay."""
    return minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target shares; a document may come twice, once or in part. Null texts and texts without words have nothing to give and go; a null source is a source of its own; repeated rows count each. A long text may come in part; reruns agree, ties in the draw go by row; all columns stay."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in their sequences, with their token ids. A null or empty text is one piece of one token; rows of one doc_id are packed apart. Equal lengths go by doc_id and start; a long text has a sequence for each 1024 tokens; other columns are not read."""
    return packing.pack(docs, tokenizer_file(), with_ids=True)


STAGES = [("toxicity", clean), ("line_dedup", lines), ("near_dedup", dedup), ("mixing", mixture), ("packing", packed)]

#: Trained scores, hash permutations and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
