"""Ranked lexical search in whole numbers over a table of postings.

``postings`` counts the terms of every text where it is read and writes them in term buckets; a term
that very many texts hold is dealt over slices of its bucket. ``search`` joins the asked terms with
their buckets, gives each match its whole-number score, deals the scored matches by document, and sums
them by item and document, where no further shuffle is needed. A window takes each item's best.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.llm.shared import cut, map_batches, utf8
from rowmill.sources.scratch import scratch

#: ASCII letters and digits, and every sign beyond ASCII, whose UTF-8 bytes are all above 0x7F.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bucket of the rows that tell the documents' lengths.
LENGTHS = -1
BUCKETS = 64
#: Documents a slice of a term's bucket; rows of a table that is broadcast at most.
SLICE, BROADCAST = 1_000_000, 500_000


def terms_of(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with n (all terms of the text), terms and counts (its distinct terms) in place of ``text``."""
    names = [c for c in rows.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, terms, counts = [], [], []
        for body in utf8(batch.column(text)):
            found = Counter(TERM.findall((body or b"").lower()))
            n.append(found.total())
            terms.append([t.decode() for t in found])
            counts.append(list(found.values()))
        made = [pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], names=[*names, "n", "terms", "counts"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return map_batches(rows, run, f"{kept}, n long, terms array<string>, counts array<long>")


def bounded(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def postings(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """bucket, term, row, doc_id, n, tf: one row for each document and term, and one with a null term for each document, in bucket ``LENGTHS``.

    Written in term buckets. ``only`` (term): the terms that are kept; all by default. ``row`` tells rows of
    ``docs`` apart, so ``docs`` should be a table that is read the same way again (files, not a shuffle).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    made = terms_of(rows)
    every = made.select("row", "doc_id", "n", F.explode(F.expr("concat(array(struct(string(null) as term, 0L as tf)), transform(arrays_zip(terms, counts), p -> struct(p.terms as term, p.counts as tf)))")).alias("p"))
    every = every.select("row", "doc_id", "n", "p.term", "p.tf")
    if only is not None:
        some = bounded(only.select("term", F.lit(True).alias("__asked")))
        every = every.join(some, "term", "left").where("term is null or __asked").drop("__asked")
    slices = max(1, -(-docs.count() // SLICE))
    every = every.withColumn("bucket", F.when(F.col("term").isNull(), LENGTHS).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int"))
    every = every.repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(slices)))
    path = scratch(docs.sparkSession, "postings")
    every.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    schema = "term string, row long, doc_id long, n long, tf long, bucket int"
    return docs.sparkSession.read.schema(schema).parquet(path)


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest scores above 0 for each item.

    items (item_id, text), docs (doc_id, text). Texts that are null or hold no term match nothing. Items
    that repeat id and text are asked once; two texts of one item_id have a list each. Rows of ``docs``
    that repeat an id, or have none, are documents each on their own; equal scores go by ascending doc_id
    (null last). Other columns are not read. Empty tables give an empty result.
    """
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).dropDuplicates(["item_id", "text"])
    asked = cut(terms_of(asked.withColumn("item", F.monotonically_increasing_id())), "items")
    pairs = cut(asked.select("item", "item_id", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("item", "item_id", F.col("p.terms").alias("term"), F.col("p.counts").alias("times")), "asked")
    terms = pairs.select("term").distinct()
    index = postings(docs, terms)
    size = index.where(F.col("bucket") == LENGTHS).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n_docs, total, longest = size
    empty = docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    if not n_docs:
        return empty
    wide = 75 * longest * n_docs >= 1 << 63  # beyond a long only while it is divided
    m = F.expr(f"100 - 75 + cast((cast({75 * n_docs} as decimal(20,0)) * n) div {total} as bigint)" if wide else f"100 - 75 + ({75 * n_docs}L * n) div {total}L")
    held = index.where(F.col("bucket") != LENGTHS)
    weights = held.groupBy("bucket", "term").agg(F.count("*").alias("df")).select("bucket", "term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w"))
    found = held.join(bounded(cut(weights, "weights")), ["bucket", "term"]).withColumn("m", m)
    found = found.select("row", "doc_id", "term", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("s")).where("s > 0")
    return _best(found, pairs, k)


def _best(scored: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Items are taken in blocks whose pairs can be broadcast; each block's sums need no shuffle but that of its best rows."""
    blocks = max(1, -(-pairs.count() // BROADCAST))
    scored = cut(scored, "scored") if blocks > 1 else scored
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    out = None
    for i in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        dealt = scored.repartition("row")
        sums = dealt.join(bounded(some), "term").groupBy("row", "doc_id", "item", "item_id").agg(F.sum(F.col("s") * F.col("times")).alias("score"))
        best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
