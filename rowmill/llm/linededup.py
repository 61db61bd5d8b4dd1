"""Line dedup with content-defined chunks of lines.

A rolling hash over the hashes of ``window`` neighbouring non-blank lines chooses chunk boundaries, so lines
put in or taken out shift only the chunks around them; blank lines go with the chunk before them. Chunks of two or more non-blank lines that occur
more than once in all documents are removed but for their first occurrence (smallest doc_id, then
place), after their bytes, up to the last non-blank line, were compared with that occurrence's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rowmill.llm.shared import cut, each_batch, gram_hashes, join_hot, map_batches, utf8

WHERE = "doc_id long, mark long"


def chunks(lines: list[bytes], window: int = 2, modulus: int = 2, least: int = 2) -> list[tuple[int, int]]:
    """Line ranges [from, to). A boundary needs ``least`` non-blank lines before it and a rolling hash of such divisible by ``modulus``; blank lines before all others stand alone."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(lines[i]) for i in at), np.uint64, len(at))
    ends = np.flatnonzero(gram_hashes(hashes, window) % np.uint64(modulus) == 0) + window
    starts, start = [0] if lines else [], 0
    if at and at[0]:
        starts.append(at[0])
    for end in ends.tolist():
        if end - start >= least and end < len(at):
            starts.append(at[end])
            start = end
    return list(zip(starts, [*starts[1:], len(lines)], strict=False))


def repeated(lines: list[bytes]) -> list[tuple[int, int, bytes]]:
    """The chunks that may be removed, those with two non-blank lines at least, and their bytes up to the last of these."""
    found = []
    for a, b in chunks(lines):
        text = [i for i in range(a, b) if lines[i].strip()]
        if len(text) >= 2:
            found.append((a, b, b"\n".join(lines[a : text[-1] + 1])))
    return found


def _profile(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, counts, shas, lists = [], [], [], []
        for text in utf8(batch.column("text")):
            text = text or b""
            lines = text.split(b"\n") if text else []
            marks.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            counts.append(len(lines))
            shas.append(hashlib.sha256(text).hexdigest())
            lists.append([{"at": a, "hash": xxhash.xxh3_128_digest(x)} for a, _, x in repeated(lines)])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.binary())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(marks, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(lists, kind)], names=["doc_id", "mark", "n_lines", "sha", "chunks"])

    return map_batches(docs.select("doc_id", "text"), run, WHERE + ", n_lines long, sha string, chunks array<struct<at: int, hash: binary>>")


def _marked(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [xxhash.xxh3_64_intdigest(x or b"") - (1 << 63) for x in utf8(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text"), pa.array(marks, pa.int64())], names=["doc_id", "text", "mark"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, text string, mark long")


def _changes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, mark, gone, sha, text) of the texts that lose chunks."""
    places = rows.select("doc_id", "mark", F.explode("chunks").alias("c")).select("doc_id", "mark", "c.at", "c.hash")
    order = F.struct(F.expr("doc_id is null").alias("none"), "doc_id", "mark", "at")
    twice = cut(places.groupBy("hash").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1"), "lines-twice")
    often = twice.select("hash", "n")
    wanted = join_hot(places, twice.select("hash", "first"), "hash", "mark", often).withColumn("is_first", F.expr("first.doc_id <=> doc_id and first.mark = mark and first.at = at"))
    wanted = wanted.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("all"), F.collect_set(F.when(F.col("is_first"), F.col("at"))).alias("firsts"))
    wanted = wanted.withColumnsRenamed({"doc_id": "d", "mark": "m"})
    texts = _marked(docs).join(wanted, F.expr("doc_id <=> d and mark = m")).drop("d", "m")
    texts = cut(texts, "lines-texts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, place, first, hashes, body = [], [], [], [], []
        for i, (text, every, firsts) in enumerate(zip(utf8(batch.column("text")), batch.column("all").to_pylist(), batch.column("firsts").to_pylist(), strict=True)):
            every, firsts = set(every), set(firsts)
            for a, _, x in repeated(text.split(b"\n")):
                if a in every:
                    at.append(i)
                    place.append(a)
                    first.append(a in firsts)
                    hashes.append(xxhash.xxh3_128_digest(x))
                    body.append(x)
        rows_at = pa.array(at, pa.int64())
        cols = [batch.column("doc_id").take(rows_at), batch.column("mark").take(rows_at), pa.array(place, pa.int32()), pa.array(first, pa.bool_()), pa.array(hashes, pa.binary()), pa.array(body, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "at", "is_first", "hash", "body"])

    bodies = map_batches(texts, run, WHERE + ", at int, is_first boolean, hash binary, body binary")
    firsts = bodies.where("is_first").groupBy("hash").agg(F.first("body").alias("kept_body"))
    same = join_hot(bodies.where("not is_first"), firsts, "hash", "mark", often).where("body = kept_body")
    gone = same.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone")).withColumnsRenamed({"doc_id": "d", "mark": "m"})

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, out = [], [], []
        for text, drop in zip(utf8(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            lines, drop = text.split(b"\n"), set(drop)
            kept = [x for a, b in chunks(lines) if a not in drop for x in lines[a:b]]
            text = b"\n".join(kept)
            counts.append(len(lines) - len(kept))
            shas.append(hashlib.sha256(text).hexdigest())
            out.append(text.decode())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(out, pa.string())], names=["d", "m", "n_removed", "new_sha", "new_text"])

    # of rows that repeat id and text, the first is changed so
    source = texts.select("doc_id", "mark", "text").dropDuplicates(["doc_id", "mark"])
    changed = source.join(gone, F.expr("doc_id <=> d and mark = m")).select("doc_id", "mark", "text", "gone")
    return map_batches(changed, cut_out, "d long, m long, n_removed long, new_sha string, new_text string")


def _copies(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(d, m, first, n_again, again_sha, again_text): what rows that repeat id and text become, but for the one at ``first``; None where there are none.

    Each of their chunks occurs in that one too, so they lose all that can be removed.
    """
    twice = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    twice = cut(twice.selectExpr("doc_id as d", "mark as m", "first"), "lines-copies")
    if twice.isEmpty():
        return None
    # one text of each: the first row's, found by its place
    texts = _placed(docs).join(twice.select("d", "m", F.col("first")), F.expr("doc_id <=> d and mark = m and row = first"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, out = [], [], []
        for text in utf8(batch.column("text")):
            lines = (text or b"").split(b"\n") if text else []
            drop = {a for a, _, _ in repeated(lines)}
            kept = [x for a, b in chunks(lines) if a not in drop for x in lines[a:b]]
            left = b"\n".join(kept)
            counts.append(len(lines) - len(kept))
            shas.append(hashlib.sha256(left).hexdigest())
            out.append(left.decode())
        names = ["d", "m", "first", "n_again", "again_sha", "again_text"]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], pa.array(counts, pa.int64()), pa.array(shas), pa.array(out, pa.string())], names=names)

    return map_batches(texts.select("d", "m", "first", "text"), run, "d long, m long, first long, n_again long, again_sha string, again_text string")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text, row: as ``_marked``, with the place of each row."""
    return _marked(docs).withColumn("row", F.monotonically_increasing_id())


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for every row of ``docs`` (doc_id and text are read).

    A null or empty text has no lines. Of rows that repeat both id and text the one that comes first in
    ``docs`` is the first occurrence and the others lose what it has; so ``docs`` should be a table that is read the same
    way again (files, not a shuffle). A null doc_id comes after all others. Nothing is removed from the first occurrence, so of equal
    texts one stays whole.
    """
    rows = cut(_profile(docs).withColumn("row", F.monotonically_increasing_id()), "lines")
    changed = _changes(docs, rows).drop("new_text")
    out = rows.select("doc_id", "mark", "row", "n_lines", "sha").join(changed, F.expr("doc_id <=> d and mark = m"), "left").drop("d", "m")
    n, sha = F.coalesce("n_removed", F.lit(0)), F.coalesce("new_sha", "sha")
    if (copies := _copies(docs, rows)) is not None:
        out = out.join(copies.drop("again_text"), F.expr("doc_id <=> d and mark = m"), "left")
        n, sha = F.when(F.col("row") != F.col("first"), F.col("n_again")).otherwise(n), F.when(F.col("row") != F.col("first"), F.col("again_sha")).otherwise(sha)
    return out.select("doc_id", "n_lines", n.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``; every row and column stays, ``n_chars`` is set anew where it changed. Rows are those of ``dedup_lines``."""
    rows = cut(_profile(docs).withColumn("row", F.monotonically_increasing_id()), "lines")
    changed = cut(_changes(docs, rows).selectExpr("d as __line_d", "m as __line_m", "new_text as __line_text"), "lines-changed")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [xxhash.xxh3_64_intdigest(x or b"") - (1 << 63) for x in utf8(batch.column("text"))]
        return batch.append_column("__line_mark", pa.array(marks, pa.int64()))

    schema = StructType([*docs.schema.fields, StructField("__line_mark", LongType())])
    out = docs.mapInArrow(each_batch(run), schema).withColumn("__line_row", F.monotonically_increasing_id())
    out = out.join(changed, F.expr("doc_id <=> __line_d and __line_mark = __line_m"), "left")
    new = F.col("__line_text")
    if (copies := _copies(docs, rows)) is not None:
        copies = cut(copies.selectExpr("d as __copy_d", "m as __copy_m", "first as __copy_first", "n_again as __copy_n", "again_text as __copy_text"), "lines-copied")
        out = out.join(copies, F.expr("doc_id <=> __copy_d and __line_mark = __copy_m"), "left")
        new = F.when(F.col("__line_row") != F.col("__copy_first"), F.when(F.col("__copy_n") > 0, F.col("__copy_text"))).otherwise(new)
    out = out.withColumn("__line_new", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__line_new").isNull(), F.col("n_chars")).otherwise(F.length("__line_new").cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.coalesce("__line_new", "text")).select(*docs.columns)
