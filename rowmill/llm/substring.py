"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``window - gram + 1`` neighbouring word grams the smallest hash is
picked, so two equal windows pick equal anchors. Every occurrence of a repeated anchor, with the words
of the windows that pick it, is joined with the anchor's earliest occurrence and extended word by word
to both sides; where the match is at least ``window`` words long, its words are marked. Marks that
touch or overlap form the maximal repeats, which are cut out. Windows around an anchor that occurs a
third time, and that do not agree with the earliest occurrence, are compared with each other by their
words, as an earlier copy may stand anywhere between; windows that repeat in their own text are found
there. Texts with equal word sequences are settled before, by the smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.shared import as_long, cut, gram_hashes, join_hot, map_batches, utf8, word_hashes

LAST = (1 << 63) - 1


def picked(grams: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` values the position of its smallest (the last of equal ones); positions never fall."""
    if len(grams) < span:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
    return (len(grams) - 1 - (view.argmin(1) + np.arange(len(view))))[::-1]


def covered(first: np.ndarray, last: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins between ``first`` and ``last``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + window, -1)
    return np.cumsum(step[:-1]) > 0


def runs(at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """(k, 2) places where runs of neighbouring ``at`` with equal ``of`` begin and end (inclusive)."""
    if not len(at):
        return np.empty((0, 2), np.int64)
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(of) != 0)) + 1
    return np.column_stack([np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]) - 1])


def _profile(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Of each text the anchors that it holds once (anchors) and more than once (twice)."""
    span = window - gram + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, counts, shas, anchors, twice = [], [], [], [], []
        for text in utf8(batch.column("text")):
            words = (text or b"").split()
            joined = b" ".join(words)
            digests.append(xxhash.xxh3_128_digest(joined))
            counts.append(len(words))
            shas.append(hashlib.sha256(joined).hexdigest())
            if len(words) < window:
                anchors.append(None)
                twice.append(None)
                continue
            grams = gram_hashes(word_hashes(words), gram)
            found, n = np.unique(grams[np.unique(picked(grams, span))], return_counts=True)
            anchors.append(as_long(found[n == 1]))
            twice.append(as_long(found[n > 1]))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(anchors, longs), pa.array(twice, longs)],
            names=["doc_id", "digest", "n_words", "sha", "anchors", "twice"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, digest binary, n_words long, sha string, anchors array<long>, twice array<long>")


def repeats_itself(words: list[bytes], hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which windows begin earlier in ``starts`` with the same words; equal hashes are confirmed on the words."""
    grams = gram_hashes(hashes, window)[starts]
    _, first, of = np.unique(grams, return_index=True, return_inverse=True)
    out = np.zeros(len(starts), bool)
    for i in np.flatnonzero(first[of] != np.arange(len(starts))):
        a, b = int(starts[first[of[i]]]), int(starts[i])
        out[i] = words[a : a + window] == words[b : b + window]
    return out


def _spots(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(node, at_doc, anchor, pos, lo, hi, body): where a repeated anchor stands, the windows that pick it and their words.

    A null anchor marks windows lo to hi as repeats in their own text.
    """
    span = window - gram + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, doc, anchor, place, low, high, body = [], [], [], [], [], [], []
        for k, doc_id, text, anchors in zip(batch.column("node").to_pylist(), batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("anchors"), strict=True):
            words = text.split()
            hashes = word_hashes(words)
            grams = as_long(gram_hashes(hashes, gram))
            pick = picked(grams.view(np.uint64), span)
            starts = np.flatnonzero(np.isin(grams[pick], np.asarray(anchors.values)))
            again = repeats_itself(words, hashes, starts, window)
            own, starts = starts[again], starts[~again]
            mine = runs(own, np.zeros(len(own)))
            spots = runs(starts, pick[starts])
            lo, hi = starts[spots[:, 0]], starts[spots[:, 1]]
            at = pick[lo]
            n = len(mine) + len(spots)
            node += [k] * n
            doc += [LAST if doc_id is None else doc_id] * n
            anchor += [None] * len(mine) + grams[at].tolist()
            place += [0] * len(mine) + at.tolist()
            low += own[mine[:, 0]].tolist() + lo.tolist()
            high += own[mine[:, 1]].tolist() + hi.tolist()
            body += [None] * len(mine) + [b" ".join(words[a : b + window]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        cols = [pa.array(x, kind) for x, kind in zip((node, doc, anchor, place, low, high, body), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["node", "at_doc", "anchor", "pos", "lo", "hi", "body"])

    return map_batches(texts, run, "node long, at_doc long, anchor long, pos int, lo int, hi int, body binary")


def extended(a: list[bytes], at: int, b: list[bytes], bt: int) -> tuple[int, int]:
    """The longest run of ``a`` around place ``at`` that equals ``b`` around ``bt``: [first, end); empty where not even the word there does."""
    left = right = 0
    while right < min(len(a) - at, len(b) - bt) and a[at + right] == b[bt + right]:
        right += 1
    while right and left < min(at, bt) and a[at - left - 1] == b[bt - left - 1]:
        left += 1
    return at - left, at + right


def _extend(pairs: DataFrame, window: int) -> DataFrame:
    """(node, at_doc, lo, hi, words): with null words a mark on windows lo to hi; else a window that does not agree with the earliest occurrence."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, doc, low, high, kept = [], [], [], [], []
        names = ("node", "at_doc", "pos", "lo", "hi", "n", "first_doc", "first_pos", "first_lo")
        rows = zip(*[batch.column(c).to_pylist() for c in (*names, "body", "first_body")], strict=True)
        for k, d, pos, lo, hi, n, first_doc, first_pos, first_lo, body, first_body in rows:
            words = None
            if body == first_body and pos - lo == first_pos - first_lo:
                a, b = lo, hi
            else:
                words = body.split(b" ")
                start, end = extended(words, pos - lo, first_body.split(b" "), first_pos - first_lo)
                a, b = lo + start, min(hi, lo + end - window)
            if b >= a and d > first_doc:
                node.append(k)
                doc.append(d)
                low.append(a)
                high.append(b)
                kept.append(None)
            if n > 2 and words is not None:
                for s in range(lo, hi + 1):
                    if not a <= s <= b:
                        node.append(k)
                        doc.append(d)
                        low.append(s)
                        high.append(s)
                        kept.append(b" ".join(words[s - lo : s - lo + window]))
        cols = [pa.array(node, pa.int64()), pa.array(doc, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["node", "at_doc", "lo", "hi", "words"])

    return map_batches(pairs, run, "node long, at_doc long, lo int, hi int, words binary")


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row per row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts earlier (smaller doc_id, or
    the same row further left) in the input. kept_text is null where nothing was removed. A null text
    has no words; a null doc_id counts as the last of all, without order among such rows. Rows with
    the same doc_id are never earlier than each other. Other columns of ``docs`` are not read.
    """
    rows = cut(_profile(docs, window, gram), "substring")
    long = rows.where(f"n_words >= {window}")
    nodes = long.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "substring-nodes")
    one = long.select("doc_id", "digest", "anchors", "twice").join(nodes, "digest").where("doc_id <=> rep")
    each = F.expr("concat(transform(anchors, x -> struct(x as anchor, 1 as n)), transform(twice, x -> struct(x as anchor, 2 as n)))")
    seeds = one.select("node", F.explode(each).alias("s")).select("node", "s.anchor", "s.n")
    often = cut(seeds.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "substring-often")
    hits = join_hot(seeds.select("node", "anchor"), often.select("anchor"), "anchor", "node", often).groupBy("node").agg(F.collect_set("anchor").alias("anchors"))
    hits = cut(hits.join(nodes, "node"), "substring-hits")

    digest = _digests(docs)
    texts = digest.join(hits.select("node", "anchors", "rep", F.col("digest").alias("want")), F.expr("doc_id <=> rep and digest = want"))
    texts = cut(texts.select("node", "doc_id", "text", "anchors").dropDuplicates(["node"]), "substring-texts")
    spots = cut(_spots(texts, window, gram), "substring-spots")
    seen = spots.where("anchor is not null")
    first = F.min_by(F.struct("at_doc", "node", "pos", "lo", "body"), F.struct("at_doc", "node", "pos", "lo")).alias("first")
    firsts = cut(seen.groupBy("anchor").agg(F.count("*").alias("n"), first).where(f"n > 1 and first.at_doc < {LAST}"), "substring-firsts")
    sides = firsts.select("anchor", "n", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("node", "pos", "lo", "body")], F.col("first.at_doc").alias("first_doc"))
    pairs = join_hot(seen, sides, "anchor", "node", firsts.select("anchor", "n")).where("not (node = first_node and pos = first_pos and lo = first_lo)")
    found = cut(_extend(pairs, window), "substring-found")

    others = found.where("words is not null")
    early = cut(others.groupBy("words").agg(F.min("at_doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "substring-early")
    later = join_hot(others, early.select("words", "first"), "words", "node", early.select("words", "n")).where("first < at_doc").select("node", "lo", "hi")
    marks = found.where("words is null").select("node", "lo", "hi").union(later).union(spots.where("anchor is null").select("node", "lo", "hi"))
    marks = marks.groupBy("node").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, kept = [], []
        for text, lo, hi in zip(utf8(batch.column("text")), batch.column("lo"), batch.column("hi"), strict=True):
            words = text.split()
            gone = covered(np.asarray(lo.values).astype(np.int64), np.asarray(hi.values).astype(np.int64), window, len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]).decode())
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(removed, pa.int64()), pa.array(shas), pa.array(kept, pa.string())], names=["node", "removed", "new_sha", "kept_text"])

    changed = map_batches(texts.select("node", "text").join(marks, "node"), run, "node long, removed long, new_sha string, kept_text string")
    # a text is cut at its first document only; its copies lose all their words
    known = nodes.join(changed, "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        rows.select("doc_id", "digest", "n_words", "sha").join(known, "digest", "left")
        .withColumn("copy", F.expr("node is not null and rep is not null and not (doc_id <=> rep)"))
        .select(
            "doc_id", "n_words",
            F.expr("if(copy, n_words, coalesce(removed, 0L))").alias("n_removed"),
            F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )


def _digests(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [xxhash.xxh3_128_digest(b" ".join((x or b"").split())) for x in utf8(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text"), pa.array(digests, pa.binary())], names=["doc_id", "text", "digest"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, text string, digest binary")
