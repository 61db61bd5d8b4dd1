"""Near-duplicate documents by min-max hashing.

Of every permutation both the smallest and the largest value are kept, so ``perms`` hash evaluations
give ``2 * perms`` signature values. ``rows`` values make a band; documents that agree on a band are
candidates, and every link is confirmed on the full sets of 64-bit shingle hashes.

Inside a bucket, members are first checked against one hub (linear work). Members that are still in
different components afterwards are checked exactly, in blocks of bounded size, so no link between
two documents that share a bucket is lost and no pairs are emitted. Texts with equal word sequences
count as one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from rowmill.llm.components import components
from rowmill.llm.shared import as_long, cut, each_batch, give_back, gram_hashes, join_hot, map_batches, scramble, utf8, word_hashes


@dataclass(frozen=True)
class MinMax:
    """words: of a shingle; percent: of the union that two sets must share; block: rows of one side of an exact check."""

    words: int = 5
    percent: int = 80
    perms: int = 60
    rows: int = 5
    bands: int = 24
    block: int = 512
    seed: int = 7

    @property
    def floor(self) -> float:
        """Estimates under this are six standard deviations below the threshold."""
        p = self.percent / 100
        return p - 6 * (p * (1 - p) / (2 * self.perms)) ** 0.5

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 1 << 63, self.perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, rng.integers(0, 1 << 63, self.perms, dtype=np.uint64)


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (both are what ``bytes`` methods do)."""
    return (text or b"").lower().split()


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of ``n``-word shingles; of the whole sequence, where it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(gram_hashes(word_hashes(words), n))


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per permutation the minimum, then per permutation the maximum."""
    low, high = np.full(len(a), (1 << 64) - 1, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(values), 2048):
        x = values[i : i + 2048, None] * a[None, :] + b[None, :]
        np.minimum(low, x.min(0), out=low)
        np.maximum(high, x.max(0), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A band takes neighbouring permutations; its key also holds the band's number."""
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in sig[: rows * bands].reshape(bands, rows).T:
        key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def _profile(docs: DataFrame, p: MinMax) -> DataFrame:
    a, b = p.multipliers()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, keys, sigs, seen = [], [], [], [], {}
        for text in utf8(batch.column("text")):
            words = tokens(text)
            digest = xxhash.xxh3_128_digest(b" ".join(words))
            if digest not in seen:
                values = shingles(words, p.words)
                if len(values):
                    sig = signature(values, a, b)
                    seen[digest] = len(values), as_long(band_keys(sig, p.rows, p.bands)), (sig >> np.uint64(56)).astype(np.uint8).tobytes()
                else:
                    seen[digest] = 0, np.empty(0, np.int64), b""
            size, key, sig = seen[digest]
            digests.append(digest)
            sizes.append(size)
            keys.append(key)
            sigs.append(sig)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc_id", "digest", "n_shingles", "bands", "sig"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, digest binary, n_shingles long, bands array<long>, sig binary")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, p: MinMax) -> DataFrame:
    """(node, values): the full shingle sets of the ``wanted`` nodes, as packed 64-bit hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, values = [], []
        for text in utf8(batch.column("text")):
            words = tokens(text)
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            values.append(shingles(words, p.words).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(values, pa.binary())], names=["digest", "values"])

    need = nodes.join(wanted, "node", "left_semi").select("node", "digest", F.col("rep").alias("rep"))
    ids = need.select("rep").distinct()
    texts = docs.select("doc_id", "text").join(ids, F.expr("doc_id <=> rep"), "left_semi")
    made = map_batches(texts, run, "digest binary, values binary")
    return need.join(made, "digest").groupBy("node").agg(F.first("values").alias("values"))


def _agreement(x: pd.Series, y: pd.Series) -> pd.Series:
    out = np.zeros(len(x))
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        out[i] = (np.frombuffer(u, np.uint8) == np.frombuffer(v, np.uint8)).mean()
    return pd.Series(out)


def _overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, y in batches:
        yield pd.Series([len(np.intersect1d(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), assume_unique=True)) for u, v in zip(x, y, strict=True)], dtype="int64")
    x = y = None
    give_back()


def _enough(percent: int, common: str, m: str, n: str) -> str:
    return f"100 * {common} >= {percent} * ({m} + {n} - {common})"


def exact_links(ids: np.ndarray, labels: np.ndarray, rest: np.ndarray, values: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the labels of rows marked ``rest`` to others, each from the true intersection size.

    Every pair is judged; of the links between labels that others already join, none is returned, so
    the result is smaller than the number of rows. An inverted index of the block gives a row's intersections with all others in one count.
    """
    sizes = np.array([len(v) for v in values], np.int64)
    owner = np.repeat(np.arange(len(values)), sizes)
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    names, at = np.unique(labels, return_inverse=True)
    parent = np.arange(len(names))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i in np.flatnonzero(rest):
        lo, hi = np.searchsorted(flat, values[i], "left"), np.searchsorted(flat, values[i], "right")
        n = hi - lo
        ends = np.cumsum(n)
        common = np.bincount(owner[np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)], minlength=len(values))
        hit = np.flatnonzero((100 * common >= percent * (sizes + sizes[i] - common)) & (labels != labels[i]))
        for j in hit[np.unique(at[hit], return_index=True)[1]].tolist():
            a, b = root(at[i]), root(at[j])
            if a != b:
                parent[a] = b
                out.append((int(ids[i]), int(ids[j])))
    return out


def _block_links(shared: DataFrame, docs: DataFrame, nodes: DataFrame, p: MinMax) -> DataFrame:
    """shared (bucket, node, label): buckets whose members are in several components. -> links (u, v)."""
    by = shared.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    main = cut(by.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("most")), "minmax-main")
    rows = (
        join_hot(shared, main, "bucket", "node", main.select("bucket", "n"))
        .withColumn("rest", F.expr("label <> main"))
        .withColumn("ml", F.expr(f"cast(ceil(most / {p.block}) as int)"))
        .withColumn("mr", F.expr(f"cast(ceil((n - most) / {p.block}) as int)"))
        .withColumn("at", F.expr("cast(pmod(xxhash64(node), if(rest, mr, ml)) as int)"))
        .withColumn("cell", F.explode(F.expr(
            "if(rest, concat(transform(sequence(0, ml - 1), x -> struct(x as x, at as y)),"
            " transform(sequence(at, mr - 1), y -> struct(ml + at as x, y as y)),"
            " filter(transform(sequence(0, at), x -> struct(ml + x as x, at as y)), c -> c.x < ml + at)),"
            " transform(sequence(0, mr - 1), y -> struct(at as x, y as y)))")))
        .select("bucket", "cell.x", "cell.y", "node", "label", "rest")
    )
    rows = rows.join(_sets(docs, nodes, shared.select("node").distinct(), p), "node")
    percent = p.percent

    def run(table: pa.Table) -> pa.Table:
        found = exact_links(
            table["node"].to_numpy(), table["label"].to_numpy(), table["rest"].to_numpy(zero_copy_only=False),
            [np.frombuffer(v, np.uint64) for v in table["values"].to_pylist()], percent,
        )
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return rows.groupBy("bucket", "x", "y").applyInArrow(run, "u long, v long")


def _groups(docs: DataFrame, p: MinMax) -> tuple[DataFrame, DataFrame]:
    """The profile of ``docs``, and (digest, n copies, rep, label) of its word sequences: equal labels are one component, rep is the smallest doc_id."""
    rows = cut(_profile(docs, p), "minmax")
    nodes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "minmax-nodes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = cut(spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "minmax-hubs")
    members = cut(join_hot(spread, hubs.withColumnRenamed("n", "k"), "bucket", "node", hubs.select("bucket", "n")), "minmax-buckets")

    pairs = cut(members.where("node <> hub").select("node", "hub").distinct(), "minmax-pairs")
    side = nodes.select("node", "n", "sig")
    hub_side = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"))
    pairs = (
        join_hot(pairs.join(side, "node"), hub_side, "hub", "node", pairs.groupBy("hub").agg(F.count("*").alias("n")))
        .where(f"100 * least(n, hub_n) >= {p.percent} * greatest(n, hub_n)")
        .where(F.pandas_udf(_agreement, "double")("sig", "hub_sig") >= p.floor)
        .select("node", "hub", "n", "hub_n")
    )
    pairs = cut(pairs, "minmax-close")
    sets = cut(_sets(docs, nodes, pairs.select("node").union(pairs.select("hub")).distinct(), p), "minmax-sets")
    hub_sets = sets.select(F.col("node").alias("hub"), F.col("values").alias("hub_values"))
    links = (
        join_hot(pairs.join(sets, "node"), hub_sets, "hub", "node", pairs.groupBy("hub").agg(F.count("*").alias("n")), least=64)
        .withColumn("common", F.pandas_udf(_overlap, "long")("values", "hub_values"))
        .where(_enough(p.percent, "common", "n", "hub_n"))
        .select(F.col("node").alias("u"), F.col("hub").alias("v"))
    )
    labels = cut(components(links), "minmax-labels")

    # members of a bucket that its hub has not brought together are checked with each other
    wide = cut(members.where("k > 2").select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "minmax-wide")
    split = cut(wide.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a <> b").select("bucket", "n"), "minmax-split")
    more = cut(_block_links(join_hot(wide, split.select("bucket"), "bucket", "node", split), docs, nodes, p), "minmax-more")
    if not more.isEmpty():
        old = labels.withColumnsRenamed({"node": "u", "label": "lu"})
        ends = more.join(old, "u", "left").join(old.withColumnsRenamed({"u": "v", "lu": "lv"}), "v", "left")
        joined = components(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))).withColumnsRenamed({"node": "old", "label": "new"})
        every = labels.union(ends.where("lu is null").select("u", "u")).union(ends.where("lv is null").select("v", "v")).distinct()
        labels = cut(every.join(joined, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "minmax-labels")

    named = nodes.select("node", "digest", "rep", F.col("copies").alias("n")).join(labels, "node", "left").select("digest", "n", "rep", F.coalesce("label", "node").alias("label"))
    return rows, cut(named, "minmax-named")


def _named(named: DataFrame, best: DataFrame) -> DataFrame:
    """(digest, ...): what ``best`` (label, ...) says of each word sequence's component."""
    return join_hot(named.select("digest", "label"), best, "label", "digest", named.groupBy("label").agg(F.count("*").alias("n"))).drop("label")


def near_duplicates(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Null or empty texts and texts of white space have an empty set and stand alone. Rows of equal
    word sequences are linked; rows that share a doc_id but not their words are judged apart. A null
    doc_id gives its component no name: component_id is the smallest known id, or null, and kept is
    false. Other columns of ``docs`` are not read.
    """
    rows, named = _groups(docs, p)
    names = _named(named, named.groupBy("label").agg(F.min("rep").alias("component_id")))
    return (
        join_hot(rows.select("doc_id", "digest", "n_shingles"), names, "digest", "doc_id", named.select("digest", "n"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def keep_one(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns; texts without words all stay.

    The row kept is of the smallest doc_id, known before null, and there of the smallest digest; of rows
    that repeat both, any one. Rows are told apart by doc_id and digest.
    """
    rows, named = _groups(docs, p)
    best = named.groupBy("label").agg(F.min(F.struct(F.expr("rep is null").alias("none"), "rep", "digest")).alias("best"))
    gone = join_hot(rows.where("n_shingles > 0").select("doc_id", "digest"), _named(named, best), "digest", "doc_id", named.select("digest", "n")).where("not (doc_id <=> best.rep and digest = best.digest)")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__gone_digest")).distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, empty = [], []
        for text in utf8(batch.column("text")):
            words = tokens(text)
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            empty.append(not words)
        return batch.append_column("__digest", pa.array(digests, pa.binary())).append_column("__empty", pa.array(empty, pa.bool_()))

    schema = StructType([*docs.schema.fields, StructField("__digest", BinaryType()), StructField("__empty", BooleanType())])
    marked = docs.mapInArrow(each_batch(run), schema).withColumn("__alone", F.when(F.col("__empty"), F.monotonically_increasing_id()))
    left = marked.join(gone, F.expr("doc_id <=> __gone and __digest = __gone_digest"), "left_anti")
    return left.dropDuplicates(["doc_id", "__digest", "__alone"]).select(*docs.columns)
