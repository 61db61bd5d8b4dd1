"""Byte-level BPE over whole tables: every distinct word is encoded once, and ids are decoded through their pieces.

Texts are split into words task by task. A block of texts (``BLOCK`` words at most, unless one text has
more) keeps its distinct words in a dictionary and each text as places in it, so a word of a thousand
texts travels once. The distinct-word table deals the words of all dictionaries by their hash; there each
distinct word is encoded once by the ``tokenizers`` library, and the ids go back to their places in the
dictionaries. The ids that a block uses are joined with the vocabulary's pieces. Texts, which lie in
buckets by block, then meet their block's ids and pieces; only words, ids and pieces are shuffled.

Rows of the distinct-word table hold a block's words of one hash group, compressed.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.packing import PATTERN, byte_of_sign
from rowmill.llm.shared import cut, give_back, map_batches, word_hashes
from rowmill.sources.scratch import scratch

BLOCK = 4_000_000
#: Hash groups of the distinct-word table; a task holds one group's distinct words at a time.
GROUPS = 512
#: Words that a task knows the ids of at a time; in a group of more some are encoded again.
KNOWN = 1_000_000
#: Texts, and words of texts, in a row.
TEXTS, WORDS = 1000, 250_000
#: Vocabularies of up to so many pieces (some 20 MB) are broadcast.
BROADCAST = 1_000_000


def library(path: str):
    """The file's tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Splitter:
    """A text as words that can be encoded apart: ``"".join(words(text)) == text`` and their ids, put together, are the text's.

    Added tokens are words of their own. A file that is no plain byte-level BPE, or whose added tokens
    take blanks around them, gives the whole text as one word. Signs that the library's split takes for
    another kind (its Unicode tables may be of another year) are found by asking it once for each sign;
    texts that hold one are split by the library.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or ()
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        self.whole = not plain or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.split = library(path).pre_tokenizer
        self.find = regex.compile(PATTERN).findall
        self.alike: dict[str, bool] = {chr(i): True for i in range(128)}

    def agrees(self, sign: str) -> bool:
        if sign not in self.alike:
            probe = f"a{sign} 1{sign} !{sign} {sign}  {sign}{sign}x"
            self.alike[sign] = self.find(probe) == self.by_library(probe)
        return self.alike[sign]

    def by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if self.whole:
            return [text] if text else []
        if self.added and self.added.search(text):
            return [w for i, piece in enumerate(self.added.split(text)) for w in ([piece] if i % 2 else self.segment(piece))]
        return self.segment(text)

    def segment(self, text: str) -> list[str]:
        return self.find(text) if text.isascii() or all(map(self.agrees, set(text))) else self.by_library(text)


@functools.lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def packed(*lists: np.ndarray, tail: bytes = b"") -> bytes:
    """Lists of numbers below 2^32, and bytes, as compressed bytes. The numbers' first, second, third and fourth bytes lie apart: high bytes of small numbers are alike."""
    head = np.array([len(lists), *map(len, lists)], "<u4").tobytes()
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in lists]
    return zstandard.ZstdCompressor(level=9).compress(head + b"".join(planes) + tail)


def unpacked(data: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    count = int.from_bytes(data[:4], "little")
    sizes, at, out = np.frombuffer(data[4 : 4 + 4 * count], "<u4").tolist(), 4 + 4 * count, []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(data[at : at + 4 * n], np.uint8).reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out, data[at:]


def packed_words(words: list[bytes], at: np.ndarray) -> bytes:
    """Words and their places in the dictionary, which rise, as steps from one to the next."""
    return packed(np.diff(at, prepend=np.uint32(0)), np.array([len(w) for w in words], np.uint32), tail=b"".join(words))


def unpacked_words(data: bytes) -> tuple[np.ndarray, list[str]]:
    (at, sizes), body = unpacked(data)
    ends = np.cumsum(sizes, dtype=np.int64)
    return at, [body[e - n : e].decode() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def in_blocks(docs: DataFrame, path: str) -> DataFrame:
    """kind, block, at, data, doc_ids: of kind 0 a block's words of the hash group ``at``, of kind 2 some of its texts as places in the dictionary."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def table(block: int, index: dict[str, int], ids: list, places: list[np.ndarray]) -> pa.RecordBatch:
        words = [w.encode() for w in index]
        often = np.argsort(-np.bincount(np.concatenate(places), minlength=len(words)), kind="stable")  # common words get small numbers
        rank = np.empty(len(words), np.uint32)
        rank[often] = np.arange(len(words))
        group = (word_hashes(words) % np.uint64(GROUPS)).astype(np.int64)
        order = np.lexsort((rank, group))
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        parts = np.split(order, starts[1:]) if len(order) else []
        data = [packed_words([words[i] for i in part.tolist()], rank[part]) for part in parts]
        runs, held = [0], 0  # texts that lie in a row together
        for i, p in enumerate(places):
            if i > runs[-1] and (i - runs[-1] >= TEXTS or held + len(p) > WORDS):
                runs.append(i)
                held = 0
            held += len(p)
        texts = [(places[i:j], ids[i:j]) for i, j in zip(runs, [*runs[1:], len(ids)], strict=True)]
        data += [packed(np.array([len(p) for p in some], np.uint32), rank[np.concatenate(some)]) for some, _ in texts]
        n, m = len(parts), len(texts)
        at = [*[int(group[part[0]]) for part in parts], *range(m)]
        kinds = np.repeat(np.array([0, 2], np.int32), [n, m])
        names = pa.array([*[None] * n, *[some for _, some in texts]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.full(n + m, block)), pa.array(at, pa.int32()), pa.array(data, pa.binary()), names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = splitter(path).words
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            index, ids, places, held = defaultdict(), [], [], 0
            index.default_factory = index.__len__
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = words(text.as_py() or "")
                if held and held + len(found) > BLOCK:
                    yield table(block, index, ids, places)
                    index, ids, places, held = defaultdict(), [], [], 0
                    index.default_factory = index.__len__
                    block += 1
                held += len(found)
                ids.append(doc_id)
                places.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
            if ids:
                yield table(block, index, ids, places)
                block += 1
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "kind int, block long, at int, data binary, doc_ids array<long>")


def encoded(words: DataFrame, path: str) -> DataFrame:
    """words (block, at group, data) -> block, kind, data: of kind 0 places in the block's dictionary with their ids, of kind 1 the distinct ids a task has found for a block.

    A group's rows come one after the other, and each of its distinct words is encoded at the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, known, used = _library(path), None, {}, {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "kind", "data"])

        for batch in batches:
            rows = []
            for group, block, data in zip(*[batch.column(c).to_pylist() for c in ("at", "block", "data")], strict=True):
                if group != now:
                    now, known = group, {}
                steps, words = unpacked_words(data)
                known = {} if len(known) > KNOWN else known
                new = [w for w in words if w not in known]
                known.update(zip(new, [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch(new, add_special_tokens=False)], strict=True))
                ids = [known[w] for w in words]
                flat = np.concatenate(ids)
                rows.append((block, 0, packed(steps, np.array([len(x) for x in ids], np.uint32), flat)))
                used[block] = np.union1d(used[block], flat) if block in used else np.unique(flat)
                if len(used) > 256:
                    rows += [(b, 1, packed(x)) for b, x in used.items()]
                    used = {}
            if rows:
                yield out(rows)
        if used:
            yield out([(b, 1, packed(x)) for b, x in used.items()])
        give_back()

    rows = words.select("at", "block", "data").repartition("at").sortWithinPartitions("at", "block")
    return rows.mapInArrow(run, "block long, kind int, data binary")


@functools.lru_cache(maxsize=2)
def _library(path: str):
    return library(path)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): what each id stands for, as bytes; read in a task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sign = byte_of_sign()
        tokens = {i: t for t, i in library(path).get_vocab(with_added_tokens=True).items()}
        pieces = [bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode() for t in tokens.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.int32()), pa.array(pieces, pa.binary())], names=["id", "piece"])

    return map_batches(spark.range(1).coalesce(1), run, "id int, piece binary")


def with_pieces(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (..., id) with the piece of each id. The vocabulary is counted; one above ``BROADCAST`` is joined by a shuffle."""
    pieces = vocabulary(rows.sparkSession, path)
    small = pieces.count() <= BROADCAST
    return rows.join(F.broadcast(pieces) if small else pieces, "id")


def _distinct(table: pa.Table) -> pa.Table:
    ids = np.unique(np.concatenate([unpacked(x)[0][0] for x in table["data"].to_pylist()]))
    return pa.table({"block": np.full(len(ids), table["block"][0].as_py()), "id": ids.astype(np.int32)})


class Dictionary:
    """A block's ids by place, and pieces by id."""

    def __init__(self, rows: pa.Table):
        kind, data, ids = rows["kind"].to_pylist(), rows["data"].to_pylist(), rows["id"].to_pylist()
        found = [unpacked(x)[0] for k, x in zip(kind, data, strict=True) if k == 0]
        found = [(np.cumsum(steps), *rest) for steps, *rest in found]
        at, sizes, self.flat = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint32) for i in range(3))
        self.sizes, self.starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        self.sizes[at], self.starts[at] = sizes, np.cumsum(sizes, dtype=np.int64) - sizes
        self.pieces = {i: x for k, i, x in zip(kind, ids, data, strict=True) if k == 1}

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of all places, one after the other."""
        n = self.sizes[places]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - (ends - n), n)]

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _met(docs: DataFrame, path: str, give: Callable[[np.ndarray, bytes], tuple], columns: str, fields: list[pa.Field]) -> DataFrame:
    """doc_id and what ``give`` makes of each text's ids and decoded bytes."""
    spark, table = docs.sparkSession, f"bpe_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = in_blocks(docs, path).write.bucketBy(buckets, "block").sortBy("kind").option("path", scratch(spark, table)).option("compression", "uncompressed")
    made.saveAsTable(table)
    texts = spark.table(table)
    spark.sql(f"drop table {table}")  # only its name: the files stay in the scratch folder, and what has been read knows their place
    ids = cut(encoded(texts.where("kind = 0"), path), "bpe-ids")
    used = ids.where("kind = 1").select("block", "data").groupBy("block").applyInArrow(_distinct, "block long, id int")
    right = ids.where("kind = 0").select("block", "kind", F.lit(None).cast("int").alias("id"), "data")
    right = right.unionByName(with_pieces(used, path).select("block", F.lit(1).alias("kind"), "id", F.col("piece").alias("data")))
    left = texts.where("kind = 2").select("block", "doc_ids", "data")
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        known, out = Dictionary(rows), []
        for names, data in zip(docs["doc_ids"].to_pylist(), docs["data"].to_pylist(), strict=True):
            sizes, places = unpacked(data)[0]
            for doc_id, some in zip(names, np.split(places, np.cumsum(sizes)[:-1]), strict=True):
                ids = known.ids(some)
                out.append((doc_id, *give(ids, known.decoded(ids))))
        columns = zip(*out, strict=True) if out else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, f"doc_id long, {columns}")


def text_of(data: bytes) -> str:
    """Bytes of pieces as text; what is no UTF-8 becomes replacement signs."""
    return data.decode("utf-8", "replace")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded: one row per row of ``docs``, its whole text encoded and decoded again.

    A null text is an empty one and has no ids; rows that repeat an id or a text each have their row, a
    null doc_id too. Other columns of ``docs`` are not read. A word may be as long as its text.
    ``path``: the tokenizer file, which every executor must have at that place.
    """
    give = lambda ids, data: (ids.astype(np.int32), text_of(data))
    return _met(docs, path, give, "ids array<int>, decoded string", [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``round_trip``, whose ids and texts stay in their task."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    give = lambda ids, data: (len(ids), sha(ids.astype("<u4").tobytes()), sha(text_of(data).encode()))
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _met(docs, path, give, "n_tokens long, ids_sha256 string, decoded_sha256 string", fields)


def decode(tokens: DataFrame, path: str, run: int = 4096) -> DataFrame:
    """tokens (doc_id, ids array<int>) -> doc_id, text: ids joined with their pieces and put together by position.

    Runs of ``run`` ids are put together first, so no group holds more. Null ids give an empty text; ids
    that the vocabulary lacks give nothing. Rows are told apart by their place in ``tokens``, which is written first.
    """
    rows = cut(tokens.select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id()), "bpe-tokens")
    flat = rows.select("row", F.posexplode("ids").alias("pos", "id")).withColumn("part", F.expr(f"pos div {run}"))
    in_order = lambda at, what: F.transform(F.sort_array(F.collect_list(F.struct(at, what))), lambda x: x[what])
    whole = lambda texts: F.unhex(F.array_join(texts, ""))
    parts = with_pieces(flat, path).withColumn("piece", F.hex("piece")).groupBy("row", "part").agg(F.array_join(in_order("pos", "piece"), "").alias("piece"))
    texts = parts.groupBy("row").agg(whole(in_order("part", "piece")).alias("text"))
    decoded = F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit(""))
    return rows.select("row", "doc_id").join(texts, "row", "left").select("doc_id", decoded.alias("text"))
