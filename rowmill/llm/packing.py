"""Packing documents into fixed-length token sequences by first-fit decreasing.

A document's tokens are cut into full sequences and a rest. Rests are packed in randomised groups of
about ``group`` documents; a tournament tree over the bins' free room finds the first bin that fits.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.shared import cut, map_batches

#: The split pattern of the byte-level tokenizer files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRIDE = 1 << 31
#: Stretches of white space that ``tiktoken``'s pattern engine, which recurs on each sign, is not given.
BLANKS = re.compile(r"\s{2000}")


def byte_of_sign() -> dict[str, int]:
    """Printable Latin-1 signs stand for themselves, other bytes for the signs from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_merges(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the standard split and nothing around it, whose ids rise with the merges."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
        return False
    if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"):
        return False
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"].get(x, -1) for x in merged]
    return -1 not in ids and all(a < b for a, b in zip(ids, ids[1:], strict=False)) and set(byte_of_sign()) <= set(model["vocab"])


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, from a byte-level BPE file of the ``tokenizers`` library.

    The same merges run in ``tiktoken``, which is several times faster, if the file says no more than
    plain byte-level merges. Texts that hold an added token of the file or very long white space go
    through ``tokenizers``, as all do with any other file.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = Tokenizer.from_file(path)
    added = [t["content"] for t in spec.get("added_tokens", ())]
    if not plain_merges(spec):
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    sign = byte_of_sign()
    ranks = {bytes(sign[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or BLANKS.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class Tournament:
    """First bin with enough room: a complete binary tree whose inner nodes hold the larger child."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [0] * self.size + [room] * bins + [0] * (self.size - bins)
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def take(self, n: int) -> int:
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < n:
                i += 1
        tree[i] -= n
        bin_ = i - self.size
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return bin_


def first_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` must be in decreasing order and at most ``room``."""
    tree, used = Tournament(len(lengths), room), [0] * len(lengths)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        b = tree.take(n)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
    return bins, offsets


def tokenized(docs: DataFrame, path: str, length: int, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, lot[, ids]: the pieces of every document.

    ``path``: the tokenizer file, which every executor must have at that place.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path)
        at, start, size, crc, tokens, lot, kept = [], [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = np.array([*encode(text or ""), 0], "<u4")
            for lo in range(0, len(ids), length):
                piece = ids[lo : lo + length]
                at.append(i)
                start.append(lo)
                size.append(len(piece))
                crc.append(zlib.crc32(piece.tobytes()))
                tokens.append(len(ids))
                lot.append(i % 64)
                if with_ids:
                    kept.append(piece.astype(np.int32))
        long = [pa.array(x, pa.int64()) for x in (start, size, crc, tokens)]
        cols = [batch.column("doc_id").cast(pa.int64()).take(pa.array(at, pa.int64())), *long, pa.array(lot, pa.int32())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"]
        if with_ids:
            return pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.list_(pa.int32()))], names=[*names, "ids"])
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot int" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, length: int = 1024, group: int = 2000, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]: one row per piece.

    Every document ends with id 0, so a null or empty text is one piece of one token. Pieces that fill a
    sequence have it to themselves (its id is negative) and are not shuffled, so a group holds one piece a document at
    most, however long texts are; pieces are written first, and so a task that runs again deals the same ones. Rows are packed
    apart from each other, also where they repeat an id; a null doc_id is packed like any other. Ties
    in length go by doc_id and start. Other columns of ``docs`` are not read.
    """
    groups = max(1, -(-docs.count() // group))
    pieces = cut(tokenized(docs, path, length, with_ids), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    full = pieces.where(F.col("length") == length).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = pieces.where(F.col("length") < length).withColumn("pack", F.expr(f"pmod(xxhash64(doc_id, doc_tokens, lot), {groups}L)"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit(table["length"].to_numpy(), length)
        first = table["pack"][0].as_py() * STRIDE
        return table.drop_columns(["lot", "pack"]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids array<int>, " * with_ids) + "sequence_id long, offset long"
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot", *["ids"] * with_ids, "pack"]
    return rests.select(*order).groupBy("pack").applyInArrow(run, schema).unionByName(full)
