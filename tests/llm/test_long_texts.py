"""Texts of more than ten megabytes, whole, and the digests of stored media."""

import hashlib
import random
import re

import numpy as np
import pytest

from rowmill.llm import bpe, linededup, matroska, minhash, mixing, substring, toxicity
from rowmill.llm.queries import tokenizer_file

WORDS = 1_700_000


@pytest.fixture(scope="module")
def long_words():
    rng = np.random.default_rng(1)
    return [f"w{x}" for x in rng.integers(0, 200_000, WORDS)]


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long").coalesce(1)


def test_minhash_links_long_texts(spark, long_words):
    near, far = list(long_words), list(long_words)
    near[::100] = ["changed"] * len(near[::100])
    far[::10] = ["changed"] * len(far[::10])
    texts = [" ".join(x) for x in (long_words, near, far)]
    assert len(texts[0]) > 10_000_000
    rows = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, *texts)).collect()}
    assert [rows[i].component_id for i in range(3)] == [0, 0, 2]
    grams = set(zip(*[long_words[i:] for i in range(5)], strict=False))
    assert rows[0].n_shingles == len(grams)


def test_substring_dedup_of_long_texts(spark, long_words):
    passage = long_words[900_000:900_050]
    rows = substring.remove_repeats(frame(spark, " ".join(long_words), " ".join(["before", *passage, "after"]))).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert got[1] == (52, 50, hashlib.sha256(b"before after").hexdigest())
    assert got[0] == (WORDS, 0, hashlib.sha256(" ".join(long_words).encode()).hexdigest())


def test_line_dedup_of_long_texts(spark, long_words):
    lines = [" ".join(long_words[i : i + 10]) for i in range(0, WORDS, 10)]
    rows = {r.doc_id: r for r in linededup.without_repeats(frame(spark, "\n".join(lines), "\n".join(["own", "lines", *lines[50_000:50_400]]))).collect()}
    assert rows[0].text == "\n".join(lines) and rows[0].n_chars == len(rows[0].text)
    assert rows[1].text.startswith("own\nlines") and len(rows[1].text.split("\n")) < 20


def test_mixing_sizes_of_long_texts(spark, long_words):
    rows = {r.doc_id: r for r in mixing.amounts(frame(spark, " ".join(long_words), "a b")).collect()}
    assert rows[0]["size"] == WORDS and rows[1]["size"] == 2 and rows[0].taken <= 2 * WORDS and abs(rows[0].taken + rows[1].taken - 1.5 * (WORDS + 2)) < 0.01 * WORDS


def test_toxicity_reads_long_texts_to_their_end(long_words):
    rng = random.Random(2)
    bad = ["foulword", "nastything", "vileperson"]
    texts = [" ".join(rng.choices(long_words, k=40) + rng.choices(bad, k=8) * (i % 2)) for i in range(200)]
    model = toxicity.fit([t.encode() for t in texts], [i % 2 for i in range(200)])
    half = " ".join(long_words[: WORDS // 2])
    end = " ".join(rng.choices(bad, k=WORDS // 2))
    low, high = model.scores([half.encode(), f"{half} {end}".encode()])
    assert low < 0.3 <= high


def test_bpe_of_long_texts(spark, long_words):
    text = " ".join(long_words)
    row = bpe.digests(frame(spark, text, "x" * 11_000_000), tokenizer_file()).where("doc_id = 0").first()
    ids = bpe.library(tokenizer_file()).encode(text, add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "a", "word " * 700, "é" * 40_000])
def test_media_digests(spark, text):
    """What is stored is what ``mux`` makes of the padded text, and the feature tells what lies in it."""
    row = matroska.digests(frame(spark, text)).first()
    payload = matroska.padded(text.encode())
    data = matroska.mux(payload)
    assert (row.media_bytes, row.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    found = dict(re.findall(r"(\w+)=([^;]*)", row.feature))
    x = np.abs(np.frombuffer(payload, np.uint8).astype(int) - 128)
    clusters = len(re.findall(rb"\x1f\x43\xb6\x75", data))
    assert int(found["peak"]) == x.max() and int(found["level"]) == x.sum() * 1000 // len(x) and int(found["clusters"]) == clusters
    assert row.feature.startswith("A_PCM/INT/LIT;") and 1 <= int(found["packets"]) <= -(-len(payload) // 64) and int(found["cues"]) <= clusters
