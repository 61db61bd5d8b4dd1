"""Lexical search, vector codes and BPE against plain Python and the tokenizers library."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm import bpe, codes, lexical
from rowmill.llm.queries import tokenizer_file

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, term string, row long, n long"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(items, texts, k=10):
    """Sorted (item_id, rank, doc_id, score) of every asked text."""
    docs = [(i, Counter(terms(t))) for i, t in texts]
    n_docs, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc_id, c in docs:
            m = 100 - 75 + (75 * c.total() * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, doc_id, -score) for r, (score, _, _, doc_id) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


ASKED = [(1, "w1 w2 W3 w3"), (2, None), (3, ""), (4, "Été x y ñandú"), (4, "same line HERE"), (5, "one"), (5, "one"), (None, "a edit"), (6, "w7-w8 w9;nowhere")]


@pytest.mark.parametrize("limits", [{}, {"BROADCAST": 3}, {"SLICE": 10, "BUCKETS": 2}])
def test_lexical_search(spark, docs, texts, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    if "BROADCAST" in limits:
        monkeypatch.setattr(lexical.bounded, "__defaults__", (3,))
    items = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ASKED], ITEMS)
    kept = docs.sparkSession.read.parquet(_written(docs))
    assert Counter(tuple(r) for r in lexical.search(items, kept).collect()) == ranked(ASKED, texts)


def _written(df):
    from rowmill.sources.scratch import scratch

    path = scratch(df.sparkSession, "test")
    df.write.parquet(path)
    return path


def test_lexical_search_of_a_very_long_text_and_many_ties(spark):
    rng = random.Random(5)
    texts = [(1, " ".join(f"t{rng.randrange(50)}" for _ in range(400_000))), *[(i, "t1 t2 tie") for i in range(40, 2, -1)], (None, "t1 t2 tie")]
    got = lexical.search(spark.createDataFrame([(1, "t1 tie t2 tie")], "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == ranked([(1, "t1 tie t2 tie")], texts)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(3, 13))


def test_lexical_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(items, empty).count() == 0
    assert lexical.search(items.limit(0), docs).count() == 0
    assert lexical.search(items, docs.withColumn("text", F.lit("., -"))).count() == 0


def test_long_divisions_go_beyond_a_long(spark):
    """75 * n * N of a very long text among many passes 63 bits; the quotient does not."""
    table = spark.createDataFrame([(2**40, 2**50)], "n long, l long")
    got = table.select(F.expr(f"100 - 75 + cast((cast({75 * 2**30} as decimal(20,0)) * n) div l as bigint)")).first()[0]
    assert got == 25 + 75 * 2**30 * 2**40 // 2**50


def coded(rows, parts=8, entries=16, rounds=6):
    """{(vec_id, code, error, label_error, digest): times} by plain rounds over all parts."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    whole = [[math.floor(x * 4096) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, list(kept[i][1])))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[i], p) for i in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (away(cut(v, p), books[p][e]), e)) for p in range(parts)] for v in whole]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, g in zip(whole, got, strict=True) if g[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = assign()
    errors = [sum(away(cut(v, p), books[p][g[p]]) for p in range(parts)) for v, g in zip(whole, got, strict=True)]
    by = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    top = (1 << 63) - 1
    return Counter((i, bytes(g).hex(), min(top, min(top, e)), min(top, by[lab]), digest) for (i, _, lab), g, e in zip(kept, got, errors, strict=True))


def vectors(kind):
    rng = random.Random(kind)
    rows = [(i, [rng.gauss(rng.choice([-2, 0, 3]), 0.2) for _ in range(16)], rng.choice([0, 1, None])) for i in range(300)]
    if kind == "odd":
        rows += [(500, None, 1), (501, [1.0, None] * 8, 1), (502, [float("nan")] * 16, 0), (503, [float("inf")] * 16, 0), (None, [0.5] * 16, None), rows[3], rows[3], (504, [1.0, 2.0, 3.0], 1), (505, [], 0), (506, [9.0] * 21, 2)]
    if kind == "ties":
        rows = [(i, [float(rng.randrange(3)) for _ in range(8)], 1) for i in range(200)]
    if kind == "copies":
        rows = [(i, [0.25] * 16 if i % 3 else rows[i][1], i % 2) for i in range(300)]
    if kind == "few":
        rows = rows[:5]
    if kind == "one":
        rows = rows[:1]
    if kind == "huge":
        rows = [(i, [x * 1e30 for x in v], lab) for i, v, lab in rows[:60]] + rows[60:80]
    return rows


@pytest.mark.parametrize("kind", ["plain", "odd", "ties", "copies", "few", "one", "huge"])
def test_codes(spark, kind):
    rows = vectors(kind)
    as_float = lambda v: None if v is None else [None if x is None else float(np.float32(x)) for x in v]
    rows = [(i, as_float(v), lab) for i, v, lab in rows]
    df = spark.createDataFrame([(i, v, lab, 7, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, block long, heaps string").repartition(3)
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = codes.compressed(df, codes.Codes(bucket=100)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)
    assert Counter(tuple(r) for r in got) == coded(rows)


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    assert codes.compressed(none).count() == 0
    assert codes.compressed(none.limit(0).drop("label")).count() == 0


def test_later_rounds_scan_fewer_parts_and_tables_meet_without_a_shuffle(spark, monkeypatch):
    popped, plans = [], []
    kept = codes._round

    def watched(blocks, state, *rest):
        out = kept(blocks, state, *rest)
        if state is not None:
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            popped.append(state.agg(F.sum("popped")).first()[0])
        return out

    monkeypatch.setattr(codes, "_round", watched)
    df = spark.createDataFrame([(i, v, 1) for i, v, _ in vectors("plain")], "vec_id long, embedding array<float>, label int")
    codes.compressed(df).collect()
    assert popped[0] == 300 * 8
    assert popped[-1] < popped[0] / 2
    assert plans
    assert not any("Exchange" in p for p in plans)


ODD = [
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|>\n\n x", "<|endoftext", "it's 'S they'll’s  don''t", "   lead", "trail   ", "\n\n\n", "a b　c d\x85e\x1cf",
    "日本語のテキスト、句読点。", "naïve café — “quotes”", "👩‍👩‍👧 🇩🇪 ́ é", "١٢٣ ½ Ⅻ ² 12ab34", "\x00\x01\x7f", "﻿bom � \U000e0001 \U0010ffff", "Ᲊ \U00010d6f Ƛ ࢏ \U0001e5d0x", "x" * 5000, " " * 5000 + "x", "ab" * 3 + " " * 2001,
]


def test_bpe_gives_the_ids_and_texts_of_the_library(spark, docs, texts):
    path = tokenizer_file()
    whole = bpe.library(path)
    rows = [*texts, *[(1000 + i, t) for i, t in enumerate(ODD)]]
    df = docs.select("doc_id", "text", F.lit(1).alias("block"), F.lit("x").alias("word")).union(spark.createDataFrame([(1000 + i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, block int, word string"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(whole.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(tuple(r) for r in bpe.digests(df, path).collect()) == want
    both = bpe.round_trip(df, path)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in both.collect()) == Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows)
    again = bpe.decode(both.select("doc_id", "ids"), path, run=16)
    assert Counter((r.doc_id, r.text) for r in again.collect()) == Counter((i, t or "") for i, t in rows)


def test_blocks_are_cut_by_words_and_texts_may_be_longer(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (0, 3, 300_000, 5, 2_000, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    whole = bpe.library(tokenizer_file())
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(df, tokenizer_file()).collect()}
    assert got == {i: (whole.encode(t, add_special_tokens=False).ids, t) for i, t in enumerate(texts)}


def test_bpe_of_nothing(empty):
    assert bpe.digests(empty, tokenizer_file()).count() == 0
    assert bpe.round_trip(empty, tokenizer_file()).count() == 0


def test_words_split_like_the_library_at_every_sign(spark):
    """All code points: where the two splits disagree the library is asked, so the words are always its own."""
    s = bpe.Splitter(tokenizer_file())
    odd = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not s.agrees(c)]
    for c in [*odd, *"aé1²  \n 　!'’"]:
        text = f"don't{c}x {c}1 {c}  {c}{c}"
        assert s.words(text) == s.by_library(text)


def test_ids_without_a_piece_and_broken_utf8(spark):
    path = tokenizer_file()
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [99_999_999]), (None, bpe.library(path).encode("é").ids)], "doc_id long, ids array<int>")
    assert Counter(tuple(r) for r in bpe.decode(tokens, path).collect()) == Counter([(1, ""), (2, ""), (3, ""), (None, "é")])
    assert bpe.text_of(b"a\xe2\x82b\xff") == "a�b�"
