"""Every operator against brute force on a small table with odd rows, and on an empty one."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm import components, linededup, matroska, minhash, mixing, packing, substring, topk, toxicity, urlfilter, warc
from rowmill.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def group(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def grams(text, n):
    w = WORD.findall(low(text))
    return set() if not w else {tuple(w)} if len(w) < n else set(zip(*[w[i:] for i in range(n)], strict=False))


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, texts, words, percent):
    got = minhash.near_duplicates(docs, minhash.MinMax(words=words, percent=percent, block=3)).collect()
    sets = [grams(t, words) for _, t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = group(len(sets), links)
    least = {}
    for r, (i, _) in zip(root, texts, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, len(s), least.get(r) if s else i, i is not None and (least.get(r) if s else i) == i) for (i, _), s, r in zip(texts, sets, root, strict=True))
    assert Counter(tuple(r) for r in got) == want


def test_minhash_keeps_one(docs):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id between 0 and 11").count() < 12
    assert kept.where("doc_id in (30, 31, 33)").count() == 3


def test_minhash_keeps_exactly_one_row_of_a_group(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    # a: named and null copies; b: null ids only; c: one row twice; d: on an id that is a copy of a elsewhere
    rows = [(1, a), (None, a), (2, a), (None, b), (None, b), (3, c), (3, c), (2, d), (5, e), (5, e + " more"), (7, None), (7, None), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    fives = [x for x in got if x[0] == 5]
    assert len(fives) == 1 and fives[0] in rows
    assert Counter(x for x in got if x[0] != 5) == Counter([(1, a), (None, b), (3, c), (2, d), (7, None), (7, None), (None, ""), (None, "")])


def test_block_links_join_what_brute_force_joins():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    values = [np.unique(np.concatenate([rng.choice(base, 50, False), rng.integers(0, 1 << 60, 4, dtype=np.uint64)])) for _ in range(40)]
    labels = np.arange(40)
    found = minhash.exact_links(labels, labels, np.ones(40, bool), values, 70)
    want = [(i, j) for i, j in itertools.combinations(range(40), 2) if 100 * len(np.intersect1d(values[i], values[j])) >= 70 * len(np.union1d(values[i], values[j]))]
    assert group(40, found) == group(40, want) and len(found) < 40


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = group(500, links)
    assert all(root[n] == x for n, x in got.items()) and {n for a, b in links if a != b for n in (a, b)} == set(got)
    far = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long"), local=0).collect()}
    assert far == got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_topk(rows, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("index", [topk.PivotIndex(), topk.PivotIndex(k=3, pivots=5, rings=3, cell=7, queries=2, sample=50)])
def test_topk(spark, index):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) * rng.uniform(0.1, 3)]) for i in range(420)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2100, [1.0, float("nan")]), (2200, [None, 1.0]), (2300, [float("inf")] * 6), (2400, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, pivot string")
    vectors = topk.integers(df)
    got = topk.search(vectors.where("vec_id % 100 = 0"), vectors, index)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, index.k)
    none = vectors.where("false")
    assert topk.search(none, none).count() == 0 and topk.search(none, vectors).count() == 0


@pytest.mark.parametrize("size", [2e5, 1e8, 1e14])
def test_topk_scores_are_exact_integers(spark, size):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in np.concatenate([rng.normal(size=4) * size, rng.normal(size=4)])]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integers(df)
    got = sorted(map(tuple, topk.search(vectors.where("vec_id % 100 = 0"), vectors, topk.PivotIndex(pivots=4)).collect()))
    clip = lambda x: max(-topk.LONG - 1, min(topk.LONG, x))
    ok = [(i, [int(x) for x in clipped]) for i, v in rows for clipped in [[clip(math.floor(1024 * x)) for x in v]]]
    if size < 1e6:
        assert got == brute_topk([(i, [float(x) for x in v]) for i, v in rows], 10)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(x for q, v in ok if q % 100 == 0 for x in [(q, n, i, 0) for n, (_, i) in enumerate(sorted((-sum(int(float(a)) * int(float(b)) for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:10], 1)])]


@pytest.mark.parametrize("scale", [1, 1e4, 1e8])
def test_topk_of_queries_from_outside(spark, scale):
    """Queries that are larger and longer than all vectors, and some that are shorter."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300)]
    asked = [(5000 + i, [float(np.float32(x * scale)) for x in rng.normal(size=n)]) for i, n in enumerate([2, 4, 4, 7, 9])]
    make = lambda r: topk.integers(spark.createDataFrame(r, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, topk.search(make(asked), make(rows), topk.PivotIndex(pivots=4, sample=50)).collect()))
    whole = lambda v: [math.floor(1024 * x) for x in v]
    want = []
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(whole(v), whole(w), strict=False)), i) for i, w in rows)[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_topk_two_vectors_of_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [math.cos(i), math.sin(i)]) for i in range(1, 60)]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(vectors.where("vec_id = 0"), vectors, topk.PivotIndex(k=3, pivots=4)).collect()
    assert Counter(r["rank"] for r in got) == {1: 2, 2: 2, 3: 2} and all(r.vec_id for r in got)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_urls(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/x?q", "http://b.com", "http://b.com/", "x.com/en/", None, "", "http://notexample.com/en/", "http://q.net/es/a#b", "http://q.net/es", "ftp://z.org/en/7", "http://h?x/y://z"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    rows = {r.page_id: r for r in urlfilter.judge(df, RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = low(host)
        fit = [(len(r), a, r) for a, r in RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
        _, action, rule = max(fit, default=(0, None, None))
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == action if rule else rows[i].verdict in ("allow", "block")
    assert urlfilter.judge(df.where("false"), RULES).count() == 0


def judged(seen, held):
    """(share of the unwanted that is blocked, share of the blocked that is unwanted, share of the wanted that is blocked)."""
    model = urlfilter.fit(*zip(*seen, strict=True))
    said, truth = model.blocks([r[0] for r in held], [r[1] for r in held]) >= 0.5, np.array([r[2] == 1 for r in held])
    return (said & truth).sum() / truth.sum(), (said & truth).sum() / said.sum(), (said & ~truth).sum() / (~truth).sum()


def test_url_table_on_unseen_hosts():
    """Trained on the table, judged on the hosts of another draw of it, which no setting was chosen by."""
    seen, other = ([(*urlfilter.split_url(u), y) for u, y in urlfilter.labelled_urls(seed)] for seed in (17, 29))
    hosts = {r[0] for r in seen}
    hit, right, wrong = judged(seen, [r for r in other if r[0] not in hosts])
    assert len(seen) <= 4096 and hit >= 0.9 and right >= 0.95 and wrong <= 0.03


def test_url_table_on_unseen_words():
    """Neither the held-out words nor the hosts of the URLs that hold them are seen, and the URLs judged are of another draw; figures are in the README."""
    seen, other = ([(*urlfilter.split_url(u), y) for u, y in urlfilter.labelled_urls(seed)] for seed in (17, 29))
    found = []
    for fold in range(4):
        words = [w for w in urlfilter.TOPICS + urlfilter.WANTED if zlib.crc32(w.encode()) % 4 == fold]
        held = [r for r in other if any(w in r[0] + r[1] for w in words)]
        hosts = {r[0] for r in held}
        found.append(judged([r for r in seen if r[0] not in hosts and not any(w in r[0] + r[1] for w in words)], held))
    hit, right, wrong = np.mean(found, 0)
    print(hit, right, wrong)
    assert hit >= 0.3 and right >= 0.75 and wrong <= 0.15


def test_url_model_learns():
    rng = random.Random(4)
    make = lambda bad: (f"{'casino' if bad else 'news'}{rng.randrange(999)}.org", f"/{'win' if bad else 'story'}/{rng.randrange(99)}")
    rows = [(*make(i % 2), i % 2) for i in range(200)]
    model = urlfilter.fit(*zip(*[r for r in rows[:150]], strict=True))
    p = model.blocks([r[0] for r in rows[150:]], [r[1] for r in rows[150:]])
    assert ((p >= 0.5) == [r[2] == 1 for r in rows[150:]]).all()
    assert urlfilter.fit([], [], []).blocks(["a"], ["/"])[0] < 0.5


def test_toxicity(spark, empty):
    rng = random.Random(5)
    clean = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randrange(10, 120))]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = "vexgrr" + rng.choice(["a", "ot", "iz", "um", "!!"]) * rng.randrange(1, 3)
        rows.append((i, " ".join(words), i % 5 == 0))
    rows += [(10_000, None, False), (10_001, "", False), (None, "VEXGRRxx seen", True), (0, rows[0][1], True)]
    df = spark.createDataFrame([(i, t, "m", "c") for i, t, _ in rows], "doc_id long, text string, score string, toxic string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows[:900]] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.score(empty, labels.where("false")).count() == 0
    assert {r.predicted for r in toxicity.score(df, labels.where("false")).collect()} == {0}


def test_toxicity_scores_each_text_once(monkeypatch):
    model = toxicity.fit([b"fair words here", b"foul words here"] * 3, [0, 1] * 3)
    texts = [f"fair foul w{i}".encode() for i in range(300)]
    want = [model.odds([x])[0] for x in texts]
    calls, real = [], toxicity.split
    monkeypatch.setattr(toxicity, "split", lambda x, s: calls.append(1) or real(x, s))
    assert model.odds(texts).tolist() == want and len(calls) == len(texts)


@pytest.mark.parametrize("gap", ["", "_", ",", "/", "\u00a0", "\u3000"])
def test_toxicity_reads_long_words_whole(gap):
    rng = random.Random(9)
    clean, foul = ([chr(a + i) + chr(b + i) for i in range(0, n, 2)] for a, b, n in ((0x4E00, 0x5E00, 400), (0x6E00, 0x7E00, 20)))
    body = lambda n: [rng.choice(clean) for _ in range(n)]
    passage = lambda: [rng.choice(foul) for _ in range(20)]
    rows = [(gap.join(body(150) + (passage() if y else body(20)) + body(150)).encode(), int(y)) for y in [True, False] * 60]
    assert all(len(t.split()) == 1 for t, _ in rows)
    model = toxicity.fit([t for t, _ in rows[:80]], [y for _, y in rows[:80]])
    got = model.scores([t for t, _ in rows[80:]]) >= 0.3
    assert got.tolist() == [y == 1 for _, y in rows[80:]]


def test_pieces_hold_every_gram():
    s = toxicity.Settings()
    for n in [81, 82, 90, 96, 97, 1000]:
        word = "".join(chr(0x4E00 + i) for i in range(n))
        found = toxicity.split(f"x {word}, y".encode(), s)
        assert found[0] == b"x" and found[-1] == b"y" and all(len(x) <= 80 for x in found[1:-1])
        assert all(any(word[i : i + s.high] in x for x in found[1:-1]) for i in range(n - s.high + 1))


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path, length = tokenizer_file(), 64
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, length, group=20, with_ids=True).collect()
    plain = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in texts)
    own, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= length
        own[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, ids in plain:
        copies = plain[i, ids]
        pieces = sorted((r.start, r.length, tuple(r.ids)) for r in own[i])
        assert sum(n for _, n, _ in pieces) == copies * len(ids) and all(r.doc_tokens == len(ids) for r in own[i])
        assert all(ids[s : s + n] == x for s, n, x in pieces)
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r.length for r in rows)
    assert len(by_seq) * length < 1.25 * total
    assert packing.pack(empty, path).count() == 0


def test_first_fit_matches_a_scan():
    rng = np.random.default_rng(6)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1]
    bins, _ = packing.first_fit(lengths, 100)
    room = []
    for n, b in zip(lengths, bins, strict=True):
        first = next((i for i, r in enumerate(room) if r >= n), len(room))
        if first == len(room):
            room.append(100)
        room[first] -= n
        assert b == first


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    encode, tok = packing.encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    for text in [" " * 600_000, "\n" * 300_000 + "x", "a" * 300_000, "", "  a  b \n\n c", "don't I'LL 123 4.5", "日本語 ñandú 🙂🙂", "<|endoftext|> x", "a" * 3000, "\t\t x\u00a0y "]:
        assert list(encode(text)) == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, compression):
    bodies = ["<p>x</p>", "<p>x</p>", "", None, "é\r\n\r\nWARC/1.1", "big" * 50_000, "<p>x</p>", "one"]
    rows = [(i, None if i == 2 else f"http://h/{i}\r\nX: y", b) for i, b in enumerate(bodies)] + [(6, "again", "<p>x</p>"), (None, "u", "one"), (None, "u", "alone")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.archive(df, path, compression=compression)
    got = Counter(tuple(r) for r in warc.read_back(spark, path).collect())
    want = Counter()
    for i, _, b in rows:
        data = (b or "").encode()
        head = max((j for j, _, x in rows if (x or "") == (b or "") and j is not None), default=None)
        first = head is None or i == head
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else head] += 1
    assert got == want
    records = spark.read.format("warc").load(path)
    assert records.count() == len(rows) and records.where("record_type = 'metadata'").count() == 0
    assert spark.read.format("warc").load(path).where("target_uri = 'again'").count() == 1
    none = df.where("false")
    warc.archive(none, f"file://{tmp_path}/none")
    assert warc.read_back(spark, f"file://{tmp_path}/none").count() == 0


def test_damaged_archives_raise(tmp_path):
    data = warc.page_record(1, "http://h", "D", None, b"body" * 100)
    for name, bad in (("head", data[:60]), ("body", data[:-200]), ("junk", b"GET / HTTP/1.1\r\n\r\n")):
        (tmp_path / f"{name}.warc").write_bytes(bad)
        reader = warc.WarcReader({"path": f"file://{tmp_path}/{name}.warc"})
        with pytest.raises(ValueError):
            [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_warc_pushes_predicates(tmp_path):
    from pyspark.sql.datasource import EqualTo

    data = b"".join(warc.page_record(i, f"http://h/{i}", "D", 0, None if i % 2 else b"body") for i in range(6))
    (tmp_path / "a.warc").write_bytes(data)
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    list(reader.pushFilters([EqualTo(("record_type",), "revisit")]))
    seen = []
    plain = warc.Plain.block
    warc.Plain.block = lambda self, n: seen.append(n) or plain(self, n)
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        warc.Plain.block = plain
    assert [r["record_id"] for r in rows] == ["<urn:page:1>", "<urn:page:3>", "<urn:page:5>"] and len(seen) == 3


MASK = (1 << 64) - 1


def mixed_bits(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def boundaries(lines):
    """A new chunk begins before text line i where two were passed at least and the hash of the two before it is even; written from the definition, a line at a time."""
    text = [i for i, x in enumerate(lines) if x.strip()]
    starts, passed = ([0] if lines else []), 0
    if text and text[0] > 0:
        starts.append(text[0])
    for n in range(1, len(text) + 1):
        passed += 1
        if n >= 2:
            h = 0
            for i in text[n - 2 : n]:
                h = (h + linededup.xxhash.xxh3_64_intdigest(lines[i])) * 0x9E3779B97F4A7C15 & MASK
                h ^= h >> 29
            if mixed_bits(h) % 2 == 0 and passed >= 2 and n < len(text):
                starts.append(text[n])
                passed = 0
    return list(zip(starts, [*starts[1:], len(lines)], strict=True)) if lines else []


def brute_lines(texts):
    """(doc_id, lines, removed lines, what is left) of every row, in the order in which occurrences count."""
    seen, out = {}, []
    order = sorted(enumerate(texts), key=lambda x: (x[1][0] is None, x[1][0] or 0, linededup.xxhash.xxh3_64_intdigest((x[1][1] or "").encode()), x[0]))
    for row, (i, t) in order:
        lines, gone = (t.encode().split(b"\n") if t else []), set()
        for a, b in boundaries(lines):
            chunk = lines[a:b]
            while chunk and not chunk[-1].strip():
                chunk.pop()
            if sum(bool(x.strip()) for x in chunk) >= 2 and seen.setdefault(tuple(chunk), (row, a)) != (row, a):
                gone.update(range(a, b))
        out.append((i, len(lines), len(gone), b"\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return out


def test_lines(docs, texts, empty):
    want = brute_lines(texts)
    rows = Counter((i, n, gone, hashlib.sha256(left).hexdigest()) for i, n, gone, left in want)
    assert Counter(map(tuple, linededup.dedup_lines(docs).collect())) == rows
    assert sum(r[2] for r in rows) > 0
    out = linededup.without_repeats(docs)
    assert out.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in out.collect()) == Counter((i, left.decode()) for i, _, _, left in want)
    assert linededup.dedup_lines(empty).count() == 0 and linededup.without_repeats(empty).count() == 0


def test_lines_of_rows_that_repeat_id_and_text(spark):
    body = "\n".join(f"a line of its own {i}" for i in range(40))
    texts = [*[(1, body)] * 3, *[(None, body)] * 2, (2, "one\ntwo"), (2, "one\ntwo"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(i, t, n, {"a": [n]}) for n, (i, t) in enumerate(texts)], "doc_id long, text string, n int, `odd name: x` map<string,array<int>>").coalesce(1)
    want = Counter((i, n, gone, hashlib.sha256(left).hexdigest()) for i, n, gone, left in brute_lines(texts))
    assert Counter(map(tuple, linededup.dedup_lines(df).collect())) == want
    rows = linededup.without_repeats(df).collect()
    assert len(rows) == 9 and sum(r.text == body for r in rows) == 1 and {r.n for r in rows} == set(range(9)) and all(r["odd name: x"] == {"a": [r.n]} for r in rows)
    assert max(len(r.text) for r in rows if r.text != body) < len(body) / 4


def test_chunks_resist_shifts():
    rng = random.Random(7)
    lines = [f"line {rng.random()}".encode() for _ in range(200)]
    a = {b"\n".join(lines[x:y]) for x, y in linededup.chunks(lines)}
    moved = [b"new", *lines]
    b = {b"\n".join(moved[x:y]) for x, y in linededup.chunks(moved)}
    assert len(a & b) > 0.8 * len(a)


def test_lines_of_paragraphs_parted_by_blank_lines(spark):
    rng = random.Random(10)
    make = lambda n: [f"paragraph {rng.random()}" for _ in range(n)]
    shared = make(200)
    texts = ["\n\n".join([*make(3), *shared]), "\n\n".join([*make(4), *shared, *make(3)]), "\n\n".join(shared) + "\n \n"]
    out = linededup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kept = {r.doc_id: r.text for r in out}
    assert kept[0] == texts[0]
    for i in (1, 2):
        assert sum(x in shared for x in kept[i].split("\n")) < 0.1 * len(shared)
    assert all(x in kept[1].split("\n") for x in texts[1].split("\n") if x and x not in shared)


@pytest.mark.parametrize("text", ["", "\n", "\n\na", "a\n\nb\n\n", " \nx\n\ny\nz\n\t\nw", "a"])
def test_chunks_hold_every_line_once(text):
    lines = text.encode().split(b"\n") if text else []
    assert [i for a, b in linededup.chunks(lines) for i in range(a, b)] == list(range(len(lines)))


def water(sizes, weights, share, most):
    left, free, out = sum(sizes) * share, set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        w = sum(weights[i % len(weights)] for i in free)
        over = {i for i in free if left * weights[i % len(weights)] / w > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i % len(weights)] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def test_mixing(docs, texts, empty):
    rows = mixing.amounts(docs, block=16).collect()
    assert len(rows) == len(texts)
    names = sorted(["a", "b", "ü", "Z"], key=lambda s: s.encode()) + [None]
    pick = ["a", "b", None, "ü", "Z"]
    size, taken = Counter(), Counter()
    for i, t in texts:
        size[pick[(i or 0) % 5]] += len(WORD.findall(t or ""))
    target = dict(zip(names, water([size[n] for n in names], (3, 1, 2), 1.5, 2), strict=True))
    for r in rows:
        s = pick[(r.doc_id or 0) % 5]
        assert r.taken == sum(x.words for x in r.in_shards) and len({x.shard for x in r.in_shards}) == len(r.in_shards)
        assert r.source_size == size[s] and math.isclose(r.target, target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 32 for s in names)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.amounts(docs.repartition(5), block=16).collect()), key=str)
    out = mixing.mixed(docs, block=16)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.taken
    assert +words == +want
    assert mixing.amounts(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_shard_counts_are_multinomial_draws(spark):
    plan = spark.createDataFrame([(0, 50_000, 70_000), (1, 900, 640), (2, 5, 7), (3, 9, 0)], "rank int, blocks long, slots long")
    drawn = mixing.draws(plan, 16, 5).groupBy("rank", "shard").agg(F.sum("n").alias("n")).collect()
    total = Counter()
    for r in drawn:
        total[r["rank"]] += r["n"]
    assert total == {0: 70_000, 1: 640, 2: 7}
    for rank, n in ((0, 70_000), (1, 640)):  # chi-square with 15 degrees of freedom: neither far off nor too even
        counts = [r["n"] for r in drawn if r["rank"] == rank]
        assert 4 < sum((x - n / 16) ** 2 / (n / 16) for x in [*counts, *[0] * (16 - len(counts))]) < 38
    made = mixing.slots(plan, 16, 5, 3).collect()
    assert Counter((r["rank"], r.shard) for r in made) == {(r["rank"], r.shard): r["n"] for r in drawn}
    assert Counter(r["rank"] for r in made) == total and len({(r["rank"], r.slot) for r in made}) == len(made)
    assert set(Counter((r["rank"], r.block) for r in made if r["rank"] == 2).values()) == {1, 2}


def test_mix_tells_rows_apart_by_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text, "en", "a", {"k": 1}), (1, text, "fr", "a", {"k": 1}), (1, text, "fr", "a", {"k": 2}), (2, text, "en", "b", {}), (2, text, "en", "b", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, more map<string,int>")
    kept = mixing.mixed(df, weights=(1, 1), share=2.0, block=16).collect()  # every row twice
    assert Counter((r.doc_id, r.lang, r.source, r.more.get("k")) for r in kept if r.text == text) == {(1, "en", "a", 1): 2, (1, "fr", "a", 1): 2, (1, "fr", "a", 2): 2, (2, "en", "b", None): 4}


def test_permutation_of_huge_indices(spark):
    n = 10**15
    df = spark.range(20_000).selectExpr(f"id * {n // 20_000} as id", "cast(id % 50 as int) as k", f"{n}L as n")
    got = [r.id for r in mixing.permuted(df, "id", "n", ["k"], 9).collect()]
    assert all(0 <= x < n for x in got)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    df = mixing.permuted(spark.range(n).selectExpr("id", "cast(3 as int) k", f"{n}L n"), "id", "n", ["k"], 9)
    assert sorted(r.id for r in df.collect()) == list(range(n))


def test_matroska(docs, texts, empty):
    rows = matroska.digests(docs).collect()
    want = Counter()
    for i, t in texts:
        data = (t or "").encode()
        full = matroska.padded(data)
        assert len(full) % 64 == 0 and full and full.startswith(data)
        want[i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert matroska.digests(empty).count() == 0
    media = matroska.with_media(docs)
    packets = matroska.packets(media).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r.doc_id: r.n for r in packets.collect()}[1] == len(matroska.padded(texts[1][1].encode()))


@pytest.mark.parametrize("n", [1, 64, 512, 513, 4096, 5000, 300_000])
def test_mux_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = matroska.mux(payload)
    media = matroska.demux(data)
    assert matroska.samples(data, media) == payload and [c[2] for c in media.cues] == [data.index(b"\x1f\x43\xb6\x75", max(0, c[2])) for c in media.cues]
    assert data == matroska.mux(payload) and [p[1] for p in media.packets] == sorted(p[1] for p in media.packets)


def test_lacings():
    frames = [bytes([65 + i]) * n for i, n in enumerate([300, 20, 20, 700, 1])]
    xiph = b"\x81\x00\x00\x02" + bytes([4]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    ebml = b"\x81\x00\x00" + bytes([3 << 1]) + matroska.laced(frames)[1]
    for block in (xiph, ebml):
        spans = matroska.frames(block, 0, len(block))[3]
        assert [block[a:b] for a, b in spans] == frames
    with pytest.raises(ValueError):
        matroska.demux(matroska.element(matroska.SEGMENT, b"x" * 9)[:-3])


def test_live_stream_of_unknown_sizes():
    """Thousands of clusters without a size, each ended by the next; a second stream follows the first."""
    unknown = b"\xff"
    cluster = lambda n: (0x1F43B675).to_bytes(4, "big") + unknown + matroska.uint(matroska.TIMECODE, n) + matroska.element(matroska.SIMPLE, b"\x81\x00\x00\x80" + bytes([n % 251]))
    stream = (0x18538067).to_bytes(4, "big") + unknown + matroska.element(matroska.INFO, matroska.uint(matroska.SCALE, 1_000_000)) + b"".join(map(cluster, range(5000)))
    for data, n in ((stream, 5000), (stream + matroska.element(matroska.EBML, b"") + stream, 10_000)):
        media = matroska.demux(data)
        assert len(media.clusters) == len(media.packets) == n and [p[1] for p in media.packets[:5000]] == list(range(5000))
        assert matroska.samples(data, media) == bytes(i % 251 for i in range(5000)) * (n // 5000)


def test_damaged_media_are_rows_of_their_own(spark):
    good = matroska.mux(bytes(range(64)))
    rows = [(1, good), (2, good[:-3]), (3, b"\x00" * 9), (4, None), (5, b""), (1, good)]
    got = matroska.packets(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, media binary, error string")).collect()
    assert Counter((r.doc_id, r.error is None) for r in got) == Counter({(1, True): 2, (2, False): 1, (3, False): 1})


def brute_repeats(texts, window):
    rows = [(i if i is not None else float("inf"), n, WORD.findall(t or "")) for n, (i, t) in enumerate(texts)]
    first = {}
    for i, _, w in rows:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, _, w in rows:
        gone, own = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first[k] < i or k in own:
                gone.update(range(s, s + window))
            own.add(k)
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((None if i == float("inf") else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring(docs, texts, empty):
    got = substring.remove_repeats(docs).drop("kept_text").collect()
    assert Counter(map(tuple, got)) == brute_repeats(texts, 20)
    assert substring.remove_repeats(empty).count() == 0


def test_substring_of_few_words(spark):
    rng = random.Random(12)
    texts = [(rng.choice([i, i, i, None]), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    texts += [(200 + i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 60)))) for i in range(60)] + [(300, "a " * 500), (301, "a " * 400 + "b")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = substring.remove_repeats(df, window=5, gram=2).drop("kept_text").collect()
    assert Counter(map(tuple, got)) == brute_repeats(texts, 5)


def test_extension_goes_both_ways():
    a, b = b"x p q r s t y".split(), b"u v p q r s t".split()
    assert substring.extended(a, 3, b, 4) == (1, 6)
    assert substring.extended(a, 0, b, 4) == (0, 0)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)] + [(200, None, "en", None, None), (201, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, names = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        names.append({r.doc_id for r in docs.collect()})
    assert names[1] == {r[0] for r in rows} and names[2] == {r[0] for r in rows} - set(range(100, 105))
    kept = Counter(" ".join(r.text.split()) for r in docs.collect() if r.text and r.text.split())
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    from tokenizers import Tokenizer

    tok, texts, by_doc = Tokenizer.from_file(tokenizer_file()), Counter(), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id, r.sequence_id, r.offset].append(r)
    for rows in by_doc.values():
        for r in rows:
            if r.start == 0 and r.length == r.doc_tokens:
                texts[" ".join(tok.decode(r.ids[:-1]).split())] += 1
    assert texts and not texts - kept  # the pieces hold the texts that the mix gave


def test_warc_archives_are_added_and_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    page = lambda *ids: spark.createDataFrame([(i, f"http://x/{i}", f"html {i}") for i in ids], "page_id long, url string, html string")
    warc.archive(page(1, 2), path)
    warc.archive(page(3), path, compression="none")
    assert sorted(r.page_id for r in warc.read_back(spark, path).collect()) == [1, 2, 3]
    rows = page(7).select("page_id", "url", F.lit("D").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.encode("html", "UTF-8").alias("payload"))
    rows.write.format("warc").mode("overwrite").option("path", path).save()
    assert [r.page_id for r in warc.read_back(spark, path).collect()] == [7] and len(list((tmp_path / "w").glob("*.warc*"))) == 1


def test_full_pieces_stay_out_of_the_groups(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "a b"), (2, "a b"), (None, None), (3, long[:9000])], "doc_id long, text string")
    rows = packing.pack(df, tokenizer_file(), with_ids=True).collect()
    full = [r for r in rows if r.length == 1024]
    assert len(full) > 500 and len({r.sequence_id for r in full}) == len(full) and all(r.sequence_id < 0 and r.offset == 0 for r in full)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] for x in by.values())
    assert sorted(i for r in rows if r.doc_id == 1 for i in range(r.start, r.start + r.length)) == list(range(next(r.doc_tokens for r in rows if r.doc_id == 1)))
