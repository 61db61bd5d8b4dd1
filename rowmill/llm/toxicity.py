"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (runs of UTF-8 bytes, with marked ends) and itself, hashed into ``2 ** bits``
buckets; each bucket has a vector of ``dim`` numbers. A text is the mean of its words' vectors, fed to
a two-way softmax. Vectors and softmax are trained jointly in numpy. Only buckets that toxic and clean
training texts hold in clearly different shares (``apart``) have a vector other than zero, so that rare n-grams
are not learnt by heart; n-grams that only a few toxic texts hold therefore say nothing, which is what limits
unseen misspellings. Those that share n-grams with what was seen share their vectors. A word of more than ``LONG`` signs, as texts without white space are, is cut into overlapping
pieces that count as words; every n-gram lies in one of them.

Training runs in one task on an executor, over a sample bounded in rows and bytes; the driver sees
only the buckets that count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.shared import each_batch, give_back, gram_hashes, map_batches, scramble, utf8


@dataclass(frozen=True)
class Settings:
    """apart: standard errors between the shares of toxic and clean texts that hold a bucket, at least; of several, ``fit`` takes
    what does best on texts left out, since more texts make chance differences pass a low bar; sample: labelled texts of
    each class that training takes at most, those of smallest hash; longest: bytes of a training text at most; folds: parts of the
    training texts for the cut and the bar. ``bits``, ``high`` and ``steps`` were chosen by cross-validation inside the training rows.
    """

    dim: int = 4
    bits: int = 20
    low: int = 3
    high: int = 5
    apart: tuple[float, ...] = (5, 6, 7, 8)
    steps: int = 60
    rate: float = 0.1
    decay: float = 1e-3
    sample: int = 3000
    longest: int = 20_000
    folds: int = 3
    threshold: float = 0.3
    seed: int = 11


def bags(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word after word, and where each word's begin: its n-grams of ``low`` to ``high`` UTF-8 bytes, and itself."""
    marked = [f"<{w}>".encode() for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))  # bytes to the word's end
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, marked), np.uint64, len(marked))
    found, of = [own], [np.arange(len(marked))]
    for n in range(s.low, s.high + 1):
        whole = np.flatnonzero(left >= n)
        found.append(gram_hashes(text, n)[whole] + np.uint64(n))
        of.append(owner[whole])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    table = (scramble(np.concatenate(found)) >> np.uint64(64 - s.bits)).astype(np.int32)[order]
    return table, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(marked)))])


def many_bags(words: list[str], s: Settings, step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """``bags`` a part at a time, as its working memory is many times its result."""
    parts = [bags(words[i : i + step], s) for i in range(0, len(words), step)]
    if not parts:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([table for table, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


LONG = 80


def plain(word: bytes | str) -> str:
    """Lower-cased, without punctuation at the ends; a piece is plain already."""
    return word if isinstance(word, str) else word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}<>*_-")


def split(text: bytes | None, s: Settings) -> list[bytes | str]:
    """The words between ASCII white space, as they are; instead of a long one its pieces, plain."""
    words = (text or b"").split()
    if max(map(len, words), default=0) <= LONG:  # no word has more signs than bytes
        return words
    return [x for w in words for x in (pieces(w, s) if len(w) > LONG else [w])]


def pieces(word: bytes, s: Settings) -> list[bytes | str]:
    """Stretches of four times the longest n-gram that overlap by the longest n-gram; the word itself, if it is not long."""
    w = plain(word)
    return [w[i : i + 4 * s.high] for i in range(0, len(w) - s.high, 3 * s.high)] if len(w) > LONG else [word]


#: What a Python worker knows of the last model's words; kept from task to task, and emptied when it is full.
KNOWN: dict[int, dict[bytes | str, float]] = {}


def known_words(key: int, most: int = 100_000) -> dict[bytes | str, float]:
    if key not in KNOWN or len(KNOWN[key]) > most:
        KNOWN.clear()
        KNOWN[key] = {}
    return KNOWN[key]


class Model:
    """at, gain: the buckets that count, sorted, and what each adds to the log odds."""

    def __init__(self, at: np.ndarray, gain: np.ndarray, bias: float, s: Settings):
        self.at, self.gain, self.bias, self.s = at, gain, bias, s
        self.key = xxhash.xxh3_64_intdigest(at.tobytes() + gain.tobytes())

    def __getstate__(self):
        return self.at, self.gain, self.bias, self.s, self.key

    def __setstate__(self, state):
        self.at, self.gain, self.bias, self.s, self.key = state

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.s.bits)
        out[self.at] = self.gain
        return out

    def learn(self, words: set[bytes | str], known: dict[bytes | str, float], step: int = 10_000) -> None:
        """Words' vectors seen from the softmax: one number each, as both are linear. Spellings that differ in case or punctuation share it; null where nothing is left."""
        new = list(words)
        bare = [plain(w) for w in new]
        names = list({*bare} - {""})
        value: dict[str, float] = {"": np.nan}
        gain = self.table()
        for i in range(0, len(names), step):
            table, at = bags(names[i : i + step], self.s)
            value |= zip(names[i : i + step], (np.add.reduceat(gain[table], at[:-1]) / np.diff(at)).tolist(), strict=True)
        known.update(zip(new, map(value.__getitem__, bare), strict=True))

    def odds(self, texts: list[bytes | None], step: int = 64) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), step):
            parts = [split(t, self.s) for t in texts[lo : lo + step]]
            known = known_words(self.key)
            if new := set().union(*parts).difference(known):
                self.learn(new, known)
            for i, words in enumerate(parts, lo):
                x = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                x = x[~np.isnan(x)]
                out[i] = x.mean() if len(x) else 0.0
        return out + self.bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(texts), -30, 30)))


class Inputs:
    """Training texts as buckets: what each one's mean gives to every bucket, and which buckets each text holds."""

    def __init__(self, texts: list[bytes], s: Settings):
        self.s, ids = s, {}
        docs = [np.array([ids.setdefault(w, len(ids)) for t in split(text, s) if (w := plain(t))], np.int32) for text in texts]
        self.table, self.at = many_bags(list(ids), s)
        self.size = np.diff(self.at)
        self.words = [np.unique(doc, return_counts=True) for doc in docs]
        self.total = np.array([max(1, len(doc)) for doc in docs])
        held = [np.unique(self._flat(words, self.table, self.at)[0]) for words, _ in self.words]
        self.held, self.holder = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])

    @staticmethod
    def _flat(words: np.ndarray, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' buckets, word after word, and how many each word has."""
        n = at[words + 1] - at[words]
        return table[np.arange(n.sum()) + np.repeat(at[words] - (np.cumsum(n) - n), n)], n

    def telling(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Of each bucket, how many standard errors its shares among the toxic and the clean texts in ``use`` are apart."""
        some, m = use[self.holder], 1 << self.s.bits
        toxic = np.bincount(self.held[some], y[self.holder[some]], m)
        clean = np.bincount(self.held[some], 1 - y[self.holder[some]], m)
        n1, n0 = y[use].sum(), (1 - y[use]).sum()
        both = (toxic + clean) / (n1 + n0)
        error = np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
        return np.abs(toxic / n1 - clean / n0) / np.maximum(error, 1e-12)

    def of(self, tells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, weight) of the buckets that tell: the share of a text's mean that is the bucket's vector."""
        kept = tells[self.table]
        at, table = np.concatenate([[0], np.cumsum(kept)])[self.at], self.table[kept]
        of, buckets, weight = [], [], []
        for i, (words, times) in enumerate(self.words):
            found, n = self._flat(words, table, at)
            buckets.append(found)
            weight.append(np.repeat(times / self.size[words], n) / self.total[i])
            of.append(np.full(len(found), i))
        return np.concatenate(of), np.concatenate(buckets), np.concatenate(weight)


def _descend(of: np.ndarray, own: np.ndarray, x: np.ndarray, m: int, y: np.ndarray, use: np.ndarray, s: Settings) -> np.ndarray:
    """Adagrad over all texts in ``use`` at once, classes weighing alike: what each of ``m`` buckets adds to the log odds."""
    n = len(y)
    rng = np.random.default_rng(s.seed)
    vectors, softmax, bias = np.zeros((m, s.dim)), rng.normal(0, 0.3, (2, s.dim)), np.zeros(2)
    past, past_s, past_b = np.full(m, 1e-8), 1e-8, 1e-8
    each = np.where(use, np.where(y == 1, 0.5 / y[use].sum(), 0.5 / (1 - y[use]).sum()), 0.0)
    for _ in range(s.steps):
        means = np.stack([np.bincount(of, vectors[own, j] * x, n) for j in range(s.dim)], 1)
        logits = means @ softmax.T + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        err = p * each[:, None]
        pull = np.stack([np.bincount(own, err[of, k] * x, m) for k in (0, 1)], 1)
        grad_v, grad_s, grad_b = pull @ softmax + s.decay * vectors, err.T @ means + s.decay * softmax, err.sum(0)
        past += (grad_v * grad_v).sum(1)
        vectors -= s.rate * grad_v / np.sqrt(past)[:, None]
        past_s += (grad_s * grad_s).sum()
        softmax -= s.rate * grad_s / np.sqrt(past_s)
        past_b += (grad_b * grad_b).sum()
        bias -= s.rate * grad_b / np.sqrt(past_b)
    return vectors @ (softmax[1] - softmax[0])


def _learnt(inputs: Inputs, y: np.ndarray, use: np.ndarray, s: Settings, apart: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """From the texts in ``use``: the buckets that count, what each adds, and the log odds of all texts without a bias; None where nothing tells the classes apart."""
    if not 0 < y[use].sum() < use.sum():
        return None
    of, buckets, weight = inputs.of(inputs.telling(y, use) > apart)
    used = np.flatnonzero(np.bincount(buckets, use[of], 1 << s.bits)) if len(of) else np.empty(0, np.int64)
    if not len(used):
        return None
    number = np.full(1 << s.bits, -1)
    number[used] = np.arange(len(used))
    known = number[buckets] >= 0
    of, own, weight = of[known], number[buckets[known]], weight[known]  # buckets, numbered anew
    scale = 1 / np.sqrt(np.bincount(own, weight * weight * use[of], len(used)) / use.sum())  # every bucket's input gets about the same spread
    gain = _descend(of, own, weight * scale[own], len(used), y, use, s) * scale
    return used, gain, np.bincount(of, gain[own] * weight, len(y))


def fit(texts: list[bytes], toxic: list[int], s: Settings = Settings(), stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of all texts, with a cut between the classes that is found on texts which the models asked have not seen.

    stands_for: how many labelled texts a clean and a toxic one of ``texts`` stand for, for the cut. Each of ``folds`` parts of the texts (by their hash) gets its log odds from a model of the others. Where there are
    not both classes, or nothing tells them apart, the score is the share of toxic texts.
    """
    y = np.asarray(toxic, int)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
    constant = Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))), s)
    if not 0 < y.sum() < len(y):
        return constant
    inputs, weight = Inputs(texts, s), np.asarray(stands_for)[y]
    fold = np.array([xxhash.xxh3_64_intdigest(t, seed=s.seed) % s.folds for t in texts])
    best = None
    for apart in s.apart:
        odds, whole = np.zeros(len(y)), True
        for k in np.unique(fold):
            left = _learnt(inputs, y, fold != k, s, apart)
            whole &= left is not None
            odds = odds if left is None else np.where(fold == k, left[2], odds)
        f1, cut = _cut(odds, y, weight)
        if best is None or (whole, f1) >= best[:2]:
            best = whole, f1, cut, apart
    whole, _, cut, apart = best
    found = _learnt(inputs, y, np.ones(len(y), bool), s, apart)
    if found is None:
        return constant
    used, gain, odds = found
    cut = cut if whole else _cut(odds, y, weight)[1]  # too few texts to leave some out
    shift = float(np.log(s.threshold / (1 - s.threshold)))
    return Model(used.astype(np.int64), gain, shift - cut, s)


def _cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(F1, the log odds that part the classes best): the middle of the widest of the cuts with the highest F1 of the texts by ``weight``."""
    order = np.argsort(z)
    z, toxic, weight = z[order], weight[order] * y[order], weight[order]
    above = lambda x: x.sum() - np.concatenate([[0], np.cumsum(x)])
    f1 = 2 * above(toxic) / np.maximum(1e-12, above(weight) + toxic.sum())
    top = np.flatnonzero(f1[1:-1] >= f1[1:-1].max() - 1e-9) + 1 if len(y) > 1 else np.array([0])
    gaps = [z[i] - z[i - 1] for i in top]
    i = int(top[int(np.argmax(gaps))])
    return float(f1[i]), float((z[i] + z[i - 1]) / 2)


def trained(docs: DataFrame, labels: DataFrame, s: Settings) -> Model:
    """The model of at most ``sample`` texts of each class, those of smallest hash, whose crc32(doc_id) mod 4 is not 2.

    One task on an executor trains; what comes back are the buckets that count, ``2 ** bits`` at most.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [usable.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample) for k in (0, 1)]
    known = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows
    stands_for = tuple(max(1.0, known.get(k, 0) / s.sample) for k in (0, 1))
    picked = F.broadcast(ids[0].union(ids[1]).selectExpr("doc_id as _id", "toxic as _toxic"))  # 2 * sample rows at most
    got = docs.select("doc_id", "text").where(f"text is not null and octet_length(text) <= {s.longest}").join(picked, F.col("doc_id") == F.col("_id"))
    got = got.groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))

    def run(batches):
        rows = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("text", pa.string())])).sort_by("doc_id")
        model = fit(utf8(rows["text"].combine_chunks()), rows["toxic"].to_pylist(), s, stands_for)
        del rows
        yield pa.RecordBatch.from_arrays([pa.array([model.at]), pa.array([model.gain]), pa.array([model.bias])], names=["at", "gain", "bias"])
        give_back()

    made = got.select(F.col("doc_id").cast("long"), F.col("_toxic").cast("int").alias("toxic"), "text").coalesce(1).mapInArrow(run, "at array<long>, gain array<double>, bias double")
    rows = made.collect()
    if not rows:  # an empty input may have no part to run in
        return fit([], [], s)
    at, gain, bias = rows[0]
    return Model(np.array(at, np.int64), np.array(gain), bias, s)


def score(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from ``labels`` (doc_id, toxic; other columns unused) outside the held-out fourth. A null or
    empty text scores as one without words; a null doc_id is never held out. Equal texts score alike.
    Labels that are null or neither 0 nor 1 are left out; a document labelled both ways counts as 1.
    """
    model = trained(docs, labels, s)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.scores(utf8(batch.column("text"))))], names=["doc_id", "score"])

    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)")
    return out.select("doc_id", held.alias("held_out"), "score", F.expr(f"int(score >= {s.threshold})").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns; texts stay in place, no shuffle.

    Null and empty texts score as texts without words, which are clean unless nearly all training
    texts are toxic. Repeated rows go or stay together; an empty table gives an empty one. Columns of
    ``docs`` of any name are kept as they are.
    """
    model = trained(docs, labels, s)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(utf8(batch.column("text"))) < s.threshold))

    return docs.mapInArrow(each_batch(run), docs.schema)


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
