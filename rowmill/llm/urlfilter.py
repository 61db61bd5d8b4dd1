"""URL verdicts: rules on host and path first, then logistic regression on hashed character n-grams.

The regression is trained in numpy from a small labelled URL table (``labelled_urls``, or one that is
given, of which at most ``most`` rows are used) and holds ``2 ** bits`` weights, so what goes to the
executors has a fixed size.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What unwanted sites are about, how they praise it, and words of other sites. Lists for the labelled table.
TOPICS = (
    "casino poker bets betting slots jackpot roulette lottery bingo blackjack wager sportsbook pokies pills pharma meds viagra cialis xanax steroids painkiller "
    "diet-pills loans payday credit cash money crypto forex binary-options profits giveaway prize replica watches handbags sneakers warez torrent cracked keygen "
    "serials nulled cheats porn xxx escort nude camgirls adult hookup webcam milf fetish malware phishing hacked botnet scam essay-writing followers backlinks"
).split()
PRAISE = "free cheap win best bonus online vip hot fast easy instant lucky top super mega deal double discount no-id no-deposit guaranteed secret 24 365 777 4u xtra buy get earn order unlimited real".split()
WANTED = (
    "news library museum school college university science history garden kitchen recipes travel weather sports football music theatre cinema books poetry health "
    "clinic hospital law council transport railway map forum wiki docs software hardware photo craft family farm bakery church parish society archive gallery "
    "observatory physics chemistry biology maths language grammar dictionary insurance bank tax housing energy water forest river mountain island harbour airport"
).split()
NEUTRAL = "my the our city north south old new open local national royal hub lab blog portal group house works today free best online top real fast 24 2000".split()
ENDS, LANGS = ("com", "org", "net"), ("en", "de", "fr", "es")


def labelled_urls(seed: int = 17, times: int = 20) -> list[tuple[str, int]]:
    """The small labelled URL table (url, blocked), made by a rule: each topic and each other word ``times`` times, and as many invented names.

    Both kinds have the same ends, subdomains, languages, numbers and queries, and share words of praise; what tells them apart are
    the words of a host, or, on a host of either kind's neutral names, those of its path.
    """
    rng, out = random.Random(seed), []
    heads, tails = ("", *"bcdfghklmnprstvwz", "th", "sh", "ch", "st", "tr", "pl"), ("", "", "n", "r", "s", "l", "t", "ng", "nd", "st", "ck", "ble")
    invented = lambda: "".join(rng.choice(heads) + rng.choice("aeiou") + rng.choice(tails) for _ in range(rng.randint(1, 4)))

    def put(words: list[str], blocked: int, in_path: bool) -> None:
        name = rng.choice(("-", "", "-")).join(words)
        host = invented() if in_path else name
        host = rng.choice(("", "", "www.", "m.", "blog.")) + host + rng.choice(("", ".example", ".example")) + "." + rng.choice(ENDS)
        page = rng.choice((f"{name}.html", f"{name}/", f"{name}-{rng.randrange(99)}")) if in_path else rng.choice((f"{rng.randrange(9999)}", f"{rng.randrange(9999)}.html", f"{rng.randrange(9999)}/", f"{invented()}/{rng.randrange(99)}"))
        out.append((f"{rng.choice(('http', 'https'))}://{host}/{rng.choice(LANGS)}/{page}{rng.choice(('', '', '?page=2&ref=x', '?utm_source=feed', '#top'))}", blocked))

    def mixed(word: str, others: list[str]) -> list[str]:
        words = [word, *rng.sample(others, rng.choice((0, 1, 1, 2)))]
        rng.shuffle(words)
        return words

    for _ in range(times):
        for word in TOPICS:
            put(mixed(word, PRAISE if rng.random() < 0.85 else NEUTRAL), 1, rng.random() < 0.2)
        for word in WANTED:
            put(mixed(word, NEUTRAL), 0, rng.random() < 0.2)
            put([invented()], 0, rng.random() < 0.2)
    return out


def split_url(url: str) -> tuple[str, str]:
    """``host_and_path`` of one text."""
    rest = url.partition("://")[2]
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends, default=len(rest))]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int
    sizes: tuple[int, ...]

    def blocks(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        out = np.empty(len(hosts))
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            at = features(host, path, self.bits, self.sizes)
            out[i] = self.weights[at].sum() / max(1.0, len(at)) ** 0.5 + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def features(host: str, path: str, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Buckets of the distinct n-grams; host and path have their own, with marked ends."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            found.update(kind + text[i : i + n] for i in range(len(text) - n + 1))
    mask = (1 << bits) - 1
    return np.fromiter({zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in found}, np.int64)


def fit(hosts: list[str], paths: list[str], blocked: list[int], bits: int = 16, sizes: tuple[int, ...] = (2, 3, 4), epochs: int = 400, rate: float = 0.5, decay: float = 1e-6) -> UrlModel:
    """Full-batch Adagrad; without rows or with one label, that label's share is the answer (no rows: allow)."""
    rows = [features(h, p, bits, sizes) for h, p in zip(hosts, paths, strict=True)]
    y = np.asarray(blocked, float)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-3
    w, bias = np.zeros(1 << bits), float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.concatenate(rows)
        scale = 1 / np.sqrt(np.array([max(1, len(r)) for r in rows]))
        each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels weigh alike
        past, past_b = np.full(len(w), 1e-8), 1e-8
        for _ in range(epochs):
            z = np.bincount(owner, w[at], len(y)) * scale + bias
            err = (1 / (1 + np.exp(-z)) - y) * each
            g = np.bincount(at, (err * scale)[owner], len(w)) + decay * w
            past += g * g
            w -= rate * g / np.sqrt(past)
            past_b += err.sum() ** 2
            bias -= rate * err.sum() / past_b**0.5
    return UrlModel(w, bias, bits, sizes)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/ ? #``, A-Z lower-cased; path: from there to ``? #``. Both empty without ``://`` or url."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule: (``allow``/``block``, ``host/path``)."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, most: int = 4096) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (only page_id and url are read).

    ``labelled`` (url string, blocked int; nulls are left out) trains the model that decides where no rule fits; of it the
    ``most`` rows of smallest url hash are used. Without it, ``labelled_urls`` does. A null or odd url
    has empty host and path, which the model judges like any other. Repeated rows get equal verdicts;
    an empty table gives an empty result.
    """
    if labelled is None:
        known = labelled_urls()
    else:
        rows = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int")).distinct()
        known = [tuple(r) for r in rows.orderBy(F.xxhash64("url"), "url", "blocked").limit(most).collect()]
    model = fit([split_url(x)[0] for x, _ in known], [split_url(x)[1] for x, _ in known], [y for _, y in known])

    @F.pandas_udf("boolean")
    def blocked(host: pd.Series, path: pd.Series) -> pd.Series:
        open_ = host.notna()  # a rule has decided the others
        out = pd.Series(False, index=host.index)
        out[open_] = model.blocks(host[open_].tolist(), path[open_].tolist()) >= 0.5
        return out

    table = pages.select("page_id", "url").withColumns(dict(zip(("host", "path"), host_and_path(F.col("url")), strict=True)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    table = table.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    by_model = F.when(blocked(F.when(F.col("rule").isNull(), F.col("host")), F.col("path")), F.lit("block")).otherwise(F.lit("allow"))
    return table.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"))
