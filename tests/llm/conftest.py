import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands array<int>, node string, key int, hash string"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages and lines, nulls, empty, odd and long texts, a null id."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ñandú", "don't", "x\u00a0y"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, lines = words(35), [" ".join(words(6)) for _ in range(6)]
    rows, base = [], words(80)
    for i in range(12):  # a chain of near copies
        rows.append(" ".join(base))
        base = list(base)
        base[rng.randrange(80)] = "edit"
    for i in range(10):
        body = words(rng.randrange(30, 120))
        at = rng.randrange(len(body))
        rows.append(" ".join(body[:at] + passage + body[at:]))
    for i in range(8):
        rows.append("\n".join([" ".join(words(5)), *lines, " ".join(words(5 + i))]))
    rows += [None, "", "   \n\t ", "one", "one two", "One TWO", " ".join(["a"] * 60), "\n".join(["same line here"] * 9), " ".join(words(4000))]
    rows += rows[:3] + ["mixed   blanks\there\n\nand " + " ".join(passage)]
    out = list(enumerate(rows))
    return [*out, (None, rows[0]), out[5]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    sources = ["a", "b", None, "ü", "Z"]
    rows = [(i, t, "en", sources[(i or 0) % 5], None if t is None else len(t), [1], "n", 1, "h") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
