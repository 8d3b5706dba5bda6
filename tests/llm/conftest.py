import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, words int, n long, doc long, part string, unit string, score string, stratum int, fp string, block string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ",", "é"]) for _ in range(n)]


def sample_texts():
    """Texts with shared passages, copies, near copies, repeats, odd white space and edge cases."""
    rng = random.Random(4)
    passage = words(rng, 45)
    texts = [None, "", " \n\t ", "one", "two words", "Ünïcödé \x0b tab\tand\r\nlines", "x" * 5000, "the " * 300, "a b " * 200, "\x1c\x85  not ascii space"]
    for k in range(60):
        body = words(rng, rng.choice([3, 15, 30, 80, 200]))
        if k % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[: rng.choice([19, 20, 21, 45])]
        texts.append(rng.choice([" ", "\n"]).join(body))
    texts.append(" ".join(words(rng, 30_000, 20_000)))
    long = texts[-1].split(" ")
    texts.append(" ".join(long[5000:5100] + words(rng, 50)))
    base = words(rng, 300)
    for k in range(12):  # near copies
        copy = list(base)
        copy[k * 20] = f"changed{k}"
        texts.append(" ".join(copy))
    texts += [texts[20], texts[20], texts[21]]  # exact copies
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i * 3 + 1, t, ["en", "de", None, "fr"][i % 4], ["big", "big", "big", "small", None][i % 5], None if t is None else len(t)) for i, t in enumerate(sample_texts())]
    extra = ("x", "y", 1, 2, 3, "p", "u", "s", 4, "f", "b")
    return spark.createDataFrame([r + extra for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids, and rows that repeat wholly."""
    extra = ("x", "y", 1, 2, 3, "p", "u", "s", 4, "f", "b")
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (5, "another " + text), (7, None), (7, None), (None, None), (8, text + " end")]
    return spark.createDataFrame([(i, t, "en", "s", 0) + extra for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
