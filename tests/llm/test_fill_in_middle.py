"""Fill-in-the-middle: rank and select against plain counts, rows against plain Python, exact restoration."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm.fill_in_middle import Boundaries, cut, fill_in_middle, restored


@pytest.mark.parametrize("size,share", [(0, 0.5), (1, 1.0), (63, 0.5), (64, 0.5), (512, 1.0), (513, 0.1), (5000, 0.01), (5000, 0.9), (1024, 0.0)])
def test_rank_and_select(size, share):
    marks = np.random.default_rng(size).random(size) < share
    bounds = Boundaries(marks)
    ones = np.flatnonzero(marks)
    assert bounds.total == len(ones)
    places = np.arange(size + 1)
    assert bounds.rank(places).tolist() == [int(marks[:i].sum()) for i in places]
    assert bounds.select(np.arange(len(ones) + 1)).tolist() == [*ones.tolist(), size]


@pytest.mark.parametrize("unit", ["char", "line"])
def test_cut(unit):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "語", "😀", "\n", "é"]) for _ in range(rng.choice([0, 0, 1, 2, 9, 700]))) for _ in range(300)]
    first, second = (np.array([rng.randrange(2**32) for _ in texts]) for _ in range(2))
    n, lo, hi, x, y = cut([t.encode() for t in texts], first, second, unit)
    for k, t in enumerate(texts):
        units = list(t) if unit == "char" else t.split("\n") if not t.endswith("\n") else t.split("\n")[:-1]
        if unit == "line":
            units = [u + "\n" for u in units[:-1]] + [units[-1] + "\n" * t.endswith("\n")] if t else []
        a, b = sorted((int(first[k]) % (len(units) + 1), int(second[k]) % (len(units) + 1)))
        assert (n[k], lo[k], hi[k]) == (len(units), a, b)
        assert t.encode()[: x[k]].decode() == "".join(units[:a]) and t.encode()[x[k] : y[k]].decode() == "".join(units[a:b])


def plain(key, text):
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    t = text or ""
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def check(docs):
    rows = fill_in_middle(docs).withColumn("again", restored(F.col("fim"))).collect()
    assert sorted(rows[0].asDict()) == sorted({*docs.columns, "fim", "again"}) if rows else True
    for r in rows:
        assert tuple(r["fim"]) == plain(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    return rows


def test_rows(docs, odd_docs, no_docs):
    rows = check(docs)
    assert {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert len(check(odd_docs)) == odd_docs.count() and check(no_docs) == []


def test_marks_and_half_marks(spark):
    parts = ["<", "P", "S", "M", ">", "<P", "<S", "P>", "S>", "M>", "<M>", "é", "<P>"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert any(r["fim"]["form"] != "plain" and "<" in r["text"] for r in rows)


def test_clashing_names_and_long_texts(spark):
    text = "é語x\n" * 2_000_000
    docs = spark.createDataFrame([(k, text, 1, "n", "f`o", "o") for k in range(3)], "doc_id long, text string, fim int, n string, `f``orm` string, output string")
    rows = fill_in_middle(docs).select("n", "`f``orm`", F.col("fim")["n"].alias("units"), F.sha2(restored(F.col("fim")), 256).alias("sha")).collect()
    assert {tuple(r) for r in rows} == {("n", "f`o", 8_000_000, hashlib.sha256(text.encode()).hexdigest())}


def test_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    forms = {r["form"]: r["count"] for r in fill_in_middle(docs, rate=50, suffix_first=100).groupBy(F.col("fim")["form"].alias("form")).count().collect()}
    assert set(forms) == {"plain", "spm"} and 1800 < forms["spm"] < 2200
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="word")
