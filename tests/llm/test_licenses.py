"""Licence scans against brute force and SQL."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA, differences, duck
from waymark.llm.licenses import TEMPLATES, anchors, key_words, scan_licenses, sizes_for
from waymark.llm.queries import ORACLES, op10_licenses


def words_of(text):
    return re.sub("[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).strip(" ").split(" ")


def pairs(text):
    words = words_of(text)
    return set(zip(words, words[1:]))


def coefficient(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0


def plain(rows, dice=0.8):
    out, windows = [], set()
    for i, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        for at, unit in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
            for name, t in TEMPLATES.items():
                if coefficient(pairs(unit), pairs(t)) >= dice:
                    out.append((i, at, None, name))
        words = words_of(text)
        for name, t in TEMPLATES.items():
            size, places = len(words_of(t)), anchors(t, dice)
            starts = {max(0, at - place) for at, p in enumerate(zip(words, words[1:])) for pair, place in places if " ".join(p) == pair}
            fit = {s: c for s in starts if (c := coefficient(set(zip(words[s : s + size], words[s + 1 : s + size])), pairs(t))) >= dice}
            windows |= {(i, text, name, s) for s, c in fit.items() if all((c, -s) >= (o, -r) for r, o in fit.items() if abs(r - s) < size)}
    return sorted(out + [(i, -2, s, name) for i, _, name, s in windows], key=repr)


def wrapped(text, width=9):
    words = text.split(" ")
    return "\n".join(" * " + " ".join(words[k : k + width]) for k in range(0, len(words), width))


TEXTS = [
    *TEMPLATES.values(),
    *(t.upper() for t in TEMPLATES.values()),
    *("Intro line.\n" + t + "\nand more" for t in TEMPLATES.values()),
    *("#!/bin/sh\n/* Copyright by some of us\n" + wrapped(t) + " */\nint main(void) { return of_the(license); }\n" * 3 for t in TEMPLATES.values()),
    *("We like long lines of prose. " * 3 + t + " So there it ended." * 4 for t in TEMPLATES.values()),
    TEMPLATES["MIT-text"].replace("free of charge", "without charge").replace(", ", "\n"),
    "Licensed under the Apache Licence, Version 2.0!",
    "licensed under nothing", "", None, "one", "\n\n", "Released under the MIT license. Released under the MIT license.", "é released  under_the MIT-License",
]


def test_against_brute_force(spark, docs, no_docs):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[0])], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("size", "line", "start", "at", "pair", "id")})
    found = scan_licenses(df).collect()
    rows = sorted(((r["doc_id"], r["line"], r["start"], r["licence"]) for r in found), key=repr)
    assert rows == plain([(r["doc_id"], r["text"]) for r in df.collect()])
    assert scan_licenses(no_docs).count() == scan_licenses(docs).count() == 0
    assert scan_licenses(df, templates={"none": "word"}).count() == 0


def test_notices_inside_texts_are_found(spark):
    """Wrapped over lines or between prose on one line, and with a tenth of the words changed."""
    rng, rows = random.Random(6), []
    for name, t in TEMPLATES.items():
        words = t.split(" ")
        for k in rng.sample(range(1, len(words) - 1), len(words) // 12):
            words[k] = "changed"
        rows += [(f"{name} {kind}", "Some prose before it. " * 5 + body + " and prose behind it." * 5) for kind, body in (("whole", t), ("wrapped", wrapped(t)), ("changed", wrapped(" ".join(words))))]
    found = {(r["doc_id"], r["licence"]): r["dice"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).where("line = -2").collect()}
    for name in TEMPLATES:
        assert found[f"{name} whole", name] == found[f"{name} wrapped", name] == 1
        assert found[f"{name} changed", name] >= 0.8


def test_every_notice_of_a_long_text(spark):
    """Many notices in one text of millions of characters: each is told once, in time that grows with the text."""
    mit, prose = TEMPLATES["MIT-text"], "some words of prose that stand between and say little " * 12
    seconds = []
    for n in (400, 1600):
        text = "\n".join(f"{prose}{k}\n{mit}" for k in range(n))
        df = spark.createDataFrame([(n, text)], "doc_id long, text string")
        began = time.time()
        found = scan_licenses(df).where("line = -2 and licence = 'MIT-text'").collect()
        seconds.append(time.time() - began)
        step = len(words_of(f"{prose}{0}\n{mit}"))
        assert [r["start"] for r in sorted(found, key=lambda r: r["start"])] == [step * k + step - len(words_of(mit)) for k in range(n)]
        assert {r["dice"] for r in found} == {1.0}
    assert len(text) > 2_000_000 and seconds[1] < 60 and seconds[1] < 8 * max(seconds[0], 2)


@pytest.mark.parametrize("dice", [0.8, 0.6])
def test_key_words_and_anchors_lose_nothing(dice):
    """Units with just as many of a template's bigrams as fit, chosen at random, hold a key word and an anchor."""
    rng = random.Random(2)
    for t in TEMPLATES.values():
        b, keys, held = sorted(pairs(t)), set(key_words(t, dice)), {tuple(p.split(" ")) for p, _ in anchors(t, dice)}
        for _ in range(200):
            unit = rng.sample(b, sizes_for(len(b), dice)[0])
            assert any(w in keys for p in unit for w in p) and held & set(unit)


@pytest.mark.parametrize("b", [1, 2, 5, 40])
def test_size_bounds_lose_nothing(b):
    lo, hi = sizes_for(b, 0.8)
    for a in range(1, 3 * b + 3):
        assert (2 * min(a, b) / (a + b) >= 0.8) <= (lo <= a <= hi)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, sf):
    assert differences(op10_licenses(spark, f"{DATA}/{sf}"), duck(sf), ORACLES["op10_licenses"]) == ""
