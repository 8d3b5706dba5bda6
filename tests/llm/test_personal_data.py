"""Personal data: plain spans against the patterns as they are, disguised ones at their places in the source."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from waymark.llm.personal_data import KINDS, _told, detect, find_personal_data, masked, read_glyphs, read_words, scan, scan_all
from waymark.llm.queries import QUERIES


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, (pattern, holds) in enumerate(rules) for m in re.finditer(pattern, text) if holds(m[0])]


@pytest.mark.parametrize("letters", ["a@.b-_ 1", "0123456789 -", "12.3. 5", "+1234567890() .-x", "a1@.+é- \n"])
def test_plain_spans(letters):
    rng = random.Random(letters)
    some, texts = 0, []
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert detect(text) == plain(text)
        texts.append(text)
        some += bool(plain(text))
    assert [[s[:3] for s in found if s[3]] for found in scan_all(texts)] == list(map(plain, texts))
    assert some > 20


#: text with a disguised identifier between bars, kind, normalised value
DISGUISED = [
    ("mail |john (at) example (dot) com| now", "email", "john@example.com"),
    ("mail |john [at] example.com|, or", "email", "john@example.com"),
    ("mail |john.doe at mail5 dot example dot com| or", "email", "john.doe@mail5.example.com"),
    ("mail |john at example.com| or", "email", "john@example.com"),
    ("|JOHN_X AT EXAMPLE DOT COM|", "email", "JOHN_X@EXAMPLE.COM"),
    ("x |john-at-example-dot-com| y", "email", "john@example.com"),
    ("x |john&#64;example&#46;com| y", "email", "john@example.com"),
    ("x |john@example dot com| y", "email", "john@example.com"),
    ("x |john@example[.]com| y", "email", "john@example.com"),
    ("x |jоhn@exаmple.com| y", "email", "john@example.com"),  # Cyrillic
    ("x |ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ| y", "email", "john@example.com"),
    ("x |jo​hn@exam­ple.com| y", "email", "john@example.com"),
    ("x |maría arroba ejemplo punto es| y".replace("maría", "maria"), "email", "maria@ejemplo.es"),
    ("ip |192 dot 168 dot 0 dot 12| up", "ip", "192.168.0.12"),
    ("ip |192[.]168[.]0[.]12| up", "ip", "192.168.0.12"),
    ("ip |one nine two dot one six eight dot zero dot one| up", "ip", "192.168.0.1"),
    ("ip |１９２.１６８.０.１| up", "ip", "192.168.0.1"),
    ("pay |four one one one, one one one one, one one one one, one one one one| ok", "card", "4111111111111111"),
    ("pay |4111 1111 1111 one one one one| ok", "card", "4111 1111 1111 1111"),
    ("pay |vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins| ok", "card", "4111111111111111"),
    ("pay |4lll llll 1111 1111| ok".replace("4lll llll", "4l1l 1l1l"), "card", "4111 1111 1111 1111"),
    ("pay |4111‑1111‑1111‑1111| ok", "card", "4111-1111-1111-1111"),
    ("pay |٤111 1111 1111 1111| ok", "card", "4111 1111 1111 1111"),
    ("call |plus one five five five oh one two three four five six| ok", "phone", "+15550123456"),
    ("call |+1 (5O5) 555-O1l2| ok", "phone", "+1 (505) 555-0112"),
    ("call |＋49 30 1234567| ok", "phone", "+49 30 1234567"),
]


@pytest.mark.parametrize("text,kind,value", DISGUISED)
def test_disguises(text, kind, value):
    before, held, after = text.split("|")
    pad = "é語 some words, ünd "
    whole = pad + before + held + after
    at = len(pad + before)
    assert (KINDS.index(kind), at, at + len(held), False, value) in scan(whole)
    assert [s[:3] for s in scan(whole) if s[3]] == plain(whole)


@pytest.mark.parametrize(
    "text",
    [
        "Look at this. It is at home dot", "one two three four five six seven eight nine", "un six de sept neuf trois", "meet at noon.Then at ten.", "a @ b", "at at at dot dot dot",
        "four one one one one one one one one one one one one one one two", "Версия 1.2.3 от автора, тел не дан", "x² + y² = 10 at p.m.", "plus two points at 3 dot 5", "&#64; %40 [at] (dot)",
    ],
)
def test_clean_texts(text):
    assert scan(text) == []


def test_tapes_keep_places():
    rng = random.Random(5)
    parts = ["four ", "one", " ", "é", "а", "​", "(at)", " dot ", "x", "@", ".", "７", "plus ", "O1", ", "]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(15)))
        tape = read_words(read_glyphs(text))
        if tape.rule is None:
            assert tape.text == text
            continue
        assert len(tape.text) == len(tape.start) == len(tape.end) == len(tape.rule)
        assert (tape.start < tape.end).all() and (tape.end[:-1] <= tape.start[1:]).all()
        for c, i, j, r in zip(tape.text, tape.start, tape.end, tape.rule):
            assert r or (j == i + 1 and text[i] == c)


def test_no_text_without_evidence_has_disguises():
    rng = random.Random(6)
    parts = ["four ", "one", " ", ", ", "(at)", " dot ", " at ", "x", "ab.com", "com", "@", ".", "plus ", "O1", "1", "92", "168", "-", "_at_", "-dot-", "(", ")", "&#64;", "[.]", "<", "+", "\n", "4111 1111", "Neuf", "seven"]
    some = 0
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(60_000)]
    texts = [rng.choice(["", "ab", "192", "+15 ", "4111111111111 "]) + t for t in texts]
    for text, found in zip(texts, scan_all(texts)):
        assert found == _told(text, read_words(read_glyphs(text))), text
        some += not all(s[3] for s in found)
    assert some > 500


def test_wider_spans_keep_plain_ones():
    found = scan("jоhn@example.com")  # the o is Cyrillic
    assert [(s[1], s[2], s[3]) for s in found] == [(0, 16, False), (2, 16, True)]
    assert [s[3] for s in scan("4111111111111111 un")] == [True]


def test_masks():
    text = "a x@y.com b +1 234 567 8901 c 4111111111111111 john at example dot com"
    assert masked(text, scan(text)) == "a <EMAIL> b <PHONE> c <CARD> <EMAIL>"


def test_rows(spark, docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        rows = find_personal_data(table, mask=True).collect()
        assert len(rows) == table.count()
        for r in rows:
            assert [(KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["pii"]["spans"] if s["plain"]] == plain(r["text"] or "")
    assert find_personal_data(no_docs).count() == 0
    clash = spark.createDataFrame([("x@y.zz", 1, "k", 2)], "text string, pii int, kind string, `sp``ans` int")
    assert [s["value"] for s in find_personal_data(clash).first()["pii"]["spans"]] == ["x@y.zz"]


def test_long_texts_take_linear_time():
    for piece in ["a", "1", "1 ", "1.", "+1", "@", "a@", " ", "one ", "O1", "(", "at ", "​", "1-", " dot", "<", "x@y.zz a at b.com 4111111111111111 ", "1.1.1.1 1 dot 1 dot 1 dot 1 "]:
        text = piece * (400_000 // len(piece))
        began = time.process_time()
        assert len(scan(text)) <= len(text) // 8
        assert time.process_time() - began < 20


def test_query(spark):
    sf = f"{DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        told = ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == n for s in base) for n in range(4)]
        if not r["n_added"]:
            assert r["spans"] == told
