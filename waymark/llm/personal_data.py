"""Personal data, plain or disguised: detectors over text that transducers have normalised, told in places of the source.

Two transducers rewrite a text in turn, each from tape to tape. A tape holds characters and, for each of them, where it
begins and ends in the source and by which rule it came. The first reads glyphs: look-alike letters and digits,
full-width and styled forms become ASCII, invisible characters go. The second reads words: spelled digits, spelled
signs (`at`, `dot`, `plus`, bare or in brackets, entities), letters that stand for digits. Identifiers found on the last
tape are mapped back by its places, so spans always are in the text as it was.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, quoted, text_bytes

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PARTED = str.maketrans("", "", " -")

# What rewrote a character.
_COPIED, _GLYPH, _STRONG, _AT, _DOT, _DIGIT = range(6)

# Letters that look like ASCII ones; the second line of each pair tells which.
_ALIKE = [
    ("асеорхуіјѕһԁԛԝӏкмтвнАВЕКМНОРСТХУІЈЅԚԜ", "aceopxyijshdqwlkmtbhABEKMHOPCTXYIJSQW"),
    ("οανρικτυχεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpiktuxeABEZHIKMNOPTYX"),
    ("ıɡɑᴀʟɪ", "igaalI"),
    ("。․‧∙‐‑‒–—−", "....------"),
]
_SPACES = "               　"
_UNSEEN = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
# Digits as they are spelled in English, German, French and Spanish.
_SPELLED = [
    "zero null zéro cero oh",
    "one eins un uno",
    "two zwei zwo deux dos",
    "three drei trois tres",
    "four vier quatre cuatro",
    "five fünf cinq cinco",
    "six sechs seis",
    "seven sieben sept siete",
    "eight acht huit ocho",
    "nine neun neuf nueve",
]
_DIGITS = {word: str(d) for d, words in enumerate(_SPELLED) for word in words.split()}
_TOP_LEVEL = set("com org net edu gov mil int info biz io dev app uk eu ca ch nl de fr es it us au jp".split())
_GONE = 0xFFFFFFFF


@dataclass(frozen=True)
class Tape:
    """Characters with their places in the source (None: their own) and the rules they came by (None: copied)."""

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    rule: np.ndarray | None = None


@lru_cache(maxsize=1)
def _glyph_table() -> np.ndarray:
    """The code point that each code point becomes, from Unicode's own data and the lists above."""
    table = np.arange(0x110000, dtype=np.uint32)
    for code in range(0xA0, 0x20000):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        digit = unicodedata.decimal(char, None)
        if digit is not None:
            table[code] = ord("0") + digit
        elif len(plain) == 1 and 32 < ord(plain) < 127:
            table[code] = ord(plain)
    for odd, plain in _ALIKE:
        for a, b in zip(odd, plain, strict=True):
            table[ord(a)] = ord(b)
    table[[ord(c) for c in _SPACES]] = 32
    table[[ord(c) for c in _UNSEEN]] = _GONE
    return table


def read_glyphs(text: str) -> Tape:
    """The first transducer: one character for one, or for none."""
    if text.isascii():
        return Tape(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    new = _glyph_table()[codes]
    if (new == codes).all():
        return Tape(text)
    at = np.flatnonzero(new != _GONE)
    changed = (new != codes)[at] | (np.diff(at, prepend=-1) > 1)
    out = new[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return Tape(out, at, at + 1, np.where(changed, _GLYPH, _COPIED).astype(np.int8))


_WORD_AT, _WORD_DOT = "at|arobase|arroba", "dot|punkt|punto|point"
_SIGNS = re.compile(
    rf"""(?P<at>\s{{0,3}}[\[({{<]\s?(?:{_WORD_AT}|@)\s?[\])}}>]\s{{0,3}}|&\#0*64;|&\#x40;|&commat;|%40)
    |(?P<dot>\s{{0,3}}[\[({{<]\s?(?:{_WORD_DOT}|\.)\s?[\])}}>]\s{{0,3}}|&\#0*46;|&\#x2e;|&period;)
    |(?P<bare_at>\s{{1,3}}(?:{_WORD_AT}|@)\s{{1,3}}|(?<=[a-z0-9])[-_](?:at)[-_](?=[a-z0-9]))
    |(?P<bare_dot>\s{{1,3}}(?:{_WORD_DOT})\s{{1,3}}|(?<=[a-z0-9])[-_](?:dot)[-_](?=[a-z0-9]))
    |(?P<plus>[\[(]plus[\])]\s{{0,3}}|(?<![^\W_])plus\s{{1,3}}(?=[0-9a-z]))
    |(?P<digit>(?<![^\W_])(?:{"|".join(_DIGITS)})(?![^\W_]))
    |(?P<alike>(?<![^\W_])(?=[OolI]{{0,19}}[0-9])(?=[0-9]{{0,19}}[OolI])[0-9OolI]{{2,20}}(?![^\W_]))""",
    re.VERBOSE | re.IGNORECASE,
)
_SIGN = {"at": ("@", _STRONG), "dot": (".", _STRONG), "bare_at": ("@", _AT), "bare_dot": (".", _DOT), "plus": ("+", _DIGIT)}
_SIGN_WORDS = {*_WORD_AT.split("|"), *_WORD_DOT.split("|")}
_BETWEEN = re.compile(r"[\s,_/-]{1,3}")
_LETTERS = str.maketrans("OolIiL", "001111")


_DIGIT_WORD = f"(?:{'|'.join(_DIGITS)})"
_DOT_SIGN = rf"(?:\s{{0,3}}[\[({{<]\s?(?:{_WORD_DOT}|\.)\s?[\])}}>]|&#0*46;|&#x2e;|&period;|\s{{1,3}}(?:{_WORD_DOT})\s|[-_]dot[-_])"
#: What any text has in which the second transducer can bring an identifier about; for a matcher without lookarounds.
_EVIDENCE = "|".join([
    rf"[\[({{<]\s?(?:{_WORD_AT}|@)\s?[\])}}>]", "&#0*64;|&#x40;|&commat;|%40",
    rf"(?:\s(?:{_WORD_AT}|@)\s{{1,3}}|[-_]at[-_])[a-z0-9-]+(?:\.[a-z0-9]|{_DOT_SIGN})",
    rf"@[a-z0-9.-]+{_DOT_SIGN}", rf"{_DOT_SIGN}\s{{0,3}}[a-z0-9._%+-]*@", rf"\+[0-9][ ().0-9-]*{_DOT_SIGN}", rf"[0-9a-z.]{_DOT_SIGN}(?:\s{{0,3}})(?:[0-9]|{_DIGIT_WORD})",
    rf"(?:[0-9]|{_DIGIT_WORD})[\s,_/().+-]+{_DIGIT_WORD}", rf"{_DIGIT_WORD}[\s,_/().+-]+[0-9]",
    rf"[\[(]plus[\])]|plus\s{{1,3}}(?:[0-9(.-]|{_DIGIT_WORD})", "[0-9][ol]|[ol][0-9]|[0-9]i|i[0-9]",
])


def read_words(tape: Tape) -> Tape:
    """The second transducer: spelled signs and digits; what parts two spelled digits goes."""
    text = tape.text
    out, starts, ends, rules = [], [], [], []
    done, digit_end = 0, -1

    def put(piece: str, start, end, rule: int | None) -> None:
        out.append(piece)
        starts.append(start)
        ends.append(end)
        rules.append((rule, len(piece)))

    for m in _SIGNS.finditer(text):
        kind, i, j = m.lastgroup, *m.span()
        if not (kind == "digit" and digit_end == done and _BETWEEN.fullmatch(text, done, i)) and i > done:
            put(text[done:i], np.arange(done, i), np.arange(done + 1, i + 1), None)
        if kind == "digit":
            put(_DIGITS[m[0].lower()], [i], [j], _DIGIT)
            digit_end = j
        elif kind == "alike":
            put(m[0].translate(_LETTERS), np.arange(i, j), np.arange(i + 1, j + 1), _DIGIT)
        else:
            put(_SIGN[kind][0], [i], [j], _SIGN[kind][1])
        done = j
    if not out:
        return tape
    put(text[done:], np.arange(done, len(text)), np.arange(done + 1, len(text) + 1), None)
    start, end = np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)
    rule = np.repeat(np.array([_COPIED if r is None else r for r, _ in rules], dtype=np.int8), [n for _, n in rules])
    if tape.start is not None:
        earlier = tape.rule[start]
        start, end = tape.start[start], tape.end[end - 1]
        rule = np.where(rule == _COPIED, earlier, rule)
    return Tape("".join(out), start, end, rule)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of plain identifiers, leftmost and without overlap for each kind; linear in the text."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = len(before.rstrip(_LOCAL)) + done
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].translate(_PARTED)) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _disguised(tape: Tape, kind: int, i: int, j: int) -> bool:
    """Whether what was rewritten makes this an identifier: bare words need more evidence than brackets and glyphs."""
    rule = tape.rule[i:j]
    if not rule.any():
        return False
    if kind:
        return True
    if not np.isin(rule, (_GLYPH, _STRONG, _AT, _DOT)).any():
        return False
    value = tape.text[i:j]
    last = value.rpartition(".")[2]
    at = int(rule[value.index("@")])
    dotted = _DOT in rule or (_STRONG in rule[value.index("@") + 1 :])
    if not (last.isalpha() and 2 <= len(last) <= 24) or last.lower() in _SIGN_WORDS:
        return False
    if at == _AT and not dotted or at == _COPIED and _DOT in rule:
        return last in _TOP_LEVEL
    return True


def scan(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(kind, start, end, plain, value) of all identifiers by kind and start; value is the identifier as normalised."""
    return scan_all([text])[0]


def scan_all(texts: list[str]) -> list[list[tuple[int, int, int, bool, str]]]:
    """scan() of each text. Only texts with some evidence are read by the second transducer."""
    tapes = [read_glyphs(t) for t in texts]
    evident = pc.match_substring_regex(pa.array([t.text for t in tapes], pa.large_string()), _EVIDENCE, ignore_case=True).to_pylist()
    return [_told(text, read_words(tape) if words else tape) for text, tape, words in zip(texts, tapes, evident)]


def _told(text: str, tape: Tape) -> list[tuple[int, int, int, bool, str]]:
    plain = detect(text)
    found = [(k, i, j, True, text[i:j]) for k, i, j in plain]
    if tape.rule is not None:
        # starts and ends of each kind, both in order as plain spans of a kind don't overlap
        places = [([i for k, i, _ in plain if k == kind], [j for k, _, j in plain if k == kind]) for kind in range(len(KINDS))]
        for kind, i, j in detect(tape.text):
            if not _disguised(tape, kind, i, j):
                continue
            start, end = int(tape.start[i]), int(tape.end[j - 1])
            met = [(k, s, e) for k, (begin, stop) in enumerate(places) for s, e in zip(*(x[bisect_right(stop, start) : bisect_left(begin, end)] for x in (begin, stop)))]
            # a plain span stays; around it a wider one of its kind may come, if glyphs or signs and not digits widen it
            if all(k == kind and start <= s and e <= end and (start, end) != (s, e) for k, s, e in met) and (not met or _widened(tape.rule[i:j])):
                found.append((kind, start, end, False, tape.text[i:j]))
    return sorted(found)


def _widened(rule: np.ndarray) -> bool:
    return bool(np.isin(rule, (_GLYPH, _STRONG, _DOT)).any()) and _DIGIT not in rule


def masked(text: str, spans: list[tuple[int, int, int, bool, str]]) -> str:
    """The text with each stretch of personal data replaced by the kind of the first span in it."""
    out, done = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("value", pa.string())])
_FOUND = pa.struct([("spans", pa.list_(_SPAN)), ("masked", pa.string())])


def _scanner(mask: bool):
    @F.arrow_udf("struct<spans: array<struct<kind: string, start: long, end: long, plain: boolean, value: string>>, masked: string>")
    def scan_texts(texts: pa.Array) -> pa.Array:
        rows = []
        for lo, hi in chunks([range(len(x.as_buffer())) for x in texts]):
            plain = [x.decode("utf-8", "replace") for x in texts.slice(lo, hi - lo).to_pylist()]
            for text, spans in zip(plain, scan_all(plain)):
                rows.append({"spans": [dict(zip(_SPAN.names, (KINDS[k], *rest))) for k, *rest in spans], "masked": masked(text, spans) if mask else None})
        return pa.array(rows, _FOUND)

    return scan_texts


def find_personal_data(docs: DataFrame, text: str = "text", column: str = "pii", mask: bool = False) -> DataFrame:
    """The table with one more column: struct<spans: array<struct<kind, start, end, plain, value>>, masked>.

    Spans are in code points of the text, end exclusive, by kind (email, ip, card, phone) and start; `plain` ones match
    as they stand, others once their disguise is undone, and `value` is the identifier then. `masked`, if asked for,
    is the text with spans replaced by their kinds. Rows are judged one by one, whole, and none is shuffled; work is linear in the
    length of a text.

    Null texts count as empty and have no spans, repeated rows have the same spans, an empty table gives an empty one, a
    column named `column` is replaced, others stay whatever their names. Bytes that aren't UTF-8 count as one
    replacement character each.
    """
    return docs.withColumn(column, _scanner(mask)(text_bytes(docs[quoted(text)])))
