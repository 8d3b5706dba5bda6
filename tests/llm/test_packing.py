"""Packing: exact round trip of ids, gapless sequences, and few of them."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from waymark.llm import packing
from waymark.llm.packing import WordIds, pack_documents, plan_bins
from waymark.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def bins_of(plan):
    bins = {}
    for s in plan:
        for j in range(s.count):
            bins.setdefault(s.bin + j // s.per_bin, []).append((s.offset + j % s.per_bin * s.size, s.size))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    sizes = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 4)) for _ in range(rng.choice([0, 1, 7, 800]))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    bins = bins_of(plan_bins(histogram, capacity))
    packed = sorted(size for b in bins.values() for _, size in b)
    assert packed == sorted(sizes)
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity and sum(3 * size > capacity for _, size in b) <= 2
    # first-fit decreasing, one by one
    plain = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, room in enumerate(plain) if room >= s), None)
        if k is None:
            plain.append(capacity - s)
        else:
            plain[k] -= s
    assert len(bins) <= len(plain) + 1 + len(plain) // 50


def test_refuses_sizes_beyond_capacity():
    with pytest.raises(ValueError):
        plan_bins({11: 1}, 10)


def check(rows, docs, capacity, ids=True):
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for d in docs:
        made = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for piece, at in enumerate(range(0, len(made), capacity)):
            part = made[at : at + capacity]
            want.setdefault((d["doc_id"], piece), []).append((at, len(part), zlib.crc32(part.tobytes()), part.tolist()))
    have = {}
    for r in rows:
        have.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"], r["ids"] if ids else None))
    key = lambda x: repr(x)
    assert {k: sorted(v, key=key) for k, v in have.items()} == {k: sorted([x if ids else (*x[:3], None) for x in v], key=key) for k, v in want.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(sequences) >= total / capacity
    return len(sequences), total


def test_round_trip(docs):
    sequences, total = check(pack_documents(docs, PATH, with_ids=True).collect(), docs.collect(), 2048)
    assert sequences <= total / 2048 * 1.1 + 1
    check(pack_documents(docs, PATH, capacity=100, with_ids=True).collect(), docs.collect(), 100)


def test_odd_rows(odd_docs, no_docs):
    check(pack_documents(odd_docs, PATH).collect(), odd_docs.collect(), 2048, ids=False)
    assert pack_documents(no_docs, PATH).count() == 0


def test_special_tokens_and_marks(spark):
    texts = ["it's I'M don't. word.'s A<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ΣΑΣ ς ß ﬁ 12ab3 x.y,,z!!'s ''", "日本語 😀 naïve. café, ÉTÉ!! ²³ ª", "...", "a|b **c** %%% &&&d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pack_documents(docs, PATH, with_ids=True).collect(), docs.collect(), 2048)


def letters(rng, n):
    """Words of letters, of syllables and at random, some with few letters, some longer than are merged side by side."""
    syllables = ["the", "ing", "tion", "er", "schaft", "über", "ión", "ñ", "ß", "aa", "日本", "ль", "e"]
    made = ["a", "é", "a" * 31, "a" * 32, "ab" * 16, "a" * 33, "é" * 16, "é" * 17, "the" * 40]
    while len(made) < n:
        pick = syllables if rng.random() < 0.7 else "abcdefghijklmnopqrstuvwxyz" if rng.random() < 0.7 else "ab"
        made.append("".join(rng.choice(pick) for _ in range(rng.randint(1, 12))))
    return made


def test_new_words_of_letters_are_merged_side_by_side(monkeypatch):
    """Ids are the tokenizer's, and no call of it is made for each word; also when words are forgotten between batches."""
    words = letters(random.Random(3), 30_000)
    tokenizer = Tokenizer.from_file(PATH)
    want = {w: tokenizer.encode(w, add_special_tokens=False).ids for w in set(words)}
    alone = []
    encode = WordIds._encode
    monkeypatch.setattr(WordIds, "_encode", lambda self, unit: alone.append(unit) or encode(self, unit))
    for cached in (10**6, 5000):
        monkeypatch.setattr(packing, "_CACHED_WORDS", cached)
        ids = WordIds(PATH)
        alone.clear()
        for lo in range(0, len(words), 6000):
            part = words[lo : lo + 6000]
            made = ids.batch([w.encode() for w in part[:3000]] + [b"", " ".join(part[3000:]).encode()])
            assert [x.tolist() for x in made] == [want[w] for w in part[:3000]] + [[], [i for w in part[3000:] for i in want[w]]]
        assert {len(u) > 32 for u in alone} == {True}
