"""Shingle similarity against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from waymark.llm import similar

from .conftest import DOCS, words


def plain_set(text, size=5):
    ws = (text or "").encode().lower().split()
    return frozenset(b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def plain_groups(rows, similarity=0.8):
    """{id: smallest id of its component} over all pairs; the sets that meet in no shingle are not alike."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) / len(a | b) >= similarity):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return {i: least[top(k)] for k, (i, _) in enumerate(rows)}


def edited(rng, n):
    """A text and copies with more and more changed words: similarity about 0.95 to 0.6 to the first."""
    base = words(rng, n, 5000)
    for k in range(12):
        copy = list(base)
        for at in range(k):
            copy[at * (n // 12) + 3] = f"changed{k}x{at}"
        yield " ".join(copy)


def test_edited_copies_against_brute_force(spark, docs):
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000 + i, t) for i, t in enumerate(t for n in (24, 60, 130, 400) for t in edited(rng, n))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(df).collect()} == plain_groups(rows)


def test_generated_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    kept = similar.drop_near_duplicates(docs)
    want = plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


BITS, SEGMENTS = 8, 4


def first_key(a, b):
    """The first key that two prints of one word share, by trying all."""
    keys = [similar.variant_keys(np.array([[x]], dtype=np.uint64), BITS, SEGMENTS)[0].tolist() for x in (a, b)]
    return next((x for x, y in zip(*keys) if x == y), None)


def test_members_apart_from_the_first_are_compared():
    """Links across components join what all similar pairs with this first key join, in blocks, over batches that cut runs."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    hubs = rng.integers(0, 2**32, 6, dtype=np.uint64)
    prints = [int(rng.choice(hubs)) ^ (1 << int(rng.integers(0, 32))) ^ (1 << int(rng.integers(0, 32))) for _ in range(200)]
    sets = [np.unique(rng.choice(40, 30, replace=False).astype(np.uint64) + np.uint64(100 * (i % 3))) for i in range(200)]
    # all members at home, and at a home one bit away those of the smaller side
    values = similar._values(np.array(prints, dtype=np.uint64)[:, None], BITS, SEGMENTS)
    held = Counter((s, int(v)) for row in values for s, v in enumerate(row))
    rows = []
    for i, p in enumerate(prints):
        for s, v in enumerate(values[i].tolist()):
            rows.append((s << 40 | v, i % 50, i, 2, p))
            for bit in range(BITS):
                other = v ^ (1 << bit)
                if held[s, other] > held[s, v] or held[s, other] == held[s, v] and v > other:
                    rows.append((s << 40 | other, i % 50, i, 0, p))
    rows.sort()
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [sets[r[2]].tobytes() for r in rows], [r[4] for r in rows]]
    batches = [pa.record_batch([pa.array(c[lo : lo + 70]) for c in columns], names=["key", "c", "same", "part", "hashes", "p0"]) for lo in range(0, len(rows), 70)]
    found = [(u, v) for b in similar._across(0.6, 5, BITS, SEGMENTS)(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]

    def alike(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both / (len(sets[i]) + len(sets[j]) - both) >= 0.6

    want = [(i, j) for j in range(200) for i in range(j) if i % 50 != j % 50 and alike(i, j) and (prints[i] ^ prints[j]).bit_count() <= 5 and first_key(prints[i], prints[j]) is not None]
    assert want and len(found) < len(want) and set(found) <= set(want)

    def joined(pairs):
        label = [i % 50 for i in range(200)]
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
        return [label.index(x) for x in label]

    assert joined(found) == joined(want)


@pytest.mark.parametrize("small", [0, 512])
def test_first_links_join_what_all_pairs_join(monkeypatch, small):
    """A key's links leave no two near classes apart, or send the key's rows on."""
    monkeypatch.setattr(similar, "_SMALL", small)
    rng = np.random.default_rng(5)
    hubs = rng.integers(0, 2**24, 4, dtype=np.uint64) << np.uint64(8)  # the first segment is 0 in all
    prints = np.array([int(rng.choice(hubs)) ^ (1 << int(rng.integers(8, 32))) for _ in range(300)], dtype=np.uint64)[:, None]
    i, j, more = similar._match(0, prints, 2, BITS, SEGMENTS)
    assert more and similar._near(prints[i], prints[j], 2).all() and set(j.tolist()) == {b for b in range(300) if similar._near(prints[:b], prints[b], 2).any()}
    assert not len(similar._match(1 << 40, prints, 2, BITS, SEGMENTS)[0])  # they share an earlier key


def test_large_groups_of_near_copies(spark):
    """More copies than a key's matches may hold, each with a word of its own, and a chain whose ends are not alike."""
    rng = random.Random(11)
    base = words(rng, 120, 5000)
    rows = [(i, " ".join(base[:60] + [f"own{i}"] + base[61:])) for i in range(400)]
    rows += [(1000 + k, " ".join(f"q{i}" for i in range(k * 5, k * 5 + 60))) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(df).collect()} == plain_groups(rows)


def test_outliers_of_a_large_group(spark):
    """Copies with up to a dozen changed words: some alike to many, some to few, some to none."""
    rng = random.Random(12)
    base = words(rng, 150, 5000)
    rows = []
    for i in range(700):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(12)):
            copy[at] = f"own{i}x{at}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, want = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(df).collect()}, plain_groups(rows)
    assert 20 < len(set(want.values())) < 600
    assert sum(found[i] == want[i] for i in want) >= 0.99 * len(want)


def test_recall_at_the_similarity():
    """Of pairs at 0.8, the share that meets in a key is that promised, however many texts there are."""
    rng = np.random.default_rng(9)
    for n in (1_000, 10**6):
        bits = similar.bits_for(n)
        segments = similar.segments_for(bits, 0.8, 0.98)
        width = max(2, -(-bits * segments // 64))
        met = near = 0
        for _ in range(300):
            shared, left, right = (np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (160, 20, 20))
            prints = np.stack([similar.wide_print(np.concatenate([shared, own]), width) for own in (left, right)])
            keys = similar.variant_keys(prints, bits, segments)
            met += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
            near += similar._near(prints[0], prints[1], similar.distance_for(64 * width, 0.8))
        assert met >= 0.95 * 300 and near >= 0.99 * 300


def test_rows_that_share_an_id_or_a_working_name_are_kept(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(1, "one text " + long, "a"), (1, "quite another thing", "b"), (1, "quite another thing", "b"), (None, "the third of them", "c"), (None, "a fourth, unlike the third", "d"), (9, "one text " + long, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").withColumn("_hash", F.col("_key")).withColumn("__key", F.col("_key"))
    kept = similar.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["_key"], r["_hash"], r["__key"], r["text"]) for r in kept.collect()) == sorted((k, k, k, t) for _, t, k in {r for r in rows if r[2] != "e"})


def test_odd_rows(spark, odd_docs, no_docs):
    rows = similar.similar_groups(odd_docs).collect()
    assert len(rows) == 8
    assert {r["component_id"] for r in rows if r["doc_id"] == 7} == {None}
    assert similar.similar_groups(no_docs).count() == similar.drop_near_duplicates(no_docs).count() == 0
    assert similar.drop_near_duplicates(odd_docs).columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


@pytest.mark.parametrize("text", [b"", b" \n ", b"one", b"A b c d e", b"a B c d e f a b c d e f"])
def test_sets_have_as_many_members(text):
    assert len(similar.shingle_set(text)) == len(plain_set(text.decode()))
