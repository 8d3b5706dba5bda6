"""SimHash against brute force."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from waymark.llm.simhash import fingerprint_links, near_duplicates


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(values, distance=3):
    """Smallest id reachable for (id, fingerprint) rows."""
    label = {i: min(a for a, f in values if f == g) for i, (_, g) in enumerate(values)}
    changed = True
    prints = np.array([f for _, f in values], dtype=np.uint64)
    links = [np.flatnonzero(np.bitwise_count(prints ^ f) <= distance).tolist() for f in prints]
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min(label[j] for j in near)
            if least < label[i]:
                label[i], changed = least, True
    return [label[i] for i in range(len(values))]


def check(found, rows, size):
    values = [(r["doc_id"], plain_fingerprint(r["text"], size)) for r in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(values, plain_components(values)))
    assert sorted(tuple(r) for r in found.collect()) == want


def test_against_brute_force(docs):
    check(near_duplicates(docs), docs.collect(), 3)


def test_five_word_shingles(docs):
    check(near_duplicates(docs, shingle=5), docs.collect(), 5)


def test_dense_groups_lose_no_link(spark):
    """Groups beyond `dense` are cut anew, twice."""
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 3, dtype=np.uint64)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(150):
            bits = rng.choice(64, 9, replace=False)
            values.add(int(s) ^ sum(1 << int(b) for b in bits[: rng.integers(1, 10)]))
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    from waymark.llm.components import connected_components

    plain = plain_components(list(enumerate(values)))
    groups = {}
    for v, c in zip(signed, plain):
        groups.setdefault(c, set()).add(v)
    for dense in (2, 4096):
        found = {}
        for r in connected_components(fingerprint_links(prints, dense=dense)).collect():
            found.setdefault(r["component"], set()).add(r["node"])
        assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 8
    assert {r["component_id"] for r in rows if r["doc_id"] == 7} == {None}  # linked with a null id's empty text
    assert near_duplicates(no_docs).count() == 0


def test_fingerprint_is_over_half(spark):
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert near_duplicates(one).select(F.col("fingerprint")).first()[0] == f"{xxhash.xxh64_intdigest(b'a b c', 42):016x}"
