"""Repeated passages against brute force."""

import hashlib
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import substring
from waymark.llm.substring import drop_repeats, remove_repeats


def plain(rows, width=20):
    """(n_words, n_removed, kept words) by id, of rows with unique ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - width + 1):
            window = tuple(words[a : a + width])
            if window in seen:
                gone[a : a + width] = [True] * width
            seen.add(window)
        out[i] = (len(words), sum(gone), [w for w, g in zip(words, gone) if not g])
    return out


def test_against_brute_force(docs):
    for width in (20, 7, 2):
        want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], width)
        found = remove_repeats(docs, width=width).collect()
        assert len(found) == len(want)
        for r in found:
            n, gone, kept = want[r["doc_id"]]
            assert (r["n_words"], r["n_removed"], r["kept_text"].encode().split()) == (n, gone, kept)
            assert sum(s["end"] - s["start"] for s in r["removed"]) == gone


def test_untouched_texts_stay_as_they_are(docs):
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in drop_repeats(docs).collect():
        if len((want[r["doc_id"]] or "").split()) < 20:
            assert r["text"] == want[r["doc_id"]]
    assert drop_repeats(docs).columns == docs.columns


def test_drop_agrees(docs):
    kept = {r["doc_id"]: r["kept_text"].split() for r in remove_repeats(docs).collect()}
    assert {r["doc_id"]: (r["text"] or "").split() for r in drop_repeats(docs).collect()} == kept


def test_odd_rows(odd_docs, no_docs):
    """A null id is first; rows alike in id and text do not repeat each other."""
    rows = remove_repeats(odd_docs).collect()
    assert len(rows) == 8
    first = [r for r in rows if r["doc_id"] is None and r["n_words"]]
    assert [r["n_removed"] for r in first] == [0]
    assert sorted(r["n_removed"] for r in rows if r["doc_id"] == 5) == [60, 60, 60]
    assert [r["kept_text"].split() for r in rows if r["doc_id"] == 8] == [["end"]]
    assert remove_repeats(no_docs).count() == drop_repeats(no_docs).count() == 0
    assert drop_repeats(odd_docs).count() == 8


def test_many_rows_without_an_id(spark):
    """Rows under null are parts of the first document: each is cut by itself, and a later document by all of them."""
    passages = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(300)]
    rows = [(None, f"own{k} " + p) for k, p in enumerate(passages)] + [(4, " tail ".join(passages[:50]))] + [(None, "own0 " + passages[0])] * 3
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == len(rows)
    assert {r["n_removed"] for r in found if r["doc_id"] is None} == {0}
    assert [(r["n_removed"], set(r["kept_text"].split())) for r in found if r["doc_id"] == 4] == [(50 * 25, {"tail"})]


def test_hot_keys_and_working_names(spark, monkeypatch):
    """Keys above and below the share that is broadcast give the same rows; columns named like working ones stay."""
    from waymark.llm import common

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, f"a{k} b{k} {passage} c{k}" if k % 3 else " ".join(f"d{k // 2}x{i}" for i in range(40)), "kept", "too", "and") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string, __doc string, _at string")
    want = plain([r[:2] for r in rows])
    for heavy in (1, 5000):
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(df).collect()} == {i: w[1] for i, w in want.items()}
    cut = drop_repeats(df)
    assert cut.columns == df.columns
    assert {(r["_doc"], r["__doc"], r["_at"]) for r in cut.collect()} == {("kept", "too", "and")}


def test_query_digest(spark, docs, tmp_path):
    from waymark.llm.queries import op9_substring

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: hashlib.sha256(b" ".join(kept)).hexdigest() for i, (_, _, kept) in plain([(r["doc_id"], r["text"]) for r in docs.collect()]).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in op9_substring(spark, str(tmp_path)).collect()} == want


def test_bitmap_takes_little_of_the_driver(spark, monkeypatch):
    """All marks are set, no others, also in a full bitmap; the driver holds a few times its bytes, not a row for each of its words."""
    keys = spark.range(400_000).select(F.xxhash64("id").alias("key")).cache()
    plain_keys = np.array([r["key"] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    for most in (1 << 28, 1 << 17):
        monkeypatch.setattr(substring, "_BITMAP_BITS", most)
        tracemalloc.start()
        found = substring._bitmap(keys)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        bits = 64 * len(found)
        assert bits == min(most, 1 << 23)
        want = np.zeros(bits, dtype=bool)
        for mark in substring._marks(plain_keys, bits):
            want[mark.astype(np.int64)] = True
        assert np.array_equal(np.unpackbits(found.view(np.uint8), bitorder="little").astype(bool), want)
        assert peak < 4 * found.nbytes + (2 << 20)
    assert not substring._bitmap(keys.limit(0)).any()
    keys.unpersist()
