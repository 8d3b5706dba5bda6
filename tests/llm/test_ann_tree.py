"""Vector search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tests.compare import DATA
from waymark.llm.ann_tree import nearest
from waymark.llm.queries import op8_ann


def brute(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i in queries:
            s = (x * np.array(v, dtype=float)).sum(axis=1)
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[i] = [(int(ids[keep][o]), float(s[keep][o])) for o in order]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_on_generated_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").collect()]
    have, want = by_query(op8_ann(spark, f"{DATA}/sf0.1")), brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert set(have) == set(want)
    hits = sum(len({i for i, _ in have[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, found in have.items():
        for i, s in found:
            assert abs(s - np.dot(np.array(exact[q], float), np.array(exact[i], float))) < 1e-12


def test_small_table_is_exact_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 4)).round(2)
    rows = [(i, base[i % 30].tolist(), "x") for i in range(90)] + [(200, base[0].tolist(), "y")]
    odd = [(300, None, "x"), (301, [0.0] * 4, "x"), (302, [1.0, None, 0.0, 0.0], "x"), (303, [1.0, float("nan"), 0.0, 0.0], "x"), (304, [1.0, float("inf"), 0.0, 0.0], "x"), (305, [1.0, 2.0], "x"), (306, [], "x"), (None, base[1].tolist(), "x"), (0, base[0].tolist(), "again")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id string")
    clean = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["vec_id"] < 300]
    have = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, F.col("id") % 20 == 0, k=7, recall=1.0).collect())
    want = []
    for at, (i, v) in enumerate(clean):  # rows, not ids: one that shares an id is a query and a candidate of its own
        if i % 20 == 0:
            others = sorted((-float((np.array(v, float) * np.array(w, float)).sum()), j) for b, (j, w) in enumerate(clean) if b != at)
            want += [(i, rank, j) for rank, (_, j) in enumerate(others[:7], 1)]
    assert have == sorted(want) and sum(q == 0 for q, _, _ in have) == 14


def test_trees_below_the_top_reach_the_recall(spark, monkeypatch):
    """So small a top and leaves that every top leaf has a tree of its own and several parts."""
    from waymark.llm import ann_tree

    monkeypatch.setattr(ann_tree, "PART", 300)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 12))
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 12)) / 3).round(4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    have = by_query(nearest(df, F.col("id") % 50 == 0, k=10, recall=0.97, leaf_size=40, top=8))
    want = brute(rows, {i for i in range(0, 6000, 50)}, 10)
    assert set(have) == set(want) and all(len(f) == 10 for f in have.values())
    assert sum(len({i for i, _ in have[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    exact = by_query(nearest(df, F.col("id") % 50 == 0, k=10, recall=1.0, leaf_size=40, top=8, calibration=1000))
    assert exact == want


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert by_query(nearest(df, F.col("id") == 0)) == {0: [(1, 0.5)]}
    assert nearest(df.limit(0), F.col("id") == 0).count() == 0
    assert nearest(df.limit(1), F.lit(True)).count() == 0
    assert nearest(df, F.lit(False)).count() == 0


def test_leaves_with_fewer_than_k_vectors(spark, monkeypatch):
    """One leaf of one tree is visited: queries for which it holds fewer than k visit all, and k are told, exactly."""
    from waymark.llm import ann_tree

    monkeypatch.setattr(ann_tree, "_calibrate", lambda *_: (1, 1))
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 6)).round(4))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    have = by_query(nearest(df, F.col("id") % 20 == 0, k=20, leaf_size=10, top=8))
    want = brute(rows, set(range(0, 700, 20)), 20)
    assert set(have) == set(want) and all(len(f) == 20 for f in have.values())
    assert sum(have[q] == want[q] for q in want) >= len(want) // 3
