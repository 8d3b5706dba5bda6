"""Bridges and order statistics against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, places, stats


def plain_bridges(links):
    """By taking each link away and looking whether its ends still meet."""
    out = set()
    for k, (a, b) in enumerate(links):
        rest = [x for n, x in enumerate(links) if n != k]
        seen, todo = {a}, [a]
        while todo:
            u = todo.pop()
            for x, y in rest:
                for p, q in ((x, y), (y, x)):
                    if p == u and q not in seen:
                        seen.add(q)
                        todo.append(q)
        if b not in seen:
            out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bridges(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(14), rng.randrange(14)) for _ in range(16)] + [(20, 21), (21, 22), (22, 20), (22, 23), (30, 31), (31, 30), (40, 41)]
    links = [(a, b) for a, b in links if a != b]
    found = [tuple(r) for r in graph.bridges(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_bridges(links)
    assert graph.bridges(spark.createDataFrame([], "a long, b long")).count() == 0


def test_order_statistics_of_large_and_small_groups(spark):
    rng = random.Random(4)
    rows = [("big", float(rng.randrange(500))) for _ in range(5000)] + [("one", 3.0), (None, 7.0), (None, 1.0), ("one", None), ("none", None)]
    found = {r["g"]: r for r in stats.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert set(found) == {"big", "one", None}
    for g in found:
        mine = sorted(v for k, v in rows if k == g and v is not None)
        at = lambda q: mine[min(math.floor(len(mine) * q), len(mine) - 1)]  # noqa: E731, B023
        assert (found[g]["n"], found[g]["p50"], found[g]["p99"], found[g]["largest"]) == (len(mine), at(0.5), at(0.99), mine[-1])


def test_names_that_hold_one_another(spark):
    names = ["ab", "abc", "abcdef", "x", "north port", "port", "", "ABC"]
    asked = ["abcd", "b", "PORT", "nothing", "abc", "", "xyz", "no"]
    p = spark.createDataFrame(list(enumerate(names)), "poi_id long, name string")
    found = {r["request"]: (r["status"], r["poi_id"]) for r in places.resolve_names(spark.createDataFrame([(a,) for a in asked], "request string"), p).collect()}
    for a in asked:
        low = a.lower()
        mine = [i for i, n in enumerate(names) if n.lower() == low] or [i for i, n in enumerate(names) if n.lower() in low or low in n.lower()]
        assert found[a] == ("NotFound" if not mine else "Found" if len(mine) == 1 else "Ambiguous", mine[0] if len(mine) == 1 else None)
    assert places.resolve_names(spark.createDataFrame([("a",)], "request string"), p.limit(0)).select(F.col("status")).first()[0] == "NotFound"


def test_bridges_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    links = [(k, k + 1) for k in range(150)] + [(40, 60), (200, 201), (201, 202), (202, 200), (202, 203)]
    rounds, real = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: rounds.append(1) or real(df))
    found = {tuple(r) for r in graph.bridges(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == plain_bridges(links) and len(rounds) < 40


def test_bridges_by_rounds_where_components_are_large(spark):
    links = [(k, k + 1) for k in range(8)] + [(2, 5), (10, 11), (11, 12), (12, 10), (12, 13), (20, 21), (21, 20), (30, 31)]
    found = [tuple(r) for r in graph.bridges(spark.createDataFrame(links, "a long, b long"), most=3).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_bridges(links)
