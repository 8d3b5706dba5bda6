"""Junction operators: roundabouts, their exits, and whether movements hold a junction together.

A junction's movements are few (a table by design), so each is one small group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

SHORTEST, LONGEST, MEAN_M = 3, 8, 120.0


def rings(movements: list[tuple[int, int, float]]) -> list[int] | None:
    """The ring of a roundabout: a simple cycle of 3 to 8 nodes, of movements at most 120 m long in the mean, each of
    whose nodes has at most one movement to another ring node, with entries and exits in all; the smallest such cycle,
    or None. Entries come from nodes outside the ring, exits lead to them."""
    out: dict[int, list[int]] = {}
    length = {}
    for a, b, m in movements:
        if a != b:
            out.setdefault(a, []).append(b)
            length[a, b] = m
    best = None
    for start in sorted(out):
        stack = [[start]]
        while stack:
            path = stack.pop()
            for b in sorted(out.get(path[-1], ()), reverse=True):
                if b == start and len(path) >= SHORTEST:
                    ring = set(path)
                    one_chord = all(sum(x in ring for x in out.get(n, ())) == 1 for n in path)
                    entries = sum(a not in ring and b2 in ring for a, b2 in length)
                    exits = sum(a in ring and b2 not in ring for a, b2 in length)
                    mean = sum(length[x, y] for x, y in zip(path, path[1:] + path[:1])) / len(path)
                    if one_chord and entries and exits and mean <= MEAN_M and (best is None or len(path) < len(best)):
                        best = path
                elif b > start and b not in path and len(path) < LONGEST:
                    stack.append([*path, b])
    return best


def exits_from(movements: list[tuple[int, int, float]], ring: list[int], entry: int) -> list[tuple[int, int]]:
    """(exit node, number) of the exits met going round from an entry node outside the ring; its own side comes last."""
    into = next((b for a, b, _ in movements if a == entry and b in ring), None)
    if into is None:
        return []
    at = ring.index(into)
    order = ring[at + 1 :] + ring[: at + 1]
    out = [b for n in order for a, b, _ in sorted(movements) if a == n and b not in ring]
    return [(b, k + 1) for k, b in enumerate(out)]


def roundabouts(movements: DataFrame) -> DataFrame:
    """(junction_id, entry, exit, length_m) movements to one row per junction: is_roundabout and its ring."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        ring = rings(list(zip(rows["entry"], rows["exit"], rows["length_m"])))
        return pd.DataFrame({"junction_id": [rows["junction_id"].iloc[0]], "is_roundabout": [ring is not None], "ring": [ring or []]})

    return movements.select("junction_id", "entry", "exit", "length_m").groupBy("junction_id").applyInPandas(find, "junction_id long, is_roundabout boolean, ring array<long>")


def clusters(movements: DataFrame) -> DataFrame:
    """Clusters of nodes that each junction's movements join."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        parent = {n: n for n in {*rows["entry"], *rows["exit"]}}

        def root(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for a, b in zip(rows["entry"], rows["exit"]):
            parent[root(a)] = root(b)
        return pd.DataFrame({"junction_id": [rows["junction_id"].iloc[0]], "clusters": [len({root(n) for n in parent})], "nodes": [len(parent)]})

    return movements.select("junction_id", "entry", "exit").groupBy("junction_id").applyInPandas(count, "junction_id long, clusters long, nodes long")
