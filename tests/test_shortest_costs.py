"""Least costs from cities and companies, the nearest of each node, against a plain search from all."""

import heapq

import pytest

from waymark.plans import catalog, routing
from waymark.sources import roads

from .compare import DATA


def test_nearest_stops_however_far(spark):
    d = f"{DATA}/sf0.001"
    out = {}
    for r in roads.turned_edge(spark, d).collect():
        out.setdefault(r["src"], []).append((r["dst"], r["time_s"]))
    nodes = {r["uid"] for r in roads.node(spark, d).collect()}
    stops = {r["access_uid"] for r in roads.poi(spark, d).collect() if r["kind"] in ("City", "Company")} & nodes
    want = {}
    for start in stops:
        queue = [(0.0, start)]
        while queue:
            t, u = heapq.heappop(queue)
            if (start, u) not in want:
                want[start, u] = t
                for v, w in out.get(u, []):
                    heapq.heappush(queue, (t + w, v))
    assert max(want.values()) > 90.0
    found = {(r["source"], r["uid"]): r["cost"] for r in catalog.QUERIES["g01_shortest_costs"](spark, d).collect()}
    nearest = {}
    for (source, uid), t in want.items():
        nearest.setdefault(uid, []).append((round(t, 6), source))
    want = {(source, uid): t for uid, stops in nearest.items() for t, source in sorted(stops)[: routing.STOPS]}
    assert found == pytest.approx(want, abs=2e-6)
