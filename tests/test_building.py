"""Snapping places to roads against all edges."""

import math

from waymark.plans import building
from waymark.sources import roads

from .compare import DATA


def test_access_snaps_against_all_edges(spark):
    d = f"{DATA}/sf0.001"
    nodes = {r["uid"]: (r["x"] + 7, r["z"] + 11) for r in roads.node(spark, d).collect()}
    edges = [r for r in roads.edge(spark, d).collect() if r["kind"] in (0, 1)]

    def near(x, z, e):
        dx, dz = e["x2"] - e["x1"], e["z2"] - e["z1"]
        t = min(max(((x - e["x1"]) * dx + (z - e["z1"]) * dz) / (dx * dx + dz * dz), 0.0), 1.0)
        return math.hypot(x - e["x1"] - t * dx, z - e["z1"] - t * dz), t * math.hypot(dx, dz)

    found = {r["poi_id"]: r for r in building.d05_access_snaps(spark, d).collect()}
    asked = [r for r in roads.poi(spark, d).collect() if r["kind"] in ("Company", "Garage")]
    assert set(found) == {r["poi_id"] for r in asked}
    for r in asked:
        x, z = nodes[r["access_uid"]]
        least = min(near(x, z, e)[0] for e in edges)
        got = found[r["poi_id"]]
        assert (got["status"] == "Found") == (least <= 300)
        if got["status"] == "Found":
            lateral, offset = near(x, z, next(e for e in edges if e["edge_id"] == got["edge_id"]))
            assert abs(lateral - least) < 1e-9 and abs(offset - got["offset_m"]) < 1e-5
