"""Known answers of single operators."""

import heapq
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import driving, geometry
from waymark.operators import events, graph, places, routes, search, spatial
from waymark.plans import catalog
from waymark.sources import roads

from .compare import DATA


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize("v, limit, over", [(14.72, 50, False), (15.0, 50, True), (23.61, 80, False), (24.0, 80, True), (40.0, 0, False)])
def test_overspeed(spark, v, limit, over):
    assert value(spark, driving.overspeeding(*lit(v, limit))) is over


@pytest.mark.parametrize("limit, ms, diff", [(50, 13.9, 0), (50, 16.7, 10), (80, 0.0, -80), (-1, 20.0, None)])
def test_speed_difference(spark, limit, ms, diff):
    assert value(spark, driving.speed_difference(*lit(limit, ms))) == diff


def test_stopping_distance(spark):
    assert [value(spark, driving.stopping_distance(F.lit(v))) for v in (10.0, 20.0)] == [35.0, 105.0]


@pytest.mark.parametrize(
    "distance, state, remaining, v, limit, want",
    [
        (120.0, driving.RED, 12.0, 13.89, 50, (True, 15, 40)),
        (100.0, driving.RED, 5.6, 13.89, -1, (True, 15, 65)),
        (60.0, driving.RED, 18.0, 13.89, 30, (True, 5, 15)),
        (100.0, driving.GREEN, 8.0, 10.0, 60, (True, 45, 60)),
        (200.0, driving.GREEN, 2.0, 10.0, 80, (False, 0, 0)),
    ],
)
def test_glosa(spark, distance, state, remaining, v, limit, want):
    assert tuple(value(spark, driving.glosa(*lit(distance, state, True, remaining, v, limit)))) == want


@pytest.mark.parametrize("v, road, complexity, frequency, want", [(50.0, 1, 0, "standard", 250), (90.0, 3, 0, "standard", 900), (80.0, 2, 0, "standard", 640), (50.0, 1, 4, "standard", 325), (90.0, 3, 0, "low", 450), (90.0, 3, 0, "high", 1350)])
def test_speech_lead(spark, v, road, complexity, frequency, want):
    assert value(spark, driving.speech_lead(*lit(v, road, complexity), frequency)) == want


def test_angles(spark):
    assert value(spark, geometry.angle_diff(*lit(0.0, math.pi))) == pytest.approx(-math.pi)
    assert value(spark, geometry.angle_diff(*lit(0.5, 0.2))) == pytest.approx(0.3)
    assert value(spark, geometry.angle_diff(*lit(0.2, 0.5))) == pytest.approx(-0.3)
    for yaw in (math.pi / 2, -math.pi / 2, 0.3, -2.7, 1.234):
        assert value(spark, geometry.quaternion_yaw(*lit(0.0, math.sin(yaw / 2), 0.0, math.cos(yaw / 2)))) == pytest.approx(yaw, abs=1e-4)


def test_polyline_length(spark):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in ((0.0, 0.0), (3.0, 4.0), (13.0, 4.0))])
    assert value(spark, geometry.polyline_length(points)) == 15.0


def test_nearest_edge(spark):
    edges = spark.createDataFrame([(0, 0, 0.0, 0.0, 1000.0, 0.0), (1, 0, 0.0, 0.0, 0.0, 1000.0)], "edge_id long, kind int, x1 double, z1 double, x2 double, z2 double")
    at = lambda x, z, r: spatial.nearest_edge(spark.createDataFrame([(1, x, z)], "seq long, x double, z double"), edges, r, "seq").select("edge_id", "offset", "lateral").collect()
    assert [tuple(r) for r in at(600.0, 3.0, 200.0)] == [(0, 600.0, 3.0)]
    assert at(5000.0, 5000.0, 100.0) == []


@pytest.mark.parametrize("limits, want", [((80, 50, 70), [(0.0, 80), (100.0, 50), (200.0, 70)]), ((80, 80, 50), [(0.0, 80), (200.0, 50)])])
def test_speed_breaks(spark, limits, want):
    rows = spark.createDataFrame([(1, i, 0, 100.0, x) for i, x in enumerate(limits)], "route_id long, idx long, kind int, length_m double, speed_limit int")
    assert [(r["offset_m"], r["limit"]) for r in routes.speed_breaks(rows).orderBy("idx").collect()] == want


def test_off_route(spark):
    rows = spark.createDataFrame([(1, i, i, i >= 2) for i in range(20)], "vehicle long, seq long, sim_us long, miss boolean")
    states = [r["state"] for r in events.off_route(rows, F.col("miss")).orderBy("seq").collect()]
    assert states[2 + 3] == "ON_ROUTE" and states[2 + 4] == "SUSPECTED" and states[2 + 14] == "OFF_ROUTE"


def test_signal_link(spark):
    moves = spark.createDataFrame([(1, 17, 0.0, 0.0, 0.0), (2, 17, 500.0, 0.0, 0.0)], "edge_id long, semaphore_id int, x double, z double, heading double")
    light = lambda i, x: spark.createDataFrame([(0, i, x, 0.0, 0.0, 1, 5.0)], "slot long, light_id int, x double, z double, yaw double, state int, time_remaining double")
    seen = lambda i, x: {r["edge_id"]: r["confidence"] for r in places.link_signals(moves, light(i, x)).collect()}
    assert seen(17, 3.6) == {1: "VERIFIED", 2: "UNKNOWN"}
    assert seen(42, 7.0)[1] == "PROBABLE"


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (1, 2), (3, 3)] + [(100 + i, 101 + i) for i in range(40)], "src long, dst long")
    got = {r["uid"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 1: 1, 2: 1, 3: 3} | {100 + i: 100 for i in range(41)}


def test_routes_agree_with_relaxation(spark):
    """Broadcast search, rounds of joins and a plain search give the same costs."""
    edges = roads.timed_edge(spark, f"{DATA}/sf0.001")
    rows = [(r["src"], r["dst"], r["time_s"]) for r in edges.collect()]
    best, queue = {0: 0.0}, [(0.0, 0)]
    while queue:
        d, u = heapq.heappop(queue)
        for s, t, w in rows:
            if s == u and d + w < best.get(t, math.inf):
                best[t] = d + w
                heapq.heappush(queue, (d + w, t))
    pairs = spark.createDataFrame([(t, 0, t) for t in range(0, 200, 13)], "od_id long, src long, dst long")
    found = {r["od_id"]: r["cost"] for r in search.routes(edges, search.between_nodes(pairs, ("time_s",))).collect()}
    assert {k: None if v is None else round(v, 6) for k, v in found.items()} == {t: round(best[t], 6) if t in best else None for t in range(0, 200, 13)}
    far = {r["uid"]: r["cost"] for r in graph.shortest_costs(edges, spark.createDataFrame([(0,)], "uid long"), "time_s", 40.0).collect()}
    assert {k: round(v, 6) for k, v in far.items()} == {k: round(v, 6) for k, v in best.items() if v <= 40.0}


def test_same_rows_with_other_partitions(spark):
    first = catalog.QUERIES["j14_nearest_edge"](spark, f"{DATA}/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        again = catalog.QUERIES["j14_nearest_edge"](spark, f"{DATA}/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(first) == sorted(again)
