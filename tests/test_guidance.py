"""Maneuvers and sessions on known cases, and the session in batch and stream."""

import math

from pyspark.sql import functions as F

from waymark.operators.maneuvers import maneuvers
from waymark.plans import guidance
from waymark.streaming import session
from waymark.streaming.fold import fold, fold_stream

from .compare import DATA

STEP = "route_id long, idx long, kind int, road_class int, length_m double, points array<struct<x:double,z:double>>, x1 double, z1 double, x2 double, z2 double, turn_type int"


def route(spark, corners, classes=None, kinds=None, turns=None):
    rows = []
    for k, ((x1, z1), (x2, z2)) in enumerate(zip(corners, corners[1:])):
        rows.append((1, k, (kinds or {}).get(k, 0), (classes or {}).get(k, 1), math.hypot(x2 - x1, z2 - z1), [], float(x1), float(z1), float(x2), float(z2), (turns or {}).get(k)))
    return spark.createDataFrame(rows, STEP)


def told(steps, spark, siblings=()):
    other = spark.createDataFrame(list(siblings), "route_id long, idx long, tangent double")
    rows = maneuvers(steps, other).collect()
    return [(r["maneuver"], r["idx"], round(r["distance_from_prev"], 3)) for r in sorted(rows, key=lambda r: (r["idx"], r["maneuver"] == "Arrive"))]


def test_right_turn_and_motorway(spark):
    """Distances leave out the first edge and the last, and start anew at each maneuver."""
    steps = route(spark, [(0, 0), (1000, 0), (1000, 500), (1000, 1500), (1000, 3000)], classes={3: 3})
    assert told(steps, spark) == [("Depart", 0, 0.0), ("Right", 1, 0.0), ("EnterMotorway", 3, 1500.0), ("Arrive", 3, 0.0)]


def test_gentle_curves_are_not_told(spark):
    bend = math.radians(10)
    steps = route(spark, [(0, 0), (1000, 0), (1000 + 1000 * math.cos(bend), 1000 * math.sin(bend))])
    assert [m[0] for m in told(steps, spark)] == ["Depart", "Arrive"]


def test_turn_types_forks_and_ferries(spark):
    east, slope = (1000, 0), (1000 + 800 * math.cos(0.6), 800 * math.sin(0.6))
    assert [m[0] for m in told(route(spark, [(0, 0), east, slope]), spark)] == ["Depart", "SlightRight", "Arrive"]
    assert [m[0] for m in told(route(spark, [(0, 0), east, slope]), spark, [(1, 1, 0.1)])] == ["Depart", "KeepRight", "Arrive"]
    assert [m[0] for m in told(route(spark, [(0, 0), east, slope]), spark, [(1, 1, -0.5)])] == ["Depart", "SlightRight", "Arrive"]
    assert [m[0] for m in told(route(spark, [(0, 0), east, (1000, -50)], kinds={1: 1}, turns={1: -1}), spark)] == ["Depart", "Left", "Arrive"]
    assert [m[0] for m in told(route(spark, [(0, 0), east, (1200, 0)], kinds={1: 1}, turns={1: 2}), spark)] == ["Depart", "UTurn", "Arrive"]
    assert [m[0] for m in told(route(spark, [(0, 0), east, (1200, 0), (1200, 90)], kinds={1: 2, 2: 3}), spark)] == ["Depart", "Ferry", "Train", "Arrive"]


def states(frames, **options):
    state, out = {}, []
    for n, f in enumerate(frames):
        row = {"vehicle": 1, "seq": n, "x": 0.0, "z": 0.0, "speed_ms": 9.0, "matched": True, "remaining_m": 500.0, "has_destination": True, "plan_ok": True} | f
        state, made = session.session_step(state, row, **options)
        out.append(made["state"])
    return out


def test_session_runs_from_planning_to_arrival():
    assert states([{"has_destination": False}, {}, {}, {}, {"remaining_m": 10.0}, {}]) == ["Idle", "Planning", "Navigating", "Navigating", "Arrived", "Arrived"]
    assert states([{}, {"plan_ok": False}, {}]) == ["Planning", "Error", "Error"]
    assert states([{}, {}] + [{"speed_ms": 0.0}] * 3, pause_frames=3)[-2:] == ["Navigating", "Paused"]


def test_off_route_by_frames_and_by_metres():
    still = states([{}, {}] + [{"matched": False}] * 15 + [{}])
    assert still[5:7] == ["Navigating", "SuspectedOffRoute"] and still[15:] == ["SuspectedOffRoute", "Rerouting", "Navigating"]
    moving = states([{}, {}] + [{"matched": False, "x": 30.0 * k} for k in range(1, 4)])
    assert moving[-2:] == ["Navigating", "Rerouting"]  # 90 m after three frames
    assert states([{}, {}] + [{"matched": False}] * 6 + [{}])[-1] == "Navigating"


def test_session_in_batch_and_stream(spark, tmp_path):
    rows = guidance._watched(spark, f"{DATA}/sf0.001").where("vehicle < 8")
    batch = fold(rows, "vehicle", ["sim_us", "seq"], session.session_step, {}, session.SESSION_SCHEMA).collect()
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fold_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "vehicle", ["sim_us", "seq"], session.session_step, {}, session.SESSION_SCHEMA)
    run = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, batch))
    assert {r["state"] for r in batch} >= {"Planning", "Navigating", "Arrived"}


def test_every_state_and_maneuver_occurs(spark):
    d = f"{DATA}/sf0.01"
    assert {r["state"] for r in guidance.x05_off_route_states(spark, d).collect()} >= {"Idle", "Planning", "Navigating", "Rerouting", "Arrived", "Paused", "Error"}
    kinds = {r[0] for r in guidance.w08_maneuvers(spark, d).select("maneuver").distinct().collect()}
    assert kinds >= {"Depart", "Arrive", "Ferry", "Train", "EnterMotorway", "ExitMotorway", "KeepLeft", "KeepRight", "Left", "SharpRight", "SlightLeft", "UTurn"}
    assert guidance.f08_forks(spark, d).agg(F.sum("n")).first()[0] > 0
