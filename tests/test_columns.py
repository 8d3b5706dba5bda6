"""Folds by columns give the rows of folds by rows, over batches of any size, in batch and in streams."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from waymark.plans import guidance
from waymark.sources import roads
from waymark.streaming import session, vehicle
from waymark.streaming.columns import ColumnStep, fold_columns, fold_columns_stream

from .compare import DATA, plain
from .test_streaming import plain as plain_fold

D = f"{DATA}/sf0.001"


@pytest.fixture(params=[(10_000, 0), (7, 0), (10_000, 10**9), (20, 4)])
def small(spark, request, monkeypatch):
    """Arrow batches of so many rows (slices of one number then reach over several); the rows of a narrow slice are yielded."""
    size, narrow = request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for name in ("MATCH_COLUMNS", "TRACK_COLUMNS"):
        monkeypatch.setattr(vehicle, name, replace(getattr(vehicle, name), narrow=narrow))
    yield narrow
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def same(have, want, names):
    have = sorted((tuple(plain(r[n]) for n in names) for r in have.collect()), key=repr)
    assert have == sorted((tuple(plain(r.get(n)) for n in names) for r in want), key=repr)
    assert have


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_sessions(spark, small):
    rows = guidance._watched(spark, D)
    want = plain_fold(dicts(rows), lambda s, r: session.session_step(s, r, 4))
    same(fold_columns(rows, ["vehicle"], ["sim_us", "seq"], replace(session.session_columns(4), narrow=small), session.SESSION_SCHEMA), want, session.SESSION_SCHEMA.names)


def test_gates(spark, small):
    rows = roads.frame(spark, D).select("vehicle", "seq", (F.col("sim_us") * 60).alias("sim_us"), F.concat(F.lit("k"), F.col("seq") % 3).alias("kind"))
    want = plain_fold(dicts(rows), lambda s, r: vehicle.gate_step(s, r, 20.0))
    same(vehicle.gate(rows, 20.0), want, vehicle.GATE_SCHEMA.names)
    step = replace(vehicle.gate_columns(20.0), narrow=small)
    same(fold_columns(rows, ["vehicle", "kind"], ["sim_us", "seq"], step, vehicle.GATE_SCHEMA), want, vehicle.GATE_SCHEMA.names)
    assert {r["allowed"] for r in want} == {True, False}


def test_matches(spark, small):
    f = roads.frame(spark, D)
    away = F.when(F.col("seq") % 5 == 0, 40.0).when(F.col("vehicle") % 4 == 0, 5000.0).otherwise(0.0)
    frames = f.select("vehicle", "seq", "sim_us", (F.col("x") + away).alias("x"), "z", (F.col("seq") % 7 * 0.5 - 1.5).alias("heading"))
    near = vehicle.with_candidates(frames, roads.edge(spark, D))
    want = plain_fold(dicts(near), vehicle.match_step)
    same(vehicle.match(frames, roads.edge(spark, D)), want, vehicle.MATCH_SCHEMA.names)
    assert {r["confidence"] for r in want} >= {"HIGH", "UNMATCHED"}


def test_a_lost_vehicle_is_searched_afresh(spark):
    """After more than 30 lost frames edges count from farther away, and nothing follows any more."""
    edges = spark.createDataFrame([(0, 0, 1, 0, 0.0, 0.0, 1000.0, 0.0), (1, 1, 2, 0, 1000.0, 0.0, 2000.0, 0.0)], "edge_id long, src long, dst long, kind int, x1 double, z1 double, x2 double, z2 double")
    for lost in (30, 31):
        rows = [(7, 0, 0, 500.0, 1.0, 0.0)] + [(7, i, i, 500.0, 900.0, 0.0) for i in range(1, lost + 1)] + [(7, 99, 99, 1500.0, 1.0, 0.0)]
        last = {r["seq"]: r for r in vehicle.match(spark.createDataFrame(rows, "vehicle long, seq long, sim_us long, x double, z double, heading double"), edges).collect()}[99]
        assert last["edge_id"] == 1 and last["score"] == pytest.approx(0.5 * 0.95 + 0.3 + 0.2 * (1.0 if lost == 30 else 0.5))


def test_tracks(spark, small):
    route = roads.route_edge(spark, D).where("route_id < 40")
    f = roads.frame(spark, D).withColumn("route_id", F.col("vehicle") % 40)
    matches = f.join(route.select("route_id", F.col("edge_ref"), "length_m"), "route_id").where((F.col("seq") + F.col("edge_ref")) % 3 == 0)
    one = matches.groupBy("vehicle", "route_id", "seq", "sim_us").agg(F.min("edge_ref").alias("edge_ref")).withColumn("offset", F.col("seq") % 10 * 1.0)
    twice = route.unionByName(route.withColumn("idx", F.col("idx") + 3))  # edges driven twice
    got = vehicle.track(one, twice)
    starts = {}
    for r in sorted(dicts(twice), key=lambda r: (r["route_id"], r["idx"])):
        starts.setdefault(r["route_id"], []).append(r)
    rows = []
    for m in dicts(one):
        walk, at, places = starts.get(m["route_id"], []), 0.0, []
        for e in walk:
            places += [{"idx": e["idx"], "start_m": at}] * (e["edge_ref"] == m["edge_ref"])
            at += e["length_m"]
        rows.append(m | {"places": places, "route_m": at})
    names = ["vehicle", "seq", "idx"]
    if len({(r["route_id"], r["idx"]) for r in dicts(twice)}) == twice.count():  # else windows order ties as they like
        names += ["travelled_m", "remaining_m"]
    same(got, plain_fold(rows, vehicle.track_step), names)


#: Counts a key's rows and those with a list, and tells the odd ones.
def _count(was, rows):
    values, count = rows["many"]
    n = was["n_seen"] + 1
    total = was["total"] + rows["x"]
    return {"n_seen": n, "total": total}, {"n_seen": n, "total": (total, count > 0), "word": n % 2}, n % 2 == 1


COUNT = ColumnStep({"n_seen": 0, "total": 0.0}, ("x", "many"), ("n_seen", "total", "word"), _count, {"word": ("even", "odd")})
COUNTED = "a string, b int, t int, n_seen long, total double, word string"


def counted(rows):
    out, seen = [], {}
    for a, b, t, x, many in sorted(rows, key=lambda r: (repr(r[:2]), r[2])):
        n, total = seen.get((a, b), (0, 0.0))
        seen[a, b] = n, total = n + 1, total + (float("nan") if x is None else x)
        if n % 2:
            out.append({"a": a, "b": b, "t": t, "n_seen": n, "total": total if many and total == total else None, "word": "odd"})
    return out


ROWS = [("u" if k % 3 else None, k % 2 if k % 5 else None, k, None if k == 50 else k * 0.5, [k] * (k % 3) if k % 4 else None) for k in range(60)] + [("hot", 1, k, 1.0, [1]) for k in range(200)]


def schema(spark):
    return spark.createDataFrame([], COUNTED).schema


def test_null_keys_lists_and_clashing_names(spark, small):
    rows = spark.createDataFrame(ROWS, "a string, b int, t int, x double, many array<int>").withColumns({"n": F.lit("n"), "AT": F.lit(1), "bucket": F.lit(2)})
    same(fold_columns(rows, ["a", "b"], ["t"], COUNT, schema(spark)), counted(ROWS), schema(spark).names)
    assert fold_columns(rows.limit(0), ["a", "b"], ["t"], COUNT, schema(spark)).collect() == []


def test_stream_with_null_keys(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "a string, b int, t int, x double, many array<int>").withColumn("bucket", F.lit("b"))
    for lo, hi in ((0, 17), (17, 18), (18, 500)):
        rows.where(F.col("t").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = fold_columns_stream(stream, ["a", "b"], ["t"], COUNT, schema(spark), buckets=3)
    run = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    same(spark.read.schema(schema(spark)).parquet(str(tmp_path / "out")), counted(ROWS), schema(spark).names)


def test_sessions_in_streams(spark, tmp_path):
    rows = guidance._watched(spark, D)
    for k in range(3):
        part = rows.where(f"int(sim_us div 1000000) = {k}" if k < 2 else "int(sim_us div 1000000) >= 2")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = fold_columns_stream(stream, ["vehicle"], ["sim_us", "seq"], session.session_columns(4), session.SESSION_SCHEMA, buckets=4)
    run = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = plain_fold(dicts(rows), lambda s, r: session.session_step(s, r, 4))
    same(spark.read.schema(session.SESSION_SCHEMA).parquet(str(tmp_path / "out")), want, session.SESSION_SCHEMA.names)
