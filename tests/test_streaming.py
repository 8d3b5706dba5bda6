"""Folds give the same rows in batch, in a stream and in plain Python."""

from waymark.sources import roads
from waymark.streaming import vehicle
from waymark.streaming.fold import fold, fold_stream

from .compare import DATA

D = f"{DATA}/sf0.001"


def plain(rows, step):
    out, states = [], {}
    for row in sorted(rows, key=lambda r: (r["vehicle"], r["sim_us"], r["seq"])):
        states[row["vehicle"]], made = step(states.get(row["vehicle"], {}), row)
        if made:
            out.append(made)
    return out


def test_batch_is_the_plain_fold(spark):
    frames = roads.frame(spark, D).drop("ts")
    want = sorted((r["vehicle"], r["seq"], r["events"]) for r in plain([r.asDict() for r in frames.collect()], vehicle.event_step))
    have = fold(frames, "vehicle", ["sim_us", "seq"], vehicle.event_step, {}, vehicle.EVENT_SCHEMA).collect()
    assert sorted(map(tuple, have)) == want


def test_stream_is_the_batch(spark, tmp_path):
    frames = roads.frame(spark, D).drop("ts")
    for k in range(3):  # arrive in three files, in order of time
        third = frames.where(f"int((sim_us div 50000 - 1) div 4) = {k}" if k < 2 else "int((sim_us div 50000 - 1) div 4) >= 2")
        third.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = fold_stream(stream, "vehicle", ["sim_us", "seq"], vehicle.event_step, {}, vehicle.EVENT_SCHEMA)
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = fold(frames, "vehicle", ["sim_us", "seq"], vehicle.event_step, {}, vehicle.EVENT_SCHEMA).collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want))


def test_known_events():
    def run(*frames):
        state, out = {}, []
        for f in frames:
            state, made = vehicle.event_step(state, {"vehicle": 1, "x": 0.0, "z": 0.0, "paused": False, "job_dest": None} | f)
            out.append(made["events"] if made else "")
        return out[1:]

    assert run({"seq": 1, "sim_us": 0}, {"seq": 2, "sim_us": 1, "x": 20.0}) == [""]
    assert run({"seq": 1, "sim_us": 0}, {"seq": 2, "sim_us": 1, "x": 500.0}) == ["Teleport"]
    assert run({"seq": 1, "sim_us": 0}, {"seq": 2, "sim_us": 1, "paused": True}) == ["PauseChanged"]
    assert run({"seq": 1, "sim_us": 500_000_000}, {"seq": 2, "sim_us": 100_000_000}) == ["SimTimeReset"]
    assert run({"seq": 11, "sim_us": 0}, {"seq": 1, "sim_us": 1}) == ["SequenceRestart"]
    assert run({"seq": 1, "sim_us": 0}, {"seq": 1, "sim_us": 1, "x": 900.0}) == [""]


def test_gate():
    state, out = {}, []
    for t in (0, 10, 31):
        state, made = vehicle.gate_step(state, {"vehicle": 1, "seq": t, "sim_us": t * 1_000_000, "kind": "a"})
        out.append(made["allowed"])
    assert out == [True, False, True]
    assert vehicle.gate_step(state, {"vehicle": 1, "seq": 9, "sim_us": 32_000_000, "kind": "b"})[1]["allowed"]


def test_parallel_roads_match_the_near_one(spark):
    edges = spark.createDataFrame([(0, 0, 1, 0, 0.0, 0.0, 1000.0, 0.0), (1, 2, 3, 0, 0.0, 100.0, 1000.0, 100.0)], "edge_id long, src long, dst long, kind int, x1 double, z1 double, x2 double, z2 double")
    frames = spark.createDataFrame([(7, i, i, 20.0 * i, 2.0, 0.0) for i in range(40)], "vehicle long, seq long, sim_us long, x double, z double, heading double")
    rows = vehicle.match(frames, edges).collect()
    assert len(rows) == 40 and {r["edge_id"] for r in rows} == {0} and {r["confidence"] for r in rows} == {"HIGH"}


def test_tracker(spark):
    route = spark.createDataFrame([(1, i, 10 + i, 1000.0) for i in range(3)], "route_id long, idx long, edge_ref long, length_m double")
    rows = [(7, 1, s, s, e, o) for s, (e, o) in enumerate([(10, 500.0), (11, 0.0), (10, 900.0), (11, 500.0), (99, 0.0), (12, 100.0)])]
    matches = spark.createDataFrame(rows, "vehicle long, route_id long, seq long, sim_us long, edge_ref long, offset double")
    got = {r["seq"]: (r["idx"], r["travelled_m"], r["remaining_m"]) for r in vehicle.track(matches, route).collect()}
    assert got == {0: (0, 500.0, 2500.0), 1: (1, 1000.0, 2000.0), 2: (0, 1000.0, 2000.0), 3: (1, 1500.0, 1500.0), 5: (2, 2100.0, 900.0)}


def test_tracker_keeps_within_its_window():
    state, _ = vehicle.track_step({}, {"vehicle": 1, "seq": 0, "offset": 0.0, "route_m": 9.0, "places": [{"idx": 0, "start_m": 0.0}, {"idx": 7, "start_m": 7.0}]})
    assert state["idx"] == 0
    assert vehicle.track_step(state, {"vehicle": 1, "seq": 1, "offset": 0.0, "route_m": 9.0, "places": [{"idx": 7, "start_m": 7.0}]})[1] is None
