"""Tables and documents of a built map, readers of samples."""

import json
from pathlib import Path

import pytest

from waymark.operators import export
from waymark.plans import catalog
from waymark.sources import traces

from .compare import DATA

EDGE = "edge_id long, src long, dst long, kind int, speed_limit int, road_class int, x1 double, z1 double, x2 double, z2 double"


def test_ways_of_roads(spark):
    rows = [(0, 1, 2, 0, 50, 1, 0.0, 0.0, 3.0, 4.0), (1, 2, 1, 0, 50, 1, 3.0, 4.0, 0.0, 0.0), (2, 2, 3, 0, 50, 1, 0.0, 0.0, 1.0, 0.0), (5, 4, 5, 0, 80, 1, 0.0, 0.0, 0.0, 2.0)]
    got = {r["road"]: (r["node0"], r["node1"], r["direction"], r["length_m"]) for r in export.road_ways(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {0: (1, 2, "Both", 5.0), 1: (2, 3, "ForwardOnly", 1.0), 2: (5, 4, "BackwardOnly", 2.0)}
    assert export.road_ways(spark.createDataFrame([], EDGE)).collect() == []
    assert export.road_table(export.road_ways(spark.createDataFrame(rows, EDGE))).orderBy("uid").first()["node1"] == "0000000000000002"


def test_fingerprint(spark):
    mark = lambda rows, schema="a string, `b``c` int": export.fingerprint(spark.createDataFrame(rows, schema)).first()["print"]
    rows = [("x", 1), (None, 2), ("", 2)]
    assert mark(rows) == mark(rows[::-1])
    assert len({mark(r) for r in (rows, rows[:2], rows + rows[:1], [("x", 1), ("", 2), ("", 2)], [("x", None), (None, 2), ("", 2)], [])}) == 6
    assert mark([], "a string") == "0:0" and mark(rows, "a string, d int") != mark(rows)


def test_dataset_with_changed_rows(spark, tmp_path):
    folder = str(tmp_path / "set")
    traces.write_dataset(spark, {"node": spark.range(5), "edge": spark.range(3)}, folder)
    assert traces.open_dataset(spark, folder, prints=True)["edge"].count() == 3
    spark.range(1, 6).write.mode("overwrite").parquet(f"{folder}/node")
    traces.open_dataset(spark, folder)  # as many rows
    with pytest.raises(ValueError, match="node has other rows"):
        traces.open_dataset(spark, folder, prints=True)


def test_diagnostics_document(spark, tmp_path):
    sections = catalog.QUERIES["k04_diagnostics"](spark, f"{DATA}/sf0.001")
    traces.write_document(sections, str(tmp_path / "out"))
    (part,) = Path(tmp_path / "out").glob("part-*")
    found = json.loads(part.read_text())
    assert set(found) == {"roads", "movements", "junctions", "ferries", "terminals", "companies", "graph"}
    assert found["roads"]["total"] > found["roads"]["one_way"] > 0 and found["companies"]["total"] > found["companies"]["no_access"]


def test_an_isolated_terminal(spark):
    rows = [(0, 1, 2, 0, 50, 1, 0.0, 0.0, 3.0, 4.0), (2, 2, 3, 2, -1, 1, 0.0, 0.0, 1.0, 0.0)]
    e = spark.createDataFrame([(*r, -1) for r in rows], EDGE + ", semaphore_id int")
    moves = spark.createDataFrame([(7, 1, 2, 5.0), (7, 2, 1, 5.0)], "junction_id long, entry long, exit long, length_m double")
    found = {r["section"]: json.loads(r["document"]) for r in export.diagnostics(export.road_ways(e), e, moves, spark.createDataFrame([(1, 3), (2, 99)], "poi_id long, access_uid long")).collect()}
    assert found["terminals"] == {"total": 2, "isolated": 1} and found["companies"] == {"total": 2, "no_access": 1}
    assert found["junctions"] == {"total": 1, "movements": 2} and found["ferries"] == {"total": 1, "one_way": 1}


def test_clock_samples(spark, tmp_path):
    (tmp_path / "s.csv").write_text("wall_ms,sim_us,paused_sim_us,render_us,game_min,scale,speed_kph\n1,2,3,4,5,1.5,80\n1,2,3\n6,7,8,9,10,3\n1,x,3,4,5,1,2\n")
    assert sorted(map(tuple, traces.read_clock_samples(spark, str(tmp_path / "s.csv")).collect()), key=repr) == [(1, 2, 3, 4, 5, 1.5, 80.0), (6, 7, 8, 9, 10, 3.0, None)]


def test_frame_times(spark, tmp_path):
    line = lambda v: ",".join(["0"] * 9 + [v, "1"])
    (tmp_path / "f.csv").write_text("\n".join([line("MsBetweenPresents"), line("16.5"), line("0"), line("500"), line("499.9"), "1,2"]) + "\n")
    assert sorted(r["frame_ms"] for r in traces.read_frame_times(spark, str(tmp_path / "f.csv")).collect()) == [16.5, 499.9]
