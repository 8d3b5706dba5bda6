"""Text formats, datasets and junctions."""

import pytest

from waymark.operators.junctions import exits_from, rings
from waymark.sources import roads, traces

from .compare import DATA


def test_trace_stops_at_the_first_bad_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t":0,"sequence":1,"speed":2.5}\n{"t":1,"sequence":2}\nnot json\n{"t":3,"sequence":4}\n')
    (tmp_path / "b.jsonl").write_text('{"t":0,"sequence":9}\n')
    rows = traces.read_trace(spark, str(tmp_path)).collect()
    assert sorted((r["sequence"], r["speed"]) for r in rows) == [(1, 2.5), (2, None), (9, None)]


def test_baseline_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("r|a|b|1200|90|7|true|false\nshort|line\nr|a|c|x|y|z|false|true\n")
    rows = traces.read_baseline(spark, str(tmp_path / "in.txt"))
    want = [("r", "a", "b", 1200.0, 90.0, 7, True, False), ("r", "a", "c", -1.0, -1.0, 0, False, True)]
    assert sorted(map(tuple, rows.collect())) == want
    traces.write_baseline(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, traces.read_baseline(spark, str(tmp_path / "out")).collect())) == want


def test_phase_events(spark, tmp_path):
    (tmp_path / "e.csv").write_text("wall_ms,sim_us,paused_sim_us,game_min,scale,kind\n1,2,3,4,1.5,R2G\nbad,row\n5,6,7,8,3,G2R\n")
    assert sorted(r["wall_ms"] for r in traces.read_phase_events(spark, str(tmp_path / "e.csv")).where("kind is not null").collect()) == [1, 5]


def test_dataset(spark, tmp_path):
    d = f"{DATA}/sf0.001"
    traces.write_dataset(spark, {"node": roads.node(spark, d), "edge": roads.edge(spark, d)}, str(tmp_path / "set"))
    assert traces.open_dataset(spark, str(tmp_path / "set"))["node"].count() == 200
    with pytest.raises(ValueError):
        traces.open_dataset(spark, str(tmp_path / "set"), ("poi",))
    spark.range(1).write.mode("append").parquet(str(tmp_path / "set/node"))
    with pytest.raises(ValueError):
        traces.open_dataset(spark, str(tmp_path / "set"))


def test_rings():
    ring = [(i, (i + 1) % 5, 20.0) for i in range(5)]
    arms = [(100 + i, i, 10.0) for i in range(4)] + [(i, 200 + i, 10.0) for i in range(1, 4)]
    assert rings(ring + arms) == [0, 1, 2, 3, 4]
    assert exits_from(ring + arms, [0, 1, 2, 3, 4], 100) == [(201, 1), (202, 2), (203, 3)]
    assert rings([(0, 1, 9.0), (2, 3, 9.0)]) is None
    assert rings([(a, b, 9.0) for a in range(4) for b in range(4)]) is None  # a full mesh
    assert rings([(a, b, 500.0) for a, b, _ in ring] + arms) is None
