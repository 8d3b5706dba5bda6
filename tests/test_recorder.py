"""The sample sink: batch and stream, tasks tried again, batches written again, aborts; and lines numbered over splits."""

import pyarrow as pa

from waymark.sources import recorder
from waymark.sources.traces import numbered_lines, read_trace

SCHEMA = "wall_ms long, slot int, kind string, state int, x double"


def rows(spark, n, at=0):
    return spark.createDataFrame([(at + k, k % 3, "a,\"b", k % 4, k / 2) for k in range(n)], SCHEMA)


def read(spark, folder):
    return sorted(map(tuple, spark.read.csv(folder, header=True, schema=SCHEMA, escape='"').collect()))


def test_batch(spark, tmp_path):
    recorder.register(spark)
    folder = str(tmp_path / "out")
    want = sorted(map(tuple, rows(spark, 50).collect()))
    rows(spark, 50).repartition(4).write.format(recorder.FORMAT).mode("append").save(folder)
    assert read(spark, folder) == want
    rows(spark, 7, 100).write.format(recorder.FORMAT).mode("append").save(folder)
    assert len(read(spark, folder)) == 57
    rows(spark, 3).write.format(recorder.FORMAT).mode("overwrite").save(folder)
    assert len(read(spark, folder)) == 3


def test_tasks_that_are_tried_again_show_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    batch = pa.RecordBatch.from_pylist([{"wall_ms": 1, "slot": 2, "kind": "k", "state": 3, "x": 0.5}])
    writer = recorder._Writer(folder, False)
    lost, kept, none = writer.write(iter([batch])), writer.write(iter([batch])), writer.write(iter([]))
    assert lost.name != kept.name and none.name is None
    writer.commit([kept, none, None])
    assert read(spark, folder) == [(1, 2, "k", 3, 0.5)]
    again = writer.write(iter([batch, batch]))
    writer.abort([again, lost, None])
    assert read(spark, folder) == [(1, 2, "k", 3, 0.5)] and not list((tmp_path / "out" / "_staged").iterdir())
    stream = recorder._StreamWriter(folder)
    for _ in range(2):  # the same micro-batch, written again after a restart
        stream.commit([stream.write(iter([batch])), stream.write(iter([batch]))], 7)
    assert len(read(spark, folder)) == 3


def test_stream(spark, tmp_path):
    recorder.register(spark)
    for k in range(3):
        rows(spark, 5, 10 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.format(recorder.FORMAT).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r[0] for r in read(spark, str(tmp_path / "out"))] == [10 * k + i for k in range(3) for i in range(5)]


def test_lines_over_many_tasks(spark, tmp_path):
    texts = {"a": [f"line {k} " + "x" * (k % 90) for k in range(4000)], "b": ["", "one", "", ""], "c": ["é" * 70] * 900}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (name != "c"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = numbered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 1
        have = {}
        for r in found.collect():
            have.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line"], r["text"]))
        assert {n: sorted(v) for n, v in have.items()} == {n: list(enumerate(v)) for n, v in texts.items()}
        (tmp_path / "t").mkdir()
        frames = ['{"t": %d, "sequence": %d, "speed": 1.5}' % (k, k) for k in range(3000)]
        (tmp_path / "t" / "cut").write_text("\n".join(frames[:2500] + ["{broken"] + frames[2500:]))
        (tmp_path / "t" / "whole").write_text("\n".join(frames) + "\n")
        counts = {r["file"].rsplit("/", 1)[1]: r["count"] for r in read_trace(spark, str(tmp_path / "t")).groupBy("file").count().collect()}
        assert counts == {"cut": 2500, "whole": 3000}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
