"""Liveness of sources: batch and stream tell the same changes, silence too."""

import random

from pyspark.sql import functions as F

from waymark.streaming.liveness import ROCKS_DB, liveness, liveness_stream

SCHEMA = "vehicle long, at_us long, seq long, sequence long"
STALE, GONE = 2_000_000, 5_000_000


def test_known_changes(spark):
    s = 1_000_000
    rows = [(1, 0, 0, 7), (1, s, 1, 7), (1, 4 * s, 2, 7), (1, 20 * s, 3, 7), (1, 21 * s, 4, 8), (1, 23 * s, 5, 9), (2, 30 * s, 6, 1)]
    found = sorted(map(tuple, liveness(spark.createDataFrame(rows, SCHEMA), STALE, GONE).collect()))
    want = [(1, 0, "Fresh"), (1, 2 * s, "Stale"), (1, 9 * s, "Disconnected"), (1, 20 * s, "Stale"), (1, 21 * s, "Fresh"), (1, 25 * s, "Stale"), (1, 28 * s, "Disconnected"), (2, 30 * s, "Fresh")]
    assert found == want
    assert liveness(spark.createDataFrame([], SCHEMA), STALE, GONE).count() == 0


def test_stream_is_the_batch(spark, tmp_path):
    """Frames arrive in several files; the last one, of another source, moves the watermark past all timers."""
    rng = random.Random(2)
    rows, now = [], {v: 0 for v in range(6)}
    for n in range(150):
        v = rng.randrange(6)
        now[v] += rng.choice([100_000, 900_000, 1_900_000, 2_500_000, 6_000_000])
        rows.append((v, now[v] + v, n, rng.randrange(3)))
    rows.sort(key=lambda r: (r[1], r[2]))
    far = rows[-1][1] + 100_000_000
    files = [rows[k : k + 30] for k in range(0, len(rows), 30)] + [[(99, far, 1000, 0)], [(99, far + 1_000_000, 1001, 1)]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("ts", F.timestamp_micros("at_us")).withWatermark("ts", "1 second")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    try:
        query = liveness_stream(stream, STALE, GONE).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = liveness(spark.createDataFrame(rows, SCHEMA), STALE, GONE, until_us=far).collect()
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["vehicle"] != 99]
    assert {"Fresh", "Stale", "Disconnected"} == {r[2] for r in found}
    assert sorted(found) == sorted(map(tuple, want))
