"""Ordered analytics over telemetry frames and signal-phase events: windows by vehicle or junction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def by_arrival() -> WindowSpec:
    return Window.partitionBy("vehicle").orderBy("sim_us", "seq")


def by_wall() -> WindowSpec:
    return Window.partitionBy("junction_id").orderBy("wall_ms", "event_id")


TELEPORT_M, RESET_US = 50.0, 1_000_000


def _before(name: str, order: WindowSpec | None = None) -> Column:
    return F.lag(name).over(order or by_arrival())


def frame_events(frames: DataFrame) -> DataFrame:
    """What changed from the frame before: one row per frame and event."""
    moved = F.sqrt(F.pow(F.col("x") - _before("x"), 2) + F.pow(F.col("z") - _before("z"), 2))
    flags = {
        "SequenceRestart": F.col("seq") < _before("seq"),
        "SimTimeReset": F.col("sim_us") < _before("sim_us") - RESET_US,
        "Teleport": moved > TELEPORT_M,
        "PauseChanged": F.col("paused") != _before("paused"),
        "JobChanged": ~F.col("job_dest").eqNullSafe(_before("job_dest")) & _before("seq").isNotNull(),
    }
    rows = frames.withColumn("event", F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()])))
    return rows.select("vehicle", "seq", F.explode("event").alias("event"))


def phase_intervals(events: DataFrame) -> DataFrame:
    """Each phase event with the time to the next; resets and profile marks are left out first."""
    kept = events.where("kind not in ('RST', 'PROF')")
    return kept.select("junction_id", "event_id", "kind", F.lead("kind").over(by_wall()).alias("next_kind"), (F.lead("wall_ms").over(by_wall()) - F.col("wall_ms")).alias("interval_ms")).where("next_kind is not null")


def same_kind_intervals(events: DataFrame) -> DataFrame:
    """Intervals between neighbours of the same kind."""
    return phase_intervals(events).where("kind = next_kind").select("junction_id", "event_id", "kind", "interval_ms")


def warps(events: DataFrame, threshold_us: int = 300_000, longest_ms: int = 5000) -> DataFrame:
    """Where simulation time runs ahead of scaled wall time by more than the threshold."""
    wall = F.col("wall_ms") - _before("wall_ms", by_wall())
    ahead = F.col("sim_us") - _before("sim_us", by_wall()) - wall * F.col("scale") * 1000
    rows = events.withColumns({"gap_ms": wall, "ahead_us": ahead})
    return rows.where((F.col("gap_ms") > 0) & (F.col("gap_ms") <= longest_ms) & (F.col("ahead_us") > threshold_us)).select("junction_id", "event_id", "gap_ms", F.col("ahead_us").cast("long").alias("ahead_us"))


def resets(events: DataFrame) -> DataFrame:
    """Events before which simulation time went back."""
    return events.withColumn("before", _before("sim_us", by_wall())).where("sim_us < before").select("junction_id", "event_id", (F.col("before") - F.col("sim_us")).alias("back_us"))


def load_windows(events: DataFrame, cycle_ms: int = 14_000, tolerance: float = 0.15) -> DataFrame:
    """R2G events in runs whose gaps are whole cycles; another gap begins a new window."""
    reds = events.where("kind = 'R2G'")
    gap = (F.col("wall_ms") - _before("wall_ms", by_wall())) / cycle_ms
    new = F.when(gap.isNull() | (F.abs(gap - F.round(gap)) >= tolerance), 1).otherwise(0)
    rows = reds.withColumn("new", new).withColumn("window", F.sum("new").over(by_wall()))
    return rows.groupBy("junction_id", "window").agg(F.count("*").alias("events"), F.min("wall_ms").alias("from_ms"), F.max("wall_ms").alias("to_ms"))


def streaks(frames: DataFrame, condition: Column) -> DataFrame:
    """Lengths of unbroken runs of frames for which a condition holds."""
    rows = frames.withColumns({"hit": F.coalesce(condition, F.lit(False)), "n": F.row_number().over(by_arrival())}).where("hit")
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(by_arrival()))
    return rows.groupBy("vehicle", "island").agg(F.min("seq").alias("from_seq"), F.count("*").alias("frames")).select("vehicle", "from_seq", "frames")


def off_route(frames: DataFrame, unmatched: Column, suspect: int = 5, confirm: int = 15) -> DataFrame:
    """Off-route state of each frame by the length of its unmatched streak so far."""
    rows = frames.withColumns({"miss": F.coalesce(unmatched, F.lit(False)).cast("int")})
    rows = rows.withColumn("group", F.sum(1 - F.col("miss")).over(by_arrival()))
    run = F.sum("miss").over(Window.partitionBy("vehicle", "group").orderBy("sim_us", "seq"))
    return rows.withColumn("streak", run).select("vehicle", "seq", "streak", F.when(F.col("streak") >= confirm, "OFF_ROUTE").when(F.col("streak") >= suspect, "SUSPECTED").otherwise("ON_ROUTE").alias("state"))


def nearest_events(left: DataFrame, right: DataFrame, k: int, bucket_ms: int = 60_000, reach_ms: int = 60_000) -> DataFrame:
    """The k events of `right` nearest in wall time to each of `left`, of the same junction and within reach.

    Both sides meet in buckets of time, so a junction's events are not all paired.
    """
    b = F.floor(F.col("wall_ms") / bucket_ms)
    l = left.select("junction_id", F.col("event_id").alias("left_id"), F.col("wall_ms").alias("left_ms"), F.explode(F.sequence(F.floor((F.col("wall_ms") - reach_ms) / bucket_ms), F.floor((F.col("wall_ms") + reach_ms) / bucket_ms))).alias("b"))
    r = right.select("junction_id", F.col("event_id").alias("right_id"), F.col("wall_ms").alias("right_ms"), b.alias("b"))
    pairs = l.join(r, ["junction_id", "b"]).withColumn("dt", F.abs(F.col("right_ms") - F.col("left_ms"))).where(F.col("dt") <= reach_ms)
    order = Window.partitionBy("left_id").orderBy("dt", "right_ms", "right_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("left_id", "rank", "right_id", "dt")


def next_events(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The next k events of `right` at or after each of `left` in its junction, by their ordinal numbers."""
    rows = left.select("junction_id", "event_id", "wall_ms", F.lit(0).alias("side")).unionByName(right.select("junction_id", "event_id", "wall_ms", F.lit(1).alias("side")))
    order = Window.partitionBy("junction_id").orderBy("wall_ms", "side", "event_id")
    rows = rows.withColumn("n", F.sum("side").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    asked = rows.where("side = 0").select("junction_id", F.col("event_id").alias("left_id"), F.col("wall_ms").alias("left_ms"), F.posexplode(F.sequence(F.col("n") + 1, F.col("n") + k)).alias("pos", "n"))
    there = rows.where("side = 1").select("junction_id", "n", F.col("event_id").alias("right_id"), F.col("wall_ms").alias("right_ms"))
    return asked.join(there, ["junction_id", "n"]).select("left_id", (F.col("pos") + 1).cast("long").alias("rank"), "right_id", (F.col("right_ms") - F.col("left_ms")).alias("dt"))


def interval_averages(events: DataFrame, value: str, before_ms: int, bucket_ms: int = 60_000) -> DataFrame:
    """Each event with the average of a value over its junction's events of the `before_ms` up to it."""
    over = Window.partitionBy("junction_id").orderBy("wall_ms").rangeBetween(-before_ms, Window.currentRow)
    return events.select("event_id", F.round(F.avg(value).over(over), 6).alias("average"), F.count("*").over(over).alias("n"))
