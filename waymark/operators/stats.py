"""Statistics with exact order semantics, character inventories and pattern scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import checkpoint


def order_statistics(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """sorted[floor(n * q)] of each group, at most the last; the upper middle for q = 0.5. By rank, not by interpolation.

    Equal values are counted before they are shuffled. Counts are dealt by ranges of group and value, so that a large
    group is cumulated in many tasks; only one row for each group and task is gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    counts = checkpoint(counts.repartitionByRange(*keys, value).withColumn("task", F.spark_partition_id()))
    by_task = Window.partitionBy(*keys).orderBy("task")
    tasks = counts.groupBy(*keys, "task").agg(F.sum("c").alias("held"))
    tasks = tasks.withColumns({"before": F.coalesce(F.sum("held").over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("held").over(Window.partitionBy(*keys))})
    upto = F.sum("c").over(Window.partitionBy(*keys, "task").orderBy(value))
    ranked = counts.withColumn("upto", upto)
    same = [ranked[k].eqNullSafe(tasks[k]) for k in keys]
    ranked = ranked.join(tasks, [*same, ranked["task"] == tasks["task"]]).select(*[ranked[k] for k in keys], ranked[value], "n", "c", (F.col("before") + F.col("upto")).alias("end"))
    at = {name: F.least(F.floor(F.col("n") * q), F.col("n") - 1) for name, q in shares.items()}
    holds = lambda k: (k < F.col("end")) & (k >= F.col("end") - F.col("c"))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(holds(k), F.col(value))).alias(name) for name, k in at.items()], F.max(value).alias("largest"))


def characters(texts: DataFrame, text: str, by: str) -> DataFrame:
    """Code points of distinct texts: occurrences and texts that hold them, by group and block of 256."""
    distinct = texts.select(by, text).where(F.col(text).isNotNull()).distinct()
    chars = distinct.select(by, F.xxhash64(text).alias("t"), F.explode(F.split(text, "")).alias("c")).where("c <> ''")
    # a text's characters are counted before they are shuffled apart
    held = chars.groupBy(by, "t", "c").agg(F.count("*").alias("n"))
    found = held.groupBy(by, "c").agg(F.sum("n").alias("occurrences"), F.count("*").alias("texts"))
    return found.select(by, F.ascii("c").alias("code_point"), F.floor(F.ascii("c") / 256).cast("int").alias("block"), "occurrences", "texts")


#: Pattern classes of a privacy scan.
PATTERNS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "ipv4": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "long_number": "[0-9]{9,}",
    "key": "(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})",
}


def pattern_verdicts(texts: DataFrame, key: str, text: str, allowed: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, class, found, allowed) for each distinct match; allowed where (class, match) is on the list."""
    found = PATTERNS if patterns is None else patterns
    pairs = F.array(*[F.struct(F.lit(name).alias("class"), F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("matches")) for name, p in found.items()])
    rows = texts.where(F.col(text).isNotNull()).select(key, F.explode(pairs).alias("p")).select(key, "p.class", F.explode("p.matches").alias("found"))
    listed = allowed.select("class", F.col("match").alias("found"), F.lit(True).alias("listed")).distinct()
    return rows.join(listed, ["class", "found"], "left").select(key, "class", "found", F.coalesce("listed", F.lit(False)).alias("allowed"))


def pattern_scan(texts: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, class, hits) for each class of pattern that a text holds."""
    found = PATTERNS if patterns is None else patterns
    pairs = F.array(*[F.struct(F.lit(name).alias("class"), F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("hits")) for name, p in found.items()])
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(pairs).alias("p")).select(key, "p.class", F.col("p.hits").cast("long").alias("hits")).where("hits > 0")


def frame_rate(rows: DataFrame, key: str, frame_ms: str) -> DataFrame:
    """Frames per second over active frames (over 0 and under 500 ms): the mean, the middle frame's and the slowest hundredth's."""
    active = rows.where((F.col(frame_ms) > 0) & (F.col(frame_ms) < 500))
    ranks = order_statistics(active, [key], frame_ms, {"middle": 0.5, "slow": 0.99}).select(key, F.round(1000 / F.col("middle"), 6).alias("p50_fps"), F.round(1000 / F.col("slow"), 6).alias("low_fps"))
    return active.groupBy(key).agg(F.count("*").alias("frames"), F.round(1000 * F.count("*") / F.sum(frame_ms), 6).alias("mean_fps")).join(ranks, key)


def agreement(rows: DataFrame, key: str, a: Column, b: Column, limits: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Share of samples in which two values differ by at most each limit."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.count_if(F.abs(a - b) <= k) / F.count("*"), 6).alias(f"within_{k}") for k in limits])
