"""Readers and writers of traces, baselines and samples in text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import export

FRAME_SCHEMA = "t double, sequence long, running boolean, paused boolean, simulation_time long, game_time_minutes long, position array<double>, heading array<double>, speed double, speed_limit double, job struct<destination_city:string,destination_company:string,income:long>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of text files with their numbers from 0, however a file is split over tasks.

    Each split counts its own lines, a running sum over a file's splits tells where each begins.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("row"))
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    return raw.join(places, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "text")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Frames of JSON lines, each file up to its first line that cannot be read, as a replay stops there.

    The first bad line of a file is a minimum over its lines' numbers; no task holds a whole file.
    """
    rows = numbered_lines(spark, path).where("trim(text) <> ''").withColumn("frame", F.from_json("text", FRAME_SCHEMA, {"mode": "PERMISSIVE"}))
    rows = rows.withColumn("bad", F.col("frame").isNull() | F.col("frame.sequence").isNull())
    first = rows.where("bad").groupBy("file").agg(F.min("line").alias("stop"))
    kept = rows.join(first, "file", "left").where("stop is null or line < stop")
    return kept.select("file", "line", "frame.*")


def write_trace(frames: DataFrame, path: str) -> None:
    frames.write.json(path)


BASELINE_COLUMNS = ("region", "from", "to", "distance_m", "eta_s", "edges", "transit", "company")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Lines of eight fields parted by bars; lines of another width are left out, bad numbers become -1 (counts 0)."""
    parts = spark.read.text(path).select(F.split("value", "[|]").alias("f")).where(F.size("f") == len(BASELINE_COLUMNS))
    number = lambda i, kind, other: F.coalesce(F.col("f")[i].try_cast(kind), F.lit(other).cast(kind))
    named = [F.col("f")[i].alias(n) for i, n in enumerate(BASELINE_COLUMNS[:3])]
    return parts.select(*named, number(3, "double", -1).alias("distance_m"), number(4, "double", -1).alias("eta_s"), number(5, "long", 0).alias("edges"), (F.col("f")[6] == "true").alias("transit"), (F.col("f")[7] == "true").alias("company"))


def write_baseline(rows: DataFrame, path: str) -> None:
    whole = lambda c: F.format_string("%.0f", F.col(c).cast("double"))
    line = F.concat_ws("|", "region", "from", "to", whole("distance_m"), whole("eta_s"), F.col("edges").cast("string"), F.col("transit").cast("string"), F.col("company").cast("string"))
    rows.select(line.alias("value")).write.text(path)


def read_phase_events(spark: SparkSession, path: str) -> DataFrame:
    """Phase events as CSV; malformed rows are left out."""
    schema = "wall_ms long, sim_us long, paused_sim_us long, game_min long, scale double, kind string"
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")


def read_clock_samples(spark: SparkSession, path: str) -> DataFrame:
    """Clock samples as CSV with a header; the speed may be lacking. Shorter rows and unreadable ones are left out."""
    schema = "wall_ms long, sim_us long, paused_sim_us long, render_us long, game_min long, scale double, speed_kph double"
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return rows.dropna(subset=["wall_ms", "sim_us", "paused_sim_us", "game_min", "scale"])


def read_frame_times(spark: SparkSession, path: str, column: int = 10, longest_ms: float = 500.0) -> DataFrame:
    """(frame_ms) from a column, counted from one, of CSV files of any width; headers and times out of range are left out."""
    value = F.get(F.split("value", ","), F.lit(column - 1)).try_cast("double").alias("frame_ms")
    return spark.read.text(path).select(value).where((F.col("frame_ms") > 0) & (F.col("frame_ms") < longest_ms))


def open_dataset(spark: SparkSession, folder: str, required: tuple[str, ...] = ("node", "edge"), prints: bool = False) -> dict[str, DataFrame]:
    """Tables of a dataset whose manifest.json names format 2 and each table's rows; fails if a count differs.

    With `prints`, every table is read whole and held against its fingerprint too.
    """
    manifest = spark.read.json(f"{folder}/manifest.json", multiLine=True, schema="format int, tables map<string,long>, prints map<string,string>").first()
    if manifest is None or manifest["format"] != 2:
        raise ValueError(f"{folder} is no dataset of format 2")
    found = {}
    for name, rows in manifest["tables"].items():
        found[name] = spark.read.parquet(f"{folder}/{name}")
        if found[name].count() != rows:
            raise ValueError(f"{name} has another number of rows than its manifest")
        if prints and export.fingerprint(found[name]).first()["print"] != (manifest["prints"] or {}).get(name):
            raise ValueError(f"{name} has other rows than its manifest")
    if missing := set(required) - set(found):
        raise ValueError(f"{folder} lacks {sorted(missing)}")
    return found


def write_dataset(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables as Parquet and a manifest with their counts and fingerprints last, so that a manifest tells a whole dataset."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    counts = {name: spark.read.parquet(f"{folder}/{name}").count() for name in tables}
    prints = {name: export.fingerprint(spark.read.parquet(f"{folder}/{name}")).first()["print"] for name in tables}
    one = spark.createDataFrame([(2, counts, prints)], "format int, tables map<string,long>, prints map<string,string>")
    one.coalesce(1).write.json(f"{folder}/manifest.json")


def write_document(sections: DataFrame, path: str) -> None:
    """Sections (section, document) as one JSON object, a key for each; sections are few."""
    one = sections.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "document")))).alias("m"))
    body = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ",")
    one.select(F.concat(F.lit("{"), body, F.lit("}")).alias("value")).coalesce(1).write.text(path)
