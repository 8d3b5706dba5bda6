"""Road-network, telemetry and place tables derived from the driver's star schema.

The network is a grid: a node per part, edges to the right and upper neighbour, most of them both ways. Traces are
events by user, routes are orders, signal events are events by user. Formulas are those of FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cost, geometry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        uid.alias("uid"),
        ((uid % 50) * 100).cast("double").alias("x"),
        F.col("p_size").cast("double").alias("y"),
        (F.floor(uid / 50) * 100).cast("double").alias("z"),
        F.col("p_size"),
        F.col("p_name"),
    )


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges with straight geometry (x1, z1) to (x2, z2)."""
    return _edge(spark, sf_dir).drop("p_size")


def _edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = node(spark, sf_dir)
    size = F.col("p_size")
    out = a.withColumn("dir", F.explode(F.array(*map(F.lit, range(4))))).where(((F.col("dir") >= 2) | (F.col("uid") % 50 < 49)) & ((F.col("dir") % 2 == 0) | (size % 3 != 0)))
    out = out.withColumn("other", F.col("uid") + F.when(F.col("dir") < 2, 1).otherwise(50))
    b = a.select(F.col("uid").alias("other"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    back = F.col("dir") % 2 == 1
    kind = F.when(size % 7 == 0, 1).when(size == 50, 2).otherwise(0)
    limit = F.when((F.col("kind") != 0) | (size % 10 == 0), -1).when(size % 10 == 9, 0).otherwise(30 + 10 * (size % 10))
    return (
        out.join(b, "other")
        .withColumn("kind", kind)
        .select(
            (F.col("uid") * 4 + F.col("dir")).alias("edge_id"),
            F.when(back, F.col("other")).otherwise(F.col("uid")).alias("src"),
            F.when(back, F.col("uid")).otherwise(F.col("other")).alias("dst"),
            "kind",
            limit.alias("speed_limit"),
            (size % 4).alias("road_class"),
            (2 * (size % 11 == 0).cast("int") + 4 * (size % 13 == 0).cast("int")).alias("flags"),
            F.when((F.col("kind") == 1) & (size % 2 == 0), size).otherwise(-1).alias("semaphore_id"),
            F.when(back, F.col("bx")).otherwise(F.col("x")).alias("x1"),
            F.when(back, F.col("bz")).otherwise(F.col("z")).alias("z1"),
            F.when(back, F.col("x")).otherwise(F.col("bx")).alias("x2"),
            F.when(back, F.col("z")).otherwise(F.col("bz")).alias("z2"),
            "p_size",
        )
    )


def timed_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their length, time and cost by profile."""
    return _timed(edge(spark, sf_dir))


def _timed(edges: DataFrame, turn: Column | None = None) -> DataFrame:
    c = F.col
    e = edges.withColumn("length_m", geometry.distance(c("x1"), c("z1"), c("x2"), c("z2")))
    e = e.withColumn("time_s", cost.time_s(c("kind"), c("speed_limit"), c("semaphore_id"), c("length_m"), turn))
    return e.withColumns({p: cost.cost(p, c("time_s"), c("length_m"), c("flags")) for p in ("fastest", "shortest", "balanced")})


def turned_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed edges along their own polylines: movements bend in their middle, and sharp bends take time."""
    c = F.col
    e = _edge(spark, sf_dir)
    length = geometry.distance(c("x1"), c("z1"), c("x2"), c("z2"))
    aside = 65.0 * (c("p_size") % 5) / length
    point = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    begin, end = point(c("x1"), c("z1")), point(c("x2"), c("z2"))
    middle = point((c("x1") + c("x2")) / 2 - aside * (c("z2") - c("z1")), (c("z1") + c("z2")) / 2 + aside * (c("x2") - c("x1")))
    e = e.withColumn("points", F.when(c("kind") == 1, F.array(begin, middle, end)).otherwise(F.array(begin, end)))
    ends = (c("points"), c("x1"), c("z1"), c("x2"), c("z2"))
    e = e.withColumn("turn", F.abs(geometry.turn_angle(geometry.entry_tangent(*ends), geometry.exit_tangent(*ends))))
    return _timed(e.drop("p_size"), c("turn"))


def route_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    unknown = (F.col("l_returnflag") == "N") | (F.col("l_quantity") <= 5)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route_id"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("kind"),
        F.round(F.col("l_extendedprice") / 100, 4).alias("length_m"),
        F.when(unknown, -1).when(F.col("l_quantity") == 50, 0).otherwise(20 + 10 * F.floor(F.col("l_quantity") / 10)).cast("int").alias("speed_limit"),
        F.col("l_partkey").alias("edge_ref"),
    )


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route edges laid end to end in the plane: each turns against the one before and bends in its middle."""
    c = F.col
    by = Window.partitionBy("route_id").orderBy("idx")
    before, so_far = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = c("edge_ref")
    r = route_edge(spark, sf_dir).withColumn("kind", F.when(ref % 23 == 0, 2).when(ref % 29 == 0, 3).otherwise(c("kind")))
    r = r.withColumns({"turn": F.when(c("idx") == 0, 0.0).otherwise((ref * 7 % 13 - 6) * 0.25), "bend": F.when(c("kind") == 1, (ref % 9 - 4) * 0.45).otherwise((ref % 5 - 2) * 0.1)})
    r = r.withColumn("b_in", F.sum("turn").over(so_far) + F.coalesce(F.sum("bend").over(before), F.lit(0.0))).withColumn("b_out", c("b_in") + c("bend"))
    half = c("length_m") / 2
    r = r.withColumns({"mx": half * F.cos("b_in"), "mz": half * F.sin("b_in"), "dx": half * (F.cos("b_in") + F.cos("b_out")), "dz": half * (F.sin("b_in") + F.sin("b_out"))})
    r = r.withColumns({"x1": F.coalesce(F.sum("dx").over(before), F.lit(0.0)), "z1": F.coalesce(F.sum("dz").over(before), F.lit(0.0))})
    r = r.withColumns({"x2": c("x1") + c("dx"), "z2": c("z1") + c("dz")})
    point = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    points = F.array(point(c("x1"), c("z1")), point(c("x1") + c("mx"), c("z1") + c("mz")), point(c("x2"), c("z2")))
    turn = F.when(c("kind") == 1, F.when(ref % 6 == 0, -1).when(ref % 6 == 1, 0).when(ref % 6 == 2, 1).when(ref % 6 == 3, 2))
    return r.select("route_id", "idx", "kind", (F.floor(ref / 8) % 4).cast("int").alias("road_class"), "length_m", "speed_limit", points.alias("points"), "x1", "z1", "x2", "z2", turn.alias("turn_type"), "b_out", "edge_ref")


def walk_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another road out of the node where some of the walked edges begin."""
    c = F.col
    w = walk(spark, sf_dir).withColumn("before", F.lag("b_out").over(Window.partitionBy("route_id").orderBy("idx")))
    return w.where((c("idx") > 0) & ((c("edge_ref") + c("idx")) % 2 == 0)).select("route_id", "idx", (c("before") + (c("edge_ref") * 11 % 9 - 4) * 0.15).alias("tangent"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, order = _k(), Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("vehicle"),
        F.col("event_id").alias("seq"),
        (50_000 * F.row_number().over(order)).cast("long").alias("sim_us"),
        ((k % 50) * 100 + F.col("event_id") % 7).cast("double").alias("x"),
        (F.floor(k / 50) * 100 + F.col("event_id") % 5).cast("double").alias("z"),
        (F.col("value") / 10).alias("speed_ms"),
        (5 * (F.col("event_id") % 5)).cast("double").alias("limit_ms"),
        (F.col("event_type") == "error").alias("paused"),
        F.when(F.col("event_type") == "purchase", k).alias("job_dest"),
        F.col("ts"),
    )


def strayed_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames beside the roads by up to 45 m each way; every fifth vehicle is far off the map for 35 frames."""
    aside = F.col("seq") % 10 * 5.0
    away = F.when((F.col("vehicle") % 5 == 0) & F.col("sim_us").between(300_000, 2_000_000), 100_000.0).otherwise(0.0)
    return frame(spark, sf_dir).withColumns({"x": F.col("x") + aside + away, "z": F.col("z") + aside})


def signal_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = F.create_map(*[F.lit(x) for pair in (("click", "R2G"), ("view", "G2R"), ("signup", "OTHER"), ("error", "RST"), ("purchase", "PROF")) for x in pair])
    rn = F.row_number().over(order).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("junction_id"),
        F.col("event_id"),
        (7000 * rn + F.col("event_id") % 400).alias("wall_ms"),
        (21_000_000 * rn + 3000 * (F.col("event_id") % 400)).alias("sim_us"),
        F.lit(3.0).alias("scale"),
        F.element_at(kinds, F.col("event_type")).alias("kind"),
    )


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("City", "Company", "Garage", "Fuel", "Repair", "Rest", "Ferry", "Train")))
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(F.broadcast(n)).select(
        F.col("c_custkey").alias("poi_id"),
        F.element_at(kinds, (F.col("c_custkey") % 8 + 1).cast("int")).alias("kind"),
        F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_nationkey")).alias("name"),
        (3 * F.col("c_custkey") % F.col("n")).alias("access_uid"),
    )


def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("slot"),
        (key % 51).alias("light_id"),
        ((key % 50) * 100 + 4 * (key % 3)).cast("double").alias("x"),
        (F.floor(key / 50) * 100).cast("double").alias("z"),
        (key % 4).alias("state"),
        F.col("s_nationkey").cast("double").alias("time_remaining"),
    )


def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        n.alias("city_id"), F.col("n_name").alias("city"), ((n % 5) * 1000 + 500).cast("double").alias("cx"), (F.floor(n / 5) * 800 + 400).cast("double").alias("cz"), F.col("r_name").alias("country")
    )
