"""Tables and documents of a built map: roads, junctions, movements, diagnostics, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance

FERRY = 2


def hex_uid(uid: Column) -> Column:
    return F.lpad(F.lower(F.hex(uid)), 16, "0")


def road_ways(edges: DataFrame) -> DataFrame:
    """One row for each road of edges (edge_id, src, dst, kind, speed_limit, road_class, x1 to z2), whatever ways it runs.

    Edges 2k and 2k + 1 are the ways of road k, there and back. A road that runs back only is told from its own start.
    """
    forward = F.col("edge_id") % 2 == 0
    ends = F.min_by(F.when(forward, F.struct("src", "dst")).otherwise(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edge_id")
    length = F.max(distance(*(F.col(c) for c in ("x1", "z1", "x2", "z2"))))
    one = edges.groupBy(F.floor(F.col("edge_id") / 2).alias("road"), "kind", "speed_limit", "road_class").agg(
        ends.alias("e"), length.alias("length_m"), F.bool_or(forward).alias("there"), F.bool_or(~forward).alias("back")
    )
    way = F.when(F.col("there") & F.col("back"), "Both").when(F.col("there"), "ForwardOnly").otherwise("BackwardOnly")
    return one.select("road", "kind", "road_class", "speed_limit", F.col("e.src").alias("node0"), F.col("e.dst").alias("node1"), way.alias("direction"), "length_m")


def road_table(ways: DataFrame) -> DataFrame:
    uids = [hex_uid(F.col(c)).alias(n) for c, n in (("road", "uid"), ("node0", "node0"), ("node1", "node1"))]
    return ways.where("kind = 0").select(*uids, "road_class", "speed_limit", "direction", "length_m")


def movement_table(movements: DataFrame) -> DataFrame:
    """Movements (junction_id, entry, exit, length_m and more columns) by the names of their nodes."""
    uids = [hex_uid(F.col(c)).alias(n) for c, n in (("junction_id", "junction_uid"), ("entry", "entry"), ("exit", "exit"))]
    return movements.select(*uids, *(c for c in movements.columns if c not in ("junction_id", "entry", "exit")))


def junction_table(movements: DataFrame) -> DataFrame:
    """Nodes and movements of each junction. Only distinct nodes of a junction pass the shuffle."""
    ends = movements.select("junction_id", F.posexplode(F.array("entry", "exit")).alias("which", "node"))
    nodes = ends.groupBy("junction_id", "node").agg(F.count_if(F.col("which") == 0).alias("entries"))
    found = nodes.groupBy("junction_id").agg(F.count("*").alias("node_count"), F.sum("entries").alias("movement_count"))
    return found.select(hex_uid(F.col("junction_id")).alias("uid"), "node_count", "movement_count")


def diagnostics(ways: DataFrame, edges: DataFrame, movements: DataFrame, companies: DataFrame) -> DataFrame:
    """(section, document): counts of a map as JSON, a row for each section.

    `companies` are (poi_id, access_uid); one without an edge at its access node has no access. A terminal is isolated
    if no land edge touches it. Each section is one aggregate; nothing but counts comes together.
    """
    one_way = F.count_if(F.col("direction") != "Both")
    some = lambda p: F.count_if(F.expr(p))
    touched = edges.select(F.explode(F.array("src", "dst")).alias("uid"), (F.col("kind") == FERRY).alias("ferry"))
    nodes = touched.groupBy("uid").agg(F.bool_or("ferry").alias("ferry"), F.bool_or(~F.col("ferry")).alias("land"))
    known = nodes.select(F.col("uid").alias("access_uid"), F.lit(True).alias("known"))
    sections = {
        "roads": ways.where("kind = 0").agg(F.count("*").alias("total"), one_way.alias("one_way")),
        "movements": edges.where("kind = 1").agg(F.count("*").alias("total"), some("semaphore_id >= 0").alias("with_semaphore")),
        "junctions": junction_table(movements).agg(F.count("*").alias("total"), F.sum("movement_count").alias("movements")),
        "ferries": ways.where(F.col("kind") == FERRY).agg(F.count("*").alias("total"), one_way.alias("one_way")),
        "terminals": nodes.agg(some("ferry").alias("total"), some("ferry and not land").alias("isolated")),
        "companies": companies.join(known, "access_uid", "left").agg(F.count("*").alias("total"), some("known is null").alias("no_access")),
        "graph": edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == FERRY).alias("transit_edges")),
    }
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("document")) for name, df in sections.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def fingerprint(table: DataFrame) -> DataFrame:
    """One row `print`: number of rows and the sum of their hashes, the same in any order; repeated rows count.

    Columns count by name and place; nulls and empty texts differ.
    """
    row = F.to_json(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in table.columns)), {"ignoreNullFields": "false"}) if table.columns else F.lit("")
    summed = F.coalesce(F.sum(F.xxhash64(row).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return table.agg(F.concat_ws(":", F.count("*").cast("string"), summed.cast("string")).alias("print"))
