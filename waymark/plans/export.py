"""Named queries of a built map's tables and documents, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export
from ..sources import roads
from . import oracle
from .completeness import junction_movements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        # DuckDB 2.0.0 fails on edges that it materialises with their texts and reads many times
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle.with_tables(sql, ("f_edge",))
        return f

    return add


_HEX = "lpad(lower(to_hex({})), 16, '0')"
_WAYS = """(SELECT edge_id // 2 AS road, kind, road_class, speed_limit, arg_min(CASE WHEN edge_id % 2 = 0 THEN src ELSE dst END, edge_id) AS node0, arg_min(CASE WHEN edge_id % 2 = 0 THEN dst ELSE src END, edge_id) AS node1,
  CASE WHEN count(DISTINCT edge_id % 2) = 2 THEN 'Both' WHEN min(edge_id % 2) = 0 THEN 'ForwardOnly' ELSE 'BackwardOnly' END AS direction, max(sqrt((x2 - x1) ** 2 + (z2 - z1) ** 2)) AS length_m FROM f_edge GROUP BY 1, 2, 3, 4)"""
_MOVES = """(SELECT s AS junction_id, i AS entry, (i + 1) % n AS exit, n, s % 7 * 25 + 10.0e0 AS length_m FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT s_suppkey AS s, s_suppkey % 5 + 3 AS n FROM supplier))
  UNION ALL SELECT s, CASE WHEN inward THEN i + 100 ELSE i END, CASE WHEN inward THEN i ELSE i + 200 END, n, s % 7 * 25 + 10.0e0 FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT s_suppkey AS s, s_suppkey % 5 + 3 AS n FROM supplier WHERE s_suppkey % 3 <> 0)) CROSS JOIN (VALUES (true), (false)) v(inward)
  UNION ALL SELECT s_suppkey, 900, 901, 0, s_suppkey % 7 * 25 + 10.0e0 FROM supplier WHERE s_suppkey % 4 = 1)"""
_JUNCTIONS = f"(SELECT junction_id, count(DISTINCT node) AS node_count, count(*) // 2 AS movement_count FROM (SELECT junction_id, unnest([entry, exit]) AS node FROM {_MOVES}) GROUP BY 1)"


@query(f"SELECT {_HEX.format('road')} AS uid, {_HEX.format('node0')} AS node0, {_HEX.format('node1')} AS node1, road_class, speed_limit, direction, round(length_m, 6) AS length_m FROM {_WAYS} WHERE kind = 0")
def k05_roads(spark, d):
    """Roads by their names, with their ends, ways and lengths."""
    return export.road_table(export.road_ways(roads.edge(spark, d))).withColumn("length_m", F.round("length_m", 6))


@query(f"SELECT {_HEX.format('junction_id')} AS junction_uid, {_HEX.format('entry')} AS entry, {_HEX.format('exit')} AS exit, length_m FROM {_MOVES}")
def k05_movements(spark, d):
    """Movements by the names of their junctions and nodes."""
    return export.movement_table(junction_movements(spark, d))


@query(f"SELECT {_HEX.format('junction_id')} AS uid, node_count, movement_count FROM {_JUNCTIONS}")
def k05_junctions(spark, d):
    """Nodes and movements of each junction."""
    return export.junction_table(junction_movements(spark, d))


_ENDS = "(SELECT uid, bool_or(kind = 2) AS ferry, bool_or(kind <> 2) AS land FROM (SELECT kind, unnest([src, dst]) AS uid FROM f_edge) GROUP BY 1)"
_SECTIONS = {
    "roads": f"SELECT count(*) AS total, count(*) FILTER (direction <> 'Both') AS one_way FROM {_WAYS} WHERE kind = 0",
    "movements": "SELECT count(*) AS total, count(*) FILTER (semaphore_id >= 0) AS with_semaphore FROM f_edge WHERE kind = 1",
    "junctions": f"SELECT count(*) AS total, sum(movement_count)::BIGINT AS movements FROM {_JUNCTIONS}",
    "ferries": f"SELECT count(*) AS total, count(*) FILTER (direction <> 'Both') AS one_way FROM {_WAYS} WHERE kind = 2",
    "terminals": f"SELECT count(*) FILTER (ferry) AS total, count(*) FILTER (ferry AND NOT land) AS isolated FROM {_ENDS}",
    "companies": f"SELECT count(*) AS total, count(*) FILTER (uid IS NULL) AS no_access FROM (SELECT 2 * c_custkey AS access_uid FROM customer WHERE c_custkey % 8 = 1) LEFT JOIN {_ENDS} ON uid = access_uid",
    "graph": "SELECT count(*) AS edges, count(*) FILTER (kind = 2) AS transit_edges FROM f_edge",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS section, to_json(s)::VARCHAR AS document FROM ({sql}) s" for name, sql in _SECTIONS.items()))
def k04_diagnostics(spark, d):
    """The diagnostics document by sections; companies stand at nodes of which some are unknown."""
    e = roads.edge(spark, d)
    companies = roads.table(spark, d, "customer").where("c_custkey % 8 = 1").select(F.col("c_custkey").alias("poi_id"), (2 * F.col("c_custkey")).alias("access_uid"))
    return export.diagnostics(export.road_ways(e), e, junction_movements(spark, d), companies)
