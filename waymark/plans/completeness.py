"""Named queries of completeness and gates, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import completeness, graph, junctions, search
from ..sources import graph_file, roads
from ..streaming import vehicle
from .routing import LCG_A, LCG_C, _COSTS, od_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

C = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def junction_movements(spark: SparkSession, d: str) -> DataFrame:
    """Movements of made-up junctions: one for each supplier, some of them rings with entries and exits."""
    s = roads.table(spark, d, "supplier").select(C("s_suppkey").alias("junction_id"), (C("s_suppkey") % 5 + 3).alias("n"))
    i = s.withColumn("i", F.explode(F.sequence(F.lit(0), C("n").cast("int") - 1)))
    ring = i.select("junction_id", C("i").alias("entry"), ((C("i") + 1) % C("n")).alias("exit"))
    arms = i.where("junction_id % 3 <> 0").select("junction_id", (C("i") + 100).alias("entry"), C("i").alias("exit")).union(i.where("junction_id % 3 <> 0").select("junction_id", C("i").alias("entry"), (C("i") + 200).alias("exit")))
    apart = s.where("junction_id % 4 = 1").select("junction_id", F.lit(900).alias("entry"), F.lit(901).alias("exit"))
    return ring.union(arms).union(apart).select("junction_id", C("entry").cast("long").alias("entry"), C("exit").cast("long").alias("exit"), (C("junction_id") % 7 * 25 + 10).cast("double").alias("length_m"))


# A chain of navigation nodes for each supplier, broken in its middle for every fifth; its ends and middle are physical.
_LAST = "(s_suppkey % 7 * 3 + 3)"
_CURVES = f"(SELECT s_suppkey AS prefab, unnest(range({_LAST})) AS a FROM supplier)"
_PHYSICAL = f"(SELECT DISTINCT s_suppkey AS prefab, unnest([0, {_LAST} // 2, {_LAST}]) AS node FROM supplier)"
_MOVED = f"(SELECT s_suppkey AS prefab, 0 AS x, {_LAST} AS y FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 0, {_LAST} // 2 FROM supplier WHERE s_suppkey % 2 = 0)"


@query(
    f"""WITH RECURSIVE curves AS (SELECT prefab, a, a + 1 AS b FROM {_CURVES} JOIN supplier ON s_suppkey = prefab WHERE s_suppkey % 5 <> 0 OR a <> {_LAST} // 2),
both_ways AS (SELECT prefab, a, b FROM curves UNION SELECT prefab, b, a FROM curves), moved AS (SELECT prefab, x AS a, y AS b FROM {_MOVED} UNION SELECT prefab, y, x FROM {_MOVED}),
nav(prefab, start, node) AS (SELECT prefab, node, node FROM {_PHYSICAL} UNION SELECT n.prefab, n.start, b.b FROM nav n JOIN both_ways b ON b.prefab = n.prefab AND b.a = n.node),
mv(prefab, start, node) AS (SELECT prefab, node, node FROM {_PHYSICAL} UNION SELECT n.prefab, n.start, b.b FROM mv n JOIN moved b ON b.prefab = n.prefab AND b.a = n.node),
hop(prefab, start, node, n) AS (SELECT prefab, node, node, 0 FROM {_PHYSICAL} UNION ALL SELECT h.prefab, h.start, c.b, h.n + 1 FROM hop h JOIN curves c ON c.prefab = h.prefab AND c.a = h.node)
SELECT *, mv_clusters > nav_clusters AS under_recovered FROM (SELECT p.prefab, count(*) AS physical,
  (SELECT count(DISTINCT r) FROM (SELECT start, min(node) AS r FROM nav n WHERE n.prefab = p.prefab GROUP BY 1)) AS nav_clusters,
  (SELECT count(DISTINCT r) FROM (SELECT start, min(node) AS r FROM mv n WHERE n.prefab = p.prefab GROUP BY 1)) AS mv_clusters,
  (SELECT count(*) FROM {_MOVED} m WHERE m.prefab = p.prefab) AS movements,
  EXISTS (SELECT 1 FROM hop h JOIN {_PHYSICAL} q ON q.prefab = h.prefab AND q.node = h.node WHERE h.prefab = p.prefab AND h.n >= 16 AND h.node <> h.start) AS depth_limited
FROM {_PHYSICAL} p GROUP BY p.prefab HAVING count(*) >= 2)"""
)
def g23_recovery(spark, d):
    """Prefabs whose movements part what their navigation graph joins, and those whose ways are deep."""
    s = roads.table(spark, d, "supplier").select(C("s_suppkey").alias("prefab"), (C("s_suppkey") % 7 * 3 + 3).alias("last"))
    half = F.floor(C("last") / 2)
    curves = s.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), C("last") - 1))).where((C("prefab") % 5 != 0) | (C("a") != half)).select("prefab", "a", (C("a") + 1).alias("b"))
    physical = s.select("prefab", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), half, C("last")))).alias("node"))
    moved = s.where("prefab % 3 <> 0").select("prefab", F.lit(0).cast("long").alias("entry"), C("last").alias("exit")).unionByName(s.where("prefab % 2 = 0").select("prefab", F.lit(0).cast("long").alias("entry"), half.alias("exit")))
    return completeness.recovery(curves, physical, moved)


_RINGS = "(SELECT s_suppkey AS junction_id, s_suppkey % 5 + 3 AS n FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 7 * 25 + 10 <= 120)"


@query(f"SELECT junction_id, i + 100 AS entry, j + 200 AS exit, CAST((j - i - 1 + n) % n + 1 AS INTEGER) AS number FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT *, unnest(range(n)) AS i FROM {_RINGS}))")
def g14_exit_numbers(spark, d):
    """The number of each exit of the roundabouts, from each of their entries."""
    m = junction_movements(spark, d)
    return completeness.exit_numbers(m, junctions.roundabouts(m))


#: West of this (metres) a roundabout counts apart.
WEST_M = 2500.0


@query(f"""SELECT count(*) AS roundabouts, CAST(count_if(x < {WEST_M}) AS BIGINT) AS west FROM (SELECT junction_id, avg(px) AS x FROM (
  SELECT junction_id, unnest([0, 10, 20, 30]) + l.x + e % 7 AS px FROM (SELECT junction_id, unnest(list_concat(range(n), list_concat(list_transform(range(n), lambda i: i + 100), range(n)))) AS e, unnest(list_concat(list_transform(range(n), lambda i: true), list_transform(range(2 * n), lambda i: true))) FROM {_RINGS}
    UNION ALL SELECT junction_id, 900, true FROM {_RINGS} WHERE junction_id % 4 = 1) JOIN f_light l ON l.slot = junction_id) GROUP BY 1)""")
def a32_roundabouts(spark, d):
    """Roundabouts, and those that lie west by the mean of the first four points of their movements."""
    m = junction_movements(spark, d)
    light = roads.light(spark, d).select(C("slot").alias("junction_id"), C("x").alias("lx"))
    points = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: 10.0 * i + C("lx") + C("entry") % 7)
    first = m.join(light, "junction_id").select("junction_id", F.explode(F.slice(points, 1, 4)).alias("px")).groupBy("junction_id").agg(F.avg("px").alias("x"))
    found = junctions.roundabouts(m).where("is_roundabout").join(first, "junction_id")
    return found.agg(F.count("*").alias("roundabouts"), F.count_if(C("x") < WEST_M).alias("west"))


_ITEMS = "(SELECT edge_id AS uid, src AS node0, dst AS node1 FROM f_edge WHERE kind = 0)"


def _road_items(spark: SparkSession, d: str) -> DataFrame:
    return roads.edge(spark, d).where("kind = 0").select(C("edge_id").alias("uid"), C("src").alias("node0"), C("dst").alias("node1"))


def prefab_nodes(spark: SparkSession, d: str) -> DataFrame:
    key = C("s_suppkey")
    return roads.table(spark, d, "supplier").select(key.alias("uid"), F.transform(F.sequence(F.lit(0), (key % 4 + 1).cast("int")), lambda i: 11 * key + 51 * i).alias("nodes"))


_PREFAB_NODES = "(SELECT s_suppkey AS uid, unnest(list_transform(range(s_suppkey % 4 + 2), lambda i: 11 * s_suppkey + 51 * i)) AS node FROM supplier)"


@query(f"""SELECT 'STRUCT_MISSING_NODE' AS code, 'Error' AS severity, uid FROM (SELECT uid, unnest([node0, node1]) AS node FROM {_ITEMS} UNION ALL SELECT uid, node FROM {_PREFAB_NODES}) x
WHERE NOT EXISTS (SELECT 1 FROM f_node n WHERE n.uid = x.node AND n.uid % 17 <> 0)""")
def j26_missing_nodes(spark, d):
    """Nodes that roads and prefabs name but that are not there."""
    return completeness.missing_nodes(_road_items(spark, d), prefab_nodes(spark, d), roads.node(spark, d).where("uid % 17 <> 0"))


#: The magic of the files that the round trip writes, and their number.
MAGIC, SHARDS = b"WAYMARK", 4


@query("""SELECT edge_id, src, dst, kind, CAST(CAST(length_m AS FLOAT) AS DOUBLE) AS length_m, speed_limit, road_class, semaphore_id, flags + CASE WHEN kind = 1 THEN 8 ELSE 0 END AS flags, CASE WHEN kind = 1 THEN edge_id % 97 END AS movement_id,
  CASE WHEN kind = 1 THEN 3 ELSE 2 END AS points, x1 + x2 + CASE WHEN kind = 1 THEN (x1 + x2) / 2 - 65.0e0 * (p_size % 5) / length_m * (z2 - z1) ELSE 0.0e0 END AS x_sum FROM f_bent JOIN f_node ON uid = edge_id // 4""")
def k01_packed_graph(spark, d):
    """The network written as packed files and read again by byte ranges."""
    c = F.col
    e = roads.turned_edge(spark, d).withColumns({"source_uid": c("edge_id"), "movement_id": F.when(c("kind") == 1, c("edge_id") % 97), "y1": F.lit(0.0), "y2": F.lit(0.0)})
    e = e.withColumn("points", F.transform("points", lambda p: F.struct(p["x"].alias("x"), F.lit(0.0).alias("y"), p["z"].alias("z"))))
    columns = "source_uid src dst kind length_m speed_limit road_class semaphore_id flags movement_id points x1 y1 z1 x2 y2 z2".split()
    files = graph_file.write_graph(e.select(*columns), graph.new_folder(spark, "packed"), MAGIC, SHARDS)
    found = graph_file.named_edges(*graph_file.read_graph(spark, files, MAGIC))
    x_sum = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["x"])
    return found.select(c("source_uid").alias("edge_id"), "src", "dst", "kind", c("length_m").cast("double").alias("length_m"), "speed_limit", "road_class", "semaphore_id", "flags", "movement_id", F.size("points").alias("points"), x_sum.alias("x_sum"))


_FERRIES = """(SELECT poi_id AS uid, CASE WHEN poi_id % 31 = 6 THEN -poi_id ELSE access_uid END AS node, poi_id % 130 AS prefab, n.x + 37 + poi_id % 900 AS x, n.z - 3000 * (poi_id % 5) AS z FROM f_poi JOIN f_node n ON n.uid = access_uid WHERE kind IN ('Ferry', 'Train'))"""
_ENDS = "(SELECT src AS node, 1 AS o, kind FROM f_edge UNION ALL SELECT dst, 0, kind FROM f_edge)"
_LAND = "(SELECT DISTINCT node FROM (SELECT unnest([src, dst]) AS node FROM f_edge WHERE kind NOT IN (2, 3)))"


@query(f"""SELECT f.uid, EXISTS (SELECT 1 FROM f_node n WHERE n.uid = f.node) AS in_graph, EXISTS (SELECT 1 FROM {_ENDS} e WHERE e.node = f.node) AS any_edge, f.node IN (SELECT node FROM {_LAND}) AS on_land,
  (SELECT count(*) FROM f_edge e WHERE e.src = f.node) AS out_edges, (SELECT count(*) FROM f_edge e WHERE e.dst = f.node) AS in_edges, l.n AS link_nodes, l.k AS link_land_nodes, o.owner,
  CASE WHEN o.owner IS NOT NULL THEN (SELECT count(*) FROM {_MOVED} m WHERE m.prefab = o.owner) END AS owner_movements, round(d.m, 4) AS nearest_land_m
FROM {_FERRIES} f LEFT JOIN (SELECT uid AS prefab, count(*) AS n, count(g.node) AS k FROM {_PREFAB_NODES} p LEFT JOIN {_LAND} g ON g.node = p.node GROUP BY 1) l ON l.prefab = f.prefab
LEFT JOIN (SELECT node, min(uid) AS owner FROM {_PREFAB_NODES} GROUP BY 1) o ON o.node = f.node
JOIN (SELECT f.uid, sqrt(min((n.x - f.x) * (n.x - f.x) + (n.z - f.z) * (n.z - f.z))) AS m FROM {_FERRIES} f, f_node n WHERE n.uid IN (SELECT node FROM {_LAND}) GROUP BY 1) d ON d.uid = f.uid""")
def g19_ferry_report(spark, d):
    """What every ferry and train terminal stands on, and how far land is."""
    n = roads.node(spark, d)
    p = roads.poi(spark, d).where("kind in ('Ferry', 'Train')").join(n.select(C("uid").alias("access_uid"), "x", "z"), "access_uid")
    ferries = p.select(C("poi_id").alias("uid"), F.when(C("poi_id") % 31 == 6, -C("poi_id")).otherwise(C("access_uid")).alias("node"), (C("poi_id") % 130).alias("prefab"), (C("x") + 37 + C("poi_id") % 900).alias("x"), (C("z") - 3000 * (C("poi_id") % 5)).alias("z"))
    s = roads.table(spark, d, "supplier").select(C("s_suppkey").alias("prefab"))
    moved = s.where("prefab % 3 <> 0").unionByName(s.where("prefab % 2 = 0"))
    found = completeness.ferry_report(ferries, roads.edge(spark, d), n, prefab_nodes(spark, d), moved)
    return found.withColumn("nearest_land_m", F.round("nearest_land_m", 4))


@query(f"SELECT count(*) // 2 AS edges, count(*) AS endpoints, count(*) FILTER (node NOT IN (SELECT node FROM {_LAND})) AS endpoints_isolated FROM (SELECT unnest([src, dst]) AS node FROM f_edge WHERE kind IN (2, 3))")
def g19_transit_summary(spark, d):
    """Ferries and trains, their ends, and the ends that no other edge touches."""
    return completeness.transit_summary(roads.edge(spark, d))


_NAMED = "(SELECT uid, CASE WHEN p_size % 9 = 0 THEN 0 ELSE uid * 4 + p_size % 3 END AS forward, CASE WHEN p_size % 8 = 0 THEN 0 ELSE (uid - 1) * 4 + p_size % 2 END AS backward FROM f_node)"


@query(f"""SELECT 'DIR_NODE0_MISMATCH' AS code, 'Error' AS severity, r.uid FROM {_ITEMS} r, {_NAMED} n WHERE n.uid = node0 AND forward <> 0 AND forward <> r.uid
UNION ALL SELECT 'DIR_NODE1_MISMATCH', 'Error', r.uid FROM {_ITEMS} r, {_NAMED} n WHERE n.uid = node1 AND backward <> 0 AND backward <> r.uid""")
def j27_directions(spark, d):
    """Roads whose nodes name another item ahead of the first or behind the last."""
    forward = F.when(C("p_size") % 9 == 0, 0).otherwise(C("uid") * 4 + C("p_size") % 3)
    backward = F.when(C("p_size") % 8 == 0, 0).otherwise((C("uid") - 1) * 4 + C("p_size") % 2)
    return completeness.direction_issues(_road_items(spark, d), roads.node(spark, d).select("uid", forward.alias("forward"), backward.alias("backward")))


@query(f"""SELECT * FROM (WITH RECURSIVE near AS (SELECT src AS a, dst AS b FROM f_edge WHERE kind = 0 UNION SELECT dst, src FROM f_edge WHERE kind = 0),
label(uid, c) USING KEY (uid) AS (SELECT DISTINCT a, a FROM near UNION SELECT s.uid, s.c FROM (SELECT b AS uid, min(l.c) AS c FROM label l JOIN near ON a = l.uid GROUP BY 1) s JOIN recurring.label AS r ON r.uid = s.uid WHERE s.c < r.c)
SELECT spans, count(*) AS junctions FROM (SELECT p.uid, count(DISTINCT l.c) AS spans FROM {_PREFAB_NODES} p LEFT JOIN label l ON l.uid = p.node GROUP BY 1) GROUP BY 1)""")
def a25_junction_span(spark, d):
    """Junctions by the number of components of the road network that their nodes lie in."""
    labels = graph.components(roads.edge(spark, d).where("kind = 0")).withColumnRenamed("uid", "node")
    nodes = prefab_nodes(spark, d).select("uid", F.explode("nodes").alias("node"))
    spans = nodes.join(labels, "node", "left").groupBy("uid").agg(F.count_distinct("component").alias("spans"))
    return spans.groupBy("spans").agg(F.count("*").alias("junctions"))


_WALKED = "(SELECT route_id, idx, e.src, e.dst FROM f_route LEFT JOIN f_edge e ON e.edge_id = edge_ref * 4 + idx % 4)"
_ROUTE = "PARTITION BY route_id ORDER BY idx"


@query(f"""SELECT route_id, count(*) AS edges, count(*) FILTER (src IS NULL) AS unknown, count(*) FILTER (dst <> nsrc) AS jumps, count(*) FILTER (src = ndst AND dst = nsrc) AS uturns FROM (
  SELECT *, lead(src) OVER ({_ROUTE}) AS nsrc, lead(dst) OVER ({_ROUTE}) AS ndst FROM {_WALKED}) GROUP BY 1""")
def w10_continuity(spark, d):
    """Edges of each route that are unknown, that end where the next does not begin, and that the next takes back."""
    order = Window.partitionBy("route_id").orderBy("idx")
    e = roads.edge(spark, d).select(C("edge_id").alias("ref"), "src", "dst")
    steps = roads.route_edge(spark, d).withColumn("ref", C("edge_ref") * 4 + C("idx") % 4).join(e, "ref", "left").withColumns({"nsrc": F.lead("src").over(order), "ndst": F.lead("dst").over(order)})
    turned = (C("src") == C("ndst")) & (C("dst") == C("nsrc"))
    return steps.groupBy("route_id").agg(F.count("*").alias("edges"), F.count_if(C("src").isNull()).alias("unknown"), F.count_if(C("dst") != C("nsrc")).alias("jumps"), F.count_if(turned).alias("uturns"))


@query("""SELECT vehicle, seq FROM (SELECT user_id AS vehicle, event_id AS seq, n, lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) // 25 AS n FROM events)) WHERE before IS NULL OR n <> before""")
def x01_new_sequences(spark, d):
    """Frames whose sequence number differs from the one before: the others repeat what is known."""
    n = F.floor(F.get_json_object("props", "$.k").cast("long") / 25)
    before = F.lag("n").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = roads.table(spark, d, "events").withColumn("n", n).withColumn("before", before)
    return rows.where(C("before").isNull() | (C("before") != C("n"))).select(C("user_id").alias("vehicle"), C("event_id").alias("seq"))


_TRACKED = """(WITH RECURSIVE sized AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n, sum(length_m) OVER (PARTITION BY route_id) AS route_m,
    coalesce(sum(length_m) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS start_m FROM f_route),
  matched AS (SELECT vehicle, seq, edge_ref, length_m * (seq % 10) / 10 AS off, route_m, row_number() OVER (PARTITION BY vehicle ORDER BY sim_us, seq) AS k FROM f_frame f JOIN sized s ON s.route_id = f.vehicle AND s.idx = f.sim_us // 150000 % s.n),
  placed AS (SELECT m.*, p.idx, p.start_m FROM matched m JOIN sized p ON p.route_id = m.vehicle AND p.edge_ref = m.edge_ref),
  t(vehicle, k, seq, idx, travelled, route_m, told) AS (
    SELECT DISTINCT vehicle, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 0.0e0, 0.0e0, false FROM matched
    UNION ALL
    SELECT vehicle, k, seq, coalesce(b.i, was), CASE WHEN b IS NULL THEN before ELSE greatest(before, b.s + off) END, route_m, b IS NOT NULL FROM (
      SELECT t.vehicle, m.k, m.seq, t.idx AS was, t.travelled AS before, m.route_m, m.off,
        min(CASE WHEN t.idx IS NULL OR abs(m.idx - t.idx) <= 4 THEN {'d': abs(m.idx - coalesce(t.idx, 0)), 'i': m.idx, 's': m.start_m} END) AS b
      FROM t JOIN placed m ON m.vehicle = t.vehicle AND m.k = t.k + 1 GROUP BY ALL))
  SELECT vehicle, k, seq, idx, travelled, route_m FROM t WHERE told)"""


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    r = roads.route_edge(spark, d)
    n = r.groupBy("route_id").agg(F.count("*").alias("n"))
    f = roads.frame(spark, d).join(n, C("vehicle") == C("route_id")).withColumn("idx", F.floor(C("sim_us") / 150_000) % C("n"))
    matches = f.join(r.select("route_id", "idx", "edge_ref", "length_m"), ["route_id", "idx"]).withColumn("offset", C("length_m") * (C("seq") % 10) / 10)
    return vehicle.track(matches, r)


@query(f"SELECT vehicle, seq, idx, round(travelled, 6) AS travelled_m, round(route_m - travelled, 6) AS remaining_m FROM {_TRACKED}")
def x06_tracker(spark, d):
    """Each vehicle drives the route of its number: its frames are matched to the route's edges in turn. Vehicles without a route are not tracked."""
    return _tracked(spark, d).select("vehicle", "seq", "idx", F.round("travelled_m", 6).alias("travelled_m"), F.round("remaining_m", 6).alias("remaining_m"))


@query(f"""SELECT vehicle, count(*) AS frames, count(*) FILTER (travelled < before) AS falls, count(*) FILTER (idx < earlier) AS steps_back, round(max(travelled), 6) AS travelled_m FROM (
  SELECT *, lag(travelled) OVER w AS before, lag(idx) OVER w AS earlier FROM {_TRACKED} WINDOW w AS (PARTITION BY vehicle ORDER BY k)) GROUP BY 1""")
def w22_monotone_progress(spark, d):
    """How far each tracked vehicle has come: travelled distance never falls, though matches may step back."""
    order = Window.partitionBy("vehicle").orderBy("sim_us", "seq")
    rows = _tracked(spark, d).join(roads.frame(spark, d).select("seq", "sim_us"), "seq").withColumns({"before": F.lag("travelled_m").over(order), "earlier": F.lag("idx").over(order)})
    return rows.groupBy("vehicle").agg(F.count("*").alias("frames"), F.count_if(C("travelled_m") < C("before")).alias("falls"), F.count_if(C("idx") < C("earlier")).alias("steps_back"), F.round(F.max("travelled_m"), 6).alias("travelled_m"))


@query(f"""SELECT repeats, loops, pairs, reached, repeats = 0 AND loops = 0 AND reached >= 0.9e0 * pairs AS passed FROM (SELECT
  (SELECT count(*) FROM (SELECT src, dst FROM f_edge WHERE kind = 0 GROUP BY 1, 2 HAVING count(*) > 1)) AS repeats, (SELECT count(*) FROM f_edge WHERE kind = 1 AND src = dst) AS loops,
  (SELECT count(*) FROM f_od) AS pairs, (SELECT count(cost) FROM {_COSTS} WHERE profile = 'fastest') AS reached)""")
def v08_semantic_gate(spark, d):
    """No road twice, no movement from a node to itself, and nine of ten requests reached at least."""
    e = roads.turned_edge(spark, d)
    repeats = e.where("kind = 0").groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeats"))
    loops = e.where("kind = 1 and src = dst").agg(F.count("*").alias("loops"))
    found = search.costs(e, search.between_nodes(od_pairs(spark, d), ("fastest",))).agg(F.count("*").alias("pairs"), F.count("cost").alias("reached"))
    every = repeats.join(F.broadcast(loops)).join(F.broadcast(found))
    return every.withColumn("passed", (C("repeats") == 0) & (C("loops") == 0) & (C("reached") >= 0.9 * C("pairs")))


@query("""SELECT n_name AS name, CASE WHEN b.print IS NULL THEN 'ABSENT' WHEN b.print = a.print THEN 'MATCH' ELSE 'CHANGED' END AS status FROM (SELECT n_nationkey, n_name, md5(n_name || ':' || n_regionkey) AS print FROM nation) a
  LEFT JOIN (SELECT n_nationkey, md5(n_name || ':' || (n_regionkey + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END)) AS print FROM nation WHERE n_nationkey % 4 <> 3) b USING (n_nationkey)""")
def v10_manifest_status(spark, d):
    """Fingerprints of rows against those of an earlier manifest."""
    n = roads.table(spark, d, "nation")
    mark = lambda region: F.md5(F.concat_ws(":", "n_name", region).cast("binary")).alias("print")
    manifest = n.where("n_nationkey % 4 <> 3").select(C("n_name").alias("name"), mark(C("n_regionkey") + F.when(C("n_nationkey") % 5 == 0, 1).otherwise(0)))
    return completeness.print_status(n.select(C("n_name").alias("name"), mark(C("n_regionkey"))), manifest)


@query("""SELECT uid, missing FROM (SELECT c_custkey AS uid, CASE WHEN n_nationkey IS NULL THEN 'country' WHEN r_regionkey IS NULL THEN 'continent' END AS missing
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 7 <> 3) ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 4) ON r_regionkey = n_regionkey) WHERE missing IS NOT NULL""")
def v11_chains(spark, d):
    """Places whose chain of definitions, country and then continent, breaks off, and where it does first."""
    items = roads.table(spark, d, "customer").select(C("c_custkey").alias("uid"), C("c_nationkey").alias("country"))
    countries = roads.table(spark, d, "nation").where("n_nationkey % 7 <> 3").select(C("n_nationkey").alias("country"), C("n_regionkey").alias("continent"))
    continents = roads.table(spark, d, "region").where("r_regionkey <> 4").select(C("r_regionkey").alias("continent"))
    return completeness.first_missing(items, [("country", "country", countries), ("continent", "continent", continents)])


@query(f"""SELECT uid, CAST(s >> 33 AS DOUBLE) / 2147483648.0e0 AS u, CAST((s * CAST({LCG_A} AS UHUGEINT) + CAST({LCG_C} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) >> 33 AS DOUBLE) / 2147483648.0e0 AS v FROM (
  SELECT s_suppkey AS uid, (CAST(s_suppkey AS UHUGEINT) * CAST({LCG_A} AS UHUGEINT) + CAST({LCG_C} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS s FROM supplier)""")
def f18_random_numbers(spark, d):
    """The generator's first two numbers for each supplier's seed: 64-bit products by halves."""
    whole = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    low_a, high_a, word = LCG_A % 2**32, LCG_A // 2**32, whole(2**32)

    def step(s):
        low, high = s % word, F.floor(s / word).cast("decimal(20,0)")
        # each term below 2**66
        upper = ((high * whole(low_a) % word) + (low * whole(high_a) % word)) % word
        return ((low * whole(low_a) + upper * word + whole(LCG_C)) % whole(2**64)).cast("decimal(20,0)")

    unit = lambda s: F.floor(s / whole(2**33)).cast("double") / 2.0**31
    rows = roads.table(spark, d, "supplier").select(C("s_suppkey").alias("uid"), step(C("s_suppkey").cast("decimal(20,0)")).alias("s")).withColumn("t", step(C("s")))
    return rows.select("uid", unit(C("s")).alias("u"), unit(C("t")).alias("v"))
