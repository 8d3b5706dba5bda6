"""More named queries over the derived road tables, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, routes, spatial
from ..sources import roads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

C = F.col

#: Words that a scan for evidence looks for.
KEYWORDS = ("license", "permission", "contact", "camera")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _half(spark: SparkSession, d: str) -> DataFrame:
    return roads.edge(spark, d).where("road_class in (0, 1)")


def _main(labels: DataFrame) -> DataFrame:
    """The largest component, of equals the one with the smallest node: one row."""
    return labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")


def direction(right: Column, left: Column) -> Column:
    """The way a road runs, by the lanes of its sides; a road without lanes counts as both ways."""
    return F.when((right > 0) & (left <= 0), "Forward").when((left > 0) & (right <= 0), "Backward").otherwise("Both")


def turn_type(degrees: Column) -> Column:
    """0: straight on, 2: back, 1 and -1: to the sides."""
    return F.when(F.abs(degrees) < 30, 0).when(F.abs(degrees) > 150, 2).otherwise(F.signum(degrees).cast("int"))


_DIRECTION = "CASE WHEN p_size % 4 > 0 AND p_size % 3 = 0 THEN 'Forward' WHEN p_size % 3 > 0 AND p_size % 4 = 0 THEN 'Backward' ELSE 'Both' END"
_TURN = "CASE WHEN abs(a) < 30 THEN 0 WHEN abs(a) > 150 THEN 2 ELSE CAST(sign(a) AS INTEGER) END"
_MAIN = "(SELECT component FROM f_component GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)"
_ROUTE = "PARTITION BY route_id ORDER BY idx"
_TOKEN = "string_split(p_name, ' ')[1]"


@query(f"SELECT p_partkey, {_DIRECTION} AS direction, p_size % 12 = 0 AS degraded FROM part")
def p03_road_direction(spark, d):
    right, left = C("p_size") % 4, C("p_size") % 3
    return roads.table(spark, d, "part").select("p_partkey", direction(right, left).alias("direction"), ((right <= 0) & (left <= 0)).alias("degraded"))


@query("SELECT edge_id FROM f_edge WHERE src IN (SELECT uid FROM f_node WHERE uid % 17 <> 0) AND dst IN (SELECT uid FROM f_node WHERE uid % 17 <> 0)")
def p04_whole_roads(spark, d):
    """Edges whose ends are both known."""
    known = roads.node(spark, d).where("uid % 17 <> 0")
    e = roads.edge(spark, d)
    return e.join(known.select(C("uid").alias("src")), "src", "left_semi").join(known.select(C("uid").alias("dst")), "dst", "left_semi").select("edge_id")


@query("SELECT p_partkey FROM part WHERE NOT starts_with(lower(p_type), 'promo')")
def p05_without_class(spark, d):
    return roads.table(spark, d, "part").where(~F.lower("p_type").startswith("promo")).select("p_partkey")


@query(f"SELECT p_partkey, unnest(CASE WHEN w = 'Both' THEN ['Forward', 'Backward'] ELSE [w] END) AS direction FROM (SELECT p_partkey, {_DIRECTION} AS w FROM part)")
def p06_direction_rows(spark, d):
    """A row for each way that a road runs."""
    way = C("direction")
    ways = F.when(way == "Both", F.array(F.lit("Forward"), F.lit("Backward"))).otherwise(F.array(way))
    return p03_road_direction(spark, d).select("p_partkey", F.explode(ways).alias("direction"))


@query("SELECT edge_id FROM f_edge WHERE kind IN (0, 1)")
def p07_routable(spark, d):
    return roads.edge(spark, d).where(C("kind").isin(0, 1)).select("edge_id")


@query("SELECT event_id FROM events WHERE value > 0 AND value < 500")
def p10_active_frames(spark, d):
    return roads.table(spark, d, "events").where((C("value") > 0) & (C("value") < 500)).select("event_id")


@query("""SELECT uid, CASE WHEN uid % 2 = 0 THEN 1 ELSE -1 END * (uid % 50) AS sx, uid // 50 AS sz FROM f_node WHERE uid % 7 <> 0""")
def p11_sector_names(spark, d):
    """Names of sectors to their numbers; other names are dropped."""
    sign = F.when(C("uid") % 2 == 0, "+").otherwise("-")
    four = lambda n: F.lpad(n, F.greatest(F.length(n.cast("string")), F.lit(4)), F.lit("0"))
    name = F.when(C("uid") % 7 == 0, F.concat(F.lit("other"), C("uid"))).otherwise(F.concat(F.lit("sec"), sign, four(C("uid") % 50), F.lit("+"), four(F.floor(C("uid") / 50))))
    pattern = r"^sec([+-]\d+)([+-]\d+)$"
    named = roads.node(spark, d).select("uid", name.alias("name")).where(C("name").rlike(pattern))
    return named.select("uid", *[F.regexp_extract("name", pattern, k).cast("long").alias(c) for k, c in ((1, "sx"), (2, "sz"))])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 IN (5, 8)")
def p12_spawn_points(spark, d):
    return roads.table(spark, d, "supplier").where((C("s_suppkey") % 10).isin(5, 8)).select("s_suppkey")


@query("SELECT edge_id, kind = 0 AND speed_limit < 0 AS estimated_speed, kind = 1 AND semaphore_id >= 0 AS has_signal FROM f_edge")
def p17_edge_predicates(spark, d):
    return roads.edge(spark, d).select("edge_id", ((C("kind") == 0) & (C("speed_limit") < 0)).alias("estimated_speed"), ((C("kind") == 1) & (C("semaphore_id") >= 0)).alias("has_signal"))


@query(f"SELECT seq, {_TURN} AS turn FROM (SELECT seq, seq % 13 * 30 - 180 AS a FROM f_frame)")
def p19_turn_type(spark, d):
    return roads.frame(spark, d).select("seq", turn_type(C("seq") % 13 * 30 - 180).alias("turn"))


@query(f"SELECT seq, CASE WHEN t IN (1, -1) AND seq % 2 = 0 THEN -t ELSE t END AS turn FROM (SELECT seq, {_TURN} AS t FROM (SELECT seq, seq % 13 * 30 - 180 AS a FROM f_frame))")
def p20_mirrored_turns(spark, d):
    """Turns to the sides change sides where traffic keeps left."""
    t = C("turn")
    return p19_turn_type(spark, d).select("seq", F.when(t.isin(1, -1) & (C("seq") % 2 == 0), -t).otherwise(t).alias("turn"))


@query("SELECT edge_id, semaphore_id, slot FROM f_edge LEFT JOIN (SELECT light_id, min(slot) AS slot FROM f_light GROUP BY 1) ON light_id = semaphore_id WHERE kind = 1")
def j11_movement_signals(spark, d):
    """The first light of each movement's signal group."""
    first = roads.light(spark, d).groupBy(C("light_id").alias("semaphore_id")).agg(F.min("slot").alias("slot"))
    return roads.edge(spark, d).where("kind = 1").join(first, "semaphore_id", "left").select("edge_id", "semaphore_id", "slot")


@query("SELECT n.uid, n.uid * 4 + n.p_size % 3 AS item FROM f_node n WHERE NOT EXISTS (SELECT 1 FROM f_edge e WHERE e.edge_id = n.uid * 4 + n.p_size % 3)")
def j25_missing_items(spark, d):
    """Nodes that name an item that isn't there."""
    n = roads.node(spark, d).select("uid", (C("uid") * 4 + C("p_size") % 3).alias("item"))
    return n.join(roads.edge(spark, d).select(C("edge_id").alias("item")), "item", "left_anti").select("uid", "item")


@query(f"""SELECT name, coalesce(bool_or(c.component = (SELECT component FROM {_MAIN})), false) AS reached FROM f_poi LEFT JOIN f_component c ON c.uid = access_uid
  WHERE kind IN ('City', 'Company') GROUP BY 1""")
def j29_city_in_main(spark, d):
    """Names of which any access node lies in the largest component."""
    labels = graph.components(_half(spark, d))
    inside = labels.join(F.broadcast(_main(labels)), "component", "left_semi").select(C("uid").alias("access_uid"), F.lit(1).alias("there"))
    return roads.poi(spark, d).where("kind in ('City', 'Company')").join(inside, "access_uid", "left").groupBy("name").agg((F.count("there") > 0).alias("reached"))


@query(f"""SELECT f.component, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z))), 6) AS gap_m
  FROM f_component f JOIN f_node a ON a.uid = f.uid, f_component m JOIN f_node b ON b.uid = m.uid
  WHERE f.component <> (SELECT component FROM {_MAIN}) AND m.component = (SELECT component FROM {_MAIN}) AND abs(a.x - b.x) <= 2000 AND abs(a.z - b.z) <= 2000
    AND (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 2000.0e0 * 2000 GROUP BY 1""")
def j31_fragment_gap(spark, d):
    """How near each smaller component comes to the largest, within 2 km, by cells of 500 m."""
    labels = graph.components(_half(spark, d))
    main = _main(labels)
    placed = labels.join(roads.node(spark, d).select("uid", "x", "z"), "uid").withColumns({"a": spatial.cell(C("x"), 500.0), "b": spatial.cell(C("z"), 500.0)})
    far = placed.join(F.broadcast(main), "component", "left_anti")
    for c in ("a", "b"):
        far = far.withColumn(c, F.explode(F.sequence(C(c) - 4, C(c) + 4)))
    near = placed.join(F.broadcast(main), "component", "left_semi").select("a", "b", C("x").alias("mx"), C("z").alias("mz"))
    d2 = (C("x") - C("mx")) * (C("x") - C("mx")) + (C("z") - C("mz")) * (C("z") - C("mz"))
    return far.join(near, ["a", "b"]).where(d2 <= 2000.0 * 2000.0).groupBy("component").agg(F.round(F.sqrt(F.min(d2)), 6).alias("gap_m"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return roads.table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[0].alias("token"))


@query(f"SELECT {_TOKEN} AS token, count(*) AS uses FROM part WHERE {_TOKEN} NOT IN (SELECT {_TOKEN} FROM part WHERE p_partkey % 400 = 0) GROUP BY 1")
def j33_unresolved_tokens(spark, d):
    """Tokens without a descriptor: one row each, with how often they are used."""
    t = _tokens(spark, d)
    return t.join(t.where("p_partkey % 400 = 0").select("token"), "token", "left_anti").groupBy("token").agg(F.count("*").alias("uses"))


@query("SELECT src AS uid FROM f_edge WHERE kind IN (0, 1) UNION SELECT dst FROM f_edge WHERE kind IN (0, 1)")
def u01_touched_nodes(spark, d):
    return graph.active_nodes(roads.edge(spark, d).where("kind in (0, 1)"))


@query(f"SELECT {_TOKEN} AS token FROM part EXCEPT SELECT {_TOKEN} FROM part WHERE p_partkey % 400 = 0")
def u04_missing_definitions(spark, d):
    t = _tokens(spark, d)
    return t.select("token").subtract(t.where("p_partkey % 400 = 0").select("token"))


@query(f"SELECT DISTINCT {_TOKEN} AS token FROM part")
def u06_distinct_tokens(spark, d):
    return _tokens(spark, d).select("token").distinct()


@query(f"SELECT uid FROM f_component WHERE component = (SELECT component FROM {_MAIN})")
def g11_largest_component(spark, d):
    labels = graph.components(_half(spark, d))
    return labels.join(F.broadcast(_main(labels)), "component", "left_semi").select("uid")


@query(f"""SELECT kind, count(*) AS edges FROM f_half e JOIN f_component c ON c.uid = e.src WHERE c.component <> (SELECT component FROM {_MAIN}) GROUP BY 1""")
def a24_fragment_edges(spark, d):
    """Edges outside the largest component, by kind."""
    e = _half(spark, d)
    labels = graph.components(e)
    rest = labels.join(F.broadcast(_main(labels)), "component", "left_anti").select(C("uid").alias("src"))
    return e.join(rest, "src", "left_semi").groupBy("kind").agg(F.count("*").alias("edges"))


@query(f"""SELECT route_id, idx, coalesce(last_value(CASE WHEN kind = 0 THEN speed_limit END IGNORE NULLS) OVER ({_ROUTE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(speed_limit) OVER ({_ROUTE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS "limit" FROM f_route""")
def w03_limit_in_force(spark, d):
    return roads.route_edge(spark, d).select("route_id", "idx", routes.carried_limit().alias("limit"))


_ARRIVAL = "PARTITION BY vehicle ORDER BY sim_us, seq"


def _arrival():
    return Window.partitionBy("vehicle").orderBy("sim_us", "seq")


@query("""SELECT junction_id, event_id, kind, wall_ms FROM (SELECT *, lag(kind) OVER (PARTITION BY junction_id ORDER BY wall_ms, event_id) AS before FROM f_signal) WHERE before <> kind""")
def x15_phase_anchors(spark, d):
    """Events at which a junction's state changes."""
    before = F.lag("kind").over(Window.partitionBy("junction_id").orderBy("wall_ms", "event_id"))
    return roads.signal_event(spark, d).withColumn("before", before).where("before <> kind").select("junction_id", "event_id", "kind", "wall_ms")


@query("SELECT lpad(lower(to_hex(access_uid)), 16, '0') AS access, min(poi_id) AS poi_id FROM f_poi GROUP BY 1")
def d02_by_access(spark, d):
    """The first place at each access node."""
    return roads.poi(spark, d).groupBy(F.lpad(F.lower(F.hex("access_uid")), 16, "0").alias("access")).agg(F.min("poi_id").alias("poi_id"))


@query("SELECT k AS keyword, CAST(coalesce(sum(CASE WHEN contains(lower(text), k) THEN 1 ELSE 0 END), 0) AS BIGINT) AS texts FROM documents, (VALUES " + ", ".join(f"('{k}')" for k in KEYWORDS) + ") v(k) GROUP BY 1")
def v12_keyword_evidence(spark, d):
    """Texts that hold each keyword."""
    text = F.lower("text")
    counts = roads.table(spark, d, "documents").agg(*[F.count_if(F.contains(text, F.lit(k))).alias(k) for k in KEYWORDS])
    return counts.unpivot([], list(KEYWORDS), "keyword", "texts")
