"""Named queries of building and checking a network, and of destinations, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..operators import graph, profiles, spatial
from ..sources import roads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

C = F.col

#: Names of signal group types by number; other numbers are type_<n>.
SIGNAL_TYPES = ("use_profile", "model_only", "traffic_light", "traffic_light_minor", "traffic_light_major", "barrier_manual", "barrier_distance", "traffic_light_blockable", "barrier_gas", "traffic_light_virtual", "barrier_automatic")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def signal_type(number: Column) -> Column:
    return F.coalesce(F.get(F.lit(list(SIGNAL_TYPES)), number), F.concat(F.lit("type_"), number))


@query(f"SELECT s_suppkey, coalesce([{', '.join(repr(t) for t in SIGNAL_TYPES)}][CAST(s_suppkey % 14 + 1 AS INTEGER)], 'type_' || s_suppkey % 14) AS signal_type FROM supplier")
def p21_signal_types(spark, d):
    """Names of signal group types."""
    return roads.table(spark, d, "supplier").select("s_suppkey", signal_type((C("s_suppkey") % 14).cast("int")).alias("signal_type"))


@query(
    """SELECT seq, round(greatest(9.0e0, least(16.5e0, (13 + log2(greatest(10.0e0, dist)) * -0.55e0 - log2(v / 40) * 0.5e0) * CASE WHEN exits THEN 1.2e0 ELSE 1.0e0 END)), 6) AS zoom FROM (
  SELECT seq, greatest(speed_ms * 3.6e0, 10.0e0) AS v, CASE WHEN seq % 4 = 0 THEN 500.0e0 ELSE greatest(CAST(seq % 900 AS DOUBLE), 30.0e0) END AS dist, seq % 4 <> 0 AND seq % 9 = 0 AS exits FROM f_frame)"""
)
def p28_zoom(spark, d):
    """Zoom by speed and the distance to the next maneuver, 500 m where there is none; closer at roundabouts."""
    s = C("seq")
    v, dist = F.greatest(C("speed_ms") * 3.6, F.lit(10.0)), F.when(s % 4 == 0, 500.0).otherwise(F.greatest((s % 900).cast("double"), F.lit(30.0)))
    zoom = (13 + F.log2(F.greatest(F.lit(10.0), dist)) * -0.55 - F.log2(v / 40) * 0.5) * F.when((s % 4 != 0) & (s % 9 == 0), 1.2).otherwise(1.0)
    return roads.frame(spark, d).select("seq", F.round(F.greatest(F.lit(9.0), F.least(F.lit(16.5), zoom)), 6).alias("zoom"))


@query(
    """SELECT c_custkey, coalesce(a.r, b.r) AS region FROM (SELECT *, lower(c_mktsegment) AS name FROM customer) c
LEFT JOIN (SELECT 'city.' || lower(c_mktsegment) AS full_name, min(c_nationkey) AS r FROM customer WHERE c_nationkey < 5 GROUP BY 1) a ON a.full_name = 'city.' || c.name
LEFT JOIN (SELECT lower(c_mktsegment) AS plain_name, max(c_nationkey) AS r FROM customer WHERE c_mktsegment > 'C' GROUP BY 1) b ON b.plain_name = c.name"""
)
def j03_prefixed_names(spark, d):
    """A definition by its prefixed name, else by its plain one."""
    c = roads.table(spark, d, "customer").withColumn("name", F.lower("c_mktsegment"))
    full = c.where("c_nationkey < 5").groupBy(F.concat(F.lit("city."), "name").alias("full_name")).agg(F.min("c_nationkey").alias("r1"))
    plain = c.where("c_mktsegment > 'C'").groupBy(C("name").alias("plain_name")).agg(F.max("c_nationkey").alias("r2"))
    rows = c.join(full, F.concat(F.lit("city."), C("name")) == C("full_name"), "left").join(plain, C("name") == C("plain_name"), "left")
    return rows.select("c_custkey", F.coalesce("r1", "r2").alias("region"))


#: Prefabs: a supplier's, with up to four nodes of the network; every seventh has none.
_PREFAB_SQL = "(SELECT s_suppkey AS prefab_id, CASE WHEN s_suppkey % 7 = 0 THEN CAST([] AS BIGINT[]) ELSE list_transform(range(s_suppkey % 4 + 1), lambda i: (s_suppkey * 11 + i * 3) % n) END AS nodes FROM supplier CROSS JOIN (SELECT count(*) AS n FROM part))"
_TOUCHED = "(SELECT src AS uid FROM f_half UNION SELECT dst FROM f_half)"


def _prefabs(spark: SparkSession, d: str) -> DataFrame:
    n = roads.table(spark, d, "part").agg(F.count("*").alias("n"))
    s = roads.table(spark, d, "supplier").join(F.broadcast(n))
    nodes = F.transform(F.sequence(F.lit(0), (C("s_suppkey") % 4).cast("int")), lambda i: (C("s_suppkey") * 11 + i * 3) % C("n"))
    return s.select(C("s_suppkey").alias("prefab_id"), F.when(C("s_suppkey") % 7 == 0, F.array().cast("array<long>")).otherwise(nodes.cast("array<long>")).alias("nodes"))


def _half(spark: SparkSession, d: str) -> DataFrame:
    return roads.edge(spark, d).where("road_class in (0, 1)")


@query(
    f"""SELECT c.c_custkey, p.access_uid FROM customer c LEFT JOIN (SELECT prefab_id, arg_min(u, i) AS access_uid FROM (SELECT prefab_id, unnest(nodes) AS u, unnest(range(len(nodes))) AS i FROM {_PREFAB_SQL})
  WHERE u IN (SELECT uid FROM {_TOUCHED}) GROUP BY 1) p ON p.prefab_id = c.c_custkey % 150"""
)
def j06_company_access(spark, d):
    """The first node of each company's prefab that a road touches; null where there is none."""
    touched = graph.active_nodes(_half(spark, d)).select(C("uid").alias("u"))
    first = _prefabs(spark, d).select("prefab_id", F.posexplode("nodes").alias("i", "u")).join(touched, "u", "left_semi").groupBy("prefab_id").agg(F.min_by("u", "i").alias("access_uid"))
    return roads.table(spark, d, "customer").withColumn("prefab_id", C("c_custkey") % 150).join(first, "prefab_id", "left").select("c_custkey", "access_uid")


@query(
    f"""SELECT poi_id, coalesce(t, CAST(access_uid AS VARCHAR)) AS terminals, t IS NULL AS degraded FROM f_poi LEFT JOIN (
  SELECT prefab_id, string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) AS t FROM (SELECT DISTINCT prefab_id, unnest(nodes) AS u FROM {_PREFAB_SQL}) WHERE u IN (SELECT uid FROM {_TOUCHED}) GROUP BY 1) ON prefab_id = poi_id % 150 WHERE kind = 'Ferry'"""
)
def j07_ferry_terminals(spark, d):
    """Terminal nodes of each ferry port: those of its prefab that a road touches, else its own node."""
    touched = graph.active_nodes(_half(spark, d)).select(C("uid").alias("u"))
    nodes = _prefabs(spark, d).select("prefab_id", F.explode("nodes").alias("u")).join(touched, "u", "left_semi").groupBy("prefab_id").agg(F.array_sort(F.collect_set("u")).alias("t"))
    ports = roads.poi(spark, d).where("kind = 'Ferry'").withColumn("prefab_id", C("poi_id") % 150).join(nodes, "prefab_id", "left")
    return ports.select("poi_id", F.when(C("t").isNull(), C("access_uid").cast("string")).otherwise(F.array_join("t", ",")).alias("terminals"), C("t").isNull().alias("degraded"))


_MAIN = "(SELECT component FROM f_component GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)"


@query(
    f"""SELECT count(*) AS prefabs, CAST(count_if(k > 1) AS BIGINT) AS several, CAST(count_if(main AND k > 1) AS BIGINT) AS main_and_other FROM (
  SELECT prefab_id, count(DISTINCT component) AS k, bool_or(component = {_MAIN}) AS main FROM (SELECT prefab_id, unnest(nodes) AS uid FROM {_PREFAB_SQL}) JOIN f_component USING (uid) GROUP BY 1)"""
)
def j30_junction_components(spark, d):
    """Prefabs whose nodes lie in several components, and those that touch the largest and another."""
    labels = graph.components(_half(spark, d))
    main = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select(C("component").alias("main"))  # one row
    rows = _prefabs(spark, d).select("prefab_id", F.explode("nodes").alias("uid")).join(labels, "uid").join(F.broadcast(main))
    at = rows.groupBy("prefab_id").agg(F.countDistinct("component").alias("k"), F.max(C("component") == C("main")).alias("main"))
    return at.agg(F.count("*").alias("prefabs"), F.count_if(C("k") > 1).alias("several"), F.count_if(C("main") & (C("k") > 1)).alias("main_and_other"))


def _scale(s: str) -> str:
    return f"CASE WHEN {s} < 0.2e0 THEN 0 WHEN {s} < 0.5e0 THEN 1 WHEN {s} < 0.8e0 THEN 2 WHEN {s} <= 1.25e0 THEN 3 WHEN {s} <= 2.0e0 THEN 4 WHEN {s} <= 5.0e0 THEN 5 WHEN {s} <= 20.0e0 THEN 6 ELSE 7 END"


@query(f"SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM (SELECT {_scale('(edge_ref % 50 + 1) / 10.0e0')} AS bucket FROM f_walk WHERE kind = 1 AND length_m > 1e-6) GROUP BY 1")
def a23_anchoring_scale(spark, d):
    """Movements by the ratio of their length along their points to the length they state, in eight buckets."""
    arc = geometry.polyline_length(C("points"))
    rows = roads.walk(spark, d).where("kind = 1 and length_m > 1e-6").withColumn("scale", F.round(arc * (C("edge_ref") % 50 + 1) / 10.0 / C("length_m"), 9))
    ends = (0.2, 0.5, 0.8, 1.25, 2.0, 5.0, 20.0)
    s, bucket = C("scale"), F.lit(7)
    for k in range(6, -1, -1):
        bucket = F.when(s < ends[k] if k < 3 else s <= ends[k], k).otherwise(bucket)
    return rows.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT uid, round_even((x + p_size * 0.37e0) * 256, 0) / 256 AS x FROM f_node")
def f19_fixed_point(spark, d):
    """Coordinates to whole parts of 256, halves to the even one."""
    return roads.node(spark, d).select("uid", (F.rint((C("x") + C("p_size") * 0.37) * 256) / 256).alias("x"))


@query(
    """SELECT edge_id, k AS step, round(x1 + (x2 - x1) * least(k * 5.0e0 / length_m, 1.0e0), 6) AS x, round(z1 + (z2 - z1) * least(k * 5.0e0 / length_m, 1.0e0), 6) AS z FROM (
  SELECT *, unnest(range(CAST(ceil(length_m / 5) AS BIGINT) + 1)) AS k FROM f_timed WHERE kind = 2)"""
)
def f21_resampled(spark, d):
    """Points every 5 m along ferries, and their ends."""
    e = roads.timed_edge(spark, d).where("kind = 2").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(C("length_m") / 5))))
    t = F.least(C("step") * 5.0 / C("length_m"), F.lit(1.0))
    return e.select("edge_id", "step", F.round(C("x1") + (C("x2") - C("x1")) * t, 6).alias("x"), F.round(C("z1") + (C("z2") - C("z1")) * t, 6).alias("z"))


@query(
    """SELECT s_suppkey, CASE WHEN v < 40 THEN 'off' WHEN s < 90 THEN 'white' WHEN h < 20 OR h >= 340 THEN 'red' WHEN h < 70 THEN 'yellow' WHEN h >= 90 AND h < 170 THEN 'green' ELSE 'unknown' END AS light
FROM (SELECT s_suppkey, s_suppkey * 53 % 360 AS h, s_suppkey * 31 % 256 AS s, s_suppkey * 17 % 256 AS v FROM supplier)"""
)
def f22_light_colours(spark, d):
    """Colours of lights by hue (0 to 359), saturation and value (0 to 255)."""
    k = C("s_suppkey")
    h, s, v = k * 53 % 360, k * 31 % 256, k * 17 % 256
    light = F.when(v < 40, "off").when(s < 90, "white").when((h < 20) | (h >= 340), "red").when(h < 70, "yellow").when((h >= 90) & (h < 170), "green").otherwise("unknown")
    return roads.table(spark, d, "supplier").select("s_suppkey", light.alias("light"))


@query("SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86413 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM orders")
def f37_calendar(spark, d):
    """Seconds since 1970 as a date and time of day; the session's zone plays no part."""
    s = C("o_orderkey") * 86413
    # years of five digits get no sign
    day = F.regexp_replace(F.date_from_unix_date(F.floor(s / 86400).cast("int")).cast("string"), r"^\+", "")
    return roads.table(spark, d, "orders").select("o_orderkey", F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))).alias("utc"))


_PROFILES = """(SELECT s_suppkey AS name, CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey - 2 WHEN s_suppkey % 10 IN (1, 2) THEN s_suppkey + 1 WHEN s_suppkey % 10 = 4 THEN -1 WHEN s_suppkey % 5 > 0 THEN s_suppkey - 1 END AS parent,
  list_transform(range(s_suppkey % 4), lambda i: s_suppkey * 10 + i) AS vals FROM supplier)"""
_LINES = f"(WITH RECURSIVE l(name, upper, steps) AS (SELECT name, name, 0 FROM {_PROFILES} UNION ALL SELECT l.name, p.parent, steps + 1 FROM l JOIN {_PROFILES} p ON p.name = l.upper WHERE p.parent IS NOT NULL AND steps < 20) SELECT * FROM l)"
_WELL = f"(SELECT DISTINCT l.name FROM {_LINES} l JOIN {_PROFILES} p ON p.name = l.upper WHERE p.parent IS NULL)"


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to four profiles; some go round in a ring, some lead to nothing."""
    k = C("s_suppkey")
    there = roads.table(spark, d, "supplier")
    parent = F.when(k % 10 == 3, k - 2).when((k % 10).isin(1, 2), k + 1).when(k % 10 == 4, F.lit(-1)).when(k % 5 > 0, k - 1)
    values = F.transform(F.when(k % 4 > 0, F.sequence(F.lit(0).cast("long"), k % 4 - 1)).otherwise(F.array().cast("array<long>")), lambda i: k * 10 + i)
    return there.select(k.alias("name"), parent.cast("long").alias("parent"), values.alias("values"))


@query(
    f"""SELECT name, CAST(i AS INTEGER) AS at, arg_min(v, steps) AS value FROM (SELECT l.name, steps, unnest(range(len(vals))) AS i, unnest(vals) AS v FROM {_LINES} l JOIN {_PROFILES} p ON p.name = l.upper WHERE l.name IN (SELECT name FROM {_WELL})) GROUP BY 1, 2"""
)
def f41_inherited_profiles(spark, d):
    """Arrays of profiles with what they inherit, element by element."""
    return profiles.inherited(_profiles(spark, d))[0].select("name", "at", "value")


@query(
    f"""SELECT name, CASE WHEN EXISTS (SELECT 1 FROM {_LINES} l WHERE l.name = p.name AND l.upper NOT IN (SELECT name FROM {_PROFILES})) THEN 'Missing' ELSE 'Cycle' END AS issue FROM {_PROFILES} p WHERE name NOT IN (SELECT name FROM {_WELL})"""
)
def f41_profile_issues(spark, d):
    """Profiles that inherit from themselves, or from what is not there."""
    return profiles.inherited(_profiles(spark, d))[1]


@query("SELECT path, max(p_size) AS priority FROM (SELECT string_split(p_name, ' ')[1] AS path, p_size FROM part) GROUP BY 1")
def u02_overlay_paths(spark, d):
    """Each path of an overlay once, by its highest priority."""
    return roads.table(spark, d, "part").select(F.split("p_name", " ")[0].alias("path"), "p_size").groupBy("path").agg(F.max("p_size").alias("priority"))


@query("SELECT p.poi_id, e.edge_id FROM f_poi p JOIN f_edge e ON e.src = p.access_uid WHERE p.kind = 'Garage'")
def g22_out_edges(spark, d):
    """Edges out of the access node of each garage."""
    return roads.poi(spark, d).where("kind = 'Garage'").join(roads.edge(spark, d), C("access_uid") == C("src")).select("poi_id", "edge_id")


_JOBS = """(SELECT o_orderkey AS job, lower(c_mktsegment) || '_' || (c_nationkey + o_orderkey % 3) AS company, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'nowhere' ELSE lower(c_mktsegment) || '_' || (c_nationkey + o_orderkey % 2) END AS city
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_PLACED = "(SELECT p.*, n.x, n.z FROM f_poi p JOIN f_node n ON n.uid = access_uid)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Companies and cities that jobs name; some name no city, some one that is not there."""
    k = C("o_orderkey")
    o = roads.table(spark, d, "orders").join(roads.table(spark, d, "customer"), C("o_custkey") == C("c_custkey"))
    name = lambda n: F.concat(F.lower("c_mktsegment"), F.lit("_"), n)
    city = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, F.lit("nowhere")).otherwise(name(C("c_nationkey") + k % 2))
    return o.select(k.alias("job"), name(C("c_nationkey") + k % 3).alias("company"), city.alias("city"))


@query(
    f"""SELECT j.job, CASE WHEN count(p.poi_id) = 0 THEN 'NotFound' WHEN count(p.poi_id) > 1 THEN 'Ambiguous' ELSE 'Found' END AS status, CASE WHEN count(p.poi_id) = 1 THEN min(p.poi_id) END AS poi_id
FROM {_JOBS} j LEFT JOIN (SELECT name, count(*) AS n, min(x) AS cx, min(z) AS cz FROM {_PLACED} WHERE kind = 'City' GROUP BY 1) c ON c.name = j.city AND c.n = 1
LEFT JOIN (SELECT * FROM {_PLACED} WHERE kind = 'Company') p ON p.name = j.company AND (c.name IS NULL OR sqrt((p.x - cx) * (p.x - cx) + (p.z - cz) * (p.z - cz)) < 1500) GROUP BY j.job"""
)
def d03_job_destinations(spark, d):
    """The company that a job names, near its city; a city that no single place is plays no part. The network is small, so near is 1.5 km."""
    n = roads.node(spark, d).select(C("uid").alias("access_uid"), "x", "z")
    p = roads.poi(spark, d).join(n, "access_uid")
    city = p.where("kind = 'City'").groupBy(C("name").alias("city")).agg(F.count("*").alias("n"), F.min("x").alias("cx"), F.min("z").alias("cz")).where("n = 1").drop("n")
    company = p.where("kind = 'Company'").select("poi_id", C("name").alias("company"), "x", "z")
    rows = _jobs(spark, d).join(city, "city", "left").join(company, "company", "left")
    near = C("cx").isNull() | (geometry.distance(C("x"), C("z"), C("cx"), C("cz")) < 1500)
    at = rows.withColumn("hit", F.when(near, C("poi_id"))).groupBy("job").agg(F.count("hit").alias("n"), F.min("hit").alias("poi_id"))
    return at.select("job", F.when(C("n") == 0, "NotFound").when(C("n") > 1, "Ambiguous").otherwise("Found").alias("status"), F.when(C("n") == 1, C("poi_id")).alias("poi_id"))


@query()
def d05_access_snaps(spark, d):
    """The place on the nearest road to each company and garage, within 300 m of a point beside its access node. No SQL: DuckDB breaks off on it."""
    n = roads.node(spark, d).select(C("uid").alias("access_uid"), (C("x") + 7).alias("x"), (C("z") + 11).alias("z"))
    p = roads.poi(spark, d).where("kind in ('Company', 'Garage')").join(n, "access_uid").select("poi_id", "x", "z")
    near = spatial.nearest_edge(p, roads.edge(spark, d), 300.0, "poi_id")
    rows = p.select("poi_id").join(near.select("poi_id", "edge_id", "offset"), "poi_id", "left")
    return rows.select("poi_id", "edge_id", F.round("offset", 6).alias("offset_m"), F.when(C("edge_id").isNull(), "NotFound").otherwise("Found").alias("status"))


@query(
    """SELECT code, severity, uid, row_number() OVER (PARTITION BY severity ORDER BY code, uid) AS place FROM (
  SELECT 'REF_BROKEN_START' AS code, 'Error' AS severity, edge_id AS uid FROM f_edge WHERE src NOT IN (SELECT uid FROM f_node WHERE uid % 17 <> 0)
  UNION ALL SELECT DISTINCT 'CONN_ONEWAY_DEAD_END', 'Info', src FROM f_half WHERE kind = 0 AND src NOT IN (SELECT dst FROM f_half)) QUALIFY place <= 25"""
)
def t06_worst_issues(spark, d):
    """A report of the first issues of each severity: at most 25 each."""
    from ..operators import quality

    e, n = roads.edge(spark, d), roads.node(spark, d)
    found = quality.together(quality.broken_references(e, n.where("uid % 17 <> 0")).where("code = 'REF_BROKEN_START'"), quality.dead_ends(_half(spark, d), n))
    place = F.row_number().over(Window.partitionBy("severity").orderBy("code", "uid"))
    return found.withColumn("place", place).where("place <= 25").select("code", "severity", "uid", C("place").cast("long").alias("place"))


@query(
    """SELECT (SELECT count(*) FROM f_edge e LEFT JOIN f_node a ON a.uid = e.src LEFT JOIN f_node b ON b.uid = e.dst WHERE a.uid IS NULL OR b.uid IS NULL) AS loose_ends,
  (SELECT count(*) FROM f_edge WHERE src = dst) AS loops, (SELECT CAST(count_if(length_m <= 0) AS BIGINT) FROM f_timed) AS without_length,
  (SELECT count(*) FROM (SELECT edge_id FROM f_edge GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, (SELECT CAST(count_if(access_uid NOT IN (SELECT uid FROM f_node)) AS BIGINT) FROM f_poi) AS places_off"""
)
def v09_smoke_checks(spark, d):
    """Counts that a sound dataset has at zero."""
    e, n, p = roads.timed_edge(spark, d), roads.node(spark, d).select("uid"), roads.poi(spark, d)
    known = n.select("uid", F.lit(1).alias("there"))
    ends = e.join(known.toDF("src", "a"), "src", "left").join(known.toDF("dst", "b"), "dst", "left")
    one = ends.agg(F.count_if(C("a").isNull() | C("b").isNull()).alias("loose_ends"), F.count_if(C("src") == C("dst")).alias("loops"), F.count_if(C("length_m") <= 0).alias("without_length"))
    two = e.groupBy("edge_id").agg(F.count("*").alias("n")).agg(F.count_if(C("n") > 1).alias("repeated_ids"))
    three = p.join(known, C("access_uid") == C("uid"), "left").agg(F.count_if(C("there").isNull()).alias("places_off"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))  # one row each


@query(
    """SELECT edge_id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || CAST(CAST(x1 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(z1 AS BIGINT) AS VARCHAR) || '],[' || CAST(CAST(x2 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(z2 AS BIGINT) AS VARCHAR) || ']]},"properties":{"id":' || edge_id || ',"kind":' || kind || '}}' AS feature FROM f_edge"""
)
def k09_features(spark, d):
    """Edges as GeoJSON features, one to a line."""
    c = F.array(F.array(C("x1").cast("long"), C("z1").cast("long")), F.array(C("x2").cast("long"), C("z2").cast("long")))
    line = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), c.alias("coordinates")).alias("geometry"), F.struct(C("edge_id").alias("id"), "kind").alias("properties"))
    return roads.edge(spark, d).select("edge_id", F.to_json(line).alias("feature"))
