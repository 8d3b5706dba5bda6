"""Named queries of route search, each beside its SQL twin where SQL can tell the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import od, search, synthesis
from ..operators.graph import checkpoint
from ..operators.overlay import Overlay, nearest_sources
from ..sources import roads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

C = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def relaxed(key: str, seeds: str, weight: str = "f_weight", extra: str = "") -> str:
    """SQL of the least cost from seeds (key, node, cost) to every node: rounds that keep one row per key and node."""
    same = " AND ".join(f"r.{k.strip()} = s.{k.strip()}" for k in key.split(","))
    profile = "AND e.profile = d.profile" if "profile" in key else ""
    added = " + coalesce(x.extra, 0.0e0)" if extra else ""
    join = f"LEFT JOIN ({extra}) x ON x.od_id = d.od_id AND x.edge_id = e.edge_id" if extra else ""
    return f"""(WITH RECURSIVE d({key}, node, cost) USING KEY ({key}, node) AS (
  {seeds} UNION SELECT s.* FROM (
    SELECT {', '.join('d.' + k.strip() for k in key.split(','))}, e.dst AS node, min(d.cost + e.w{added}) AS cost FROM d JOIN {weight} e ON e.src = d.node {profile} {join} GROUP BY ALL) s
  LEFT JOIN recurring.d AS r ON {same} AND r.node = s.node WHERE r.cost IS NULL OR s.cost < r.cost) SELECT * FROM d)"""


_PROFILES = "(VALUES ('fastest'), ('shortest'), ('balanced')) v(profile)"
_OD_SEEDS = f"SELECT od_id, profile, src, 0.0e0 FROM f_od CROSS JOIN {_PROFILES}"
_COSTS = f"(SELECT o.od_id, p.profile, d.cost FROM f_od o CROSS JOIN {_PROFILES.replace(' v(', ' p(')} LEFT JOIN {relaxed('od_id, profile', _OD_SEEDS)} d ON d.od_id = o.od_id AND d.profile = p.profile AND d.node = o.dst)"


def od_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A request for each supplier, from one node to another."""
    n = roads.table(spark, d, "part").agg(F.count("*").alias("n"))
    s = roads.table(spark, d, "supplier").join(F.broadcast(n))
    return s.select(C("s_suppkey").alias("od_id"), (7 * C("s_suppkey") % C("n")).alias("src"), ((37 * C("s_suppkey") + 11 * C("s_nationkey")) % C("n")).alias("dst"))


def _walked(found: DataFrame, edges: DataFrame, weights: tuple[str, ...]) -> DataFrame:
    """Routes with what their edges cost together and how often they don't follow one another or turn back."""
    steps = found.select("od_id", "profile", F.posexplode("edges").alias("i", "edge_id"))
    w = edges.select("edge_id", "src", "dst", *weights)
    order = Window.partitionBy("od_id", "profile").orderBy("i")
    steps = steps.join(w, "edge_id").select("od_id", "profile", "src", "dst", F.coalesce(*[F.when(C("profile") == p, C(p)) for p in weights]).alias("w"), (C("dst") != F.lead("src").over(order)).alias("jump"), (F.lead("dst").over(order) == C("src")).alias("uturn"))
    sums = steps.groupBy("od_id", "profile").agg(F.sum("w").alias("walked"), F.count_if("jump").alias("jumps"), F.count_if("uturn").alias("uturns"))
    return found.join(sums, ["od_id", "profile"], "left")


@query("SELECT edge_id, round(turn, 6) AS turn, round(time_s, 6) AS time_s FROM f_bent")
def p15_turn_times(spark, d):
    """How far each edge bends along its polyline, and its time with the delay of sharp bends and U-turns."""
    return roads.turned_edge(spark, d).select("edge_id", F.round("turn", 6).alias("turn"), F.round("time_s", 6).alias("time_s"))


@query(f"SELECT od_id, profile, round(cost, 4) AS cost, true AS valid FROM {_COSTS}")
def g02_route_costs(spark, d):
    """Cost of each request's route, and whether its edges follow one another and cost as much."""
    e = roads.turned_edge(spark, d)
    found = _walked(checkpoint(search.routes(e, search.between_nodes(od_pairs(spark, d)))), e, search.PROFILES)
    valid = C("cost").isNull() | ((F.abs(C("cost") - F.coalesce("walked", F.lit(0.0))) < 1e-6) & (F.coalesce("jumps", F.lit(0)) == 0))
    return found.select("od_id", "profile", F.round("cost", 4).alias("cost"), valid.alias("valid"))


@query(f"SELECT count(*) AS pairs, count(cost) AS reached, CAST(0 AS BIGINT) AS jumps, CAST(0 AS BIGINT) AS uturns FROM {_COSTS} WHERE profile = 'fastest'")
def a19_od_check(spark, d):
    """Reached pairs, and how often the edges of their routes don't follow one another or turn back."""
    e = roads.turned_edge(spark, d)
    found = _walked(checkpoint(search.routes(e, search.between_nodes(od_pairs(spark, d), ("fastest",)))), e, ("fastest",))
    return found.agg(F.count("*").alias("pairs"), F.count("cost").alias("reached"), F.coalesce(F.sum("jumps"), F.lit(0)).cast("long").alias("jumps"), F.coalesce(F.sum("uturns"), F.lit(0)).cast("long").alias("uturns"))


_STOPS = "SELECT DISTINCT access_uid AS uid FROM f_poi WHERE kind IN ('City', 'Company') AND access_uid IN (SELECT uid FROM f_node)"


#: Stops that are told for each node.
STOPS = 5


@query(
    f"""SELECT source, node AS uid, round(cost, 6) AS cost FROM {relaxed('source', f'SELECT uid, uid, 0.0e0 FROM ({_STOPS})', '(SELECT src, dst, time_s AS w FROM f_bent)')}
QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(cost, 6), source) <= {STOPS}"""
)
def g01_shortest_costs(spark, d):
    """Least times from cities and companies: the nearest five of each node, however far."""
    p = roads.poi(spark, d).where("kind in ('City', 'Company')").select(C("access_uid").alias("uid")).distinct()
    stops = p.join(roads.node(spark, d).select("uid"), "uid", "left_semi")
    cells = Overlay.build(roads.turned_edge(spark, d), ["time_s"])
    return nearest_sources(cells, stops, "time_s", STOPS).select("source", "uid", F.round("cost", 6).alias("cost"))


@query(f"SELECT source, node AS uid, round(cost, 4) AS metres FROM {relaxed('source', 'SELECT DISTINCT r_regionkey * (n // 5), r_regionkey * (n // 5), 0.0e0 FROM region CROSS JOIN (SELECT count(*) AS n FROM part)', '(SELECT src, dst, CASE WHEN length_m > 0 THEN length_m ELSE 1.0e0 END AS w FROM f_timed)')}")
def g20_lengths(spark, d):
    """Least lengths from one node of each region; an edge without length counts one metre."""
    n = roads.table(spark, d, "part").agg(F.count("*").alias("n"))
    starts = roads.table(spark, d, "region").join(F.broadcast(n)).select((C("r_regionkey") * F.floor(C("n") / 5)).alias("uid")).distinct()
    e = roads.timed_edge(spark, d).withColumn("w", F.when(C("length_m") > 0, C("length_m")).otherwise(1.0))
    return nearest_sources(Overlay.build(e, ["w"]), starts, "w", None).select("source", "uid", F.round("cost", 4).alias("metres"))


_FIRST_OUT = "(SELECT src, min(edge_id) AS edge_id FROM f_edge GROUP BY src)"
_PLACES = f"""(SELECT od_id, a.edge_id AS start_edge, CAST(od_id * 13 % 100 AS DOUBLE) AS start_m, od_id % 2 = 0 AS back, CASE WHEN od_id % 5 = 0 THEN a.edge_id ELSE b.edge_id END AS goal_edge, CAST(od_id * 29 % 100 AS DOUBLE) AS goal_m
  FROM f_od JOIN {_FIRST_OUT} a ON a.src = f_od.src JOIN {_FIRST_OUT} b ON b.src = f_od.dst)"""
_PART = "CASE profile WHEN 'fastest' THEN ({m}) / speed WHEN 'shortest' THEN ({m}) ELSE 0.7e0 * ({m}) / speed + 0.3e0 * ({m}) / 1000 END"
_PLACE_SEEDS = f"""SELECT od_id, profile, node, min(cost) FROM (
  SELECT od_id, profile, dst AS node, {_PART.format(m='length_m - start_m')} AS cost FROM {_PLACES} JOIN f_weight ON edge_id = start_edge WHERE start_edge <> goal_edge
  UNION ALL SELECT od_id, profile, src, {_PART.format(m='start_m')} FROM {_PLACES} JOIN f_weight ON edge_id = start_edge WHERE start_edge <> goal_edge AND (back OR start_m <= 1e-6)) GROUP BY ALL"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    """A place along the first edge out of each end of a request; for every fifth request both lie on one edge."""
    out = roads.edge(spark, d).groupBy("src").agg(F.min("edge_id").alias("edge_id"))
    a, b = out.select("src", C("edge_id").alias("a")), out.select(C("src").alias("dst"), C("edge_id").alias("b"))
    rows = od_pairs(spark, d).join(a, "src").join(b, "dst")
    return rows.select("od_id", C("a").alias("start_edge"), (C("od_id") * 13 % 100).cast("double").alias("start_m"), (C("od_id") % 2 == 0).alias("back"), F.when(C("od_id") % 5 == 0, C("a")).otherwise(C("b")).alias("goal_edge"), (C("od_id") * 29 % 100).cast("double").alias("goal_m"))


@query(
    f"""SELECT p.od_id, w.profile, round(d.cost + {_PART.format(m='goal_m').replace('CASE profile', 'CASE w.profile')}, 4) AS cost FROM {_PLACES} p JOIN f_weight w ON w.edge_id = p.goal_edge
LEFT JOIN {relaxed('od_id, profile', _PLACE_SEEDS)} d ON d.od_id = p.od_id AND d.profile = w.profile AND d.node = w.src WHERE start_edge <> goal_edge"""
)
def g03_places_along_edges(spark, d):
    """Costs from a place along one edge to a place along another."""
    e = roads.turned_edge(spark, d)
    return search.costs(e, search.between_places(_places(spark, d), e)).select("od_id", "profile", F.round("cost", 4).alias("cost"))


@query(f"SELECT od_id, profile, round({_PART.format(m='abs(goal_m - start_m)')}, 6) AS cost FROM {_PLACES} JOIN f_weight ON edge_id = start_edge WHERE start_edge = goal_edge")
def g04_along_one_edge(spark, d):
    """Costs where both places lie on one edge."""
    return search.along_one_edge(_places(spark, d), roads.turned_edge(spark, d)).select("od_id", "profile", F.round("cost", 6).alias("cost"))


_EXTRA = "SELECT o.od_id, e.edge_id, 60.0e0 AS extra FROM f_od o JOIN f_edge e ON e.dst = o.dst WHERE e.edge_id % 2 = 0"


@query(
    f"""SELECT o.od_id, p.profile, round(d.cost, 4) AS cost FROM f_od o CROSS JOIN {_PROFILES.replace(' v(', ' p(')}
LEFT JOIN {relaxed('od_id, profile', _OD_SEEDS, extra=_EXTRA)} d ON d.od_id = o.od_id AND d.profile = p.profile AND d.node = o.dst"""
)
def g06_penalties(spark, d):
    """Costs where some of the edges into each goal cost a minute more."""
    e, pairs = roads.turned_edge(spark, d), od_pairs(spark, d)
    dearer = pairs.join(e.select("edge_id", "dst").where("edge_id % 2 = 0"), "dst").select("od_id", F.explode(F.array(*map(F.lit, search.PROFILES))).alias("profile"), "edge_id", F.lit(60.0).alias("extra"))
    return search.costs(e, search.with_penalties(search.between_nodes(pairs), dearer)).select("od_id", "profile", F.round("cost", 4).alias("cost"))


@query()
def g05_alternatives(spark, d):
    """Up to three routes of each request that differ. No SQL: which of two equally cheap routes is found is the search's."""
    found = search.alternatives(roads.turned_edge(spark, d), search.between_nodes(od_pairs(spark, d)))
    return found.select("od_id", "rank", "profile", F.round("length_m", 4).alias("length_m"))


_NEXT = """(SELECT n_nationkey, r_name, coalesce(lead(n_nationkey) OVER w, first_value(n_nationkey) OVER w) AS other FROM nation JOIN region ON n_regionkey = r_regionkey
  WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))"""
_CITY_ROWS = "(SELECT DISTINCT name AS place, access_uid AS uid, x, z FROM f_poi JOIN f_node ON uid = access_uid WHERE kind = 'City')"
_CITY_PAIRS = f"""(SELECT DISTINCT r_name AS region, place AS "from", split_part(place, '_', 1) || '_' || other AS "to" FROM {_CITY_ROWS} JOIN {_NEXT} ON n_nationkey = CAST(split_part(place, '_', 2) AS BIGINT))"""


def _od_sql(edges: str) -> str:
    """Features of the city pairs over some edges: costs with the features of their paths, least cost first."""
    asked = "time_s + CASE WHEN flags & 2 <> 0 THEN 600.0e0 ELSE 0.0e0 END + CASE WHEN flags & 4 <> 0 THEN 3600.0e0 ELSE 0.0e0 END + 1e-6 * length_m + CASE WHEN kind IN (2, 3) THEN 1e-4 ELSE 0.0e0 END"
    return f"""(WITH RECURSIVE steps AS (SELECT src, dst, {asked} AS w, length_m, time_s, kind IN (2, 3) AS wet FROM f_bent WHERE {edges}),
d(source, node, c, m, s, n, t) USING KEY (source, node) AS (
  SELECT DISTINCT uid, uid, 0.0e0, 0.0e0, 0.0e0, 0::BIGINT, false FROM {_CITY_ROWS} UNION SELECT q.* FROM (
    SELECT source, node, b.c, b.m, b.s, b.n, b.t FROM (SELECT d.source, e.dst AS node, min({{'c': d.c + e.w, 'm': d.m + e.length_m, 's': d.s + e.time_s, 'n': d.n + 1, 't': d.t OR e.wet}}) AS b FROM d JOIN steps e ON e.src = d.node GROUP BY ALL)) q
  LEFT JOIN recurring.d AS r ON r.source = q.source AND r.node = q.node WHERE r.c IS NULL OR q.c < r.c - 1e-9)
SELECT "from", "to", b.m AS distance_m, b.s AS eta_s, b.n AS edges, b.t AS transit, EXISTS (SELECT 1 FROM f_poi o JOIN f_node k ON k.uid = o.access_uid JOIN f_node g ON g.uid = b.g WHERE o.kind = 'Company' AND (k.x - g.x) * (k.x - g.x) + (k.z - g.z) * (k.z - g.z) < 2250000.0e0) AS company FROM (
  SELECT "from", "to", min({{'m': round(d.m, 3), 's': round(d.s, 3), 'a': d.source, 'g': d.node, 'n': d.n, 't': d.t}}) AS b
  FROM {_CITY_PAIRS} p JOIN {_CITY_ROWS} a ON a.place = p."from" JOIN {_CITY_ROWS} g ON g.place = p."to" JOIN d ON d.source = a.uid AND d.node = g.uid GROUP BY ALL))"""


def _od_features(spark: SparkSession, d: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """City pairs of each region, a name's own kind in the next country, and their features over some edges."""
    poi = roads.poi(spark, d).join(roads.node(spark, d).select(C("uid").alias("access_uid"), "x", "z"), "access_uid")
    rows = poi.where("kind = 'City'").select(C("name").alias("place"), C("access_uid").alias("uid"), "x", "z").distinct()
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nations = roads.table(spark, d, "nation").join(roads.table(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    first = F.first("n_nationkey").over(order)
    nations = nations.select(C("n_nationkey").alias("country"), C("r_name").alias("region"), F.coalesce(F.lead("n_nationkey").over(order), first).alias("other"))
    part = F.split("place", "_")
    pairs = rows.select("place", part[0].alias("kind"), part[1].cast("long").alias("country")).distinct().join(F.broadcast(nations), "country")
    pairs = pairs.select("region", C("place").alias("from"), F.concat_ws("_", "kind", "other").alias("to"))
    return pairs, od.od_features(roads.turned_edge(spark, d).where(edges), pairs, rows, poi.where("kind = 'Company'").select("x", "z"))


@query(f'SELECT region, f.* FROM {_od_sql("true")} f JOIN {_CITY_PAIRS} USING ("from", "to")')
def g16_od_features(spark, d):
    """Least distance, time, edges, ferries and companies of the fastest roads between the rows of two cities."""
    pairs, found = _od_features(spark, d, "true")
    return pairs.join(found, ["from", "to"])


_DIFFERS = "abs(n.{0} - b.{0}) / greatest(b.{0}, 1) > {1}"


@query(
    f"""SELECT b."from", b."to", n."from" IS NULL AS missing, coalesce({_DIFFERS.format('distance_m', '0.01e0')}, false) AS distance, coalesce({_DIFFERS.format('eta_s', '0.05e0')}, false) AS eta, coalesce({_DIFFERS.format('edges', '0.05e0')}, false) AS edges,
  coalesce(n.transit <> b.transit, false) AS transit, coalesce(n.company <> b.company, false) AS company FROM {_od_sql("true")} b LEFT JOIN {_od_sql("kind <> 2")} n ON n."from" = b."from" AND n."to" = b."to" """
)
def g17_od_regression(spark, d):
    """City pairs without the ferries against the baseline with them."""
    return od.regression(_od_features(spark, d, "true")[1], _od_features(spark, d, "kind <> 2")[1])


_LEGS = """(SELECT od_id, 0 AS idx, a.x AS x1, a.z AS z1, b.x AS x2, a.z AS z2, abs(b.x - a.x) AS len, 0.0e0 AS off FROM f_od JOIN f_node a ON a.uid = src JOIN f_node b ON b.uid = dst
  UNION ALL SELECT od_id, 1, b.x, a.z, b.x, b.z, abs(b.z - a.z), abs(b.x - a.x) FROM f_od JOIN f_node a ON a.uid = src JOIN f_node b ON b.uid = dst)"""


@query(
    f"""SELECT od_id, count(*) AS frames, round(max(v), 6) AS top_speed, round(sum(v) * 0.05e0, 3) AS driven_m, round(sum(x1 + (x2 - x1) * p), 2) AS x_sum, round(sum(z1 + (z2 - z1) * p), 2) AS z_sum FROM (
  SELECT t.*, l.x1, l.z1, l.x2, l.z2, least(floor((pos - off) * greatest(ceil(len), 1) / greatest(len, 1e-9)), greatest(ceil(len), 1)) / greatest(ceil(len), 1) AS p FROM (
    WITH RECURSIVE totals AS (SELECT od_id, sum(len) AS total FROM {_LEGS} GROUP BY 1),
    t(od_id, total, n, pos, v) AS (SELECT od_id, total, 0, 0.0e0, 0.5e0 FROM totals UNION ALL SELECT od_id, total, n + 1, a,
      CASE WHEN n + 1 < 160 THEN greatest(least((n + 1) * 0.05e0 / 8 * 22, 22.0e0), 0.5e0) WHEN a > greatest(total - 200, 0.0e0) THEN greatest(least(22 * greatest((total - a) / 200, 0.0e0), 22.0e0), 0.5e0) ELSE 22.0e0 END
      FROM (SELECT *, pos + v * 0.05e0 AS a FROM t) WHERE a < total) SELECT * FROM t) t
  JOIN {_LEGS} l ON l.od_id = t.od_id AND l.idx = CASE WHEN pos >= (SELECT len FROM {_LEGS} o WHERE o.od_id = t.od_id AND o.idx = 0) AND (SELECT len FROM {_LEGS} o WHERE o.od_id = t.od_id AND o.idx = 1) > 0 THEN 1 ELSE 0 END) GROUP BY 1"""
)
def f20_route_synthesis(spark, d):
    """Drives along each request's way, east or west and then north or south: frames, speed, distance and places."""
    n = roads.node(spark, d)
    ends = od_pairs(spark, d).join(n.select(C("uid").alias("src"), C("x").alias("ax"), C("z").alias("az")), "src").join(n.select(C("uid").alias("dst"), C("x").alias("bx"), C("z").alias("bz")), "dst")
    leg = lambda k, x1, z1, x2, z2: F.struct(F.lit(k).alias("idx"), C(x1).alias("x1"), C(z1).alias("z1"), C(x2).alias("x2"), C(z2).alias("z2"))
    legs = ends.select(C("od_id").alias("route_id"), F.explode(F.array(leg(0, "ax", "az", "bx", "az"), leg(1, "bx", "az", "bx", "bz"))).alias("l")).select("route_id", "l.*")
    total = lambda v, digits: F.round(F.sum(v), digits)
    found = synthesis.drive(legs).groupBy(C("route_id").alias("od_id"))
    return found.agg(F.count("*").alias("frames"), F.round(F.max("speed"), 6).alias("top_speed"), F.round(F.sum("speed") * synthesis.STEP_S, 3).alias("driven_m"), total("x", 2).alias("x_sum"), total("z", 2).alias("z_sum"))


#: The multiplier and increment of the generator of random pairs, modulo 2**64.
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407
#: Pairs that a random check draws.
RANDOM_PAIRS = 100


def random_numbers(n: int, seed: int) -> list[float]:
    out, s = [], seed
    for _ in range(n):
        s = (s * LCG_A + LCG_C) % 2**64
        out.append((s >> 33) / 2**31)
    return out


_DRAWN = f"""(WITH RECURSIVE r(k, s) AS (SELECT 0, CAST(42 AS HUGEINT) UNION ALL
  SELECT k + 1, (s * CAST({LCG_A} AS HUGEINT) + CAST({LCG_C} AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT) FROM r WHERE k < {2 * RANDOM_PAIRS}) SELECT k, CAST(s >> 33 AS DOUBLE) / 2147483648.0e0 AS u FROM r WHERE k > 0)"""


@query(
    f"""SELECT count(*) AS pairs, count(d.cost) AS reached, round(sum(d.cost), 3) AS total_s FROM (
  SELECT a.k // 2 AS od_id, CAST(floor(a.u * n) AS BIGINT) AS src, CAST(floor(b.u * n) AS BIGINT) AS dst FROM {_DRAWN} a JOIN {_DRAWN} b ON b.k = a.k + 1 CROSS JOIN (SELECT count(*) AS n FROM part) WHERE a.k % 2 = 1) o
LEFT JOIN {relaxed('source', 'SELECT DISTINCT CAST(floor(u * n) AS BIGINT), CAST(floor(u * n) AS BIGINT), 0.0e0 FROM ' + _DRAWN + ' CROSS JOIN (SELECT count(*) AS n FROM part) WHERE k % 2 = 1', "(SELECT src, dst, w FROM f_weight WHERE profile = 'fastest')")} d ON d.source = o.src AND d.node = o.dst"""
)
def g18_random_od(spark, d):
    """A fixed number of random pairs: how many have a route, and the routes' costs together."""
    n = roads.table(spark, d, "part").count()
    u = random_numbers(2 * RANDOM_PAIRS, 42)
    pairs = spark.createDataFrame([(k, int(u[2 * k] * n), int(u[2 * k + 1] * n)) for k in range(RANDOM_PAIRS)], "od_id long, src long, dst long")
    found = search.costs(roads.turned_edge(spark, d), search.between_nodes(pairs, ("fastest",)))
    return found.agg(F.count("*").alias("pairs"), F.count("cost").alias("reached"), F.round(F.sum("cost"), 3).alias("total_s"))
