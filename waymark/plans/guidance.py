"""Named queries of guidance along a route: maneuvers, session states, signals; each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..operators import maneuvers, search
from ..sources import roads
from ..streaming import liveness, session
from ..streaming.columns import fold_columns
from .routing import relaxed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

C = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _angle(a: str, b: str) -> str:
    d = f"(({b} - {a}) % (2 * pi()))"
    return f"CASE WHEN {d} > pi() THEN {d} - 2 * pi() WHEN {d} < -pi() THEN {d} + 2 * pi() ELSE {d} END"


_BY = "PARTITION BY route_id ORDER BY idx"
_STEPS = f"""(SELECT *, {_angle('prev_out', 'b_in')} AS bent, CASE WHEN kind = 1 THEN {_angle('b_in', 'b_out')} ELSE {_angle('prev_out', 'b_in')} END AS angle,
  CASE WHEN idx > 0 AND (edge_ref + idx) % 2 = 0 THEN abs({_angle('prev_out', '(prev_out + (edge_ref * 11 % 9 - 4) * 0.15e0)')}) END AS straightest FROM (
  SELECT *, lag(b_out) OVER ({_BY}) AS prev_out, lag(kind) OVER ({_BY}) AS prev_kind, lag(road_class) OVER ({_BY}) AS prev_class,
    coalesce(sum(CASE WHEN idx > 0 THEN length_m ELSE 0.0e0 END) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS off,
    idx = max(idx) OVER (PARTITION BY route_id) AS is_last FROM f_walk))"""
_SIDE = "CASE WHEN {a} > 0 THEN 'Right' ELSE 'Left' END"
_KIND = f"""CASE WHEN idx = 0 THEN 'Depart' WHEN kind = 2 THEN 'Ferry' WHEN kind = 3 THEN 'Train'
  WHEN prev_class < 3 AND road_class = 3 THEN 'EnterMotorway' WHEN prev_class = 3 AND road_class < 3 THEN 'ExitMotorway'
  WHEN abs(angle) < 0.44e0 AND coalesce(turn_type, 0) = 0 THEN NULL
  WHEN turn_type = 2 THEN 'UTurn' WHEN turn_type = 0 THEN 'Continue'
  WHEN turn_type IS NOT NULL THEN CASE WHEN abs(angle) < 0.7e0 THEN 'Slight' WHEN abs(angle) < 1.6e0 THEN '' ELSE 'Sharp' END || CASE WHEN turn_type < 0 THEN 'Left' ELSE 'Right' END
  WHEN kind = 0 AND prev_kind = 0 AND straightest < 0.44e0 AND abs(bent) >= 0.44e0 AND abs(bent) < 0.9e0 THEN 'Keep' || {_SIDE.format(a='bent')}
  WHEN abs(angle) >= 2.6e0 THEN 'UTurn'
  ELSE CASE WHEN abs(angle) < 0.7e0 THEN 'Slight' WHEN abs(angle) < 1.6e0 THEN '' ELSE 'Sharp' END || {_SIDE.format(a='angle')} END"""


@query(
    f"""SELECT route_id, idx, maneuver, round(angle, 6) + 0.0e0 AS angle, round(x, 4) + 0.0e0 AS x, round(z, 4) + 0.0e0 AS z, round(off - coalesce(lag(off) OVER (PARTITION BY route_id ORDER BY idx, o), 0.0e0), 4) AS distance_from_prev FROM (
  SELECT route_id, idx, off, 0 AS o, maneuver, CASE WHEN maneuver IN ('Depart', 'Ferry', 'Train', 'EnterMotorway', 'ExitMotorway') THEN 0.0e0 ELSE angle END AS angle, x1 AS x, z1 AS z FROM (SELECT *, {_KIND} AS maneuver FROM {_STEPS}) WHERE maneuver IS NOT NULL
  UNION ALL SELECT route_id, idx, off, 1, 'Arrive', 0.0e0, x2, z2 FROM {_STEPS} WHERE is_last)"""
)
def w08_maneuvers(spark, d):
    """Maneuvers of the walked routes."""
    found = maneuvers.maneuvers(roads.walk(spark, d), roads.walk_siblings(spark, d))
    return found.select("route_id", "idx", "maneuver", F.round("angle", 6).alias("angle"), F.round("x", 4).alias("x"), F.round("z", 4).alias("z"), F.round("distance_from_prev", 4).alias("distance_from_prev"))


_AHEAD = "OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


@query(
    f"""SELECT route_id, idx, first_value(CASE WHEN told IS NOT NULL THEN idx END IGNORE NULLS) {_AHEAD} AS next_idx, first_value(told IGNORE NULLS) {_AHEAD} AS next_maneuver FROM (
  SELECT *, coalesce(maneuver, CASE WHEN is_last THEN 'Arrive' END) AS told FROM (SELECT *, {_KIND} AS maneuver FROM {_STEPS}))"""
)
def w19_next_maneuver(spark, d):
    """The maneuver that comes after each walked edge and the edge where it is told, if there is one; the last edge's own comes before the arrival."""
    steps = roads.walk(spark, d)
    found = maneuvers.maneuvers(steps, roads.walk_siblings(spark, d))
    told = found.groupBy("route_id", "idx").agg(F.min(F.struct((C("maneuver") == "Arrive").alias("last"), "maneuver"))["maneuver"].alias("told"))
    marked = steps.select("route_id", "idx").join(told, ["route_id", "idx"], "left")
    ahead = Window.partitionBy("route_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    at = F.when(C("told").isNotNull(), C("idx"))
    return marked.select("route_id", "idx", F.first(at, ignorenulls=True).over(ahead).alias("next_idx"), F.first("told", ignorenulls=True).over(ahead).alias("next_maneuver"))


@query(f"SELECT maneuver, count(*) AS n FROM (SELECT {_KIND} AS maneuver FROM {_STEPS}) WHERE maneuver LIKE 'Keep%' GROUP BY 1")
def f08_forks(spark, d):
    """Forks that routes keep to, by side."""
    found = maneuvers.maneuvers(roads.walk(spark, d), roads.walk_siblings(spark, d))
    return found.where("maneuver like 'Keep%'").groupBy("maneuver").agg(F.count("*").alias("n"))


@query(f"SELECT route_id, idx, round({_angle('0.0e0', 'b_in')}, 6) + 0.0e0 AS entry, round({_angle('0.0e0', 'b_out')}, 6) + 0.0e0 AS leave, round(length_m, 4) AS length_m FROM f_walk")
def f09_tangents(spark, d):
    """Directions in which walked edges begin and end, and their length along their points."""
    ends = (C("x1"), C("z1"), C("x2"), C("z2"))
    return roads.walk(spark, d).select("route_id", "idx", F.round(geometry.entry_tangent(C("points"), *ends), 6).alias("entry"), F.round(geometry.exit_tangent(C("points"), *ends), 6).alias("leave"), F.round(geometry.edge_length(C("points"), *ends), 4).alias("length_m"))


#: A pause in these queries: slow frames in a row.
_PAUSE = 4


def _watched(spark: SparkSession, d: str) -> DataFrame:
    """Frames with what a session reads: made up by sequence numbers."""
    s = C("seq")
    f = roads.frame(spark, d).where("not paused")
    return f.select(
        "vehicle", "seq", "sim_us", "x", "z", F.when(s % 13 == 0, 0.1).otherwise(C("speed_ms")).alias("speed_ms"), (s % 7 != 0).alias("matched"),
        (s % 50 * 10.0 + 25.0).alias("remaining_m"), (s % 3 == 0).alias("has_destination"), (s % 41 != 0).alias("plan_ok"),
    )


_WATCHED = """(SELECT vehicle, seq, row_number() OVER (PARTITION BY vehicle ORDER BY sim_us, seq) AS rn, x, z, CASE WHEN seq % 13 = 0 THEN 0.1e0 ELSE speed_ms END AS speed_ms, seq % 7 <> 0 AS matched,
  seq % 50 * 10.0e0 + 25.0e0 AS remaining_m, seq % 3 = 0 AS has_destination, seq % 41 <> 0 AS plan_ok FROM f_frame WHERE NOT paused)"""
_NEXT = f"""CASE WHEN now IN ('Planning', 'Rerouting') THEN CASE WHEN plan_ok THEN 'Navigating' ELSE 'Error' END
  WHEN now = 'Idle' THEN CASE WHEN has_destination THEN 'Planning' ELSE 'Idle' END
  WHEN now IN ('Navigating', 'SuspectedOffRoute') THEN CASE
    WHEN NOT matched AND (u2 >= 15 OR o2 >= 80) THEN 'Rerouting' WHEN NOT matched AND (u2 >= 5 OR now = 'SuspectedOffRoute') THEN 'SuspectedOffRoute'
    WHEN remaining_m < 30 THEN 'Arrived' ELSE 'Navigating' END ELSE now END"""
_SESSION = f"""(WITH RECURSIVE watched AS (SELECT * FROM {_WATCHED}),
s(vehicle, rn, seq, state, unmatched, off_m, low, x, z) AS (
  SELECT DISTINCT vehicle, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 'Idle', CAST(0 AS BIGINT), 0.0e0, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM watched
  UNION ALL
  SELECT vehicle, rn, seq, CASE WHEN next = 'Navigating' AND low >= {_PAUSE} THEN 'Paused' ELSE next END, u3, o3, low, x, z FROM (
    SELECT *, {_NEXT} AS next, CASE WHEN now IN ('Planning', 'Rerouting') THEN 0 WHEN now IN ('Navigating', 'SuspectedOffRoute') THEN u2 ELSE u END AS u3,
      CASE WHEN now IN ('Planning', 'Rerouting') THEN 0.0e0 WHEN now IN ('Navigating', 'SuspectedOffRoute') THEN o2 ELSE o END AS o3 FROM (
    SELECT w.vehicle, w.rn, w.seq, w.x, w.z, w.matched, w.remaining_m, w.has_destination, w.plan_ok, s.state AS now, s.unmatched AS u, s.off_m AS o,
      CASE WHEN w.matched THEN 0 ELSE s.unmatched + 1 END AS u2,
      CASE WHEN w.matched THEN 0.0e0 ELSE s.off_m + CASE WHEN s.x IS NOT NULL AND sqrt((w.x - s.x) ** 2 + (w.z - s.z) ** 2) >= 0.5e0 THEN sqrt((w.x - s.x) ** 2 + (w.z - s.z) ** 2) ELSE 0.0e0 END END AS o2,
      CASE WHEN w.speed_ms < 0.5e0 THEN s.low + 1 ELSE 0 END AS low
    FROM s JOIN watched w ON w.vehicle = s.vehicle AND w.rn = s.rn + 1)))
SELECT * FROM s WHERE rn > 0)"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return fold_columns(_watched(spark, d), ["vehicle"], ["sim_us", "seq"], session.session_columns(_PAUSE), session.SESSION_SCHEMA)


@query(f"SELECT vehicle, seq, state, unmatched, round(off_m, 3) AS off_m FROM {_SESSION}")
def x07_session(spark, d):
    """Each vehicle's session state after every frame, with the evidence that it is off its route."""
    return _sessions(spark, d).select("vehicle", "seq", "state", "unmatched", F.round("off_m", 3).alias("off_m"))


@query(f"SELECT state, count(*) AS frames, count(DISTINCT vehicle) AS vehicles FROM {_SESSION} GROUP BY 1")
def x05_off_route_states(spark, d):
    """Frames and vehicles in each state: off the route by frames or by metres driven."""
    return _sessions(spark, d).groupBy("state").agg(F.count("*").alias("frames"), F.countDistinct("vehicle").alias("vehicles"))


@query(
    f"""SELECT s.vehicle, s.seq, s.state, CASE WHEN s.state IN ('Navigating', 'SuspectedOffRoute') THEN remaining_m END AS remaining_m,
  array_to_string(list_filter([CASE WHEN s.state = 'Rerouting' THEN 'OffRoute' END, CASE WHEN limit_ms > 0 AND w.speed_ms * 3.6e0 > limit_ms * 3.6e0 + 5 THEN 'OverSpeed' END, CASE WHEN s.state = 'Arrived' THEN 'Arrived' END], lambda x: x IS NOT NULL), ',') AS reminders
FROM {_SESSION} s JOIN {_WATCHED} w ON w.vehicle = s.vehicle AND w.seq = s.seq JOIN f_frame f ON f.seq = s.seq"""
)
def x08_snapshots(spark, d):
    """What is shown after each frame: state, what remains, reminders."""
    rows = _sessions(spark, d).join(_watched(spark, d).select("vehicle", "seq", "remaining_m", "speed_ms"), ["vehicle", "seq"]).join(roads.frame(spark, d).select("seq", "limit_ms"), "seq")
    over = (C("limit_ms") > 0) & (C("speed_ms") * 3.6 > C("limit_ms") * 3.6 + 5)
    told = F.array_compact(F.array(F.when(C("state") == "Rerouting", "OffRoute"), F.when(over, "OverSpeed"), F.when(C("state") == "Arrived", "Arrived")))
    return rows.select("vehicle", "seq", "state", F.when(C("state").isin("Navigating", "SuspectedOffRoute"), C("remaining_m")).alias("remaining_m"), F.array_join(told, ",").alias("reminders"))


_HERE = "CAST(floor(x / 100) + 50 * floor(z / 100) AS BIGINT)"


@query(
    f"""SELECT q.seq, round(d.cost, 4) AS cost FROM (SELECT seq, {_HERE} AS src, vehicle * 37 % (SELECT count(*) FROM part) AS dst FROM {_SESSION} WHERE state = 'Rerouting') q
LEFT JOIN {relaxed('source', f"SELECT DISTINCT {_HERE}, {_HERE}, 0.0e0 FROM f_frame WHERE {_HERE} IN (SELECT uid FROM f_node)", "(SELECT src, dst, w FROM f_weight WHERE profile = 'fastest')")} d ON d.source = q.src AND d.node = q.dst"""
)
def x09_reroutes(spark, d):
    """A new route for each frame that confirms a vehicle to be off its own, from the node where it is."""
    n = roads.table(spark, d, "part").agg(F.count("*").alias("n"))
    at = roads.frame(spark, d).select("seq", (F.floor(C("x") / 100) + 50 * F.floor(C("z") / 100)).alias("src"))
    asked = _sessions(spark, d).where("state = 'Rerouting'").join(at, "seq").join(F.broadcast(n))
    pairs = asked.select(C("seq").alias("od_id"), "src", (C("vehicle") * 37 % C("n")).alias("dst"))
    found = search.costs(roads.turned_edge(spark, d), search.between_nodes(pairs, ("fastest",)))
    return found.select(C("od_id").alias("seq"), F.round("cost", 4).alias("cost"))


#: Microseconds after which a source without a new sequence is stale, and one without frames is gone.
STALE_US, GONE_US = 6 * 3600 * 10**6, 24 * 3600 * 10**6
_SEEN = "(SELECT user_id AS vehicle, event_id AS seq, epoch_us(ts) AS at_us, CAST(json_extract(props, '$.k') AS BIGINT) // 25 AS sequence FROM events)"
_SEEN_BY = "PARTITION BY vehicle ORDER BY at_us, seq"


@query(
    f"""WITH RECURSIVE numbered AS (SELECT *, row_number() OVER ({_SEEN_BY}) AS n, lead(at_us) OVER ({_SEEN_BY}) AS after, (SELECT max(at_us) FROM {_SEEN}) AS until FROM {_SEEN}),
walked(vehicle, n, sequence, new_us, seen_us, status, told) AS (
  SELECT vehicle, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 'None', [{{'at_us': 0::BIGINT, 'state': ''}}][2:] FROM (SELECT DISTINCT vehicle FROM {_SEEN})
  UNION ALL
  SELECT vehicle, n, sequence, new_us, at_us, status,
    list_filter([CASE WHEN came <> before THEN {{'at_us': at_us, 'state': came}} END, CASE WHEN dried THEN {{'at_us': new_us + {STALE_US}, 'state': 'Stale'}} END, CASE WHEN gone THEN {{'at_us': at_us + {GONE_US}, 'state': 'Disconnected'}} END], lambda x: x IS NOT NULL) FROM (
    SELECT *, CASE WHEN gone THEN 'Disconnected' WHEN dried THEN 'Stale' ELSE came END AS status FROM (
    SELECT *, came = 'Fresh' AND new_us + {STALE_US} < coalesce(after, until + 1) AS dried, at_us + {GONE_US} < coalesce(after, until + 1) AS gone FROM (
    SELECT f.vehicle, f.n, f.sequence, f.at_us, f.after, f.until, w.status AS before, CASE WHEN w.sequence IS DISTINCT FROM f.sequence THEN f.at_us ELSE w.new_us END AS new_us,
      CASE WHEN w.sequence IS DISTINCT FROM f.sequence THEN 'Fresh' WHEN w.status = 'Disconnected' THEN 'Stale' ELSE w.status END AS came
    FROM walked w JOIN numbered f ON f.vehicle = w.vehicle AND f.n = w.n + 1))))
SELECT vehicle, t.at_us AS at_us, t.state AS state FROM (SELECT vehicle, unnest(told) AS t FROM walked)"""
)
def s07_liveness(spark, d):
    """When each vehicle's source becomes fresh, stale and disconnected."""
    k = F.get_json_object("props", "$.k").cast("long")
    frames = roads.table(spark, d, "events").select(C("user_id").alias("vehicle"), F.unix_micros(C("ts").cast("timestamp")).alias("at_us"), C("event_id").alias("seq"), F.floor(k / 25).alias("sequence"))
    return liveness.liveness(frames, STALE_US, GONE_US)


#: The phases of the signal script, 40 frames each: light (1 red, 2 green, 3 yellow), seconds left, metres ahead, limit.
SCRIPT = ((1, 12.0, 120.0, 50), (1, 5.6, 100.0, -1), (3, 6.0, 120.0, 50), (None, 0.0, 0.0, 50), (2, 8.0, 100.0, 50), (1, 18.0, 60.0, 30))
SCRIPT_FRAMES = 40


@query(
    f"""SELECT f.seq, p.light, p.left_s, p.ahead_m, p.limit_kmh FROM (SELECT seq, row_number() OVER (PARTITION BY vehicle ORDER BY sim_us, seq) AS n FROM f_frame) f
JOIN (VALUES {', '.join(f"({k}, {'NULL' if p[0] is None else p[0]}, {p[1]}e0, {p[2]}e0, {p[3]})" for k, p in enumerate(SCRIPT))}) p(phase, light, left_s, ahead_m, limit_kmh) ON p.phase = n // {SCRIPT_FRAMES} % 6"""
)
def x10_signal_script(spark, d):
    """The scripted signal of each vehicle's frames, counted from one."""
    n = F.row_number().over(Window.partitionBy("vehicle").orderBy("sim_us", "seq"))
    phases = spark.createDataFrame([(k, *p) for k, p in enumerate(SCRIPT)], "phase int, light int, left_s double, ahead_m double, limit_kmh int")
    rows = roads.frame(spark, d).select("seq", (F.floor(n / SCRIPT_FRAMES) % 6).cast("int").alias("phase"))
    return rows.join(F.broadcast(phases), "phase").select("seq", "light", "left_s", "ahead_m", "limit_kmh")
