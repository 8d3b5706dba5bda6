"""SQL twins of the catalogue's queries, for DuckDB over the same tables."""

from __future__ import annotations

#: The derived tables of sources/roads.py.
FIXTURES = {
    "f_node": """SELECT p_partkey AS uid, CAST((p_partkey % 50) * 100 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y,
      CAST((p_partkey // 50) * 100 AS DOUBLE) AS z, p_size, p_name FROM part""",
    "f_edge": """SELECT a.uid * 4 + dir AS edge_id,
      CASE WHEN dir % 2 = 1 THEN b.uid ELSE a.uid END AS src, CASE WHEN dir % 2 = 1 THEN a.uid ELSE b.uid END AS dst,
      CASE WHEN a.p_size % 7 = 0 THEN 1 WHEN a.p_size = 50 THEN 2 ELSE 0 END AS kind,
      CASE WHEN a.p_size % 7 = 0 OR a.p_size = 50 OR a.p_size % 10 = 0 THEN -1 WHEN a.p_size % 10 = 9 THEN 0 ELSE 30 + 10 * (a.p_size % 10) END AS speed_limit,
      a.p_size % 4 AS road_class,
      2 * CAST(a.p_size % 11 = 0 AS INTEGER) + 4 * CAST(a.p_size % 13 = 0 AS INTEGER) AS flags,
      CASE WHEN a.p_size % 7 = 0 AND a.p_size % 2 = 0 THEN a.p_size ELSE -1 END AS semaphore_id,
      CASE WHEN dir % 2 = 1 THEN b.x ELSE a.x END AS x1, CASE WHEN dir % 2 = 1 THEN b.z ELSE a.z END AS z1,
      CASE WHEN dir % 2 = 1 THEN a.x ELSE b.x END AS x2, CASE WHEN dir % 2 = 1 THEN a.z ELSE b.z END AS z2
      FROM f_node a CROSS JOIN (VALUES (0), (1), (2), (3)) v(dir)
      JOIN f_node b ON b.uid = a.uid + CASE WHEN dir < 2 THEN 1 ELSE 50 END
      WHERE (dir >= 2 OR a.uid % 50 < 49) AND (dir % 2 = 0 OR a.p_size % 3 <> 0)""",
    "f_timed": """SELECT *, length_m / speed + CASE WHEN kind = 1 AND semaphore_id >= 0 THEN 8.0e0 ELSE 0.0e0 END AS time_s FROM (
      SELECT *, sqrt((x2 - x1) * (x2 - x1) + (z2 - z1) * (z2 - z1)) AS length_m,
        CASE WHEN kind <> 0 THEN 30 WHEN speed_limit < 0 THEN 50 WHEN speed_limit = 0 THEN 130 ELSE least(speed_limit, 130) END / 3.6e0 AS speed FROM f_edge)""",
    "f_bent": """SELECT * EXCLUDE (time_s, bent), abs(bent) AS turn, time_s + CASE WHEN kind <> 1 THEN 0.0e0 WHEN abs(bent) >= 2.6e0 THEN 30.0e0 WHEN abs(bent) >= 1.2e0 THEN 3.0e0 ELSE 0.0e0 END AS time_s FROM (
      SELECT * EXCLUDE (mx, mz), CASE WHEN kind <> 1 THEN 0.0e0 ELSE (atan2(z2 - mz, x2 - mx) - atan2(mz - z1, mx - x1) + 3 * pi()) % (2 * pi()) - pi() END AS bent FROM (
      SELECT t.*, (x1 + x2) / 2 - 65.0e0 * (p_size % 5) / length_m * (z2 - z1) AS mx, (z1 + z2) / 2 + 65.0e0 * (p_size % 5) / length_m * (x2 - x1) AS mz FROM f_timed t JOIN f_node ON uid = edge_id // 4))""",
    "f_weight": """SELECT profile, edge_id, src, dst, kind, length_m, speed, CASE profile WHEN 'fastest' THEN time_s WHEN 'shortest' THEN length_m ELSE 0.7e0 * time_s + 0.3e0 * length_m / 1000 END
      + CASE WHEN flags & 2 <> 0 THEN 600.0e0 ELSE 0.0e0 END + CASE WHEN flags & 4 <> 0 THEN 3600.0e0 ELSE 0.0e0 END AS w
      FROM f_bent CROSS JOIN (VALUES ('fastest'), ('shortest'), ('balanced')) v(profile)""",
    "f_od": """SELECT s_suppkey AS od_id, 7 * s_suppkey % n AS src, (37 * s_suppkey + 11 * s_nationkey) % n AS dst, n
      FROM supplier CROSS JOIN (SELECT count(*) AS n FROM part)""",
    "f_route": """SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS idx,
      CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS kind, round(l_extendedprice / 100, 4) AS length_m,
      CASE WHEN l_returnflag = 'N' OR l_quantity <= 5 THEN -1 WHEN l_quantity = 50 THEN 0 ELSE CAST(20 + 10 * floor(l_quantity / 10) AS INTEGER) END AS speed_limit,
      l_partkey AS edge_ref FROM lineitem""",
    "f_walk": """SELECT *, x1 + dx AS x2, z1 + dz AS z2 FROM (SELECT *,
        coalesce(sum(dx) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS x1,
        coalesce(sum(dz) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS z1 FROM (
      SELECT *, length_m / 2 * (cos(b_in) + cos(b_out)) AS dx, length_m / 2 * (sin(b_in) + sin(b_out)) AS dz, edge_ref // 8 % 4 AS road_class,
        CASE WHEN kind = 1 AND edge_ref % 6 < 4 THEN CASE edge_ref % 6 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END END AS turn_type FROM (
      SELECT *, b_in + bend AS b_out FROM (
      SELECT *, sum(turn) OVER (PARTITION BY route_id ORDER BY idx) + coalesce(sum(bend) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS b_in FROM (
      SELECT *, CASE WHEN idx = 0 THEN 0.0e0 ELSE (edge_ref * 7 % 13 - 6) * 0.25e0 END AS turn, CASE WHEN kind = 1 THEN (edge_ref % 9 - 4) * 0.45e0 ELSE (edge_ref % 5 - 2) * 0.1e0 END AS bend FROM (
      SELECT * REPLACE (CASE WHEN edge_ref % 23 = 0 THEN 2 WHEN edge_ref % 29 = 0 THEN 3 ELSE kind END AS kind) FROM f_route))))))""",
    "f_rtime": """SELECT *, length_m / (CASE WHEN kind <> 0 THEN 30 WHEN speed_limit < 0 THEN 50 WHEN speed_limit = 0 THEN 130 ELSE speed_limit END / 3.6e0) AS t FROM f_route""",
    "f_frame": """SELECT *, CAST((k % 50) * 100 + seq % 7 AS DOUBLE) AS x, CAST((k // 50) * 100 + seq % 5 AS DOUBLE) AS z, CASE WHEN event_type = 'purchase' THEN k END AS job_dest FROM (
      SELECT user_id AS vehicle, event_id AS seq, 50000 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sim_us,
        CAST(json_extract(props, '$.k') AS BIGINT) AS k, value / 10 AS speed_ms, CAST(5 * (event_id % 5) AS DOUBLE) AS limit_ms, event_type = 'error' AS paused, event_type FROM events)""",
    "f_signal": """SELECT junction_id, event_id, 7000 * rn + event_id % 400 AS wall_ms, 21000000 * rn + 3000 * (event_id % 400) AS sim_us, 3.0e0 AS scale,
      CASE event_type WHEN 'click' THEN 'R2G' WHEN 'view' THEN 'G2R' WHEN 'signup' THEN 'OTHER' WHEN 'error' THEN 'RST' WHEN 'purchase' THEN 'PROF' END AS kind FROM (
      SELECT user_id AS junction_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""",
    "f_poi": """SELECT c_custkey AS poi_id, ['City', 'Company', 'Garage', 'Fuel', 'Repair', 'Rest', 'Ferry', 'Train'][CAST(c_custkey % 8 + 1 AS INTEGER)] AS kind,
      lower(c_mktsegment) || '_' || c_nationkey AS name, 3 * c_custkey % (SELECT count(*) FROM part) AS access_uid FROM customer""",
    "f_light": """SELECT s_suppkey AS slot, s_suppkey % 51 AS light_id, CAST((s_suppkey % 50) * 100 + 4 * (s_suppkey % 3) AS DOUBLE) AS x,
      CAST((s_suppkey // 50) * 100 AS DOUBLE) AS z, s_suppkey % 4 AS state, CAST(s_nationkey AS DOUBLE) AS time_remaining FROM supplier""",
    "f_city": """SELECT n_nationkey AS city_id, CAST((n_nationkey % 5) * 1000 + 500 AS DOUBLE) AS cx, CAST((n_nationkey // 5) * 800 + 400 AS DOUBLE) AS cz, r_name AS country
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "f_half": "SELECT * FROM f_edge WHERE road_class IN (0, 1)",
    "f_approach": """SELECT f.*, l.state, l.time_remaining, CAST(seq % 240 AS DOUBLE) AS ahead_m, seq % 4 <> 0 AS verified
      FROM f_frame f JOIN f_light l ON l.slot = f.seq % (SELECT count(*) FROM supplier)""",
    "f_strayed": """SELECT * REPLACE (x + seq % 10 * 5.0e0 + CASE WHEN vehicle % 5 = 0 AND sim_us BETWEEN 300000 AND 2000000 THEN 100000.0e0 ELSE 0.0e0 END AS x, z + seq % 10 * 5.0e0 AS z) FROM f_frame""",
    # points near edges, with the box test and the projection
    "f_near": """SELECT *, sqrt((x - x1 - t * dx) * (x - x1 - t * dx) + (z - z1 - t * dz) * (z - z1 - t * dz)) AS lat, t * sqrt(dx * dx + dz * dz) AS off FROM (
      SELECT *, CASE WHEN dx * dx + dz * dz > 0 THEN least(greatest(((x - x1) * dx + (z - z1) * dz) / (dx * dx + dz * dz), 0.0e0), 1.0e0) ELSE 0.0e0 END AS t FROM (
      SELECT f.seq, f.x, f.z, e.*, e.x2 - e.x1 AS dx, e.z2 - e.z1 AS dz,
        pow(f.x - greatest(least(x1, x2), least(f.x, greatest(x1, x2))), 2) + pow(f.z - greatest(least(z1, z2), least(f.z, greatest(z1, z2))), 2) AS box2
      FROM f_frame f JOIN f_edge e ON least(x1, x2) <= f.x + 300 AND greatest(x1, x2) >= f.x - 300 AND least(z1, z2) <= f.z + 300 AND greatest(z1, z2) >= f.z - 300))""",
    "f_component": """SELECT uid, min(label) AS component FROM (
      WITH RECURSIVE b AS (SELECT src, dst FROM f_half UNION SELECT dst, src FROM f_half),
      r(uid, label) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, r.label FROM r JOIN b ON r.uid = b.src WHERE r.label < b.dst)
      SELECT uid, label FROM r) GROUP BY uid""",
    "f_roads": "SELECT * FROM f_edge WHERE kind = 0 AND road_class IN (0, 1)",
    "f_roadcomp": """SELECT uid, min(label) AS component FROM (
      WITH RECURSIVE b AS (SELECT src, dst FROM f_roads UNION SELECT dst, src FROM f_roads),
      r(uid, label) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, r.label FROM r JOIN b ON r.uid = b.src WHERE r.label < b.dst)
      SELECT uid, label FROM r) GROUP BY uid""",
    "f_land": "SELECT * FROM f_edge WHERE kind IN (0, 1) AND road_class = 1",
    "f_landcomp": """SELECT uid, min(label) AS component FROM (
      WITH RECURSIVE b AS (SELECT src, dst FROM f_land UNION SELECT dst, src FROM f_land),
      r(uid, label) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, r.label FROM r JOIN b ON r.uid = b.src WHERE r.label < b.dst)
      SELECT uid, label FROM r) GROUP BY uid""",
    # ways over water or motorway between pieces of land, each once for both directions
    "f_ways": """SELECT least(src, dst) AS p, greatest(src, dst) AS q, min(least(coalesce(x.component, src), coalesce(y.component, dst))) AS a, max(greatest(coalesce(x.component, src), coalesce(y.component, dst))) AS b
      FROM f_edge e LEFT JOIN f_landcomp x ON x.uid = e.src LEFT JOIN f_landcomp y ON y.uid = e.dst WHERE kind = 2 OR road_class = 3 GROUP BY 1, 2""",
}
FIXTURES["f_strayednear"] = FIXTURES["f_near"].replace("f_frame", "f_strayed")

_DEPENDS = {
    "f_edge": ["f_node"], "f_timed": ["f_edge"], "f_bent": ["f_timed"], "f_weight": ["f_bent"], "f_rtime": ["f_route"], "f_walk": ["f_route"], "f_half": ["f_edge"], "f_approach": ["f_frame", "f_light"],
    "f_near": ["f_frame", "f_edge"], "f_strayed": ["f_frame"], "f_strayednear": ["f_strayed", "f_edge"], "f_component": ["f_half"], "f_roads": ["f_edge"], "f_roadcomp": ["f_roads"], "f_land": ["f_edge"], "f_landcomp": ["f_land"], "f_ways": ["f_landcomp"],
}


def with_tables(sql: str, inline: tuple[str, ...] = ()) -> str:
    """Puts the derived tables that a query names before it; those of `inline` are computed at each use."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in _DEPENDS.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in FIXTURES:
        if name in sql:
            add(name)
    return "WITH " + ",\n".join(f"{n} AS {'NOT MATERIALIZED ' * (n in inline)}({FIXTURES[n]})" for n in wanted) + "\n" + sql if wanted else sql


def _scan(radius: float) -> str:
    return ", ".join(f"greatest(floor(least({a}, {b}) / 256), floor(({p} - {radius}) / 256) - 1)" for p, a, b in (("x", "x1", "x2"), ("z", "z1", "z2")))


_NEAREST = """(SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(lat, 9), {scan}, edge_id) AS rn FROM f_near
  WHERE kind IN (0, 1) AND box2 <= {r} * {r} AND lat <= {r} QUALIFY rn = 1)"""

_ROUTE = "PARTITION BY route_id ORDER BY idx"
_WALL = "PARTITION BY junction_id ORDER BY wall_ms, event_id"
_ARRIVAL = "PARTITION BY vehicle ORDER BY sim_us, seq"

_BREAKS = f"""(SELECT * FROM (SELECT *, lag(lim) OVER ({_ROUTE}) AS before FROM (
  SELECT route_id, idx, round(coalesce(sum(length_m) OVER ({_ROUTE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0), 4) AS offset_m,
    coalesce(last_value(CASE WHEN kind = 0 THEN speed_limit END IGNORE NULLS) OVER ({_ROUTE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(speed_limit) OVER ({_ROUTE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS lim FROM f_route) {{where}}) WHERE before IS NULL OR before <> lim)"""

_SIGNED = "((b - a + pi()) % (2 * pi()) - pi())"

_SQL = {
    "a07_time_distance_by_kind": """SELECT kind, count(*) AS edges, round(sum(length_m), 6) AS distance_m, round(sum(time_s), 6) AS time_s,
      round(sum(CASE WHEN kind = 0 AND speed_limit < 0 THEN length_m ELSE 0.0e0 END), 6) AS unknown_speed_m FROM f_timed GROUP BY kind""",
    "p16_cost_by_profile": """SELECT edge_id, round(time_s + extra, 6) AS fastest, round(length_m + extra, 6) AS shortest, round(0.7e0 * time_s + 0.3e0 * length_m / 1000 + extra, 6) AS balanced
      FROM (SELECT *, CASE WHEN flags & 2 <> 0 THEN 600.0e0 ELSE 0.0e0 END + CASE WHEN flags & 4 <> 0 THEN 3600.0e0 ELSE 0.0e0 END AS extra FROM f_timed)""",
    "p01_flag_predicates": "SELECT edge_id, flags & 1 <> 0 AS no_ai, flags & 2 <> 0 AS gps_avoid, flags & 4 <> 0 AS secret FROM f_edge",
    "a01_graph_stats": """SELECT count(*) AS edges, CAST(count_if(kind = 0) AS BIGINT) AS kind_0, CAST(count_if(kind = 1) AS BIGINT) AS kind_1, CAST(count_if(kind = 2) AS BIGINT) AS kind_2, CAST(count_if(kind = 0 AND speed_limit < 0) AS BIGINT) AS unknown_speed,
      (SELECT count(*) FROM (SELECT src FROM f_edge UNION SELECT dst FROM f_edge)) AS active_nodes FROM f_edge""",
    "a02_degree": "SELECT uid, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS uid, 1 AS o, 0 AS i FROM f_edge UNION ALL SELECT dst, 0, 1 FROM f_edge) GROUP BY uid",
    "a17_distributions": "SELECT kind, speed_limit, road_class, count(*) AS n FROM f_edge GROUP BY ALL",
    "p08_active_nodes": "SELECT src AS uid FROM f_edge WHERE road_class = 1 UNION SELECT dst FROM f_edge WHERE road_class = 1",
    "u05_edges_by_kind_union": "SELECT edge_id, kind FROM f_edge WHERE kind IN (0, 1, 2)",
    "j01_road_endpoints": "SELECT edge_id, round(b.y - a.y, 6) AS climb FROM f_edge e JOIN f_node a ON a.uid = e.src JOIN f_node b ON b.uid = e.dst WHERE kind = 0",
    "j13_radius_edges": "SELECT seq, edge_id FROM f_near WHERE box2 <= 100 * 100",
    "f02_project_points": "SELECT seq, edge_id, round(lat, 6) AS \"lateral\", round(off, 6) AS \"offset\" FROM f_near WHERE kind = 0 AND box2 <= 50 * 50",
    "j14_nearest_edge": "SELECT seq, edge_id, round(lat, 6) AS \"lateral\", round(off, 6) AS \"offset\" FROM " + _NEAREST.format(scan=_scan(200), r=200),
    "j15_topk_candidates": f"""SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY score DESC, {_scan(300)}, edge_id) AS rank, edge_id, round(score, 6) AS score FROM (
      SELECT *, round(0.5e0 * greatest(least(1 - lat / 20, 1.0e0), 0.0e0) + 0.3e0 * greatest(least(1 - abs(least(dd, pi() - dd)) / (pi() / 2), 1.0e0), 0.0e0) + 0.2e0 * 0.5e0, 9) AS score FROM (
      SELECT *, CASE WHEN d0 < -pi() THEN d0 + 2 * pi() ELSE d0 END AS dd FROM (
      SELECT *, ((seq % 7 * 0.5e0 - 1.5e0) - atan2(z2 - z1, x2 - x1) + pi()) % (2 * pi()) - pi() AS d0 FROM f_near WHERE kind IN (0, 1) AND box2 <= 300 * 300 AND lat <= 60)))
      QUALIFY rank <= 8""",
    "a10_match_confidence": "SELECT CASE WHEN lat < 8 THEN 'HIGH' WHEN lat < 20 THEN 'MEDIUM' WHEN lat IS NOT NULL THEN 'LOW' ELSE 'UNMATCHED' END AS confidence, count(*) AS n, round(avg(lat), 6) AS mean_lateral FROM f_frame LEFT JOIN " + _NEAREST.format(scan=_scan(60), r=60).replace("f_near", "f_strayednear") + " USING (seq) GROUP BY 1",
    "a11_most_matched_edges": "SELECT edge_id, count(*) AS frames FROM " + _NEAREST.format(scan=_scan(60), r=60) + " GROUP BY 1 ORDER BY frames DESC, edge_id LIMIT 5",
    "j04_country_of_node": """SELECT n.uid, coalesce(c.country, 'germany') AS country FROM f_node n LEFT JOIN (
      SELECT uid, country FROM f_node, f_city WHERE abs(x - cx) <= 800 AND abs(z - cz) <= 800 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY abs(x - cx) + abs(z - cz), city_id) = 1) c ON c.uid = n.uid""",
    "j12_poi_access": "SELECT poi_id, kind, x, z FROM f_poi LEFT JOIN f_node ON access_uid = uid",
    "j23_near_company": """SELECT uid FROM f_node n WHERE EXISTS (SELECT 1 FROM f_poi p JOIN f_node c ON p.access_uid = c.uid
      WHERE p.kind = 'Company' AND sqrt((n.x - c.x) * (n.x - c.x) + (n.z - c.z) * (n.z - c.z)) <= 150)""",
    "j17_signal_link": """SELECT m.edge_id, light_id, round(score, 6) AS score, CASE WHEN score >= 0.8 AND light_id = m.semaphore_id THEN 'VERIFIED' WHEN score >= 0.55 THEN 'PROBABLE' ELSE 'UNKNOWN' END AS confidence
      FROM f_edge m LEFT JOIN (
        SELECT edge_id, light_id, slot, round(0.5e0 * greatest(least(1 - d / 15, 1.0e0), 0.0e0) + 0.3e0 * greatest(least(1 - least(a, 6.283185307179586e0 - a) / 0.9e0, 1.0e0), 0.0e0) + 0.2e0 * CAST(light_id = semaphore_id AS INTEGER), 9) AS score FROM (
          SELECT e.edge_id, e.semaphore_id, l.light_id, l.slot, sqrt((e.x1 - l.x) * (e.x1 - l.x) + (e.z1 - l.z) * (e.z1 - l.z)) AS d, abs(slot % 4 * 0.4e0 - atan2(z2 - z1, x2 - x1)) % 6.283185307179586e0 AS a
          FROM f_edge e, f_light l WHERE e.kind = 1) WHERE d < 15
        QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY score DESC, slot) = 1) b ON b.edge_id = m.edge_id WHERE m.kind = 1""",
    "j19_nearest_events": """SELECT a.event_id AS left_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.wall_ms - a.wall_ms), b.wall_ms, b.event_id) AS rank, b.event_id AS right_id, abs(b.wall_ms - a.wall_ms) AS dt
      FROM f_signal a JOIN f_signal b ON a.junction_id = b.junction_id AND abs(b.wall_ms - a.wall_ms) <= 60000 WHERE a.kind = 'OTHER' AND b.kind IN ('R2G', 'G2R') QUALIFY rank <= 2""",
    "j20_next_events": """SELECT a.event_id AS left_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.wall_ms, b.event_id) AS rank, b.event_id AS right_id, b.wall_ms - a.wall_ms AS dt
      FROM f_signal a JOIN f_signal b ON a.junction_id = b.junction_id AND b.wall_ms >= a.wall_ms WHERE a.kind = 'RST' AND b.kind IN ('R2G', 'G2R') QUALIFY rank <= 3""",
    "j21_nearest_reset": """SELECT a.event_id AS left_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.wall_ms - a.wall_ms), b.wall_ms, b.event_id) AS rank, b.event_id AS right_id, abs(b.wall_ms - a.wall_ms) AS dt
      FROM f_signal a JOIN f_signal b ON a.junction_id = b.junction_id AND abs(b.wall_ms - a.wall_ms) <= 60000 WHERE a.kind = 'PROF' AND b.kind = 'RST' QUALIFY rank <= 1""",
    "j22_interval_avg": """SELECT event_id, round(avg(v) OVER w, 6) AS average, count(*) OVER w AS n FROM (SELECT *, CAST(event_id % 97 AS DOUBLE) AS v FROM f_signal)
      WINDOW w AS (PARTITION BY junction_id ORDER BY wall_ms RANGE BETWEEN 30000 PRECEDING AND CURRENT ROW)""",
    "j24_isolated_transit": """SELECT uid FROM (SELECT src AS uid, kind FROM f_edge WHERE road_class < 3 UNION ALL SELECT dst, kind FROM f_edge WHERE road_class < 3)
      GROUP BY uid HAVING count_if(kind IN (2, 3)) > 0 AND count_if(kind IN (0, 1)) = 0""",
    "j32_dump_diff": """SELECT *, 'left' AS side FROM (SELECT src, dst FROM f_edge WHERE road_class <> 2 EXCEPT ALL SELECT src, dst FROM f_edge WHERE road_class <> 3)
      UNION ALL SELECT *, 'right' FROM (SELECT src, dst FROM f_edge WHERE road_class <> 3 EXCEPT ALL SELECT src, dst FROM f_edge WHERE road_class <> 2)""",
    "v02_broken_refs": """SELECT 'REF_BROKEN_START' AS code, 'Error' AS severity, edge_id AS uid FROM f_edge WHERE src NOT IN (SELECT uid FROM f_node WHERE uid % 17 <> 0)
      UNION ALL SELECT 'REF_BROKEN_END', 'Error', edge_id FROM f_edge WHERE dst NOT IN (SELECT uid FROM f_node WHERE uid % 17 <> 0)""",
    "v06_geometry_issues": """SELECT * FROM (SELECT CASE WHEN isnan(m) THEN 'GEOM_NAN' WHEN m < 0.01 THEN 'GEOM_ZERO_LENGTH' WHEN m > 2000 THEN 'GEOM_TELEPORT' END AS code,
      CASE WHEN isnan(m) THEN 'Error' ELSE 'Warning' END AS severity, edge_ref AS uid FROM (
      SELECT *, CASE WHEN idx % 7 = 6 THEN CAST('nan' AS DOUBLE) WHEN idx % 5 = 4 THEN 0.0e0 ELSE length_m * 3 END AS m FROM f_route)) WHERE code IS NOT NULL""",
    "a27_duplicates": "SELECT 'STRUCT_DUP_EDGE' AS code, 'Warning' AS severity, route_id AS uid FROM f_route QUALIFY row_number() OVER (PARTITION BY route_id, edge_ref ORDER BY idx) > 1",
    "a29_oneway_deadends": "SELECT DISTINCT 'CONN_ONEWAY_DEAD_END' AS code, 'Info' AS severity, src AS uid FROM f_half WHERE kind = 0 AND src NOT IN (SELECT dst FROM f_half)",
    "a26_severity_counts": """SELECT severity, code, n FROM (SELECT unnest(['Error', 'Error', 'Warning', 'Info']) AS severity, unnest(['REF_BROKEN_START', 'REF_BROKEN_END', 'STRUCT_DUP_EDGE', 'CONN_ONEWAY_DEAD_END']) AS code, unnest([
      (SELECT CAST(count_if(src % 17 = 0) AS BIGINT) FROM f_edge), (SELECT CAST(count_if(dst % 17 = 0) AS BIGINT) FROM f_edge), (SELECT count(*) - count(DISTINCT (src // 10) * 1000000000 + dst // 10) FROM f_edge),
      (SELECT count(DISTINCT h.src) FROM f_half h LEFT JOIN (SELECT DISTINCT dst FROM f_half) t ON t.dst = h.src WHERE h.kind = 0 AND t.dst IS NULL)]) AS n) WHERE n > 0""",
    "w01_suffix_remaining": f"""SELECT route_id, idx, round(sum(length_m) OVER w, 6) AS remaining_m, round(sum(t) OVER w, 6) AS remaining_s FROM f_rtime WINDOW w AS ({_ROUTE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "w02_speed_breaks": "SELECT route_id, idx, offset_m, lim AS \"limit\" FROM " + _BREAKS.format(where="WHERE offset_m < 3000"),
    "w05_next_change": f"SELECT route_id, idx, offset_m, lim AS \"limit\" FROM {_BREAKS.format(where='')} QUALIFY row_number() OVER ({_ROUTE}) = 2",
    "w06_change_beyond": f"SELECT route_id, min_by(lim, offset_m) AS \"limit\", min(offset_m) AS offset_m FROM {_BREAKS.format(where='')} WHERE offset_m > 500.5 GROUP BY route_id",
    "w07_legs": f"SELECT route_id, idx, kind FROM (SELECT *, lag(kind) OVER ({_ROUTE}) AS before FROM f_route) WHERE before IS NULL OR before <> kind",
    "a07_route_metrics": """SELECT route_id, round(sum(length_m), 4) AS length_m, round(sum(t), 6) AS time_s, CAST(count_if(kind = 0) AS BIGINT) AS roads, CAST(count_if(kind <> 0) AS BIGINT) AS junctions,
      round(sum(CASE WHEN kind = 0 AND speed_limit < 0 THEN length_m ELSE 0.0e0 END), 4) AS unknown_speed_m FROM f_rtime GROUP BY route_id""",
    "a09_route_overlap": """SELECT p.a, p.b, coalesce(s.n, 0) AS shared_edges, round(coalesce(s.m, 0.0e0) / least(la.len, lb.len), 6) AS overlap FROM
      (SELECT x.route_id AS a, y.route_id AS b FROM (SELECT DISTINCT route_id FROM f_route) x JOIN (SELECT DISTINCT route_id FROM f_route) y ON y.route_id = x.route_id + 1) p
      JOIN (SELECT route_id, sum(length_m) AS len FROM f_route GROUP BY 1) la ON la.route_id = p.a JOIN (SELECT route_id, sum(length_m) AS len FROM f_route GROUP BY 1) lb ON lb.route_id = p.b
      LEFT JOIN (SELECT e.route_id AS a, g.route_id AS b, count(*) AS n, sum(e.m) AS m FROM (SELECT route_id, edge_ref % 40 AS r, min(length_m) AS m FROM f_route GROUP BY 1, 2) e
        JOIN (SELECT DISTINCT route_id, edge_ref % 40 AS r FROM f_route) g ON g.route_id = e.route_id + 1 AND g.r = e.r GROUP BY 1, 2) s ON s.a = p.a AND s.b = p.b""",
    "u03_shared_edges": """SELECT x.route_id AS a, CAST(len(list_intersect(x.e, y.e)) AS BIGINT) AS shared FROM (SELECT route_id, list(DISTINCT edge_ref % 40) AS e FROM f_route GROUP BY 1) x
      JOIN (SELECT route_id, list(DISTINCT edge_ref % 40) AS e FROM f_route GROUP BY 1) y ON y.route_id = x.route_id + 1""",
    "w11_trace_events": f"""SELECT vehicle, seq, unnest(list_filter([CASE WHEN seq < s0 THEN 'SequenceRestart' END, CASE WHEN sim_us < m0 - 1000000 THEN 'SimTimeReset' END,
      CASE WHEN sqrt(pow(x - x0, 2) + pow(z - z0, 2)) > 50 THEN 'Teleport' END, CASE WHEN paused <> p0 THEN 'PauseChanged' END, CASE WHEN s0 IS NOT NULL AND job_dest IS DISTINCT FROM j0 THEN 'JobChanged' END], lambda e: e IS NOT NULL)) AS event
      FROM (SELECT *, lag(seq) OVER w AS s0, lag(sim_us) OVER w AS m0, lag(x) OVER w AS x0, lag(z) OVER w AS z0, lag(paused) OVER w AS p0, lag(job_dest) OVER w AS j0 FROM f_frame WINDOW w AS ({_ARRIVAL}))""",
    "w12_phase_intervals": f"SELECT * FROM (SELECT junction_id, event_id, kind, lead(kind) OVER ({_WALL}) AS next_kind, lead(wall_ms) OVER ({_WALL}) - wall_ms AS interval_ms FROM f_signal WHERE kind NOT IN ('RST', 'PROF')) WHERE next_kind IS NOT NULL",
    "w13_same_kind_intervals": f"SELECT junction_id, event_id, kind, interval_ms FROM (SELECT junction_id, event_id, kind, lead(kind) OVER ({_WALL}) AS next_kind, lead(wall_ms) OVER ({_WALL}) - wall_ms AS interval_ms FROM f_signal WHERE kind NOT IN ('RST', 'PROF')) WHERE next_kind = kind",
    "w14_warps": f"""SELECT junction_id, event_id, gap_ms, CAST(ahead_us AS BIGINT) AS ahead_us FROM (SELECT *, wall - lag(wall) OVER w AS gap_ms, sim - lag(sim) OVER w - (wall - lag(wall) OVER w) * scale * 1000 AS ahead_us
      FROM (SELECT *, wall_ms - 4000 * (event_id % 3) AS wall, sim_us + 400000 * (event_id % 5) AS sim FROM f_signal) WINDOW w AS (PARTITION BY junction_id ORDER BY wall, event_id)) WHERE gap_ms > 0 AND gap_ms <= 5000 AND ahead_us > 300000""",
    "w15_resets": f"SELECT junction_id, event_id, b - s AS back_us FROM (SELECT *, lag(s) OVER ({_WALL}) AS b FROM (SELECT *, sim_us % 200000000 AS s FROM f_signal)) WHERE s < b",
    "w16_load_windows": f"""SELECT junction_id, "window", count(*) AS events, min(wall_ms) AS from_ms, max(wall_ms) AS to_ms FROM (SELECT *, CAST(sum(new) OVER ({_WALL}) AS BIGINT) AS "window" FROM (
      SELECT *, CASE WHEN gap IS NULL OR abs(gap - round(gap)) >= 0.15 THEN 1 ELSE 0 END AS new FROM (SELECT *, (wall_ms - lag(wall_ms) OVER ({_WALL})) / 14000 AS gap FROM f_signal WHERE kind = 'R2G'))) GROUP BY 1, 2""",
    "w20_low_speed_streaks": f"""SELECT vehicle, min(seq) AS from_seq, count(*) AS frames FROM (SELECT *, n - row_number() OVER ({_ARRIVAL}) AS island FROM (SELECT *, row_number() OVER ({_ARRIVAL}) AS n FROM f_frame) WHERE speed_ms < 3) GROUP BY vehicle, island""",
    "w21_offroute_state": f"""SELECT vehicle, seq, CAST(streak AS BIGINT) AS streak, CASE WHEN streak >= 15 THEN 'OFF_ROUTE' WHEN streak >= 5 THEN 'SUSPECTED' ELSE 'ON_ROUTE' END AS state FROM (
      SELECT *, sum(miss) OVER (PARTITION BY vehicle, grp ORDER BY sim_us, seq) AS streak FROM (SELECT *, sum(1 - miss) OVER ({_ARRIVAL}) AS grp FROM (SELECT *, CAST(speed_ms < 8 AS INTEGER) AS miss FROM f_frame)))""",
    "p22_speed_compare": "SELECT seq, diff AS diff_kmh, abs(diff) > 5 AS mismatch FROM (SELECT seq, CASE WHEN m >= 0 THEN CAST(round(limit_ms * 3.6e0) - m AS INTEGER) END AS diff FROM (SELECT *, CASE WHEN seq % 6 = 5 THEN -1 ELSE 10 * (seq % 9) END AS m FROM f_frame))",
    "p23_overspeed": "SELECT seq, lim > 0 AND speed_ms * 3 * 3.6e0 > lim + CASE WHEN lim <= 50 THEN 3.0e0 ELSE 5.0e0 END AS over FROM (SELECT *, limit_ms * 3.6e0 AS lim FROM f_frame)",
    "p24_red_light": """SELECT seq, state IN (1, 3) AND ahead_m >= 0 AND ahead_m < speed_ms * 1.0e0 + speed_ms * speed_ms / 5.0e0 + 5.0e0 AS warn,
      state = 1 AND verified AND speed_ms < 5.0e0 AND time_remaining / 5 >= 0 AND time_remaining / 5 < 3.0e0 AS imminent FROM f_approach""",
    "p26_glosa": """SELECT seq, ok AS feasible, CASE WHEN ok THEN CAST(greatest(floor((lo * 3.6e0 + 1e-3) / 5) * 5, 0) AS INTEGER) ELSE 0 END AS v_min_kmh, CASE WHEN ok THEN CAST(greatest(ceil((hi * 3.6e0 - 1e-3) / 5) * 5, 5) AS INTEGER) ELSE 0 END AS v_max_kmh FROM (
      SELECT *, coalesce(verified AND ahead_m BETWEEN 20 AND 500 AND time_remaining >= 0 AND state IN (1, 2) AND t2 > 0 AND lo <= hi, false) AS ok FROM (
      SELECT *, CASE WHEN t2 <> 0 THEN ahead_m / t2 END AS lo, least(sqrt(speed_ms * speed_ms + 4.0e0 * ahead_m), CASE WHEN t1 > 0 THEN ahead_m / t1 ELSE 1e300 END, CASE WHEN lim > 0 THEN lim / 3.6e0 ELSE 1e300 END) AS hi FROM (
      SELECT *, CASE WHEN state = 1 THEN time_remaining ELSE 0.0e0 END AS t1, CASE WHEN state = 1 THEN time_remaining + 15 ELSE time_remaining END AS t2, CAST(trunc(limit_ms * 3.6e0) AS INTEGER) AS lim FROM f_approach)))""",
    "p27_speak_distance": """SELECT seq, CAST(trunc(greatest(least(speed_ms * 3.6e0 * 10.0e0 * CASE WHEN seq % 4 = 3 THEN 1.0e0 WHEN seq % 4 = 2 THEN 0.8e0 ELSE 0.5e0 END * CASE WHEN seq % 5 >= 3 THEN 1.3e0 ELSE 1.0e0 END * 1.0e0, 2000.0e0), 100.0e0)) AS INTEGER) AS lead_m FROM f_frame""",
    "f36_speech_text": """SELECT seq, '前方' || CASE WHEN m % 100 = 0 THEN (m // 100) || '百米' ELSE m || '米' END || '，' || CASE WHEN l < 0 THEN '限速未知' WHEN l = 0 THEN '解除限速' ELSE '限速' || l END AS said FROM (SELECT seq, seq % 30 * 50 AS m, seq % 4 * 30 - 30 AS l FROM f_frame)""",
    "f05_signed_angle": f"""SELECT seq, round(g, 6) AS angle, CASE WHEN abs(g) < 0.7 THEN 'Slight' || side WHEN abs(g) < 1.6 THEN side WHEN abs(g) < 2.6 THEN 'Sharp' || side ELSE 'UTurn' END AS turn FROM (
      SELECT *, CASE WHEN g > 0 THEN 'Right' ELSE 'Left' END AS side FROM (SELECT seq, CASE WHEN {_SIGNED} < -pi() THEN {_SIGNED} + 2 * pi() ELSE {_SIGNED} END AS g FROM (SELECT seq, seq % 13 * 0.5e0 - 3.0e0 AS a, seq % 11 * 0.6e0 - 3.0e0 AS b FROM f_frame)))""",
    "a12_latency_quantiles": """SELECT event_type, n, s[CAST(least(floor(n * 0.5e0), n - 1) AS BIGINT) + 1] AS p50, s[CAST(least(floor(n * 0.9e0), n - 1) AS BIGINT) + 1] AS p90, s[CAST(least(floor(n * 0.99e0), n - 1) AS BIGINT) + 1] AS p99, s[n] AS largest
      FROM (SELECT event_type, count(value) AS n, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY 1)""",
    "a13_upper_median": "SELECT route_id, n, s[n // 2 + 1] AS median FROM (SELECT route_id, count(*) AS n, list_sort(list(length_m)) AS s FROM f_route GROUP BY 1)",
    "a14_frame_stats": """SELECT user_id, frames, mean_fps, round(1000 / s[CAST(least(floor(frames * 0.5e0), frames - 1) AS BIGINT) + 1], 6) AS p50_fps, round(1000 / s[CAST(least(floor(frames * 0.99e0), frames - 1) AS BIGINT) + 1], 6) AS low_fps FROM (
      SELECT user_id, count(*) AS frames, round(1000 * count(*) / sum(value), 6) AS mean_fps, list_sort(list(value)) AS s FROM events WHERE value > 0 AND value < 500 GROUP BY 1)""",
    "j28_issue_places": """SELECT code, i.uid, coalesce(e.x1, -1.0e0) AS x, coalesce(e.z1, -1.0e0) AS z FROM (
      SELECT 'REF_BROKEN_START' AS code, edge_id AS uid FROM f_edge WHERE src NOT IN (SELECT uid FROM f_node WHERE uid % 17 <> 0)
      UNION ALL SELECT 'REF_BROKEN_END', edge_id FROM f_edge WHERE dst NOT IN (SELECT uid FROM f_node WHERE uid % 17 <> 0)) i LEFT JOIN f_edge e ON e.edge_id = i.uid AND e.road_class > 0""",
    "f17_tile_id": """SELECT uid, CAST((power(4, 11) - 1) / 3 AS BIGINT) + d AS tile_id FROM (WITH RECURSIVE t(uid, s, x, y, d) AS (
      SELECT uid, CAST(1024 AS BIGINT), CAST(least(greatest(floor((x * 40 / 111320.0e0 + 180) / 360 * 2048), 0), 2047) AS BIGINT),
        CAST(least(greatest(floor((1 - ln(tan(radians(-z * 40 / 111320.0e0)) + 1 / cos(radians(-z * 40 / 111320.0e0))) / pi()) / 2 * 2048), 0), 2047) AS BIGINT), CAST(0 AS BIGINT) FROM f_node
      UNION ALL SELECT uid, s // 2, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - y % s ELSE y % s END ELSE x % s END, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - x % s ELSE x % s END ELSE y % s END,
        d + s * s * (CASE WHEN rx = 1 AND ry = 1 THEN 2 WHEN rx = 1 THEN 3 ELSE ry END) FROM (SELECT *, CASE WHEN x & s > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & s > 0 THEN 1 ELSE 0 END AS ry FROM t WHERE s > 0))
      SELECT uid, d FROM t WHERE s = 0)""",
    "w17_reminder_gate": """SELECT vehicle, seq, 'OverSpeed' AS kind, allowed FROM (WITH RECURSIVE g AS (SELECT vehicle, seq, sim_us * 60 / 1e6 AS t, row_number() OVER (PARTITION BY vehicle ORDER BY sim_us, seq) AS rn FROM f_frame WHERE speed_ms > 4),
      r(vehicle, rn, seq, last, allowed) AS (SELECT DISTINCT vehicle, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST('-infinity' AS DOUBLE), false FROM g
      UNION ALL SELECT g.vehicle, g.rn, g.seq, CASE WHEN g.t - r.last >= 30 THEN g.t ELSE r.last END, g.t - r.last >= 30 FROM r JOIN g ON g.vehicle = r.vehicle AND g.rn = r.rn + 1) SELECT * FROM r WHERE rn > 0)""",
    "a15_agreement": "SELECT vehicle, count(*) AS n, round(count_if(abs(limit_ms * 3.6e0 - speed_ms * 3.6e0) <= 5) / count(*), 6) AS within_5, round(count_if(abs(limit_ms * 3.6e0 - speed_ms * 3.6e0) <= 20) / count(*), 6) AS within_20 FROM f_frame GROUP BY 1",
    "a03_components": "SELECT uid, component FROM f_component",
    "a04_component_sizes": """SELECT CASE WHEN nodes <= 1 THEN 0 WHEN nodes <= 2 THEN 1 WHEN nodes <= 5 THEN 2 WHEN nodes <= 10 THEN 3 WHEN nodes <= 50 THEN 4 WHEN nodes <= 100 THEN 5 WHEN nodes <= 1000 THEN 6 ELSE 7 END AS bucket,
      count(*) AS components, CAST(sum(nodes) AS BIGINT) AS nodes FROM (SELECT component, count(*) AS nodes FROM f_component GROUP BY 1) GROUP BY 1""",
    "a05_component_bbox": "SELECT component, count(*) AS nodes, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM f_component JOIN f_node USING (uid) GROUP BY 1 ORDER BY nodes DESC, component LIMIT 30",
    "g08_reachable": """SELECT source, uid FROM (WITH RECURSIVE r(source, uid) AS (SELECT uid, uid FROM (SELECT DISTINCT r_regionkey * (n // 5) AS uid FROM region CROSS JOIN (SELECT count(*) AS n FROM part)) UNION SELECT r.source, e.dst FROM r JOIN f_half e ON e.src = r.uid) SELECT * FROM r)""",
    "g09_khop": """SELECT source, uid, CAST(min(hops) AS INTEGER) AS hops FROM (WITH RECURSIVE r(source, uid, hops) AS (SELECT uid, uid, 0 FROM (SELECT DISTINCT access_uid AS uid FROM f_poi WHERE kind IN ('City', 'Company')) UNION SELECT r.source, e.dst, r.hops + 1 FROM r JOIN f_edge e ON e.src = r.uid WHERE r.hops < 3) SELECT * FROM r) GROUP BY 1, 2""",
    "t04_poi_search": "SELECT poi_id, name FROM f_poi WHERE contains(lower(name), 'build') ORDER BY poi_id LIMIT 20",
    "d01_resolve_name": """SELECT request, CASE WHEN coalesce(x.n, f.n) IS NULL THEN 'NotFound' WHEN coalesce(x.n, f.n) > 1 THEN 'Ambiguous' ELSE 'Found' END AS status, CASE WHEN coalesce(x.n, f.n) = 1 THEN coalesce(x.p, f.p) END AS poi_id
      FROM (SELECT 'Building_' || n_nationkey AS request FROM nation UNION ALL SELECT lower(r_name) FROM region) q
      LEFT JOIN (SELECT name, count(*) AS n, min(poi_id) AS p FROM f_poi WHERE kind IN ('City', 'Company') GROUP BY 1) x ON x.name = lower(q.request)
      LEFT JOIN (SELECT r.request AS rq, count(*) AS n, min(poi_id) AS p FROM (SELECT 'Building_' || n_nationkey AS request FROM nation UNION ALL SELECT lower(r_name) FROM region) r
        JOIN f_poi ON kind IN ('City', 'Company') AND (contains(name, lower(r.request)) OR contains(lower(r.request), name)) GROUP BY 1) f ON f.rq = q.request""",
    "f16_tile_xy": """SELECT uid, CAST(least(greatest(floor((x / 111320.0e0 + 180) / 360 * 2048), 0), 2047) AS BIGINT) AS tile_x,
      CAST(least(greatest(floor((1 - ln(tan(radians(-z / 111320.0e0)) + 1 / cos(radians(-z / 111320.0e0))) / pi()) / 2 * 2048), 0), 2047) AS BIGINT) AS tile_y FROM f_node""",
    "a35_charset": """SELECT lang, CAST(unicode(c) AS INTEGER) AS code_point, CAST(unicode(c) // 256 AS INTEGER) AS block, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS texts FROM (
      SELECT lang, text, c, count(*) AS n FROM (SELECT lang, text, unnest(string_split(text, '')) AS c FROM (SELECT DISTINCT lang, text FROM documents WHERE text IS NOT NULL)) WHERE c <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
    "f30_hex_uid": "SELECT uid, lpad(lower(to_hex(uid)), 16, '0') AS hex FROM f_node",
    "a31_fingerprint": "SELECT source, doc_id // 1000 AS block, sha256(string_agg('|' || doc_id || ':' || n_chars, '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1, 2",
    "s15_overlay": "SELECT p_name AS path, arg_max(p_partkey, CAST(p_size AS BIGINT) * 1000000000 - p_partkey) AS item, max(p_size) AS priority FROM part GROUP BY 1",
    "j02_lane_class_fallback": """SELECT item, coalesce(a.class, b.class) AS class FROM (SELECT p_partkey AS item, string_split(p_name, ' ')[1] AS look FROM part) l
      LEFT JOIN (SELECT * FROM (SELECT CASE WHEN m % 2 = 0 THEN 'road.' || look ELSE look END AS name, m AS class FROM (SELECT string_split(p_name, ' ')[1] AS look, min(p_size) AS m FROM part GROUP BY 1)) WHERE class < 40) a ON a.name = 'road.' || l.look
      LEFT JOIN (SELECT * FROM (SELECT CASE WHEN m % 2 = 0 THEN 'road.' || look ELSE look END AS name, m AS class FROM (SELECT string_split(p_name, ' ')[1] AS look, min(p_size) AS m FROM part GROUP BY 1)) WHERE class < 40) b ON b.name = l.look""",
    "j05_limits": """SELECT c_custkey, CAST(coalesce(l.lim, -1) AS INTEGER) AS "limit" FROM customer LEFT JOIN (SELECT n_nationkey AS country, k AS class, 30 + 10 * ((n_nationkey + k) % 9) AS lim FROM nation, (VALUES (0), (1), (2), (3)) v(k)) l
      ON l.country = c_nationkey AND l.class = c_custkey % 6""",
    "j10_control_nodes": """SELECT s_suppkey, control, s_suppkey * 10 + ((control - s_suppkey % 7) % n + n) % n AS node FROM (SELECT s_suppkey, s_nationkey % 5 + 2 AS n FROM supplier), (VALUES (0), (1), (2), (3)) v(control)""",
    "j18_limit_at_endpoint": """SELECT seq, speed_limit FROM (SELECT f.seq, e.speed_limit, e.edge_id, sqrt((f.x - x1) * (f.x - x1) + (f.z - z1) * (f.z - z1)) AS d FROM f_frame f JOIN f_edge e ON abs(f.x - x1) < 30 AND abs(f.z - z1) < 30 AND speed_limit >= 0)
      WHERE d < 30 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY round(d, 9), edge_id) = 1""",
    "a06_diagnostics": "SELECT CAST(count_if(kind = 0) AS BIGINT) AS roads, CAST(count_if(kind = 1) AS BIGINT) AS movements, CAST(count_if(kind = 2) AS BIGINT) AS ferries, count(DISTINCT semaphore_id) AS semaphores, CAST(count_if(flags > 0) AS BIGINT) AS flagged FROM f_edge",
    "a16_sectors": "SELECT CAST(floor(x / 1000) AS BIGINT) AS sx, CAST(floor(z / 1000) AS BIGINT) AS sz, count(*) AS nodes, round(avg(y), 6) AS mean_y FROM f_node GROUP BY 1, 2",
    "a18_poi_by_type": "SELECT kind, count(*) AS n, CAST(count_if(access_uid % 5 = 0) AS BIGINT) AS without_access FROM f_poi GROUP BY 1",
    "a20_reach_scope": """SELECT poi_id, CAST(sum(nodes) AS BIGINT) AS nodes, sum(nodes) < 8 AS broken FROM (
      SELECT poi_id, unnest([src, dst]) AS source FROM f_poi JOIN (SELECT src, arg_min(dst, edge_id) AS dst FROM f_edge WHERE road_class <> 2 GROUP BY 1) ON access_uid = src WHERE kind = 'City') q
      JOIN (SELECT source, count(DISTINCT uid) AS nodes FROM (WITH RECURSIVE r(source, uid, hops) AS (SELECT uid, uid, 0 FROM f_node
        UNION SELECT r.source, e.dst, r.hops + 1 FROM r JOIN f_edge e ON e.src = r.uid WHERE r.hops < 3 AND e.road_class <> 2) SELECT * FROM r) GROUP BY 1) USING (source) GROUP BY 1""",
    "a28_connectivity": """SELECT components, largest, no_way_out, no_way_in, dead_ends FROM (SELECT count(*) AS components, max(nodes) AS largest FROM (SELECT component, count(*) AS nodes FROM f_component GROUP BY 1)),
      (SELECT CAST(count_if(o = 0) AS BIGINT) AS no_way_out, CAST(count_if(i = 0) AS BIGINT) AS no_way_in, CAST(count_if(o + i = 1) AS BIGINT) AS dead_ends FROM (SELECT uid, sum(o) AS o, sum(i) AS i FROM (SELECT src AS uid, 1 AS o, 0 AS i FROM f_half UNION ALL SELECT dst, 0, 1 FROM f_half) GROUP BY 1))""",
    "a34_extrapolation_error": "SELECT junction_id, max(least(off, 7000 - off)) AS max_error_ms FROM (SELECT junction_id, (wall_ms - min(wall_ms) OVER (PARTITION BY junction_id)) % 7000 AS off FROM f_signal) GROUP BY 1",
    "f40_parallel_arrays": """SELECT n_nationkey, k AS lane, CASE WHEN k < n_nationkey % 4 + 1 THEN (k + 1) * 10 ELSE 0 END AS "limit", CASE WHEN k < n_nationkey % 3 + 1 THEN (k + 1) * 7 ELSE 0 END AS urban
      FROM nation, (VALUES (0), (1), (2), (3)) v(k) WHERE k < greatest(n_nationkey % 4 + 1, n_nationkey % 3 + 1)""",
    "f42_last_wins": "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS loaded FROM events GROUP BY 1, 2",
    "g21_nearest_node": """SELECT city_id, uid FROM f_city, f_node WHERE (x - cx) * (x - cx) + (z - cz) * (z - cz) <= 2048.0e0 * 2048 QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY (x - cx) * (x - cx) + (z - cz) * (z - cz), uid) = 1""",
    "k06_inverted_index": "SELECT word, poi_id // 1000 AS block, count(*) AS places, string_agg(CAST(poi_id AS VARCHAR), ',' ORDER BY poi_id) AS postings FROM (SELECT poi_id, unnest(string_split(lower(name), '_')) AS word FROM f_poi) GROUP BY 1, 2",
    "k13_snapshots": """SELECT seq, '{"vehicle":' || vehicle || ',"seq":' || seq || ',"paused":' || CASE WHEN paused THEN 'true' ELSE 'false' END || ',"job_dest":' || coalesce(CAST(job_dest AS VARCHAR), 'null') || '}' AS snapshot FROM f_frame""",
    "w18_next_controlled": f"SELECT route_id, idx, min(CASE WHEN kind = 1 THEN idx END) OVER ({_ROUTE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_junction FROM f_route",
    "a22_movement_clusters": "SELECT s_suppkey AS junction_id, CAST(CASE WHEN s_suppkey % 4 = 1 THEN 2 ELSE 1 END AS BIGINT) AS clusters FROM supplier",
    "g13_roundabouts": """SELECT s_suppkey AS junction_id, ok AS is_roundabout, CASE WHEN ok THEN range(s_suppkey % 5 + 3) ELSE CAST([] AS BIGINT[]) END AS ring FROM (SELECT *, s_suppkey % 3 <> 0 AND s_suppkey % 7 * 25 + 10 <= 120 AS ok FROM supplier)""",
    "k02_movements_without_loops": "SELECT s_suppkey AS junction_id, (s_suppkey % 5 + 3) * CASE WHEN s_suppkey % 3 <> 0 THEN 3 ELSE 1 END + CASE WHEN s_suppkey % 4 = 1 THEN 1 ELSE 0 END AS movements FROM supplier",
    "j16_turn_lookup": """SELECT edge_id, t.turn FROM (SELECT edge_id, src, CASE WHEN edge_id % 3 > 0 THEN edge_id % 4 ELSE 0 END AS m FROM f_edge WHERE kind = 1) e
      LEFT JOIN (SELECT uid, k, (uid + k) % 4 - 1 AS turn FROM f_node, (VALUES (0), (1), (2)) v(k) WHERE uid % 2 = 0) t ON t.uid = e.src AND t.k = e.m""",
    "j08_port_pairs": """SELECT id, min_by(l, pos) AS port_a, min_by(r, pos) AS port_b FROM (SELECT id, pos, substr(name, 1, pos - 1) AS l, substr(name, pos + 1) AS r FROM (
      SELECT id, name, unnest(range(1, length(name) + 1)) AS pos FROM (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'p.' ELSE 'p' END || c_nationkey || '.' || CASE WHEN c_custkey % 30 % 3 = 0 THEN 'p.' ELSE 'p' END || c_custkey % 30 AS name FROM customer)) WHERE substr(name, pos, 1) = '.')
      WHERE l IN (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'p.' ELSE 'p' END || n_nationkey FROM nation) AND r IN (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'p.' ELSE 'p' END || n_nationkey FROM nation) GROUP BY id""",
    "j09_terminal_pairs": """SELECT s_suppkey, CASE WHEN w = 0 THEN a ELSE b END AS src, CASE WHEN w = 0 THEN b ELSE a END AS dst FROM (SELECT s_suppkey, s_suppkey * 10 + i AS a, s_suppkey * 10 + j + 1 AS b FROM supplier, (VALUES (0), (1), (2)) x(i), (VALUES (0), (1)) y(j)
      WHERE i <= s_nationkey % 3 AND j <= s_suppkey % 2), (VALUES (0), (1)) z(w) WHERE a <> b AND (w = 0 OR s_suppkey % 2 = 0)""",
    "a30_access_coverage": """SELECT kind, count(*) AS n, count(t.uid) AS covered, round(count(t.uid) / count(*), 6) AS share FROM f_poi LEFT JOIN (SELECT src AS uid FROM f_half UNION SELECT dst FROM f_half) t ON t.uid = access_uid
      WHERE kind IN ('Company', 'Fuel', 'Garage', 'Repair') GROUP BY 1""",
    "f04_turn_angle": """SELECT from_edge, to_edge, round(least(t, 2 * pi() - t), 6) AS angle FROM (SELECT a.edge_id AS from_edge, b.edge_id AS to_edge, abs(atan2(b.z2 - b.z1, b.x2 - b.x1) - atan2(a.z2 - a.z1, a.x2 - a.x1)) AS t
      FROM f_edge a JOIN f_edge b ON b.src = a.dst AND b.dst <> a.src WHERE a.road_class = 1 AND b.road_class = 1)""",
    "f10_yaw": "SELECT slot, round(atan2(2 * c * s, 1 - 2 * s * s), 6) AS yaw FROM (SELECT slot, sin((slot % 12 * 0.5e0 - 3.0e0) / 2) AS s, cos((slot % 12 * 0.5e0 - 3.0e0) / 2) AS c FROM f_light)",
    "f23_phase_extrapolation": "SELECT event_id, (sim_us - min(sim_us) OVER (PARTITION BY junction_id)) % 40000000 AS phase_us FROM f_signal",
    "w12_interval_stats": f"""SELECT kind, next_kind, n, s[n // 2 + 1] AS median, s[n] AS largest FROM (SELECT kind, next_kind, count(*) AS n, list_sort(list(interval_ms)) AS s FROM (
      SELECT kind, lead(kind) OVER ({_WALL}) AS next_kind, lead(wall_ms) OVER ({_WALL}) - wall_ms AS interval_ms FROM f_signal WHERE kind NOT IN ('RST', 'PROF')) WHERE next_kind IS NOT NULL GROUP BY 1, 2)""",
    "p13_poi_mapping": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Fuel' WHEN 1 THEN 'Repair' WHEN 2 THEN 'Company' WHEN 4 THEN 'Rest' END AS kind FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 4)",
    "a33_regression_tallies": """SELECT kind, count(*) AS n, count(m.component) AS in_main FROM f_poi LEFT JOIN f_component c ON c.uid = access_uid
      LEFT JOIN (SELECT component FROM f_component GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) m ON m.component = c.component GROUP BY 1""",
    "a21_transit_bridges": """SELECT DISTINCT a, b FROM f_ways w WHERE NOT EXISTS (SELECT 1 FROM (WITH RECURSIVE r(p, q, node) AS (SELECT p, q, a FROM f_ways
        UNION SELECT r.p, r.q, CASE WHEN w.a = r.node THEN w.b ELSE w.a END FROM r JOIN f_ways w ON r.node IN (w.a, w.b) WHERE NOT (w.p = r.p AND w.q = r.q)) SELECT * FROM r) r WHERE r.p = w.p AND r.q = w.q AND r.node = w.b) AND a <> b""",
    "p02_road_class": "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN 3 WHEN contains(lower(p_type), 'standard') THEN 2 WHEN contains(lower(p_type), 'economy') THEN 1 ELSE 0 END AS road_class FROM part",
}


def _pattern_sql() -> str:
    from ..operators.stats import PATTERNS

    rows = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS \"class\", CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS hits FROM documents WHERE text IS NOT NULL" for name, p in PATTERNS.items())
    return f"SELECT * FROM ({rows}) WHERE hits > 0"


_SQL["x03_map_match"] = """SELECT * FROM (WITH RECURSIVE seen AS (SELECT vehicle, seq, x, z, row_number() OVER (PARTITION BY vehicle ORDER BY sim_us, seq) AS n FROM f_strayed),
near AS (SELECT s.vehicle, s.n, edge_id, src, dst, lat, sqrt(box2) AS box,
    0.5e0 * least(greatest(1 - lat / 20, 0), 1) + 0.3e0 * least(greatest(1 - abs(least(d, pi() - d)) / (pi() / 2), 0), 1) AS alone FROM (
  SELECT *, CASE WHEN d0 < -pi() THEN d0 + 2 * pi() ELSE d0 END AS d FROM (
  SELECT *, ((seq % 7 * 0.5e0 - 1.5e0) - atan2(z2 - z1, x2 - x1) + pi()) % (2 * pi()) - pi() AS d0 FROM f_strayednear WHERE kind IN (0, 1) AND box2 <= 60 * 60 AND lat <= 60)) p JOIN seen s USING (seq)),
m(vehicle, n, seq, src, dst, lost, best) AS (
  SELECT DISTINCT vehicle, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::STRUCT(r DOUBLE, e BIGINT, s DOUBLE, l DOUBLE, a BIGINT, b BIGINT) FROM seen
  UNION ALL
  SELECT vehicle, n, seq, CASE WHEN best IS NOT NULL THEN best.a WHEN lost < 30 THEN src END, CASE WHEN best IS NOT NULL THEN best.b WHEN lost < 30 THEN dst END, CASE WHEN best IS NULL THEN lost + 1 ELSE 0 END, best FROM (
    SELECT vehicle, n, seq, src, dst, lost, min(CASE WHEN e IS NOT NULL THEN {'r': -round(score, 9), 'e': e, 's': score, 'l': lat, 'a': a, 'b': b} END) AS best FROM (
      SELECT m.vehicle, s.n, s.seq, m.src, m.dst, m.lost, c.edge_id AS e, c.lat, c.src AS a, c.dst AS b,
        c.alone + 0.2e0 * CASE WHEN m.src IS NULL THEN 0.5e0 WHEN m.dst = c.src THEN 1 WHEN m.dst = c.dst OR m.src = c.src THEN 0.3e0 ELSE 0 END AS score
      FROM m JOIN seen s ON s.vehicle = m.vehicle AND s.n = m.n + 1 LEFT JOIN near c ON c.vehicle = s.vehicle AND c.n = s.n AND c.box <= CASE WHEN m.src IS NULL THEN 300 ELSE 60 END)
    GROUP BY 1, 2, 3, 4, 5, 6))
SELECT vehicle, seq, best.e AS edge_id, round(best.l, 6) AS "lateral", round(best.s, 6) AS score, CASE WHEN best IS NULL THEN 'UNMATCHED' WHEN best.l < 8 THEN 'HIGH' WHEN best.l < 20 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m WHERE n > 0)"""
_SQL["x02_event_fold"] = _SQL["w11_trace_events"]

def _verdict_sql() -> str:
    from ..operators.stats import PATTERNS

    one = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS class, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS found FROM documents WHERE text IS NOT NULL" for name, p in PATTERNS.items())
    return f"""WITH m AS ({one}) SELECT doc_id, class, found, EXISTS (SELECT 1 FROM m a WHERE a.doc_id % 3 = 0 AND a.class = m.class AND a.found = m.found) AS allowed FROM m"""


ORACLES: dict[str, str] = {name: with_tables(sql) for name, sql in _SQL.items()} | {"a36_pattern_scan": _pattern_sql(), "a36_allow_list": _verdict_sql()}
