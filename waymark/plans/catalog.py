"""Named queries over the derived road tables; their SQL twins are in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cost, driving, geometry, tiles
from ..operators.graph import checkpoint
from ..operators import events, graph, junctions, places, quality, routes, spatial, stats
from ..sources import roads
from ..streaming import vehicle
from . import building, completeness, export, guidance, network, oracle, routing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = network.QUERIES | routing.QUERIES | guidance.QUERIES | building.QUERIES | completeness.QUERIES | export.QUERIES
ORACLES: dict[str, str] = oracle.ORACLES | {name: oracle.with_tables(sql) for name, sql in (network.SQL | routing.SQL | guidance.SQL | building.SQL | completeness.SQL).items()} | export.SQL

C = F.col


def query(f):
    QUERIES[f.__name__] = f
    return f


def route_time():
    return cost.time_s(C("kind"), C("speed_limit"), F.lit(-1), C("length_m"))


@query
def a07_time_distance_by_kind(spark, d):
    unknown = (C("kind") == 0) & (C("speed_limit") < 0)
    return roads.timed_edge(spark, d).groupBy("kind").agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 6).alias("distance_m"), F.round(F.sum("time_s"), 6).alias("time_s"), F.round(F.sum(F.when(unknown, C("length_m")).otherwise(0.0)), 6).alias("unknown_speed_m"))


@query
def p16_cost_by_profile(spark, d):
    return roads.timed_edge(spark, d).select("edge_id", *[F.round(p, 6).alias(p) for p in ("fastest", "shortest", "balanced")])


@query
def p01_flag_predicates(spark, d):
    return roads.edge(spark, d).select("edge_id", cost.has_flag(C("flags"), cost.NO_AI).alias("no_ai"), cost.has_flag(C("flags"), cost.GPS_AVOID).alias("gps_avoid"), cost.has_flag(C("flags"), cost.SECRET).alias("secret"))


@query
def a01_graph_stats(spark, d):
    e = roads.edge(spark, d)
    counts = e.agg(F.count("*").alias("edges"), *[F.count_if(C("kind") == k).alias(f"kind_{k}") for k in range(3)], F.count_if((C("kind") == 0) & (C("speed_limit") < 0)).alias("unknown_speed"))
    return counts.join(F.broadcast(graph.active_nodes(e).agg(F.count("*").alias("active_nodes"))))


@query
def a02_degree(spark, d):
    return graph.degrees(roads.edge(spark, d))


@query
def a17_distributions(spark, d):
    return roads.edge(spark, d).groupBy("kind", "speed_limit", "road_class").agg(F.count("*").alias("n"))


@query
def p08_active_nodes(spark, d):
    return graph.active_nodes(roads.edge(spark, d).where("road_class = 1"))


@query
def u05_edges_by_kind_union(spark, d):
    e = roads.edge(spark, d).select("edge_id", "kind")
    return e.where("kind = 0").unionByName(e.where("kind = 1")).unionByName(e.where("kind = 2"))


@query
def j01_road_endpoints(spark, d):
    n = roads.node(spark, d).select("uid", "y")
    e = roads.edge(spark, d).where("kind = 0")
    a, b = n.select(C("uid").alias("src"), C("y").alias("y_src")), n.select(C("uid").alias("dst"), C("y").alias("y_dst"))
    return e.join(a, "src").join(b, "dst").select("edge_id", F.round(C("y_dst") - C("y_src"), 6).alias("climb"))


@query
def j13_radius_edges(spark, d):
    return spatial.radius_join(roads.frame(spark, d), roads.edge(spark, d), 100.0, "seq").select("seq", "edge_id")


@query
def f02_project_points(spark, d):
    pairs = spatial.with_projection(spatial.radius_join(roads.frame(spark, d), roads.edge(spark, d).where("kind = 0"), 50.0, "seq"))
    return pairs.select("seq", "edge_id", F.round("lateral", 6).alias("lateral"), F.round("offset", 6).alias("offset"))


@query
def j14_nearest_edge(spark, d):
    near = spatial.nearest_edge(roads.frame(spark, d), roads.edge(spark, d), 200.0, "seq")
    return near.select("seq", "edge_id", F.round("lateral", 6).alias("lateral"), F.round("offset", 6).alias("offset"))


@query
def j15_topk_candidates(spark, d):
    frames = roads.frame(spark, d).withColumn("heading", F.pmod(C("seq"), F.lit(7)) * 0.5 - 1.5)
    return spatial.candidates(frames, roads.edge(spark, d), 300.0, "seq").select("seq", "rank", "edge_id", F.round("score", 6).alias("score"))


@query
def a10_match_confidence(spark, d):
    near = spatial.nearest_edge(roads.strayed_frame(spark, d), roads.edge(spark, d), 60.0, "seq")
    rows = roads.frame(spark, d).select("seq").join(near.select("seq", "lateral"), "seq", "left")
    confidence = F.when(C("lateral") < 8, "HIGH").when(C("lateral") < 20, "MEDIUM").when(C("lateral").isNotNull(), "LOW").otherwise("UNMATCHED")
    return rows.groupBy(confidence.alias("confidence")).agg(F.count("*").alias("n"), F.round(F.avg("lateral"), 6).alias("mean_lateral"))


@query
def a11_most_matched_edges(spark, d):
    near = spatial.nearest_edge(roads.frame(spark, d), roads.edge(spark, d), 60.0, "seq")
    return near.groupBy("edge_id").agg(F.count("*").alias("frames")).orderBy(F.desc("frames"), "edge_id").limit(5)


@query
def j04_country_of_node(spark, d):
    return places.countries(roads.node(spark, d), roads.city(spark, d))


@query
def j12_poi_access(spark, d):
    n = roads.node(spark, d).select(C("uid").alias("access_uid"), "x", "z")
    return roads.poi(spark, d).join(n, "access_uid", "left").select("poi_id", "kind", "x", "z")


@query
def j23_near_company(spark, d):
    n = roads.node(spark, d)
    company = roads.poi(spark, d).where("kind = 'Company'").join(n.select(C("uid").alias("access_uid"), "x", "z"), "access_uid")
    return places.near_places(n.select("uid", "x", "z"), company, 150.0).select("uid")


@query
def j17_signal_link(spark, d):
    moves = roads.edge(spark, d).where("kind = 1").select("edge_id", "semaphore_id", C("x1").alias("x"), C("z1").alias("z"), geometry.bearing(C("x1"), C("z1"), C("x2"), C("z2")).alias("heading"))
    lights = roads.light(spark, d).withColumn("yaw", C("slot") % 4 * 0.4)
    return places.link_signals(moves, lights).select("edge_id", "light_id", F.round("score", 6).alias("score"), "confidence")


@query
def j19_nearest_events(spark, d):
    e = roads.signal_event(spark, d)
    return events.nearest_events(e.where("kind = 'OTHER'"), e.where("kind in ('R2G', 'G2R')"), 2)


@query
def j20_next_events(spark, d):
    e = roads.signal_event(spark, d)
    return events.next_events(e.where("kind = 'RST'"), e.where("kind in ('R2G', 'G2R')"), 3)


@query
def j21_nearest_reset(spark, d):
    e = roads.signal_event(spark, d)
    return events.nearest_events(e.where("kind = 'PROF'"), e.where("kind = 'RST'"), 1)


@query
def j22_interval_avg(spark, d):
    return events.interval_averages(roads.signal_event(spark, d).withColumn("v", (C("event_id") % 97).cast("double")), "v", 30_000)


@query
def j24_isolated_transit(spark, d):
    return quality.isolated_transit(roads.edge(spark, d).where("road_class < 3"))


@query
def j32_dump_diff(spark, d):
    e = roads.edge(spark, d)
    return quality.differences(e.where("road_class <> 2").select("src", "dst"), e.where("road_class <> 3").select("src", "dst"))


@query
def v02_broken_refs(spark, d):
    return quality.broken_references(roads.edge(spark, d), roads.node(spark, d).where("uid % 17 <> 0"))


@query
def v06_geometry_issues(spark, d):
    r = roads.route_edge(spark, d).withColumn("m", F.when(C("idx") % 7 == 6, F.lit(float("nan"))).when(C("idx") % 5 == 4, 0.0).otherwise(C("length_m") * 3))
    return quality.geometry_issues(r, "edge_ref", "m")


@query
def a27_duplicates(spark, d):
    r = roads.route_edge(spark, d)
    return quality.issues(quality.repeats(r, ["route_id", "edge_ref"], ["idx"]), "STRUCT_DUP_EDGE", "Warning", "route_id")


@query
def a29_oneway_deadends(spark, d):
    return quality.dead_ends(roads.edge(spark, d).where("road_class in (0, 1)"), roads.node(spark, d))


@query
def a26_severity_counts(spark, d):
    e, n = roads.edge(spark, d), roads.node(spark, d).where("uid % 17 <> 0")
    half = e.where("road_class in (0, 1)")
    return quality.severity_counts(quality.together(quality.broken_references(e, n), quality.self_loops(e), quality.duplicate_edges(e.select("edge_id", (C("src") / 10).cast("long").alias("src"), (C("dst") / 10).cast("long").alias("dst"))), quality.dead_ends(half, n)))


@query
def w01_suffix_remaining(spark, d):
    return routes.remaining(roads.route_edge(spark, d), route_time())


@query
def w02_speed_breaks(spark, d):
    return routes.speed_breaks(roads.route_edge(spark, d), 3000.0)


@query
def w05_next_change(spark, d):
    return routes.next_change(roads.route_edge(spark, d))


@query
def w06_change_beyond(spark, d):
    return routes.change_beyond(roads.route_edge(spark, d), 500.0)


@query
def w07_legs(spark, d):
    return routes.legs(roads.route_edge(spark, d))


@query
def a07_route_metrics(spark, d):
    return routes.metrics(roads.route_edge(spark, d), route_time())


def _route_pairs(spark, d):
    r = roads.route_edge(spark, d).select("route_id").distinct()
    return r.select(C("route_id").alias("a"), (C("route_id") + 1).alias("b")).join(r.select(C("route_id").alias("b")), "b")


@query
def a09_route_overlap(spark, d):
    return routes.overlap(roads.route_edge(spark, d).withColumn("edge_ref", C("edge_ref") % 40), _route_pairs(spark, d))


@query
def u03_shared_edges(spark, d):
    r = roads.route_edge(spark, d).groupBy("route_id").agg(F.collect_set(C("edge_ref") % 40).alias("e"))
    pairs = r.select(C("route_id").alias("a"), C("e").alias("ea")).join(r.select((C("route_id") - 1).alias("a"), C("e").alias("eb")), "a")
    return pairs.select("a", F.size(F.array_intersect("ea", "eb")).cast("long").alias("shared"))


@query
def w11_trace_events(spark, d):
    return events.frame_events(roads.frame(spark, d))


@query
def w12_phase_intervals(spark, d):
    return events.phase_intervals(roads.signal_event(spark, d))


@query
def w13_same_kind_intervals(spark, d):
    return events.same_kind_intervals(roads.signal_event(spark, d))


@query
def w14_warps(spark, d):
    e = roads.signal_event(spark, d).withColumns({"wall_ms": C("wall_ms") - 4000 * (C("event_id") % 3).cast("long"), "sim_us": C("sim_us") + 400_000 * (C("event_id") % 5)})
    return events.warps(e)


@query
def w15_resets(spark, d):
    return events.resets(roads.signal_event(spark, d).withColumn("sim_us", C("sim_us") % 200_000_000))


@query
def w16_load_windows(spark, d):
    return events.load_windows(roads.signal_event(spark, d))


@query
def w20_low_speed_streaks(spark, d):
    return events.streaks(roads.frame(spark, d), C("speed_ms") < 3)


@query
def w21_offroute_state(spark, d):
    return events.off_route(roads.frame(spark, d), C("speed_ms") < 8)


@query
def p22_speed_compare(spark, d):
    f = roads.frame(spark, d).withColumn("map_kmh", F.when(C("seq") % 6 == 5, -1).otherwise(10 * (C("seq") % 9)).cast("int"))
    diff = driving.speed_difference(C("map_kmh"), C("limit_ms"))
    return f.select("seq", diff.alias("diff_kmh"), (F.abs(diff) > 5).alias("mismatch"))


@query
def p23_overspeed(spark, d):
    return roads.frame(spark, d).select("seq", driving.overspeeding(C("speed_ms") * 3, C("limit_ms") * 3.6).alias("over"))


def _approach(spark, d):
    """Frames with a light ahead of them."""
    lights = roads.light(spark, d).select(C("slot").alias("s"), "state", "time_remaining")
    f = roads.frame(spark, d)
    n = roads.table(spark, d, "supplier").agg(F.count("*").alias("n"))
    return f.join(F.broadcast(n)).withColumn("s", C("seq") % C("n")).join(lights, "s").withColumns({"ahead_m": (C("seq") % 240).cast("double"), "verified": C("seq") % 4 != 0})


@query
def p24_red_light(spark, d):
    return _approach(spark, d).select("seq", driving.red_light_warning(C("state"), C("ahead_m"), C("speed_ms")).alias("warn"), driving.green_imminent(C("state"), C("verified"), C("speed_ms"), C("time_remaining") / 5).alias("imminent"))


@query
def p26_glosa(spark, d):
    return _approach(spark, d).select("seq", driving.glosa(C("ahead_m"), C("state"), C("verified"), C("time_remaining"), C("speed_ms"), (C("limit_ms") * 3.6).cast("int")).alias("g")).select("seq", "g.*")


@query
def p27_speak_distance(spark, d):
    return roads.frame(spark, d).select("seq", driving.speech_lead(C("speed_ms") * 3.6, C("seq") % 4, C("seq") % 5).alias("lead_m"))


@query
def f36_speech_text(spark, d):
    return roads.frame(spark, d).select("seq", driving.spoken_limit((C("seq") % 30 * 50).cast("int"), (C("seq") % 4 * 30 - 30).cast("int")).alias("said"))


@query
def f05_signed_angle(spark, d):
    f = roads.frame(spark, d).select("seq", (C("seq") % 13 * 0.5 - 3.0).alias("a"), (C("seq") % 11 * 0.6 - 3.0).alias("b"))
    angle = geometry.signed_angle(C("a"), C("b"))
    return f.select("seq", F.round(angle, 6).alias("angle"), geometry.turn_of_angle(angle).alias("turn"))


@query
def a12_latency_quantiles(spark, d):
    return stats.order_statistics(roads.table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query
def a13_upper_median(spark, d):
    return stats.order_statistics(roads.route_edge(spark, d), ["route_id"], "length_m", {"median": 0.5}).select("route_id", "n", "median")


@query
def a14_frame_stats(spark, d):
    return stats.frame_rate(roads.table(spark, d, "events"), "user_id", "value")


@query
def a15_agreement(spark, d):
    return stats.agreement(roads.frame(spark, d), "vehicle", C("limit_ms") * 3.6, C("speed_ms") * 3.6)


@query
def a03_components(spark, d):
    return graph.components(roads.edge(spark, d).where("road_class in (0, 1)"))


@query
def a04_component_sizes(spark, d):
    sizes = graph.component_sizes(graph.components(roads.edge(spark, d).where("road_class in (0, 1)")))
    return sizes.groupBy(graph.size_bucket(C("nodes")).alias("bucket")).agg(F.count("*").alias("components"), F.sum("nodes").alias("nodes"))


@query
def a05_component_bbox(spark, d):
    labels = graph.components(roads.edge(spark, d).where("road_class in (0, 1)"))
    rows = labels.join(roads.node(spark, d), "uid").groupBy("component").agg(F.count("*").alias("nodes"), *[f(c).alias(f"{n}_{c}") for c in ("x", "z") for n, f in (("min", F.min), ("max", F.max))])
    return rows.orderBy(F.desc("nodes"), "component").limit(30)


def _sources(spark, d):
    """One node of each region."""
    n = roads.table(spark, d, "part").agg(F.count("*").alias("n"))
    return roads.table(spark, d, "region").join(F.broadcast(n)).select((C("r_regionkey") * F.floor(C("n") / 5)).alias("uid")).distinct()


def _stops(spark, d):
    """The access nodes of all cities and companies."""
    p = roads.poi(spark, d).where("kind in ('City', 'Company')").select(C("access_uid").alias("uid")).distinct()
    return p.join(roads.node(spark, d).select("uid"), "uid", "left_semi")


@query
def g08_reachable(spark, d):
    return graph.reachable(roads.edge(spark, d).where("road_class in (0, 1)"), _sources(spark, d)).select("source", "uid")


@query
def g09_khop(spark, d):
    return graph.reachable(roads.edge(spark, d), _stops(spark, d), 3)


@query
def t04_poi_search(spark, d):
    return places.search(roads.poi(spark, d), "Build").select("poi_id", "name")


@query
def d01_resolve_name(spark, d):
    p = roads.poi(spark, d).where("kind in ('City', 'Company')")
    asked = roads.table(spark, d, "nation").select(F.concat(F.lit("Building_"), C("n_nationkey")).alias("request")).union(roads.table(spark, d, "region").select(F.lower("r_name")))
    return places.resolve_names(asked, p)


@query
def f16_tile_xy(spark, d):
    x, y = tiles.tile_xy(C("x"), C("z"), 11)
    return roads.node(spark, d).select("uid", x.alias("tile_x"), y.alias("tile_y"))


@query
def f17_tile_id(spark, d):
    x, y = tiles.tile_xy(C("x") * 40, C("z") * 40, 11)
    return roads.node(spark, d).select("uid", tiles.tile_id(F.lit(11), x, y).alias("tile_id"))


@query
def a35_charset(spark, d):
    return stats.characters(roads.table(spark, d, "documents"), "text", "lang")


@query
def a36_pattern_scan(spark, d):
    return stats.pattern_scan(roads.table(spark, d, "documents"), "doc_id", "text")


@query
def f30_hex_uid(spark, d):
    return roads.node(spark, d).select("uid", F.lpad(F.lower(F.hex("uid")), 16, "0").alias("hex"))


@query
def a31_fingerprint(spark, d):
    """A digest of each source's documents, in order of id, by blocks of 1000 ids."""
    t = roads.table(spark, d, "documents")
    line = F.concat(F.lit("|"), C("doc_id"), F.lit(":"), C("n_chars"))
    rows = t.groupBy("source", F.floor(C("doc_id") / 1000).alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("a"))
    return rows.select("source", "block", F.sha2(F.array_join(F.transform("a", lambda s: s["l"]), ""), 256).alias("fingerprint"))


@query
def s15_overlay(spark, d):
    """Of names that several sources give, the one of highest priority."""
    rows = roads.table(spark, d, "part").select(C("p_name").alias("path"), C("p_size").alias("priority"), C("p_partkey").alias("item"))
    return rows.groupBy("path").agg(F.max_by("item", F.struct("priority", (-C("item")).alias("o"))).alias("item"), F.max("priority").alias("priority"))


@query
def x03_map_match(spark, d):
    """Frames of each vehicle matched to edges one after the other."""
    frames = roads.strayed_frame(spark, d).withColumn("heading", F.pmod(C("seq"), F.lit(7)) * 0.5 - 1.5)
    return vehicle.match(frames, roads.edge(spark, d)).select("vehicle", "seq", "edge_id", F.round("lateral", 6).alias("lateral"), F.round("score", 6).alias("score"), "confidence")


@query
def x02_event_fold(spark, d):
    """The events of w11 in order of arrival; streams tell the same by a fold (tests)."""
    return events.frame_events(roads.frame(spark, d))


@query
def w17_reminder_gate(spark, d):
    """Overspeed reminders, one in half a second of simulated time at most."""
    rows = roads.frame(spark, d).select("vehicle", "seq", C("sim_us") * 60, F.lit("OverSpeed").alias("kind"), "speed_ms").toDF("vehicle", "seq", "sim_us", "kind", "speed_ms").where("speed_ms > 4")
    return vehicle.gate(rows.drop("speed_ms"))


@query
def j02_lane_class_fallback(spark, d):
    """A look's class by its prefixed name, else by its plain name."""
    looks = roads.table(spark, d, "part").select(C("p_partkey").alias("item"), F.split("p_name", " ")[0].alias("look"), C("p_size"))
    named = looks.groupBy("look").agg(F.min("p_size").alias("m"))
    classes = named.select(F.when(C("m") % 2 == 0, F.concat(F.lit("road."), C("look"))).otherwise(C("look")).alias("name"), C("m").alias("class")).where("class < 40")
    a, b = classes.select(F.expr("name").alias("full"), C("class").alias("c1")), classes.select(C("name").alias("look"), C("class").alias("c2"))
    rows = looks.withColumn("full", F.concat(F.lit("road."), C("look"))).join(a, "full", "left").join(b, "look", "left")
    return rows.select("item", F.coalesce("c1", "c2").alias("class"))


@query
def j05_limits(spark, d):
    """Limits by country and class, -1 where none is set."""
    places_of = roads.table(spark, d, "customer").select("c_custkey", C("c_nationkey").alias("country"), (C("c_custkey") % 6).cast("int").alias("class"))
    limits = roads.table(spark, d, "nation").withColumn("class", F.explode(F.array(*map(F.lit, range(4))))).select(C("n_nationkey").alias("country"), "class", (30 + 10 * ((C("n_nationkey") + C("class")) % 9)).alias("limit"))
    return places_of.join(limits, ["country", "class"], "left").select("c_custkey", F.coalesce("limit", F.lit(-1)).cast("int").alias("limit"))


@query
def j10_control_nodes(spark, d):
    """The node of each control index, counted from an origin and around."""
    items = roads.table(spark, d, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(0), C("s_nationkey") % 5 + 1), lambda i: C("s_suppkey") * 10 + i).alias("nodes"))
    origin = C("s_suppkey") % 7
    return items.withColumn("control", F.explode(F.array(*map(F.lit, range(4))))).select("s_suppkey", "control", F.element_at("nodes", (F.pmod(C("control") - origin, F.size("nodes")) + 1).cast("int")).alias("node"))


@query
def j18_limit_at_endpoint(spark, d):
    """The limit of the nearest edge start within 30 m of each frame."""
    n = roads.edge(spark, d).where("speed_limit >= 0").select("edge_id", "speed_limit", C("x1").alias("px"), C("z1").alias("pz"), spatial.cell(C("x1"), 64.0).alias("a"), spatial.cell(C("z1"), 64.0).alias("b"))
    f = roads.frame(spark, d).withColumn("a", F.explode(F.sequence(spatial.cell(C("x") - 30, 64.0), spatial.cell(C("x") + 30, 64.0)))).withColumn("b", F.explode(F.sequence(spatial.cell(C("z") - 30, 64.0), spatial.cell(C("z") + 30, 64.0))))
    dist = geometry.distance(C("x"), C("z"), C("px"), C("pz"))
    return f.join(n, ["a", "b"]).where(dist < 30).groupBy("seq").agg(F.min_by("speed_limit", F.struct(F.round(dist, 9), "edge_id")).alias("speed_limit"))


@query
def j28_issue_places(spark, d):
    """Issues with the place of their edge, where it is known."""
    e = roads.edge(spark, d)
    found = quality.broken_references(e, roads.node(spark, d).where("uid % 17 <> 0"))
    return found.join(e.where("road_class > 0").select(C("edge_id").alias("uid"), "x1", "z1"), "uid", "left").select("code", "uid", F.coalesce("x1", F.lit(-1.0)).alias("x"), F.coalesce("z1", F.lit(-1.0)).alias("z"))


@query
def a06_diagnostics(spark, d):
    e = roads.edge(spark, d)
    return e.agg(F.count_if(F.expr("kind = 0")).alias("roads"), F.count_if(F.expr("kind = 1")).alias("movements"), F.count_if(F.expr("kind = 2")).alias("ferries"), F.countDistinct("semaphore_id").alias("semaphores"), F.count_if(F.expr("flags > 0")).alias("flagged"))


@query
def a16_sectors(spark, d):
    """Nodes and their mean height by sector of 1000 m."""
    return roads.node(spark, d).groupBy(spatial.cell(C("x"), 1000.0).alias("sx"), spatial.cell(C("z"), 1000.0).alias("sz")).agg(F.count("*").alias("nodes"), F.round(F.avg("y"), 6).alias("mean_y"))


@query
def a18_poi_by_type(spark, d):
    known = roads.node(spark, d).where("uid % 5 <> 0").select(C("uid").alias("access_uid"), F.lit(True).alias("there"))
    return roads.poi(spark, d).join(known, "access_uid", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(C("there").isNull()).alias("without_access"))


@query
def a20_reach_scope(spark, d):
    """Nodes within three hops of both ends of each city's access edge, each end for itself; fewer than eight together is broken."""
    e = roads.edge(spark, d).where("road_class <> 2")
    first = e.groupBy("src").agg(F.min_by("dst", "edge_id").alias("dst"))
    ends = roads.poi(spark, d).where("kind = 'City'").join(first, C("access_uid") == C("src")).select("poi_id", F.explode(F.array("src", "dst")).alias("source"))
    n = graph.reachable(e, ends.select(C("source").alias("uid")).distinct(), 3).groupBy("source").agg(F.count("*").alias("nodes"))
    return ends.join(n, "source").groupBy("poi_id").agg(F.sum("nodes").alias("nodes")).withColumn("broken", C("nodes") < 8)


@query
def a28_connectivity(spark, d):
    e = roads.edge(spark, d).where("road_class in (0, 1)")
    sizes = graph.component_sizes(graph.components(e))
    degree = graph.degrees(e)
    one = sizes.agg(F.count("*").alias("components"), F.max("nodes").alias("largest"))
    return one.join(F.broadcast(degree.agg(F.count_if(F.expr("out_degree = 0")).alias("no_way_out"), F.count_if(F.expr("in_degree = 0")).alias("no_way_in"), F.count_if(F.expr("out_degree + in_degree = 1")).alias("dead_ends"))))


@query
def a34_extrapolation_error(spark, d):
    """How far each junction's events stray from its first event plus whole cycles."""
    e = roads.signal_event(spark, d)
    first = e.groupBy("junction_id").agg(F.min("wall_ms").alias("anchor"))
    off = F.pmod(C("wall_ms") - C("anchor"), F.lit(7000))
    return e.join(first, "junction_id").groupBy("junction_id").agg(F.max(F.least(off, 7000 - off)).alias("max_error_ms"))


@query
def f40_parallel_arrays(spark, d):
    """Parallel arrays to rows; missing entries are 0."""
    rows = roads.table(spark, d, "nation").select("n_nationkey", F.transform(F.sequence(F.lit(1), C("n_nationkey") % 4 + 1), lambda i: i * 10).alias("limit"), F.transform(F.sequence(F.lit(1), C("n_nationkey") % 3 + 1), lambda i: i * 7).alias("urban"))
    return rows.select("n_nationkey", F.posexplode(F.arrays_zip("limit", "urban")).alias("lane", "v")).select("n_nationkey", "lane", F.coalesce("v.limit", F.lit(0)).alias("limit"), F.coalesce("v.urban", F.lit(0)).alias("urban"))


@query
def f42_last_wins(spark, d):
    """Of rows with one key, the one loaded last."""
    return roads.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("loaded"))


@query
def g21_nearest_node(spark, d):
    """The nearest node to each city's centre, by cells of 2048 m around it."""
    n = roads.node(spark, d).select("uid", "x", "z", spatial.cell(C("x"), 2048.0).alias("a"), spatial.cell(C("z"), 2048.0).alias("b"))
    c = roads.city(spark, d).withColumn("a", F.explode(F.sequence(spatial.cell(C("cx"), 2048.0) - 1, spatial.cell(C("cx"), 2048.0) + 1))).withColumn("b", F.explode(F.sequence(spatial.cell(C("cz"), 2048.0) - 1, spatial.cell(C("cz"), 2048.0) + 1)))
    d2 = (C("x") - C("cx")) * (C("x") - C("cx")) + (C("z") - C("cz")) * (C("z") - C("cz"))
    return c.join(n, ["a", "b"]).where(d2 <= 2048.0 * 2048.0).groupBy("city_id").agg(F.min_by("uid", F.struct(d2.alias("d"), "uid")).alias("uid"))


@query
def k06_inverted_index(spark, d):
    """Words of place names and the places that hold them, listed by blocks of 1000 ids."""
    rows = roads.poi(spark, d).select("poi_id", F.explode(F.split(F.lower("name"), "_")).alias("word"), F.floor(C("poi_id") / 1000).alias("block"))
    return rows.groupBy("word", "block").agg(F.count("*").alias("places"), F.array_join(F.sort_array(F.collect_list("poi_id")), ",").alias("postings"))


@query
def a36_allow_list(spark, d):
    """Matches of pattern classes and whether they are on a list of those allowed: those of every third document."""
    listed = stats.pattern_verdicts(roads.table(spark, d, "documents").where("doc_id % 3 = 0"), "doc_id", "text", spark.createDataFrame([], "class string, match string")).select("class", C("found").alias("match"))
    return stats.pattern_verdicts(roads.table(spark, d, "documents"), "doc_id", "text", listed)


@query
def k13_snapshots(spark, d):
    """Frames as JSON snapshots."""
    return roads.frame(spark, d).select("seq", F.to_json(F.struct("vehicle", "seq", "paused", "job_dest"), {"ignoreNullFields": "false"}).alias("snapshot"))


@query
def w18_next_controlled(spark, d):
    """The next junction edge at or after each route edge."""
    at = F.min(F.when(C("kind") == 1, C("idx"))).over(routes.ahead())
    return roads.route_edge(spark, d).select("route_id", "idx", at.alias("next_junction"))


@query
def p02_road_class(spark, d):
    """Class of a road by what its type's name holds; the higher class goes first."""
    low = F.lower("p_type")
    return roads.table(spark, d, "part").select("p_partkey", F.when(F.contains(low, F.lit("promo")), 3).when(F.contains(low, F.lit("standard")), 2).when(F.contains(low, F.lit("economy")), 1).otherwise(0).alias("road_class"))


@query
def g13_roundabouts(spark, d):
    return junctions.roundabouts(completeness.junction_movements(spark, d))


@query
def a22_movement_clusters(spark, d):
    return junctions.clusters(completeness.junction_movements(spark, d)).select("junction_id", "clusters")


@query
def k02_movements_without_loops(spark, d):
    return completeness.junction_movements(spark, d).where("entry <> exit").groupBy("junction_id").agg(F.count("*").alias("movements"))


@query
def j16_turn_lookup(spark, d):
    """Turn types of movements by junction and movement id; a missing id counts as 0, a missing turn stays null."""
    moves = roads.edge(spark, d).where("kind = 1").select("edge_id", C("src").alias("junction_id"), F.coalesce(F.when(C("edge_id") % 3 > 0, C("edge_id") % 4), F.lit(0)).alias("movement_id"))
    turns = roads.node(spark, d).where("uid % 2 = 0").withColumn("movement_id", F.explode(F.array(*map(F.lit, range(3))))).select(C("uid").alias("junction_id"), C("movement_id").cast("long").alias("movement_id"), ((C("uid") + C("movement_id")) % 4 - 1).alias("turn"))
    return moves.join(turns, ["junction_id", "movement_id"], "left").select("edge_id", "turn")


@query
def j08_port_pairs(spark, d):
    """Connection names split at the first dot where both halves are known ports."""
    ports = roads.table(spark, d, "nation").select(F.when(C("n_nationkey") % 3 == 0, F.concat(F.lit("p."), C("n_nationkey"))).otherwise(F.concat(F.lit("p"), C("n_nationkey"))).alias("port"))
    key = roads.table(spark, d, "customer").select(C("c_custkey").alias("id"), (C("c_nationkey")).alias("a"), (C("c_custkey") % 30).alias("b"))
    name = lambda n: F.when(n % 3 == 0, F.concat(F.lit("p."), n)).otherwise(F.concat(F.lit("p"), n))
    named = key.select("id", F.concat(name(C("a")), F.lit("."), name(C("b"))).alias("name"))
    cuts = named.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("name")))).where(F.expr("substr(name, pos, 1) = '.'"))
    halves = cuts.select("id", "pos", F.expr("substr(name, 1, pos - 1)").alias("left"), F.expr("substr(name, pos + 1)").alias("right"))
    known = halves.join(ports.select(C("port").alias("left")), "left", "left_semi").join(ports.select(C("port").alias("right")), "right", "left_semi")
    return known.groupBy("id").agg(F.min_by("left", "pos").alias("port_a"), F.min_by("right", "pos").alias("port_b"))


@query
def j09_terminal_pairs(spark, d):
    """Edges between the terminals of two ports, one way or both: terminals are a port's own short list."""
    t = roads.table(spark, d, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(0), C("s_nationkey") % 3), lambda i: C("s_suppkey") * 10 + i).alias("a"), F.transform(F.sequence(F.lit(0), C("s_suppkey") % 2), lambda i: C("s_suppkey") * 10 + i + 1).alias("b"))
    pairs = t.withColumn("src", F.explode("a")).withColumn("dst", F.explode("b")).where("src <> dst")
    both = pairs.where("s_suppkey % 2 = 0").select(C("s_suppkey"), C("dst").alias("src"), C("src").alias("dst"))
    return pairs.select("s_suppkey", "src", "dst").unionByName(both)


@query
def a30_access_coverage(spark, d):
    """Share of places of each kind whose access node is an active one."""
    active = graph.active_nodes(roads.edge(spark, d).where("road_class in (0, 1)")).select(C("uid").alias("access_uid"), F.lit(1).alias("there"))
    return roads.poi(spark, d).where("kind in ('Company', 'Fuel', 'Garage', 'Repair')").join(active, "access_uid", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("there").alias("covered"), F.round(F.count("there") / F.count("*"), 6).alias("share"))


@query
def f04_turn_angle(spark, d):
    """Angles at which edges follow one another, folded to 0 to pi, without turning back."""
    e = roads.edge(spark, d).where("road_class = 1").withColumn("b", geometry.bearing(C("x1"), C("z1"), C("x2"), C("z2")))
    pairs = e.select(C("edge_id").alias("from_edge"), C("src").alias("s"), C("dst").alias("via"), C("b").alias("b1")).join(e.select(C("edge_id").alias("to_edge"), C("src").alias("via"), C("dst").alias("t"), C("b").alias("b2")), "via").where("s <> t")
    turn = F.abs(C("b2") - C("b1"))
    return pairs.select("from_edge", "to_edge", F.round(F.least(turn, geometry.TAU - turn), 6).alias("angle"))


@query
def f10_yaw(spark, d):
    a = (C("slot") % 12) * 0.5 - 3.0
    rows = roads.light(spark, d).select("slot", a.alias("yaw"))
    return rows.select("slot", F.round(geometry.quaternion_yaw(F.lit(0.0), F.sin(C("yaw") / 2), F.lit(0.0), F.cos(C("yaw") / 2)), 6).alias("yaw"))


@query
def f23_phase_extrapolation(spark, d):
    """Seconds into the cycle since each junction's first event."""
    e = roads.signal_event(spark, d)
    first = F.min("sim_us").over(Window.partitionBy("junction_id"))
    return e.select("event_id", F.pmod(C("sim_us") - first, F.lit(40_000_000)).alias("phase_us"))


@query
def w12_interval_stats(spark, d):
    """Upper-median interval of each pair of phases."""
    return stats.order_statistics(events.phase_intervals(roads.signal_event(spark, d)), ["kind", "next_kind"], "interval_ms", {"median": 0.5})


@query
def p13_poi_mapping(spark, d):
    """Service numbers to kinds of place; others are dropped."""
    kind = F.when(C("s") == 0, "Fuel").when(C("s") == 1, "Repair").when(C("s") == 2, "Company").when(C("s") == 4, "Rest")
    return roads.table(spark, d, "orders").select("o_orderkey", (C("o_orderkey") % 6).alias("s")).select("o_orderkey", kind.alias("kind")).where("kind is not null")


@query
def a33_regression_tallies(spark, d):
    """Places by kind and region: reached, and by how many signals at most."""
    labels = graph.components(roads.edge(spark, d).where("road_class in (0, 1)"))
    main = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component", F.lit(1).alias("main"))
    rows = roads.poi(spark, d).join(labels, C("access_uid") == C("uid"), "left").join(F.broadcast(main), "component", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("main").alias("in_main"))


@query
def a21_transit_bridges(spark, d):
    """Ferry ways between pieces of land that alone keep them together."""
    e = roads.edge(spark, d)
    labels = checkpoint(graph.components(e.where("kind in (0, 1) and road_class = 1")))
    a, b = (labels.select(C("uid").alias(c), C("component").alias(f"{c}_c")) for c in ("src", "dst"))
    ways = e.where("kind = 2 or road_class = 3").join(a, "src", "left").join(b, "dst", "left").select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"), F.coalesce("src_c", "src").alias("x"), F.coalesce("dst_c", "dst").alias("y"))
    ways = ways.groupBy("p", "q").agg(F.min(F.least("x", "y")).alias("a"), F.max(F.greatest("x", "y")).alias("b"))
    return graph.bridges(ways.select("a", "b"))
