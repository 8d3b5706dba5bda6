"""Per-vehicle state machines as steps of a fold: events, reminders, map matching, progress along a route.

A `..._step` takes one row of one vehicle; `..._COLUMNS` is the same step for a row of each of many vehicles, by which
`gate`, `match` and `track` work.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from ..functions.geometry import bearing
from ..operators.events import RESET_US, TELEPORT_M
from ..operators.spatial import match_score, radius_join, with_projection
from .columns import ColumnStep, fold_columns

EVENT_SCHEMA = StructType().add("vehicle", LongType()).add("seq", LongType()).add("events", StringType())


def event_step(state: dict, row: dict) -> tuple[dict, dict | None]:
    """Drops frames whose sequence has not changed; names what changed from the frame before."""
    if state and row["seq"] == state["seq"]:
        return state, None
    now = {k: None if isinstance(row[k], float) and math.isnan(row[k]) else row[k] for k in ("seq", "sim_us", "x", "z", "paused", "job_dest")}
    found = []
    if state:
        found += ["SequenceRestart"] * (now["seq"] < state["seq"])
        found += ["SimTimeReset"] * (now["sim_us"] < state["sim_us"] - RESET_US)
        found += ["Teleport"] * (math.hypot(now["x"] - state["x"], now["z"] - state["z"]) > TELEPORT_M)
        found += ["PauseChanged"] * (bool(now["paused"]) != bool(state["paused"]))
        found += ["JobChanged"] * (now["job_dest"] != state["job_dest"])
    now = {k: v.item() if hasattr(v, "item") else v for k, v in now.items()}
    return now, {"vehicle": row["vehicle"], "seq": row["seq"], "events": ",".join(found)} if found else None


GATE_SCHEMA = StructType().add("vehicle", LongType()).add("seq", LongType()).add("kind", StringType()).add("allowed", BooleanType())


def gate_step(state: dict, row: dict, interval_s: float = 30.0) -> tuple[dict, dict]:
    """A reminder is allowed if the last allowed one of its kind is at least `interval_s` ago."""
    now = row["sim_us"] / 1e6
    allowed = now - state.get(row["kind"], -math.inf) >= interval_s
    if allowed:
        state = state | {row["kind"]: now}
    return state, {"vehicle": row["vehicle"], "seq": row["seq"], "kind": row["kind"], "allowed": allowed}


def gate_columns(interval_s: float = 30.0) -> ColumnStep:
    """The gate by vehicle and kind."""

    def advance(was: dict, row: dict) -> tuple[dict, dict, None]:
        now = row["sim_us"] / 1e6
        allowed = now - was["at"] >= interval_s
        return {"at": np.where(allowed, now, was["at"])}, {"allowed": allowed}, None

    def one(was: dict, row: dict) -> tuple[dict, dict]:
        now = row["sim_us"] / 1e6
        allowed = now - was["at"] >= interval_s
        return {"at": now} if allowed else was, {"allowed": allowed}

    return ColumnStep({"at": -math.inf}, ("sim_us",), ("allowed",), advance, one=one)


def gate(reminders: DataFrame, interval_s: float = 30.0) -> DataFrame:
    """Reminders (vehicle, seq, sim_us, kind) and whether each is allowed."""
    return fold_columns(reminders, ["vehicle", "kind"], ["sim_us", "seq"], gate_columns(interval_s), GATE_SCHEMA)


MATCH_SCHEMA = StructType().add("vehicle", LongType()).add("seq", LongType()).add("edge_id", LongType()).add("lateral", DoubleType()).add("score", DoubleType()).add("confidence", StringType())
FIRST_M, NEXT_M, SCALE_M, LOST_FRAMES = 300.0, 60.0, 20.0, 30


def match_step(state: dict, row: dict) -> tuple[dict, dict]:
    """Greedy matching with one frame of memory: distance and heading (`alone`) and whether the edge follows the last one."""
    last = state.get("last")
    best = None
    for c in row["candidates"] if row["candidates"] is not None else ():
        if c["box"] > (NEXT_M if last else FIRST_M) or c["lateral"] > 3 * SCALE_M:
            continue
        follows = 0.5 if not last else 1.0 if last[1] == c["src"] else 0.3 if last[1] == c["dst"] or last[0] == c["src"] else 0.0
        score = c["alone"] + 0.2 * follows
        rank = (-round(score, 9), c["edge_id"])
        if best is None or rank < best[0]:
            best = (rank, c, score)
    if best is None:
        lost = state.get("lost", 0) + 1
        return {"last": None if lost > LOST_FRAMES else last, "lost": lost}, {"vehicle": row["vehicle"], "seq": row["seq"], "confidence": "UNMATCHED"}
    _, c, score = best
    confidence = "HIGH" if c["lateral"] < 8 else "MEDIUM" if c["lateral"] < 20 else "LOW"
    return {"last": [int(c["src"]), int(c["dst"])], "lost": 0}, {"vehicle": row["vehicle"], "seq": row["seq"], "edge_id": c["edge_id"], "lateral": c["lateral"], "score": score, "confidence": confidence}


def with_candidates(frames: DataFrame, edges: DataFrame) -> DataFrame:
    """Frames (vehicle, seq, sim_us, x, z, heading) with the edges near them, and what of their score a frame alone decides.

    A stateless join, the same in batch and in a stream with a static network. Frames of a null place or vehicle have no edges.
    """
    pairs = with_projection(radius_join(frames, edges.where("kind in (0, 1)"), min(FIRST_M, 3 * SCALE_M), "seq")).where(F.col("lateral") <= 3 * SCALE_M)
    dx = F.col("x") - F.greatest(F.least("x1", "x2"), F.least(F.col("x"), F.greatest("x1", "x2")))
    dz = F.col("z") - F.greatest(F.least("z1", "z2"), F.least(F.col("z"), F.greatest("z1", "z2")))
    tangent = bearing(*(F.col(c) for c in ("x1", "z1", "x2", "z2")))
    alone = match_score(F.col("lateral"), F.col("heading"), tangent, F.lit(0.0), SCALE_M)
    one = F.struct("edge_id", "src", "dst", "lateral", F.sqrt(dx * dx + dz * dz).alias("box"), alone.alias("alone"))
    frame = ["vehicle", "seq", "sim_us"]
    near = pairs.groupBy(*frame).agg(F.collect_list(one).alias("candidates"))  # edges near one frame
    return frames.join(near, frame, "left")


def _first_of_rows(row: np.ndarray, *rank: np.ndarray) -> np.ndarray:
    """Places of the least entry of each row that has one, by rank."""
    order = np.lexsort((*reversed(rank), row))
    return order[np.diff(row[order], prepend=-1) != 0]


def _match_advance(was: dict, row: dict) -> tuple[dict, dict, None]:
    n = len(was["lost"])
    count = row["near_edge_id"][1]
    of = np.repeat(np.arange(n), count)
    edge, src, dst, lateral, box, alone = (row[f"near_{c}"][0] for c in _NEAR)
    matched, last_src, last_dst = (was[c][of] for c in ("matched", "src", "dst"))
    follows = np.select([~matched, last_dst == src, (last_dst == dst) | (last_src == src)], [0.5, 1.0, 0.3], 0.0)
    score = alone + 0.2 * follows
    near = np.flatnonzero((box <= np.where(matched, NEXT_M, FIRST_M)) & (lateral <= 3 * SCALE_M))
    best = near[_first_of_rows(of[near], -np.round(score[near], 9), edge[near])]
    at = of[best]
    hit = np.zeros(n, bool)
    hit[at] = True
    lost = np.where(hit, 0, was["lost"] + 1)
    new = {"matched": hit | (was["matched"] & (lost <= LOST_FRAMES)), "src": was["src"].copy(), "dst": was["dst"].copy(), "lost": lost}
    new["src"][at], new["dst"][at] = src[best], dst[best]

    def told(values: np.ndarray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(n, dtype)
        out[at] = values[best]
        return out, hit

    confidence = np.full(n, len(CONFIDENCE) - 1)
    confidence[at] = np.searchsorted((8.0, 20.0), lateral[best], side="right")
    return new, {"edge_id": told(edge, np.int64), "lateral": told(lateral, float), "score": told(score, float), "confidence": confidence}, None


CONFIDENCE = ("HIGH", "MEDIUM", "LOW", "UNMATCHED")
_NEAR = ("edge_id", "src", "dst", "lateral", "box", "alone")


def _match_one(was: dict, row: dict) -> tuple[dict, dict]:
    candidates = [dict(zip(_NEAR, c)) for c in zip(*(row[f"near_{c}"] for c in _NEAR))]
    state = {"last": [was["src"], was["dst"]] if was["matched"] else None, "lost": was["lost"]}
    state, made = match_step(state, {"vehicle": None, "seq": None, "candidates": candidates})
    last = state["last"]
    return {"matched": last is not None, "src": last[0] if last else 0, "dst": last[1] if last else 0, "lost": state["lost"]}, _NO_EDGE | made


_NO_EDGE = {"edge_id": None, "lateral": None, "score": None}
MATCH_COLUMNS = ColumnStep(
    {"matched": False, "src": 0, "dst": 0, "lost": 0}, tuple(f"near_{c}" for c in _NEAR), ("edge_id", "lateral", "score", "confidence"),
    _match_advance, {"confidence": CONFIDENCE}, _match_one,
)


def match(frames: DataFrame, edges: DataFrame) -> DataFrame:
    """Frames (vehicle, seq, sim_us, x, z, heading) matched to edges one after the other; vehicle, seq and sim_us tell frames apart."""
    flat = with_candidates(frames, edges).select("vehicle", "seq", "sim_us", *(F.col(f"candidates.{c}").alias(f"near_{c}") for c in _NEAR))
    return fold_columns(flat, ["vehicle"], ["sim_us", "seq"], MATCH_COLUMNS, MATCH_SCHEMA)


TRACK_SCHEMA = StructType().add("vehicle", LongType()).add("seq", LongType()).add("idx", LongType()).add("travelled_m", DoubleType()).add("remaining_m", DoubleType())
WINDOW = 4


def track_step(state: dict, row: dict) -> tuple[dict, dict | None]:
    """Progress along a route: the occurrence of the matched edge nearest to the last one, within WINDOW edges of it.

    row["places"] are the edge's occurrences on the vehicle's route (idx, start_m); travelled distance never falls.
    """
    last = state.get("idx")
    near = [p for p in (row["places"] if row["places"] is not None else ()) if last is None or abs(p["idx"] - last) <= WINDOW]
    if not near:
        return state, None
    p = min(near, key=lambda p: (abs(p["idx"] - (last or 0)), p["idx"]))
    travelled = max(state.get("travelled", 0.0), float(p["start_m"] + row["offset"]))
    return {"idx": int(p["idx"]), "travelled": travelled}, {"vehicle": row["vehicle"], "seq": row["seq"], "idx": int(p["idx"]), "travelled_m": travelled, "remaining_m": float(row["route_m"]) - travelled}


def _track_advance(was: dict, row: dict) -> tuple[dict, dict, np.ndarray]:
    (idx, count), start = row["places_idx"], row["places_start_m"][0]
    n = len(count)
    of = np.repeat(np.arange(n), count)
    last = was["idx"][of]
    away = np.abs(idx - np.maximum(last, 0))
    near = np.flatnonzero((last < 0) | (away <= WINDOW))
    best = near[_first_of_rows(of[near], away[near], idx[near])]
    at = of[best]
    hit = np.zeros(n, bool)
    hit[at] = True
    place, travelled = was["idx"].copy(), was["travelled"].copy()
    place[at] = idx[best]
    travelled[at] = np.fmax(travelled[at], start[best] + row["offset"][at])
    return {"idx": place, "travelled": travelled}, {"idx": place, "travelled_m": travelled, "remaining_m": row["route_m"] - travelled}, hit


def _track_one(was: dict, row: dict) -> tuple[dict, dict | None]:
    places = [{"idx": i, "start_m": s} for i, s in zip(row["places_idx"], row["places_start_m"])]
    state = {"travelled": was["travelled"]} | ({} if was["idx"] < 0 else {"idx": was["idx"]})
    state, made = track_step(state, {"vehicle": None, "seq": None, "places": places, "offset": row["offset"], "route_m": row["route_m"]})
    return was | state, made


#: Places on a route are 0 and more; -1 is none yet.
TRACK_COLUMNS = ColumnStep(
    {"idx": -1, "travelled": 0.0}, ("places_idx", "places_start_m", "offset", "route_m"), ("idx", "travelled_m", "remaining_m"), _track_advance, one=_track_one
)


def track(matches: DataFrame, route: DataFrame) -> DataFrame:
    """Matches (vehicle, route_id, seq, sim_us, edge_ref, offset) along routes (route_id, idx, edge_ref, length_m)."""
    order = Window.partitionBy("route_id").orderBy("idx")
    start = F.coalesce(F.sum("length_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = route.withColumns({"start_m": start, "route_m": F.sum("length_m").over(Window.partitionBy("route_id"))})
    places = placed.groupBy("route_id", "edge_ref").agg(F.collect_list(F.struct("idx", "start_m")).alias("places"), F.first("route_m").alias("route_m"))
    rows = matches.join(places, ["route_id", "edge_ref"])
    flat = rows.select("vehicle", "seq", "sim_us", "offset", F.col("places.idx").alias("places_idx"), F.col("places.start_m").alias("places_start_m"), "route_m")
    return fold_columns(flat, ["vehicle"], ["sim_us", "seq"], TRACK_COLUMNS, TRACK_SCHEMA)
