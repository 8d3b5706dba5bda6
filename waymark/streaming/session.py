"""The navigation session of a vehicle as a step of a fold: states from planning to arrival, with off-route evidence.

`session_step` takes one frame of one vehicle; `session_columns` is the same step for a frame of each of many vehicles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .columns import ColumnStep

SESSION_SCHEMA = StructType().add("vehicle", LongType()).add("seq", LongType()).add("state", StringType()).add("unmatched", LongType()).add("off_m", DoubleType())
#: Unmatched frames in a row that are suspected and confirmed, metres driven meanwhile that confirm, and the least that count.
SUSPECT, CONFIRM, CONFIRM_M, MOVED_M = 5, 15, 80.0, 0.5
#: Metres from the end that are an arrival; slow frames in a row that are a pause, and what is slow.
ARRIVE_M, PAUSE_FRAMES, SLOW_MS = 30.0, 600, 0.5


def session_step(state: dict, row: dict, pause_frames: int = PAUSE_FRAMES) -> tuple[dict, dict]:
    """row: vehicle, seq, x, z, speed_ms, matched, remaining_m, has_destination, plan_ok.

    Idle until there is a destination, then Planning for a frame, then Navigating or Error. Frames off the route are
    evidence by number and by distance; a confirmed one is Rerouting, and the next frame plans again. Arrived, Paused
    and Error stay.
    """
    name = state.get("state", "Idle")
    unmatched, off = state.get("unmatched", 0), state.get("off_m", 0.0)
    low = state.get("low", 0) + 1 if row["speed_ms"] < SLOW_MS else 0
    moved = math.hypot(row["x"] - state["x"], row["z"] - state["z"]) if "x" in state else 0.0
    if name == "Idle":
        name = "Planning" if row["has_destination"] else name
    elif name in ("Planning", "Rerouting"):
        name = "Navigating" if row["plan_ok"] else "Error"
        unmatched, off = 0, 0.0
    elif name in ("Navigating", "SuspectedOffRoute"):
        if row["matched"]:
            name, unmatched, off = "Navigating", 0, 0.0
        else:
            unmatched, off = unmatched + 1, off + (moved if moved >= MOVED_M else 0.0)
            name = "Rerouting" if unmatched >= CONFIRM or off >= CONFIRM_M else "SuspectedOffRoute" if unmatched >= SUSPECT else name
        if name == "Navigating" and row["remaining_m"] < ARRIVE_M:
            name = "Arrived"
    if name == "Navigating" and low >= pause_frames:
        name = "Paused"
    new = {"state": name, "unmatched": unmatched, "off_m": off, "low": low, "x": float(row["x"]), "z": float(row["z"])}
    return new, {"vehicle": row["vehicle"], "seq": row["seq"], "state": name, "unmatched": unmatched, "off_m": off}


STATES = ("Idle", "Planning", "Navigating", "SuspectedOffRoute", "Rerouting", "Arrived", "Paused", "Error")
IDLE, PLANNING, NAVIGATING, SUSPECTED, REROUTING, ARRIVED, PAUSED, ERROR = range(len(STATES))


def session_columns(pause_frames: int = PAUSE_FRAMES) -> ColumnStep:
    def advance(was: dict, row: dict) -> tuple[dict, dict, None]:
        name, matched = was["state"], row["matched"]
        low = np.where(row["speed_ms"] < SLOW_MS, was["low"] + 1, 0)
        moved = np.hypot(row["x"] - was["x"], row["z"] - was["z"])  # NaN at first, which counts as not moved
        planning = (name == PLANNING) | (name == REROUTING)
        driving = (name == NAVIGATING) | (name == SUSPECTED)
        missed = np.where(matched, 0, was["unmatched"] + 1)
        driven = np.where(matched, 0.0, was["off_m"] + np.where(moved >= MOVED_M, moved, 0.0))
        unmatched = np.where(planning, 0, np.where(driving, missed, was["unmatched"]))
        off = np.where(planning, 0.0, np.where(driving, driven, was["off_m"]))
        judged = np.where(missed >= SUSPECT, SUSPECTED, name)
        judged = np.where((missed >= CONFIRM) | (driven >= CONFIRM_M), REROUTING, judged)
        judged = np.where(matched, NAVIGATING, judged)
        judged = np.where((judged == NAVIGATING) & (row["remaining_m"] < ARRIVE_M), ARRIVED, judged)
        now = np.where(driving, judged, name)
        now = np.where(planning, np.where(row["plan_ok"], NAVIGATING, ERROR), now)
        now = np.where((name == IDLE) & row["has_destination"], PLANNING, now)
        now = np.where((now == NAVIGATING) & (low >= pause_frames), PAUSED, now)
        told = {"state": now, "unmatched": unmatched, "off_m": off}
        return told | {"low": low, "x": row["x"], "z": row["z"]}, told, None

    start = {"state": IDLE, "unmatched": 0, "off_m": 0.0, "low": 0, "x": math.nan, "z": math.nan}
    reads = ("x", "z", "speed_ms", "matched", "remaining_m", "has_destination", "plan_ok")
    one = lambda state, row: session_step(state, row | _NOBODY, pause_frames)
    return ColumnStep(start, reads, ("state", "unmatched", "off_m"), advance, {"state": STATES}, one)


#: The columns that a fold by columns copies.
_NOBODY = {"vehicle": None, "seq": None}
