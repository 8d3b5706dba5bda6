"""Travel speed, time and cost of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: km/h where the limit is unknown, where there is none, and off the road.
UNKNOWN_KPH, UNLIMITED_KPH, JUNCTION_KPH, TRANSIT_KPH = 50, 130, 30, 30
SIGNAL_S, SHARP_S, UTURN_S = 8.0, 3.0, 30.0
SHARP_RAD, UTURN_RAD = 1.2, 2.6
#: Edge flags.
NO_AI, GPS_AVOID, SECRET = 1, 2, 4
AVOID_COST, SECRET_COST = 600.0, 3600.0


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def speed_ms(kind: Column, limit: Column) -> Column:
    road = F.when(limit < 0, UNKNOWN_KPH).when(limit == 0, UNLIMITED_KPH).otherwise(F.least(limit, F.lit(UNLIMITED_KPH)))
    return F.when(kind == 0, road).when(kind == 1, JUNCTION_KPH).otherwise(TRANSIT_KPH) / F.lit(3.6)


def time_s(kind: Column, limit: Column, semaphore: Column, length: Column, turn: Column | None = None) -> Column:
    signal = F.when((kind == 1) & (semaphore >= 0), SIGNAL_S).otherwise(0.0)
    turn = F.lit(0.0) if turn is None else turn
    bend = F.when((kind == 1) & (turn >= UTURN_RAD), UTURN_S).when((kind == 1) & (turn >= SHARP_RAD), SHARP_S).otherwise(0.0)
    return length / speed_ms(kind, limit) + signal + bend


def cost(profile: str, time: Column, length: Column, flags: Column) -> Column:
    base = {"fastest": time, "shortest": length, "balanced": 0.7 * time + 0.3 * length / 1000}[profile]
    return base + F.when(has_flag(flags, GPS_AVOID), AVOID_COST).otherwise(0.0) + F.when(has_flag(flags, SECRET), SECRET_COST).otherwise(0.0)
