"""Driver-assistance rules as column expressions; speeds in m/s unless named kmh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp

RED, GREEN, YELLOW = 1, 2, 3
GREEN_S, MAX_ACCEL, MIN_M, MAX_M = 15.0, 2.0, 20.0, 500.0


def stopping_distance(v: Column) -> Column:
    """One second of reaction, 2.5 m/s^2 of braking and 5 m to spare."""
    return v * 1.0 + v * v / 5.0 + 5.0


def speed_difference(map_kmh: Column, telemetry_ms: Column) -> Column:
    """Telemetry limit less map limit in whole km/h; null where the map has none."""
    return F.when((map_kmh >= 0) & ~F.isnan(telemetry_ms), F.round(telemetry_ms * 3.6) - map_kmh).cast("int")


def overspeeding(v: Column, limit_kmh: Column) -> Column:
    margin = F.when(limit_kmh <= 50, 3.0).otherwise(5.0)
    return (limit_kmh > 0) & (v * 3.6 > limit_kmh + margin)


def red_light_warning(state: Column, distance: Column, v: Column) -> Column:
    return state.isin(RED, YELLOW) & (distance >= 0) & (distance < stopping_distance(v))


def green_imminent(state: Column, verified: Column, v: Column, remaining: Column) -> Column:
    return (state == RED) & verified & (v < 5.0) & (remaining >= 0) & (remaining < 3.0)


def glosa(distance: Column, state: Column, verified: Column, remaining: Column, v: Column, limit_kmh: Column) -> Column:
    """struct(feasible, v_min_kmh, v_max_kmh): the speeds at which a light is met green, in steps of 5 km/h."""
    usable = verified & (distance >= MIN_M) & (distance <= MAX_M) & (remaining >= 0) & state.isin(RED, GREEN)
    t1 = F.when(state == RED, remaining).otherwise(0.0)
    t2 = F.when(state == RED, remaining + GREEN_S).otherwise(remaining)
    low = distance / t2
    high = F.sqrt(v * v + 2 * MAX_ACCEL * distance)
    high = F.when(t1 > 0, F.least(high, distance / t1)).otherwise(high)
    high = F.when(limit_kmh > 0, F.least(high, limit_kmh / F.lit(3.6))).otherwise(high)
    ok = F.coalesce(usable & (t2 > 0) & (low <= high), F.lit(False))
    down = F.greatest(F.floor((low * 3.6 + 1e-3) / 5) * 5, F.lit(0))
    up = F.greatest(F.ceil((high * 3.6 - 1e-3) / 5) * 5, F.lit(5))
    return F.struct(ok.alias("feasible"), F.when(ok, down).otherwise(0).cast("int").alias("v_min_kmh"), F.when(ok, up).otherwise(0).cast("int").alias("v_max_kmh"))


def speech_lead(v_kmh: Column, road_class: Column, complexity: Column, frequency: str = "standard") -> Column:
    by_class = F.when(road_class == 3, 1.0).when(road_class == 2, 0.8).otherwise(0.5)
    by_complexity = F.when(complexity >= 3, 1.3).otherwise(1.0)
    return clamp(v_kmh * 10.0 * by_class * by_complexity * {"low": 0.5, "standard": 1.0, "high": 1.5}[frequency], 100.0, 2000.0).cast("int")


def spoken_distance(metres: Column) -> Column:
    return F.when(metres % 100 == 0, F.concat((metres / 100).cast("int").cast("string"), F.lit("百米"))).otherwise(F.concat(metres.cast("string"), F.lit("米")))


def spoken_limit(metres: Column, limit_kmh: Column) -> Column:
    head = F.concat(F.lit("前方"), spoken_distance(metres), F.lit("，"))
    return F.when(limit_kmh < 0, F.concat(head, F.lit("限速未知"))).when(limit_kmh == 0, F.concat(head, F.lit("解除限速"))).otherwise(F.concat(head, F.lit("限速"), limit_kmh.cast("string")))
