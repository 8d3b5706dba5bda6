"""Map tiles: Web Mercator positions and PMTiles ids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

METRES_PER_DEGREE = 111_320.0


def lng_lat(x: Column, z: Column) -> tuple[Column, Column]:
    """Plane metres to degrees around the origin; z runs south."""
    return x / METRES_PER_DEGREE, -z / METRES_PER_DEGREE


def tile_xy(x: Column, z: Column, zoom: int) -> tuple[Column, Column]:
    """The tile of a place, places off the map in the tiles at its edges; where latitudes have no logarithm, in the last row."""
    lng, lat = lng_lat(x, z)
    n = 1 << zoom
    rad = F.radians(lat)
    tx = F.floor((lng + 180) / 360 * n)
    up = F.tan(rad) + 1 / F.cos(rad)
    ty = F.when(up > 0, F.floor((1 - F.ln(up) / math.pi) / 2 * n)).when(up <= 0, F.lit(n - 1))
    inside = lambda t: F.least(F.greatest(t, F.lit(0)), F.lit(n - 1)).cast("long")
    return inside(tx), inside(ty)


@F.pandas_udf(LongType())
def tile_id(zoom: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Tiles of lower zooms, and the distance along the Hilbert curve of the tile's own zoom."""
    z, x, y = (s.to_numpy(np.int64).copy() for s in (zoom, x, y))
    out = (4**z - 1) // 3
    for bit in range(int(z.max()) - 1 if len(z) else -1, -1, -1):
        s = np.int64(1) << bit
        on = bit < z
        rx, ry = ((x & s) > 0) & on, ((y & s) > 0) & on
        out += np.where(on, s * s * ((3 * rx) ^ ry), 0)
        flip, swap = on & ~ry & rx, on & ~ry
        low = s - 1
        x, y = np.where(flip, low - (x & low), np.where(on, x & low, x)), np.where(flip, low - (y & low), np.where(on, y & low, y))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    return pd.Series(out)
