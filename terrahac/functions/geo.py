"""Distances on the globe, kernels and join keys, as Column expressions.

Coordinates are degrees. What depends on one point only is a column of its own (see
``cached``), so that a join's condition holds no more trigonometry than it must.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Earth's radius in km, km a degree for the flat metric.
RADIUS = 6371.0
DEGREE_KM = 111.0
#: What cached() adds.
CACHE = ("lat_r", "lon_r", "cos_lat", "sin_lat", "px", "py", "pz")


def cached(points: DataFrame) -> DataFrame:
    """points with radians, sine and cosine of latitude, and the place in space."""
    df = points.withColumns({"lat_r": F.radians("lat"), "lon_r": F.radians("lon")})
    df = df.withColumns({"cos_lat": F.cos("lat_r"), "sin_lat": F.sin("lat_r")})
    return df.withColumns({"px": RADIUS * F.col("cos_lat") * F.cos("lon_r"), "py": RADIUS * F.col("cos_lat") * F.sin("lon_r"), "pz": RADIUS * F.col("sin_lat")})


def safe_acos(x: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)))


def lon_wrapped(a: Column, b: Column) -> Column:
    """Absolute difference of two longitudes in radians, the short way round."""
    d = F.abs(a - b)
    return F.least(d, 2 * math.pi - d)


def _half_sine(x: Column) -> Column:
    s = F.sin(x / 2)
    return s * s


def haversine(i: str, j: str) -> Column:
    a = _half_sine(F.col(f"{j}.lat_r") - F.col(f"{i}.lat_r")) + F.col(f"{i}.cos_lat") * F.col(f"{j}.cos_lat") * _half_sine(F.col(f"{j}.lon_r") - F.col(f"{i}.lon_r"))
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return 2 * RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def spherical(i: str, j: str) -> Column:
    return RADIUS * safe_acos(F.col(f"{i}.sin_lat") * F.col(f"{j}.sin_lat") + F.col(f"{i}.cos_lat") * F.col(f"{j}.cos_lat") * F.cos(F.col(f"{i}.lon_r") - F.col(f"{j}.lon_r")))


def chord(i: str, j: str) -> Column:
    d = [F.col(f"{i}.{p}") - F.col(f"{j}.{p}") for p in ("px", "py", "pz")]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def flatearth(i: str, j: str) -> Column:
    """Degrees of longitude shrink by the cosine of the southern point; no wrap at the date line."""
    south = F.when(F.col(f"{i}.lat") <= F.col(f"{j}.lat"), F.col(f"{i}.cos_lat")).otherwise(F.col(f"{j}.cos_lat"))
    dy, dx = DEGREE_KM * (F.col(f"{j}.lat") - F.col(f"{i}.lat")), DEGREE_KM * south * (F.col(f"{j}.lon") - F.col(f"{i}.lon"))
    return F.sqrt(dy * dy + dx * dx)


DISTANCE = {"haversine": haversine, "spherical": spherical, "chord": chord, "flatearth": flatearth}


def weight(distance: Column, cutoff: float, kernel: str) -> Column:
    """The spatial kernel: 0 beyond the cutoff, which itself counts as within."""
    inside: Column = F.lit(1.0)
    if kernel == "bartlett" and cutoff > 0:
        inside = 1 - distance / cutoff
    return F.when(distance <= cutoff, inside).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Screen:
    """Bounds that a metric and cutoff put on pairs, and the grid that follows from them."""

    dist_fn: str
    cutoff: float

    @property
    def angle(self) -> float:
        """The largest angle between two points within the cutoff, in radians."""
        if self.cutoff < 0:
            return 0.0
        if self.dist_fn == "chord":
            theta = 2 * math.asin(min(1.0, self.cutoff / (2 * RADIUS)))
        elif self.dist_fn == "flatearth":
            theta = math.radians(self.cutoff / DEGREE_KM)
        else:
            theta = self.cutoff / RADIUS
        return min(theta, math.pi)

    @property
    def height(self) -> float:
        """Degrees of latitude of a band; a pair within the cutoff lies in one band or two adjacent ones."""
        return max(math.degrees(self.angle) * (1 + 1e-9), 1e-9)

    @property
    def banded(self) -> bool:
        return self.angle < math.pi / 2

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.height)

    def cells(self, grid: Column) -> Column:
        """Width of a longitude cell, in degrees, for pairs of bands grid and grid + 1; null where all longitudes meet."""
        lo, hi = grid * F.lit(self.height), (grid + 2) * F.lit(self.height)
        low = F.least(F.cos(F.radians(lo)), F.cos(F.radians(hi)))
        off_poles = (lo > -89.999) & (hi < 89.999)
        if self.dist_fn == "flatearth":
            return F.when(off_poles, F.lit(max(self.cutoff, 1e-9) / DEGREE_KM * (1 + 1e-9)) / low)
        s = math.sin(self.angle / 2)
        span = F.degrees(2 * F.asin(F.least(F.lit(1.0), s / low))) * (1 + 1e-9)
        return F.when(off_poles & (low > s) & (span < 120), F.lit(360.0) / F.floor(F.lit(360.0) / F.greatest(span, F.lit(1e-9))))

    def cell(self, lon: Column, width: Column) -> Column:
        if self.dist_fn == "flatearth":
            return F.coalesce(F.floor(lon / width), F.lit(0))
        return F.coalesce(F.least(F.floor(F.pmod(lon, F.lit(360.0)) / width), F.round(F.lit(360.0) / width) - 1).cast("long"), F.lit(0))

    def around(self, cell: Column, width: Column) -> Column:
        """The cells that a pair's other point can lie in."""
        near = F.array(cell - 1, cell, cell + 1)
        if self.dist_fn == "flatearth":
            return F.when(width.isNull(), F.array(F.lit(0).cast("long"))).otherwise(near)
        n = F.round(F.lit(360.0) / width).cast("long")
        return F.when(width.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(near, lambda c: F.pmod(c, n))))

    def space(self, i: str, j: str) -> Column:
        """A necessary condition that needs only the products of the points' places in space."""
        if self.dist_fn == "flatearth" or self.angle >= math.pi:
            return F.lit(True)
        dot = sum((F.col(f"{i}.{p}") * F.col(f"{j}.{p}") for p in ("py", "pz")), F.col(f"{i}.px") * F.col(f"{j}.px"))
        return dot >= RADIUS * RADIUS * (math.cos(self.angle) - 1e-12)

    def longitude(self, i: str, j: str) -> Column:
        """A necessary condition on longitudes that needs no distance."""
        if self.dist_fn == "flatearth":
            south = F.when(F.col(f"{i}.lat") <= F.col(f"{j}.lat"), F.col(f"{i}.cos_lat")).otherwise(F.col(f"{j}.cos_lat"))
            return (F.abs(south) < 1e-14) | (F.abs(south) * DEGREE_KM * F.abs(F.col(f"{j}.lon") - F.col(f"{i}.lon")) <= self.cutoff + 1e-12)
        if self.angle >= math.pi:
            return F.lit(True)
        both = F.col(f"{i}.cos_lat") * F.col(f"{j}.cos_lat")
        return (both <= 1e-14) | (_half_sine(lon_wrapped(F.col(f"{i}.lon_r"), F.col(f"{j}.lon_r"))) <= math.sin(self.angle / 2) ** 2 / both + 1e-15)
