"""Geometry as Column expressions on a spherical earth."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
FEET_PER_KM = 3280.839895013123
KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_ft(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * F.lit(FEET_PER_KM)


def planar_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared planar distance in degrees."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def unit_sphere(lat: Column, lon: Column) -> list[Column]:
    """x, y, z on the unit sphere: straight-line distance there grows with great-circle distance."""
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def chord(km: float) -> float:
    """Straight-line length on the unit sphere of an arc of ``km``."""
    return 2.0 * math.sin(min(km / EARTH_RADIUS_KM, math.pi) / 2.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value written and computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def destination(lat: Column, lon: Column, km: Column, bearing_deg: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point by ``km`` along a bearing (0 = north, 90 = east)."""
    phi, lam, theta = F.radians(lat), F.radians(lon), F.radians(bearing_deg)
    delta = km / F.lit(EARTH_RADIUS_KM)
    sin_phi2 = F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(theta)
    lam2 = lam + F.atan2(F.sin(theta) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * sin_phi2)
    return F.degrees(F.asin(sin_phi2)), F.degrees(lam2)


def rhumb_destination(lat: Column, lon: Column, km: Column, bearing_deg: Column) -> tuple[Column, Column]:
    """Point reached along a line of constant bearing; over a pole it comes down on the other side's parallel.

    At a pole itself, where there is no bearing, the longitude stays.
    """
    phi, lam, theta = F.radians(lat), F.radians(lon), F.radians(bearing_deg)
    delta = km / F.lit(EARTH_RADIUS_KM)
    dphi = delta * F.cos(theta)
    over = phi + dphi
    half = F.lit(math.pi / 2)
    phi2 = F.when(over > half, F.lit(math.pi) - over).when(over < -half, F.lit(-math.pi) - over).otherwise(over)
    quarter = F.lit(math.pi / 4)
    dpsi = F.log(F.tan(phi2 / 2 + quarter) / F.nullif(F.tan(phi / 2 + quarter), F.lit(0.0)))
    q = let(dpsi, lambda d: F.when(F.abs(d) > 1e-11, dphi / F.nullif(d, F.lit(0.0))).otherwise(F.cos(phi)))
    moved = F.when(F.abs(F.cos(phi)) < 1e-9, lam).otherwise(lam + delta * F.sin(theta) / F.nullif(q, F.lit(0.0)))
    return F.degrees(phi2), F.degrees(moved)
