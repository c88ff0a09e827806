"""Closed-form map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require

A, INVERSE_F = 6378137.0, {"wgs84": 298.257223563, "grs80": 298.257222101}
K0, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0


def _code(crs: str | int) -> int:
    text = str(crs).upper().removeprefix("EPSG:")
    if not text.isdigit():
        raise ValueError(f"not an EPSG code: {crs!r}")
    return int(text)


def _kind(code: int) -> tuple[str, str, int | None, bool]:
    """(datum family, form, zone, south) of a code."""
    if code == 4326:
        return "wgs84", "geographic", None, False
    if code == 3857:
        return "wgs84", "web", None, False
    if code in (4283, 7844):
        return f"gda{code}", "geographic", None, True
    for base, family, south in ((32600, "wgs84", False), (32700, "wgs84", True), (28300, "gda4283", True), (7800, "gda7844", True)):
        if base < code <= base + 60:
            return family, "utm", code - base, south
    raise ValueError(f"EPSG:{code} is not supported")


def _series(family: str) -> tuple[float, float, list[float], list[float]]:
    """Third flattening n, rectifying radius, and the coefficients of the transverse Mercator series both ways."""
    f = 1 / INVERSE_F["wgs84" if family == "wgs84" else "grs80"]
    n = f / (2 - f)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return n, radius, alpha, beta


def _to_geographic(x: Column, y: Column, kind: tuple) -> tuple[Column, Column]:
    """Longitude and latitude in radians."""
    family, form, zone, south = kind
    if form == "geographic":
        return F.radians(x), F.radians(y)
    if form == "web":
        return x / A, F.lit(2.0) * F.atan(F.exp(y / A)) - math.pi / 2
    n, radius, _, beta = _series(family)
    xi, eta = (y - (FALSE_NORTHING if south else 0.0)) / (K0 * radius), (x - FALSE_EASTING) / (K0 * radius)
    p, q = xi, eta
    for j, b in enumerate(beta, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate([2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15], 1):
        lat = lat + d * F.sin(2 * j * chi)
    return math.radians(zone * 6 - 183) + F.atan2(F.sinh(q), F.cos(p)), lat


def _from_geographic(lon: Column, lat: Column, kind: tuple) -> tuple[Column, Column]:
    family, form, zone, south = kind
    if form == "geographic":
        return F.degrees(lon), F.degrees(lat)
    if form == "web":
        return lon * A, A * F.log(F.tan(math.pi / 4 + lat / 2))
    n, radius, alpha, _ = _series(family)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(lat)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = lon - math.radians(zone * 6 - 183)
    xi0, eta0 = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(alpha, 1):
        xi = xi + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return FALSE_EASTING + K0 * radius * eta, (FALSE_NORTHING if south else 0.0) + K0 * radius * xi


def projected(x: Column, y: Column, source: str | int, target: str | int) -> tuple[Column, Column]:
    """x, y of the target system. WGS 84 (4326, 3857, UTM 326zz and 327zz), GDA94 and GDA2020 with their MGA zones.

    Between those families a datum shift would be needed, which is refused.
    """
    a, b = _kind(_code(source)), _kind(_code(target))
    if a[0] != b[0]:
        raise ValueError(f"a datum shift from {source} to {target} is not supported")
    if _code(source) == _code(target):
        return x, y
    return _from_geographic(*_to_geographic(x, y, a), b)


def reproject_points(df: DataFrame, x_col: str, y_col: str, source_crs: str | int, target_crs: str | int) -> DataFrame:
    """The two columns in the target system."""
    require(df, [x_col, y_col])
    x, y = projected(col(x_col).cast("double"), col(y_col).cast("double"), source_crs, target_crs)
    return df.withColumns({x_col: x, y_col: y})
