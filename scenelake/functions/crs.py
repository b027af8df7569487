"""WGS84 to UTM and Web Mercator and back as closed-form column arithmetic.

Transverse Mercator uses the published fourth-order series in the third flattening.
Other EPSG codes raise an error in the job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_N = FLATTENING / (2.0 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
_ECC = 2.0 * math.sqrt(_N) / (1.0 + _N)

# Published series coefficients of the forward, inverse and latitude steps.
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def _c(c: str | Column | float | int) -> Column:
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(c)


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def utm_epsg(lon: str | Column, lat: str | Column) -> Column:
    """EPSG code of the standard 6-degree zone of a place."""
    zone = F.least(F.greatest(F.floor((_c(lon) + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60))
    return (F.when(_c(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def _central(epsg: Column) -> Column:
    return F.radians(((epsg % 100) * 6 - 183).cast("double"))


def _south(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(FALSE_NORTHING_SOUTH)).otherwise(0.0)


def _sum(terms) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def _unsupported(epsg: Column) -> Column:
    return F.raise_error(F.concat(F.lit("unsupported EPSG code "), epsg.cast("string"))).cast("double")


def from_wgs84(lon: str | Column, lat: str | Column, epsg: str | Column | int) -> Column:
    """STRUCT<x, y> in the target system of a place in degrees."""
    lon, lat, epsg = _c(lon), _c(lat), _c(epsg)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * _ECC) * _ECC)
    dlon = F.radians(lon) - _central(epsg)
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(t * t + 1.0))
    east = eta + _sum(F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * k for j, k in enumerate(_ALPHA, 1))
    north = xi + _sum(F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * k for j, k in enumerate(_ALPHA, 1))
    x = (
        F.when(epsg == 4326, lon)
        .when(epsg == 3857, F.radians(lon) * SEMI_MAJOR)
        .when(is_utm(epsg), east * (SCALE * _RADIUS) + FALSE_EASTING)
        .otherwise(_unsupported(epsg))
    )
    y = (
        F.when(epsg == 4326, lat)
        .when(epsg == 3857, F.log(F.tan(F.radians(lat) / 2.0 + math.pi / 4.0)) * SEMI_MAJOR)
        .when(is_utm(epsg), north * (SCALE * _RADIUS) + _south(epsg))
        .otherwise(_unsupported(epsg))
    )
    return F.struct(x.alias("x"), y.alias("y"))


def to_wgs84(x: str | Column, y: str | Column, epsg: str | Column | int) -> Column:
    """STRUCT<lon, lat> in degrees of a place in the source system."""
    x, y, epsg = _c(x), _c(y), _c(epsg)
    xi = (y - _south(epsg)) / (SCALE * _RADIUS)
    eta = (x - FALSE_EASTING) / (SCALE * _RADIUS)
    xi0 = xi - _sum(F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * k for j, k in enumerate(_BETA, 1))
    eta0 = eta - _sum(F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * k for j, k in enumerate(_BETA, 1))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi + _sum(F.sin(chi * (2.0 * j)) * k for j, k in enumerate(_DELTA, 1))
    lam = _central(epsg) + F.atan2(F.sinh(eta0), F.cos(xi0))
    lon = (
        F.when(epsg == 4326, x)
        .when(epsg == 3857, F.degrees(x / SEMI_MAJOR))
        .when(is_utm(epsg), F.degrees(lam))
        .otherwise(_unsupported(epsg))
    )
    lat = (
        F.when(epsg == 4326, y)
        .when(epsg == 3857, F.degrees(F.atan(F.exp(y / SEMI_MAJOR)) * 2.0 - math.pi / 2.0))
        .when(is_utm(epsg), F.degrees(phi))
        .otherwise(_unsupported(epsg))
    )
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def bounds_to_wgs84(left, bottom, right, top, epsg, steps: int = 21) -> dict[str, Column]:
    """WGS84 bounds of a projected box, from points along its four edges."""
    l, b, r, t, code = (_c(v) for v in (left, bottom, right, top, epsg))
    parts = F.array(*[F.lit(k / steps) for k in range(steps + 1)])

    def edge(x0, y0, x1, y1):
        return F.transform(parts, lambda s: to_wgs84(x0 + (x1 - x0) * s, y0 + (y1 - y0) * s, code))

    points = F.concat(edge(l, b, r, b), edge(r, b, r, t), edge(r, t, l, t), edge(l, t, l, b))
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return {
        "min_lon": F.array_min(lons),
        "min_lat": F.array_min(lats),
        "max_lon": F.array_max(lons),
        "max_lat": F.array_max(lats),
    }


def epsg_of(text: str | Column) -> Column:
    """EPSG number of a text such as EPSG:32644, NULL when it is not one."""
    code = F.regexp_extract(F.upper(_c(text)), r"^EPSG:(\d+)$", 1)
    return F.nullif(code, F.lit("")).cast("int")


def crs_message(a: str | Column, b: str | Column) -> Column:
    """STRUCT<compatible, message> for two EPSG texts."""
    ta, tb = _c(a), _c(b)
    ea, eb = epsg_of(ta), epsg_of(tb)
    missing = ta.isNull() | tb.isNull()
    same = F.coalesce(ea == eb, F.lit(False))
    message = (
        F.when(missing, "One or both images lack spatial CRS metadata.")
        .when(ea.isNull() | eb.isNull(), "CRS compatibility check failed: unknown code.")
        .when(same & (ta == tb), F.format_string("Identical CRS (%s). No reprojection required.", ta))
        .when(same, F.format_string("Matching EPSG:%d. Spatial alignment compatible.", ea))
        .otherwise(F.format_string("CRS mismatch: %s vs %s. Reprojection required.", ta, tb))
    )
    return F.struct((same & ~missing).alias("compatible"), message.alias("message"))
