"""Plane and sphere arithmetic as column expressions: affine, areas, boxes, rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111320.0


def _c(c: str | Column | float | int) -> Column:
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(float(c))


def _radians(c: Column) -> Column:
    return c * F.pi() / 180.0


# --- pixels and affine transforms (x = a col + c, y = e row + f)


def pixel_to_geo(row: str | Column, col: str | Column, centre: bool = True, prefix: str = "") -> tuple[Column, Column]:
    """x, y of a pixel from affine columns a, c, e, f; the centre unless told otherwise."""
    shift = 0.5 if centre else 0.0
    a, c, e, f = (F.col(f"{prefix}{n}") for n in "acef")
    return a * (_c(col) + shift) + c, e * (_c(row) + shift) + f


def geo_to_pixel(x: str | Column, y: str | Column, prefix: str = "") -> tuple[Column, Column]:
    """Fractional row, col of a place."""
    a, c, e, f = (F.col(f"{prefix}{n}") for n in "acef")
    return (_c(y) - f) / e, (_c(x) - c) / a


def gsd_metres(res: str | Column, epsg: str | Column) -> Column:
    return F.when(_c(epsg) == 4326, _c(res) * METRES_PER_DEGREE).otherwise(_c(res))


def area_units(pixels: str | Column, gsd: str | Column | float) -> dict[str, Column]:
    """m2, ha and km2 of a pixel count."""
    m2 = _c(pixels) * (_c(gsd) * _c(gsd))
    return {"m2": m2, "ha": m2 / 1e4, "km2": m2 / 1e6}


# --- boxes


def radius_bbox(lat: str | Column, lon: str | Column, km: str | Column | float) -> dict[str, Column]:
    """Box around a centre at a radius in km."""
    d_lat = _c(km) / KM_PER_DEGREE
    d_lon = _c(km) / (F.cos(_radians(_c(lat))) * KM_PER_DEGREE)
    return {
        "min_lon": _c(lon) - d_lon,
        "min_lat": _c(lat) - d_lat,
        "max_lon": _c(lon) + d_lon,
        "max_lat": _c(lat) + d_lat,
    }


def bbox_area_km2(lat: str | Column, min_lon, min_lat, max_lon, max_lat) -> Column:
    """Flat area of a box with the given central latitude."""
    height = (_c(max_lat) - _c(min_lat)) * KM_PER_DEGREE
    width = (_c(max_lon) - _c(min_lon)) * KM_PER_DEGREE * F.cos(_radians(_c(lat)))
    return height * width


def distance_km(lat: str | Column, lon: str | Column, lat0: str | Column | float, lon0: str | Column | float) -> Column:
    """Equirectangular distance from a centre."""
    dy = (_c(lat) - _c(lat0)) * KM_PER_DEGREE
    dx = (_c(lon) - _c(lon0)) * (F.cos(_radians(_c(lat0))) * KM_PER_DEGREE)
    return F.sqrt(dx * dx + dy * dy)


def overlap_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Area shared by two boxes, 0 when apart."""
    width = F.least(_c(ax1), _c(bx1)) - F.greatest(_c(ax0), _c(bx0))
    height = F.least(_c(ay1), _c(by1)) - F.greatest(_c(ay0), _c(by0))
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def boxes_intersect(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Boxes share at least a border point."""
    return (_c(ax0) <= _c(bx1)) & (_c(bx0) <= _c(ax1)) & (_c(ay0) <= _c(by1)) & (_c(by0) <= _c(ay1))


def percent_box_to_geo(ymin, xmin, ymax, xmax, min_lon, min_lat, max_lon, max_lat) -> dict[str, Column]:
    """Geographic box and centroid of a percent box on a north-up canvas."""
    w, h = _c(max_lon) - _c(min_lon), _c(max_lat) - _c(min_lat)
    box = {
        "geo_min_lon": _c(min_lon) + _c(xmin) / 100.0 * w,
        "geo_min_lat": _c(max_lat) - _c(ymax) / 100.0 * h,
        "geo_max_lon": _c(min_lon) + _c(xmax) / 100.0 * w,
        "geo_max_lat": _c(max_lat) - _c(ymin) / 100.0 * h,
    }
    box["centroid_lon"] = (box["geo_min_lon"] + box["geo_max_lon"]) / 2.0
    box["centroid_lat"] = (box["geo_min_lat"] + box["geo_max_lat"]) / 2.0
    return box


# --- rings: ARRAY<STRUCT<lon, lat>>


def point(lon: str | Column | float, lat: str | Column | float) -> Column:
    return F.struct(_c(lon).cast("double").alias("lon"), _c(lat).cast("double").alias("lat"))


def box_ring(min_lon, min_lat, max_lon, max_lat, digits: int | None = None) -> Column:
    """Closed 5-point ring of a box, optionally rounded."""

    def fit(c):
        return F.round(_c(c), digits) if digits is not None else _c(c)

    x0, y0, x1, y1 = fit(min_lon), fit(min_lat), fit(max_lon), fit(max_lat)
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def closed_ring(ring: str | Column) -> Column:
    """Repeat the first vertex at the end unless it is there already."""
    r = _c(ring)
    first = F.get(r, F.lit(0))
    same = F.get(r, F.size(r) - 1) == first
    return F.when(same | (F.size(r) == 0), r).otherwise(F.concat(r, F.array(first)))


def _edges(ring: Column, term) -> Column:
    closed = closed_ring(ring)
    last = F.greatest(F.size(closed) - 1, F.lit(0))
    return F.zip_with(F.slice(closed, F.lit(1), last), F.slice(closed, F.lit(2), last), term)


def polygon_area_km2(ring: str | Column) -> Column:
    """Area of a ring on the sphere; below three vertices 0."""
    r = _c(ring)

    def term(p: Column, q: Column) -> Column:
        span = F.radians(q["lon"]) - F.radians(p["lon"])
        return span * (F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"])) + 2.0)

    total = F.aggregate(_edges(r, term), F.lit(0.0), lambda acc, t: acc + t)
    area = F.abs(total * (EARTH_RADIUS_KM * EARTH_RADIUS_KM / 2.0))
    return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(area)


def ring_bbox(ring: str | Column) -> dict[str, Column]:
    """Bounding box of a ring."""
    lons = F.transform(_c(ring), lambda p: p["lon"])
    lats = F.transform(_c(ring), lambda p: p["lat"])
    return {
        "min_lon": F.array_min(lons),
        "min_lat": F.array_min(lats),
        "max_lon": F.array_max(lons),
        "max_lat": F.array_max(lats),
    }


def point_in_rings(x: str | Column, y: str | Column, rings: str | Column) -> Column:
    """Even-odd rule over all rings of an area: parts add, holes take away."""
    px, py = _c(x), _c(y)
    return F.aggregate(_c(rings), F.lit(False), lambda acc, r: acc != point_in_ring(px, py, r))


def point_in_ring(x: str | Column, y: str | Column, ring: str | Column) -> Column:
    """Ray casting: an odd number of edges lies to the right of the point."""
    px, py = _c(x), _c(y)

    def crosses(p: Column, q: Column) -> Column:
        straddles = (p["lat"] > py) != (q["lat"] > py)
        at = p["lon"] + (py - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) * (q["lon"] - p["lon"])
        return F.when(straddles & (px < at), 1).otherwise(0)

    hits = F.aggregate(_edges(_c(ring), crosses), F.lit(0), lambda acc, t: acc + t)
    return hits % 2 == 1
