"""The coordinate systems of ``crs`` on numpy arrays, for work inside blocks."""

from __future__ import annotations

import numpy as np

from scenelake.functions import crs


def _zone(epsg: int) -> tuple[float, float] | None:
    """Central meridian in radians and false northing of a UTM code."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return np.radians(epsg % 100 * 6 - 183.0), crs.FALSE_NORTHING_SOUTH if epsg > 32700 else 0.0
    return None


def from_degrees(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """x, y of places in degrees; places that a system cannot show are NaN or infinite."""
    if epsg == 4326:
        return lon, lat
    with np.errstate(all="ignore"):
        if epsg == 3857:
            return np.radians(lon) * crs.SEMI_MAJOR, np.log(np.tan(np.radians(lat) / 2 + np.pi / 4)) * crs.SEMI_MAJOR
        zone = _zone(epsg)
        if zone is None:
            raise ValueError(f"unsupported EPSG code {epsg}")
        s = np.sin(np.radians(lat))
        t = np.sinh(np.arctanh(s) - crs._ECC * np.arctanh(crs._ECC * s))
        away = np.radians(lon) - zone[0]
        xi, eta = np.arctan2(t, np.cos(away)), np.arctanh(np.sin(away) / np.sqrt(1 + t * t))
        east = eta + sum(k * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, k in enumerate(crs._ALPHA, 1))
        north = xi + sum(k * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, k in enumerate(crs._ALPHA, 1))
        size = crs.SCALE * crs._RADIUS
        return size * east + crs.FALSE_EASTING, size * north + zone[1]


def to_degrees(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """lon, lat of places in a system."""
    if epsg == 4326:
        return x, y
    with np.errstate(all="ignore"):
        if epsg == 3857:
            return np.degrees(x / crs.SEMI_MAJOR), np.degrees(2 * np.arctan(np.exp(y / crs.SEMI_MAJOR)) - np.pi / 2)
        zone = _zone(epsg)
        if zone is None:
            raise ValueError(f"unsupported EPSG code {epsg}")
        size = crs.SCALE * crs._RADIUS
        xi, eta = (y - zone[1]) / size, (x - crs.FALSE_EASTING) / size
        xi0 = xi - sum(k * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, k in enumerate(crs._BETA, 1))
        eta0 = eta - sum(k * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, k in enumerate(crs._BETA, 1))
        chi = np.arcsin(np.sin(xi0) / np.cosh(eta0))
        lat = chi + sum(k * np.sin(2 * j * chi) for j, k in enumerate(crs._DELTA, 1))
        return np.degrees(zone[0] + np.arctan2(np.sinh(eta0), np.cos(xi0))), np.degrees(lat)


def transform(x: np.ndarray, y: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of one system in another."""
    return (x, y) if source == target else from_degrees(*to_degrees(x, y, source), target)
