"""Rasters brought onto other grids: kernels and coordinate systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.views import fixed, sfixed, sql
from scenelake.operators import raster
from scenelake.operators.align import KERNELS, align

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _wide(spark, sf):
    return raster.stack_bands(v.px_long(spark, sf).withColumn("band", F.format_string("k%d", "band")), ["k1", "k2", "k3", "k4"])


def _grid(spark, sf, a, c, e, f, width, height, epsg):
    scenes = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"))
    names = ("a", "c", "e", "f", "width", "height", "epsg")
    return scenes.select("scene_id", *[F.lit(x).alias(n) for n, x in zip(names, (a, c, e, f, width, height, epsg))])


def _kernels(spark, sf):
    px = _wide(spark, sf)
    grids = _grid(spark, sf, 20.0, 100.0, -20.0, 200.0, 4, 4, 32644), _grid(spark, sf, 30.0, 97.0, -30.0, 200.0, 3, 3, 32644)
    parts = [align(px, *grids, ["k1", "k3"], k).withColumn("kernel", F.lit(k)) for k in KERNELS]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("scene_id", "kernel", "row", "col", fixed("k1").alias("k1"), fixed("k3").alias("k3"))


def _weight(d: str) -> str:
    """Weight of a source pixel at distance ``d`` by kernel; a reference cell covers 1.5 source pixels a side."""
    t = f"abs({d})"
    return f"""case kernel when 'nearest' then case when {d} > -0.5e0 and {d} <= 0.5e0 then 1e0 else 0e0 end when 'bilinear' then greatest(1e0 - {t}, 0e0)
      when 'cubic' then case when {t} <= 1 then 1.5e0 * {t} ** 3 - 2.5e0 * {t} ** 2 + 1e0 when {t} < 2 then -0.5e0 * {t} ** 3 + 2.5e0 * {t} ** 2 - 4e0 * {t} + 2e0 else 0e0 end
      else greatest(least({d} + 0.5e0, 0.75e0) - greatest({d} - 0.5e0, -0.75e0), 0e0) end"""


QUERIES["j6_resample_kernels"] = _kernels
SQL["j6_resample_kernels"] = sql(
    "px_long",
    f"""with g as (select vec_id as scene_id, r as row, k as col, (r + 0.5e0) * 1.5e0 - 0.5e0 as sr, (k + 0.5e0) * 1.5e0 - 0.65e0 as sc, kernel
      from embeddings cross join generate_series(0, 2) t(r) cross join generate_series(0, 2) u(k) cross join (values ('nearest'), ('bilinear'), ('cubic'), ('area')) n(kernel)),
    w as (select g.scene_id, kernel, g.row, g.col, p.band, p.value, ({_weight('(p.row - sr)')}) * ({_weight('(p.col - sc)')}) as w from g join px_long p on g.scene_id = p.scene_id)
    select scene_id, kernel, row, col, {sfixed('sum(w * value) filter (where band = 1) / sum(w) filter (where band = 1)')} as k1,
      {sfixed('sum(w * value) filter (where band = 3) / sum(w) filter (where band = 3)')} as k3 from w where w <> 0 group by 1, 2, 3, 4""",
)


def _utm(spark, sf):
    source = _grid(spark, sf, 1000.0, 770000.0, -1000.0, 1430000.0, 4, 4, 32643)
    reference = _grid(spark, sf, 0.006, 77.485, -0.006, 12.93, 7, 7, 4326)
    return align(_wide(spark, sf), source, reference, ["k1", "k3"], tolerance=1e-12).select("scene_id", "row", "col", fixed("k1", 4).alias("k1"), fixed("k3", 4).alias("k3"))


# The transverse Mercator series in the third flattening n, with the ellipsoid's published axis and flattening.
QUERIES["j6_resample_utm"] = _utm
SQL["j6_resample_utm"] = sql(
    "px_long",
    f"""with n as (select (1e0 / 298.257223563e0) / (2e0 - 1e0 / 298.257223563e0) as n),
    k as (select n, 6378137e0 / (1e0 + n) * (1e0 + n ** 2 / 4e0 + n ** 4 / 64e0) * 0.9996e0 as size, 2e0 * sqrt(n) / (1e0 + n) as ecc,
      n / 2e0 - 2e0 * n ** 2 / 3e0 + 5e0 * n ** 3 / 16e0 + 41e0 * n ** 4 / 180e0 as a1, 13e0 * n ** 2 / 48e0 - 3e0 * n ** 3 / 5e0 + 557e0 * n ** 4 / 1440e0 as a2,
      61e0 * n ** 3 / 240e0 - 103e0 * n ** 4 / 140e0 as a3, 49561e0 * n ** 4 / 161280e0 as a4 from n),
    p as (select r as row, c as col, sin(radians(12.93e0 - 0.006e0 * (r + 0.5e0))) as s, radians(77.485e0 + 0.006e0 * (c + 0.5e0)) - radians(75e0) as away from generate_series(0, 6) t(r), generate_series(0, 6) u(c)),
    q as (select p.*, k.*, sinh(atanh(s) - ecc * atanh(ecc * s)) as t from p, k),
    x as (select *, atan2(t, cos(away)) as xi, atanh(sin(away) / sqrt(1e0 + t * t)) as eta from q),
    m as (select row, col, 500000e0 + size * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) as ex,
      size * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) as ny from x),
    g as (select row, col, (ny - 1430000e0) / -1000e0 - 0.5e0 as sr, (ex - 770000e0) / 1000e0 - 0.5e0 as sc from m),
    w as (select p.scene_id, g.row, g.col, p.band, p.value, greatest(1e0 - abs(sr - p.row), 0e0) * greatest(1e0 - abs(sc - p.col), 0e0) as w
      from g join px_long p on abs(sr - p.row) < 1 and abs(sc - p.col) < 1)
    select scene_id, row, col, {sfixed('sum(w * value) filter (where band = 1) / sum(w) filter (where band = 1)', 4)} as k1,
      {sfixed('sum(w * value) filter (where band = 3) / sum(w) filter (where band = 3)', 4)} as k3 from w group by 1, 2, 3""",
)
