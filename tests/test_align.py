"""Alignment against a plain per-cell warp: kernels, systems, blocks, gaps, and the bound of the lattice."""

import math
import random

import numpy as np
import pytest

from scenelake.functions import crs_arrays as ca
from scenelake.functions.crs import from_wgs84, to_wgs84
from scenelake.operators import align as al

HEAD = "scene_id int, a double, c double, e double, f double, width int, height int, epsg int"


def plain(px, s, t, kernel):
    """Cell by cell, exact places, no blocks."""
    h = {f"s_{k}": v for k, v in s.items()} | {f"t_{k}": v for k, v in t.items()}
    out = {}
    cells = np.array(list(px), float)
    values = np.array([np.nan if v is None else v for v in px.values()])
    for r in range(t["height"]):
        for c in range(t["width"]):
            at = lambda rr, cc: [float(v[0]) for v in al._place(h, "t", np.array([rr]), np.array([cc]), "s")]
            y, x = at(float(r), float(c))
            half = 0.5, 0.5
            if kernel == "area":
                up, down = (at(max(r - 1, 0), c)[0], at(min(r + 1, t["height"] - 1), c)[0])
                lo, hi = (at(r, max(c - 1, 0))[1], at(r, min(c + 1, t["width"] - 1))[1])
                half = max(abs(down - up) / (min(r + 1, t["height"] - 1) - max(r - 1, 0)), 1) / 2, max(abs(hi - lo) / (min(c + 1, t["width"] - 1) - max(c - 1, 0)), 1) / 2
            w = al._weights(kernel, cells[:, 0] - y, half[0]) * al._weights(kernel, cells[:, 1] - x, half[1])
            if w.any():
                good = np.isfinite(values) & (w != 0)
                weight = w[good].sum()
                out[r, c] = float((w[good] * values[good]).sum() / weight) if abs(weight) > 1e-9 else None
    return out


def utm_source():
    x, y = (float(v) for v in ca.from_degrees(np.array(77.5), np.array(12.9), 32643))
    return dict(a=30.0, c=x - 300, e=-30.0, f=y + 300, width=21, height=20, epsg=32643)


CASES = {
    "finer": (dict(a=20.0, c=100.0, e=-20.0, f=200.0, width=12, height=11, epsg=32644), dict(a=10.0, c=95.0, e=-10.0, f=207.0, width=25, height=24, epsg=32644)),
    "coarser": (dict(a=10.0, c=0.0, e=-10.0, f=0.0, width=40, height=37, epsg=32644), dict(a=37.0, c=-5.0, e=-33.0, f=4.0, width=11, height=12, epsg=32644)),
    "to degrees": (utm_source(), dict(a=0.0003, c=77.4975, e=-0.0003, f=12.9025, width=18, height=17, epsg=4326)),
    "to mercator": (utm_source(), dict(a=25.0, c=8626900.0, e=-25.0, f=1448600.0, width=20, height=20, epsg=3857)),
}


@pytest.mark.parametrize("case", list(CASES))
def test_kernels_against_plain_warp(spark, case):
    s, t = CASES[case]
    rng = random.Random(3)
    px = {(r, c): (None if rng.random() < 0.05 else rng.random() * 100) for r in range(s["height"]) for c in range(s["width"]) if rng.random() > 0.03}
    df = spark.createDataFrame([(1, r, c, v) for (r, c), v in px.items()] + [(2, 0, 0, 1.0)], "scene_id int, row int, col int, v double").repartition(3)
    heads = [spark.createDataFrame([(1, *g.values())], HEAD) for g in (s, t)]
    some = False
    for kernel in al.KERNELS:
        got = {(r["row"], r["col"]): r["v"] for r in al.align(df, *heads, ["v"], kernel, block=max(8, 8), tolerance=1e-9).collect()}
        want = plain(px, s, t, kernel)
        assert got.keys() == want.keys(), kernel
        assert all((a is None) == (want[k] is None) and (a is None or math.isclose(a, want[k], abs_tol=1e-6)) for k, a in got.items()), kernel
        some |= len(want) > 50
    assert some


def test_lattice_stays_within_its_bound():
    s, t = utm_source(), dict(a=0.01, c=77.0, e=-0.01, f=13.5, width=200, height=200, epsg=4326)
    h = {f"s_{k}": v for k, v in s.items()} | {f"t_{k}": v for k, v in t.items()}
    r, c = np.mgrid[0:200, 0:200].astype(float)
    exact = al._place(h, "t", r, c, "s")
    steps = set()
    for tolerance in (5.0, 1 / 8, 1 / 64, 1e-6):
        sr, sc, step = al.lattice_places(h, (0, 200), (0, 200), 16, tolerance)
        assert max(np.abs(sr - exact[0]).max(), np.abs(sc - exact[1]).max()) <= tolerance * 1.1
        steps.add(step)
    assert len(steps) > 1 and 1 in steps


def test_arrays_agree_with_columns(spark):
    spots = [(77.5, 12.9, 32643), (81.0, -5.0, 32744), (10.0, 50.0, 3857), (3.0, 4.0, 4326), (78.9, 60.0, 32643)]
    df = spark.createDataFrame(spots, "lon double, lat double, epsg int")
    rows = df.select("*", from_wgs84("lon", "lat", "epsg").alias("p")).select("*", to_wgs84("p.x", "p.y", "epsg").alias("q")).collect()
    for r in rows:
        x, y = ca.from_degrees(np.array(r["lon"]), np.array(r["lat"]), r["epsg"])
        assert math.isclose(float(x), r["p"]["x"], abs_tol=1e-6) and math.isclose(float(y), r["p"]["y"], abs_tol=1e-6)
        lon, lat = ca.to_degrees(x, y, r["epsg"])
        assert math.isclose(float(lon), r["q"]["lon"], abs_tol=1e-9) and math.isclose(float(lat), r["q"]["lat"], abs_tol=1e-9)
    with pytest.raises(ValueError):
        ca.from_degrees(np.array(1.0), np.array(1.0), 2154)


def test_source_is_shuffled_once(spark):
    s, t = CASES["finer"]
    df = spark.range(100).selectExpr("1 as scene_id", "cast(id div 10 as int) as row", "cast(id % 10 as int) as col", "1.0D as v")
    heads = [spark.createDataFrame([(1, *g.values())], HEAD) for g in (s, t)]
    plan = al.align(df, *heads, ["v"])._jdf.queryExecution().sparkPlan().toString()
    whole = al.align(df, *heads, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    # one exchange above the pixels, the others belong to the headers
    above = whole[: whole.index("Range")]
    assert above[above.rindex("Exchange") :].count("Exchange") == 1 and "Join" not in above


def test_bands_on_grids_of_their_own(spark):
    heads = [(1, "B04", 10.0, 0.0, -10.0, 0.0, 4, 4, 32644), (1, "B11", 20.0, 0.0, -20.0, 0.0, 2, 2, 32644)]
    headers = spark.createDataFrame(heads, "scene_id int, band string, a double, c double, e double, f double, width int, height int, epsg int")
    fine = [(1, "B04", r, c, float(r * 4 + c)) for r in range(4) for c in range(4)]
    coarse = [(1, "B11", r, c, float(r * 2 + c)) for r in range(2) for c in range(2)]
    px = spark.createDataFrame(fine + coarse, "scene_id int, band string, row int, col int, value double")
    rows = {(r["row"], r["col"]): (r["B04"], r["B11"]) for r in al.stack_aligned(px, headers, ["B11", "B04"], kernel="nearest").collect()}
    assert rows == {(r, c): (float(r * 4 + c), float(r // 2 * 2 + c // 2)) for r in range(4) for c in range(4)}
