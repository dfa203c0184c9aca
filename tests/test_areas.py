"""Areas of several parts with holes, and feeds in grid metres."""

import math

import pytest
from pyspark.sql import functions as F

from strideway.functions import geo
from strideway.operators import spatial
from strideway.sources import tables


def ring(cx, cy, half, back=False):
    corners = [(cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half)]
    return [{"x": float(x), "y": float(y)} for x, y in (corners[::-1] if back else corners)]


@pytest.mark.parametrize("back", [False, True])
def test_areas_with_holes_and_parts(spark, back):
    """Whatever way rings go round: a square of 40 with a hole of 20, and a second square of 10 beside it."""
    rings = [(False, ring(0, 0, 20, back)), (True, ring(0, 0, 10)), (False, ring(60, 0, 5, not back))]
    areas = spark.createDataFrame([([{"hole": h, "points": p} for h, p in rings], True, 0.0)], "rings array<struct<hole:boolean,points:array<struct<x:double,y:double>>>>, closed boolean, margin double")
    assert spatial.outlined(areas).select(geo.sides_area(F.col("outline")).alias("a")).first().a == pytest.approx(1600 - 400 + 100)
    at = [(1, 0.0, 0.0), (2, 15.0, 0.0), (3, 60.0, 0.0), (4, 40.0, 0.0), (5, 0.0, 100.0)]
    points = spark.createDataFrame(at, "id long, mx double, my double")
    near = {r.id: r.distance for r in spatial.nearest_within(points, ["id"], areas, 50.0).collect()}
    assert near == pytest.approx({1: 10.0, 2: 0.0, 3: 0.0, 4: 15.0})  # in the hole its side is nearest
    share = {r.id: r.share for r in spatial.disc_share(points, ["id"], areas, 100.0).collect()}
    disc = math.pi * 10_000
    assert share[1] == pytest.approx(1300 / disc) and share[2] == pytest.approx(1300 / disc)
    small = {r.id: r.share for r in spatial.disc_share(points, ["id"], areas, 4.0).collect()}
    assert small.get(1, 0.0) == pytest.approx(0.0) and small[2] == pytest.approx(1.0) and small[3] == pytest.approx(1.0)


def test_regions_with_holes(spark):
    index = spark.createDataFrame([([{"properties": {"id": 7, "url": "/a"}, "geometry": {"coordinates": [[[float(p["x"]), float(p["y"])] for p in q] for q in (ring(0, 0, 1), ring(0, 0, 0.5))]}}],)], "features array<struct<properties:struct<id:long,url:string>,geometry:struct<coordinates:array<array<array<double>>>>>>")
    boxes = spark.createDataFrame([(1, -0.1, -0.1, 0.1, 0.1), (2, 0.6, 0.6, 0.8, 0.8), (3, 0.4, 0.8, 0.45, 0.9)], "box_id long, min_lat double, min_lon double, max_lat double, max_lon double")
    assert {r.box_id: r.region for r in spatial.containing_region(boxes, tables.region_catalogue(index)).collect()} == {1: None, 2: 7, 3: 7}


def test_feeds_in_grid_metres(spark):
    feed = spark.createDataFrame([("358500", "173000", "Dusk to dawn"), ("x", "1", None), (None, None, None)], "Easting string, Northing string, regime string")
    rows = tables.canonical_lights(feed, "bristol").collect()
    assert len(rows) == 1 and rows[0].lat == pytest.approx(51.4543, abs=2e-3) and rows[0].lon == pytest.approx(-2.5989, abs=2e-3) and rows[0].source == "bristol"
    with pytest.raises(ValueError, match="coordinates"):
        tables.canonical_lights(spark.createDataFrame([("1",)], "Easting string"), "x")
