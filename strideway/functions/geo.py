"""Geometry as column arithmetic: nothing here leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
#: WGS 84 ellipsoid and the transverse Mercator scale.
MAJOR, FLATTENING, SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996
#: Airy 1830, for the British national grid.
AIRY_MAJOR, AIRY_MINOR, OSGB_SCALE = 6_377_563.396, 6_356_256.909, 0.9996012717


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (arc-sine form)."""
    half = _haversine_square(lat1, lon1, lat2, lon2)
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * EARTH_RADIUS)


def haversine_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (two-argument arc-tangent form)."""
    half = _haversine_square(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(half), F.sqrt(F.greatest(1 - half, F.lit(0.0)))) * (2 * EARTH_RADIUS)


def _haversine_square(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a, b = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(p1) * F.cos(p2) * b * b


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ref_lat: Column) -> Column:
    """Flat distance in metres, with longitudes scaled at ``ref_lat``."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians(ref_lat))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_RADIUS


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def flat_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing in [0, 360) on a flat map scaled at the mean latitude."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(x, lat2 - lat1)) + 360.0, F.lit(360.0))


def bearing_difference(a: Column, b: Column) -> Column:
    """Signed turn from bearing ``a`` to ``b`` in [-180, 180)."""
    return F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0


def project_point(lat: Column, lon: Column, course: Column, distance: Column) -> tuple[Column, Column]:
    """Where one gets from (lat, lon) along a bearing: (lat, lon)."""
    p, t, d = F.radians(lat), F.radians(course), distance / EARTH_RADIUS
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), lon + F.degrees(turn)


def krueger_terms() -> tuple[float, float, float, list[float]]:
    """Eccentricity, third flattening's radius, central easting and the series of the transverse Mercator projection."""
    n = FLATTENING / (2 - FLATTENING)
    radius = MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    return math.sqrt(FLATTENING * (2 - FLATTENING)), radius, 500_000.0, series


def utm30(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres in UTM zone 30 north (central meridian 3 degrees west)."""
    t, dl = _conformal(lat), F.radians(lon + 3.0)
    return _transverse(*_angles(t, dl))


def utm30_line(line: Column) -> Column:
    """:func:`utm30` of an array of {lat, lon}, as {x, y}. Functions over arrays evaluate an expression as often as it is
    written, so each step is a pass of its own."""
    step = lambda **named: F.struct(*[c.alias(n) for n, c in named.items()])
    line = F.transform(line, lambda p: step(t=_conformal(p["lat"]), dl=F.radians(p["lon"] + 3.0)))
    line = F.transform(line, lambda p: step(**dict(zip(("xi", "eta"), _angles(p["t"], p["dl"]), strict=True))))
    return F.transform(line, lambda p: step(**dict(zip("xy", _transverse(p["xi"], p["eta"]), strict=True))))


def _conformal(lat: Column) -> Column:
    e, s = krueger_terms()[0], F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - F.atanh(s * e) * e)


def _angles(t: Column, dl: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(t * t + 1))


def _transverse(xi: Column, eta: Column) -> tuple[Column, Column]:
    _, radius, centre, series = krueger_terms()
    north, east = xi, eta
    for k, a in enumerate(series, 1):
        north = north + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * a
        east = east + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * a
    return east * (SCALE * radius) + centre, north * (SCALE * radius)


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in spherical Mercator metres."""
    return F.radians(lon) * MAJOR, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MAJOR


def tile_envelope(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(min_x, min_y, max_x, max_y) of a map tile in spherical Mercator metres."""
    half = math.pi * MAJOR
    size = F.lit(2 * half) / F.pow(F.lit(2.0), z)
    return size * x - half, F.lit(half) - size * (y + 1), size * (x + 1) - half, F.lit(half) - size * y


def osgb_to_wgs84(rows: DataFrame, easting: str, northing: str) -> DataFrame:
    """``rows`` with lat and lon of British national grid metres (inverse series, then a Helmert shift; a few metres).

    Each step is a column of its own, so that later steps refer to it instead of repeating its expression.
    """
    a, b, f0 = AIRY_MAJOR, AIRY_MINOR, OSGB_SCALE
    lat0, lon0, n0, e0 = math.radians(49), math.radians(-2), -100_000.0, 400_000.0
    e2, n = 1 - (b / a) ** 2, (a - b) / (a + b)
    wide, tall = F.col(easting), F.col(northing)

    def arc(lat: Column) -> Column:
        d, s = lat - lat0, lat + lat0
        return (
            d * (1 + n + 1.25 * n**2 + 1.25 * n**3)
            - F.sin(d) * F.cos(s) * (3 * n + 3 * n**2 + 21 / 8 * n**3)
            + F.sin(d * 2) * F.cos(s * 2) * (15 / 8 * (n**2 + n**3))
            - F.sin(d * 3) * F.cos(s * 3) * (35 / 24 * n**3)
        ) * (b * f0)

    rows = rows.withColumn("_p", (tall - n0) / (a * f0) + lat0)
    for _ in range(4):
        rows = rows.withColumn("_p", F.col("_p") + (tall - n0 - arc(F.col("_p"))) / (a * f0))
    rows = rows.withColumns({"_t": F.tan("_p"), "_sec": 1 / F.cos("_p"), "_s2": F.sin("_p") * F.sin("_p") * e2, "_de": wide - e0})
    rows = rows.withColumns({"_nu": F.lit(a * f0) / F.sqrt(1 - F.col("_s2")), "_rho": F.lit(a * f0 * (1 - e2)) / F.pow(1 - F.col("_s2"), F.lit(1.5))})
    t, de, nu, rho = (F.col(c) for c in ("_t", "_de", "_nu", "_rho"))
    eta = nu / rho - 1
    phi = F.col("_p") - de**2 * t / (rho * nu * 2) + de**4 * t / (rho * nu**3 * 24) * (t**2 * 3 + 5 + eta - t**2 * eta * 9) - de**6 * t / (rho * nu**5 * 720) * (t**2 * 90 + 61 + t**4 * 45)
    lam = de * F.col("_sec") / nu - de**3 * F.col("_sec") / (nu**3 * 6) * (nu / rho + t**2 * 2) + de**5 * F.col("_sec") / (nu**5 * 120) * (t**2 * 28 + 5 + t**4 * 24) + lon0
    rows = rows.withColumns({"_phi": phi, "_lam": lam})
    flat = F.lit(a) / F.sqrt(1 - F.sin("_phi") * F.sin("_phi") * e2)
    rows = rows.withColumns({"_x": flat * F.cos("_phi") * F.cos("_lam"), "_y": flat * F.cos("_phi") * F.sin("_lam"), "_z": flat * (1 - e2) * F.sin("_phi")})
    # fixed values of the transformation between the two datums: metres, parts per million, seconds of arc
    tx, ty, tz, ppm, rx, ry, rz = 446.448, -125.157, 542.060, -20.4894, 0.1502, 0.2470, 0.8421
    rx, ry, rz, m = (*(math.radians(v / 3600) for v in (rx, ry, rz)), 1 + ppm / 1e6)
    x, y, z = (F.col(c) for c in ("_x", "_y", "_z"))
    rows = rows.withColumns({"_x2": x * m - y * rz + z * ry + tx, "_y2": x * rz + y * m - z * rx + ty, "_z2": y * rx - x * ry + z * m + tz})
    w2 = FLATTENING * (2 - FLATTENING)
    rows = rows.withColumn("_q", F.hypot("_x2", "_y2")).withColumn("_p", F.atan2(F.col("_z2"), F.col("_q") * (1 - w2)))
    for _ in range(4):
        rows = rows.withColumn("_p", F.atan2(F.col("_z2") + F.lit(MAJOR * w2) / F.sqrt(1 - F.sin("_p") * F.sin("_p") * w2) * F.sin("_p"), F.col("_q")))
    rows = rows.withColumns({"lat": F.degrees("_p"), "lon": F.degrees(F.atan2(F.col("_y2"), F.col("_x2")))})
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def ring_edges(ring: Column) -> Column:
    """The edges of a ring of points {x, y}: an array of {a, b}; the last point is joined to the first."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), shifted.alias("b"))


def line_edges(line: Column) -> Column:
    """The edges of an open line of points {x, y}."""
    return F.slice(ring_edges(line), F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))


def area_sides(rings: Column, closed: Column) -> Column:
    """The sides {a, b} of all rings {hole, points} of an area in a row: those of its parts go anticlockwise, those of its
    holes clockwise, whatever way their points go, so that sums over sides count holes off. Of an open line, its sides."""

    def turned(ring: Column) -> Column:
        sides = F.when(closed, ring_edges(ring["points"])).otherwise(line_edges(ring["points"]))
        wrong = closed & ((signed_ring_area(ring["points"]) > 0) == F.coalesce(ring["hole"], F.lit(False)))
        return F.when(wrong, F.transform(sides, lambda e: F.struct(e["b"].alias("a"), e["a"].alias("b")))).otherwise(sides)

    return F.flatten(F.transform(rings, turned))


def inside_sides(px: Column, py: Column, sides: Column) -> Column:
    """Whether a point is inside an area, by counting crossings with the sides of all its rings."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(sides, crosses)) % 2 == 1


def sides_area(sides: Column) -> Column:
    """The area of an area of :func:`area_sides`, without its holes."""
    x0, y0 = sides[0]["a"]["x"], sides[0]["a"]["y"]
    cross = lambda e: (e["a"]["x"] - x0) * (e["b"]["y"] - y0) - (e["b"]["x"] - x0) * (e["a"]["y"] - y0)
    return total(F.transform(sides, cross)) / 2


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is inside a ring."""
    return inside_sides(px, py, ring_edges(ring))


def signed_ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace formula, negative if its points go clockwise."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    return F.aggregate(F.transform(ring_edges(ring), cross), F.lit(0.0), lambda s, x: s + x) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_ring_area(ring))


def disc_side_area(cx: Column, cy: Column, radius: float, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed area between a point and one side of a ring, within ``radius`` of the point: exact, as sectors and a
    triangle. Over all sides of a ring that goes anticlockwise they add up to its part of the disc."""
    own = {"cx": cx, "cy": cy, "ax": ax, "ay": ay, "bx": bx, "by": by}
    for made in _disc_steps(radius):
        own = own | made(own)
    return own["part"]


def with_disc_parts(rows: DataFrame, radius: float) -> DataFrame:
    """``rows`` (cx, cy, ax, ay, bx, by) with ``part``, see :func:`disc_side_area`. Each step is columns of its own, so that
    later steps refer to them instead of repeating their expressions, which grow with each."""
    for made in _disc_steps(radius):
        rows = rows.withColumns(made({c: F.col(c) for c in rows.columns}))
    return rows


def _disc_steps(radius: float) -> list[Callable[[dict[str, Column]], dict[str, Column]]]:
    r2 = radius * radius

    def sector(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
        return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy) * (r2 / 2)

    def cut(c: dict[str, Column]) -> Column:
        ends = [sector(c["ux"], c["uy"], c["px"], c["py"]), sector(c["qx"], c["qy"], c["wx"], c["wy"])]
        whole = ends[0] + (c["px"] * c["qy"] - c["py"] * c["qx"]) / 2 + ends[1]
        return F.when(c["square"] == 0, 0.0).when((c["root"] <= 0) | (c["t1"] >= c["t2"]), sector(c["ux"], c["uy"], c["wx"], c["wy"])).otherwise(whole)

    share = lambda of: F.greatest(F.lit(0.0), F.least(F.lit(1.0), of))
    return [
        lambda c: {"dx": c["bx"] - c["ax"], "dy": c["by"] - c["ay"], "ux": c["ax"] - c["cx"], "uy": c["ay"] - c["cy"], "wx": c["bx"] - c["cx"], "wy": c["by"] - c["cy"]},
        lambda c: {"square": c["dx"] * c["dx"] + c["dy"] * c["dy"], "along": c["ux"] * c["dx"] + c["uy"] * c["dy"]},
        lambda c: {"root": c["along"] * c["along"] - c["square"] * (c["ux"] * c["ux"] + c["uy"] * c["uy"] - r2), "by_square": F.when(c["square"] == 0, 1.0).otherwise(c["square"])},
        lambda c: {"far": F.sqrt(F.greatest(c["root"], F.lit(0.0)))},
        lambda c: {"t1": share((-c["along"] - c["far"]) / c["by_square"]), "t2": share((c["far"] - c["along"]) / c["by_square"])},
        lambda c: {"px": c["ux"] + c["t1"] * c["dx"], "py": c["uy"] + c["t1"] * c["dy"], "qx": c["ux"] + c["t2"] * c["dx"], "qy": c["uy"] + c["t2"] * c["dy"]},
        lambda c: {"part": cut(c)},
    ]


def disc_ring_area(cx: Column, cy: Column, radius: float, ring: Column) -> Column:
    """Area of the part of a ring within ``radius`` of a point, by :func:`disc_side_area`."""
    part = lambda e: disc_side_area(cx, cy, radius, *(e[p][c] for p in "ab" for c in "xy"))
    return F.abs(F.aggregate(F.transform(ring_edges(ring), part), F.lit(0.0), lambda s, x: s + x))


def line_sides(line: Column) -> Column:
    """The sides of an open line of points {x, y} as {ax, ay, bx, by, length}."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    side = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("length"))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), side)


def line_lengths(line: Column) -> Column:
    """The lengths of a line's sides."""
    return F.transform(line_edges(line), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def running_totals(values: Column) -> Column:
    """0, then the sum of the first value, of the first two, ... of all."""
    return F.aggregate(values, F.array(F.lit(0.0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def isovist_samples(length: Column) -> Column:
    """How many isovist samples a line of this length gets: 1 below a metre, 2 below 100 m, else one each 50 m."""
    return F.when(length < 1, 1).when(length < 100, 2).otherwise((F.floor(length / 50) + 1).cast("int"))
