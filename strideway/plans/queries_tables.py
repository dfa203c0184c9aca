"""Queries over scans, sinks, scalar functions, filters and tiles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.functions import geo, text
from strideway.operators import filters, spatial, tiles
from strideway.operators.materialise import scratch, written
from strideway.plans.net_sql import bearing, hav
from strideway.sources import tables

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def r(column, digits: int = 6):
    return F.round(column, digits)


BOX = (51.41, -2.64, 51.43, -2.60)


@query(f"SELECT e.highway, count(*) AS n, round(sum(length), 3) AS metres FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v WHERE a.lat BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND a.lon BETWEEN {BOX[1]}::DOUBLE AND {BOX[3]}::DOUBLE AND b.lat BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND b.lon BETWEEN {BOX[1]}::DOUBLE AND {BOX[3]}::DOUBLE GROUP BY 1")
def scan_network_box(net) -> DataFrame:
    _, edges = tables.scan_network(net.nodes, net.edges, BOX)
    return edges.groupBy("highway").agg(F.count(F.lit(1)).alias("n"), r(F.sum("length"), 3).alias("metres"))


FEATURES = """WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE ['Polygon', 'MultiPolygon', 'LineString', 'Point'][p_partkey % 4 + 1] END AS geom_type,
['grass', 'forest', 'reservoir', NULL, NULL, 'residential', 'meadow'][p_partkey % 7 + 1] AS landuse, ['wood', NULL, 'water', NULL, 'scrub', 'wetland', NULL, NULL, 'cliff'][p_partkey % 9 + 1] AS nat,
['park', NULL, NULL, 'garden', NULL, 'pitch', NULL, NULL][p_partkey % 8 + 1] AS leisure, CASE WHEN p_partkey % 10 = 0 THEN 'river' WHEN p_partkey % 10 = 5 THEN 'drain' WHEN p_partkey % 10 = 3 THEN 'weir' END AS waterway,
['cafe', NULL, NULL, 'bench', NULL, 'pub'][p_partkey % 6 + 1] AS amenity, p_partkey % 11 = 0 AS shop, [NULL, NULL, 'museum', NULL, 'hotel'][p_partkey % 5 + 1] AS tourism, p_partkey % 14 = 0 AS castle FROM part) """
_GREEN = "(coalesce(landuse IN ('grass', 'forest', 'meadow'), false) OR coalesce(nat IN ('wood', 'scrub'), false) OR coalesce(leisure IN ('park', 'garden'), false))"
_WATER = "(coalesce(nat IN ('water', 'wetland'), false) OR coalesce(landuse = 'reservoir', false) OR waterway IS NOT NULL)"


@query(FEATURES + f"SELECT CASE WHEN {_WATER} THEN 'water' WHEN {_GREEN} THEN 'green' ELSE 'poi' END AS feature_group, count(*) AS n, sum(k)::BIGINT AS ids FROM f WHERE geom_type IS NOT NULL AND ({_WATER} AND coalesce(waterway, '') <> 'weir' OR coalesce(nat IN ('water', 'wetland'), false) OR coalesce(landuse = 'reservoir', false) OR {_GREEN} OR amenity IS NOT NULL OR shop OR tourism IS NOT NULL) GROUP BY 1")
def scan_feature_groups(net) -> DataFrame:
    return tables.grouped_features(net.features).groupBy("feature_group").agg(F.count(F.lit(1)).alias("n"), F.sum("geom_id").alias("ids"))


@query(FEATURES + f"SELECT k AS geom_id, geom_type FROM f WHERE {_GREEN} AND geom_type IN ('Polygon', 'MultiPolygon')")
def scan_green_areas(net) -> DataFrame:
    return tables.green_areas(net.features).select("geom_id", "geom_type")


@query(FEATURES + f"SELECT k AS geom_id, CASE WHEN geom_type = 'LineString' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS margin FROM f WHERE geom_type IS NOT NULL AND (coalesce(nat IN ('water', 'wetland'), false) OR coalesce(landuse = 'reservoir', false) OR coalesce(waterway = 'river', false))")
def scan_water_features(net) -> DataFrame:
    return tables.water_features(net.features).select("geom_id", "margin")


@query(FEATURES + "SELECT k AS geom_id FROM f WHERE geom_type IS NOT NULL AND (coalesce(tourism = 'museum', false) OR coalesce(amenity IN ('cafe', 'pub'), false) OR castle)")
def scan_points_of_interest(net) -> DataFrame:
    return tables.points_of_interest(net.features).select("geom_id")


@query("SELECT kind, count(*) AS n, sum(corners)::BIGINT AS corners FROM shapes WHERE kind = 'building' GROUP BY 1")
def scan_buildings(net) -> DataFrame:
    return net.polygons.where("kind = 'building'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("points")).alias("corners"))


@query("SELECT source, count(*) AS n, round(sum(y - floor(y)), 3) AS part FROM (SELECT source, y FROM lights UNION ALL SELECT source, y + 1 FROM lights WHERE light_id % 2 = 0) GROUP BY 1")
def scan_street_lights(net) -> DataFrame:
    point = lambda dy: F.struct("x", (F.col("y") + dy).alias("y"))
    rows = net.lights.withColumn("points", F.when(F.col("light_id") % 2 == 0, F.array(point(0), point(1))).otherwise(F.array(point(0))))
    return tables.street_lights(rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("y") - F.floor("y")), 3).alias("part"))


@query(
    """SELECT source, lighting_regime, count(*) AS n FROM (SELECT DISTINCT source, lat, lon, lighting_regime FROM (
    SELECT 'north' AS source, n.lat, n.lon, CASE event_type WHEN 'view' THEN 'part_night' WHEN 'click' THEN 'all_night' WHEN 'signup' THEN 'solar' WHEN 'purchase' THEN 'timed_window' ELSE 'unknown' END AS lighting_regime
    FROM events, size JOIN nodes n ON n.node_id = event_id * 13 % size.n WHERE event_id % 2 = 0)
    UNION ALL SELECT DISTINCT 'south', n.lat, n.lon, 'unknown' FROM events, size JOIN nodes n ON n.node_id = event_id * 13 % size.n WHERE event_id % 2 = 1) GROUP BY 1, 2"""
)
def council_feeds_combined(net) -> DataFrame:
    rows = net.lights
    north = tables.canonical_lights(rows.where("light_id % 2 = 0").select(F.col("lat").cast("string").alias("Site_Latitude"), F.col("lon").alias("Site Longitude"), F.col("lighting_regime_text").alias("Burning Hours")), "north")
    south = tables.canonical_lights(rows.where("light_id % 2 = 1").select("lat", F.col("lon").alias("Long")), "south").drop("lighting_regime")
    return tables.combined_lights(north.dropDuplicates(["lat", "lon", "lighting_regime"]).withColumn("lit", F.col("lighting_regime")), south).groupBy("source", "lighting_regime").agg(F.count(F.lit(1)).alias("n"))


def _hole(a: str, b: str) -> str:
    """Whether a point is in the hole of a region."""
    return f"({a} > x + 0.4::DOUBLE * w AND {a} < x + 0.6::DOUBLE * w AND {b} > y + 0.4::DOUBLE * w AND {b} < y + 0.6::DOUBLE * w)"


@query(
    """WITH c AS (SELECT r_regionkey AS id, -2.66::DOUBLE + 0.02 * r_regionkey AS x, 51.39::DOUBLE AS y, 0.05::DOUBLE + 0.01 * r_regionkey AS w FROM region),
    b AS (SELECT s_suppkey AS box_id, n.lat AS y1, n.lon AS x1, n.lat + 0.004::DOUBLE AS y2, n.lon + 0.004::DOUBLE AS x2 FROM supplier, size JOIN nodes n ON n.node_id = s_suppkey * 149 % size.n)
    SELECT b.box_id, coalesce(arg_min(id, (w, id)) FILTER (x1 > x AND x2 < x + w AND y1 > y AND y2 < y + w AND NOT (h(x1, y1, x, y, w) OR h(x2, y1, x, y, w) OR h(x1, y2, x, y, w) OR h(x2, y2, x, y, w))),
    arg_min(id, (w, id)) FILTER ((x1 + x2) / 2 > x AND (x1 + x2) / 2 < x + w AND (y1 + y2) / 2 > y AND (y1 + y2) / 2 < y + w AND NOT h((x1 + x2) / 2, (y1 + y2) / 2, x, y, w))) AS region FROM b, c GROUP BY 1""".replace(
        "NOT (h(x1, y1, x, y, w) OR h(x2, y1, x, y, w) OR h(x1, y2, x, y, w) OR h(x2, y2, x, y, w))", "NOT (" + " OR ".join(_hole(a, b) for a in ("x1", "x2") for b in ("y1", "y2")) + ")"
    ).replace("h((x1 + x2) / 2, (y1 + y2) / 2, x, y, w)", _hole("(x1 + x2) / 2", "(y1 + y2) / 2"))
)
def smallest_region(net) -> DataFrame:
    """Regions are squares with a square hole."""
    key = F.col("r_regionkey")
    x, w = key * 0.02 - 2.66, key * 0.01 + 0.05
    corner = lambda dx, dy: F.array(x + w * dx, w * dy + 51.39)
    feature = F.struct(F.struct(key.alias("id"), F.concat(F.lit("/"), "r_name").alias("url")).alias("properties"), F.struct(F.array(*[F.array(*[corner(x, y) for x, y in ((a, a), (b, a), (b, b), (a, b))]) for a, b in ((0.0, 1.0), (0.4, 0.6))]).alias("coordinates")).alias("geometry"))
    path = scratch(net.spark, "catalogue")
    net.table("region").select(F.array(feature).alias("features")).write.json(path)
    schema = "features array<struct<properties: struct<id: long, url: string>, geometry: struct<coordinates: array<array<array<double>>>>>>"
    regions = tables.region_catalogue(net.spark.read.schema(schema).json(path)).select("id", "rings")
    start = net.requests.join(net.nodes, F.col("start") == F.col("node_id"))
    boxes = start.select(F.col("request_id").alias("box_id"), F.col("lat").alias("min_lat"), F.col("lon").alias("min_lon"), (F.col("lat") + 0.004).alias("max_lat"), (F.col("lon") + 0.004).alias("max_lon"))
    return spatial.containing_region(boxes, regions)


@query(
    "WITH d AS (SELECT floor(lat * 3600) AS a, floor(lon * 3600) AS b, max(elevation) AS value FROM nodes GROUP BY 1, 2) SELECT n.node_id, round(d.value, 4) AS value FROM nodes n JOIN d ON floor(n.lat * 3600) = a AND floor(n.lon * 3600) = b"
)
def raster_lookup(net) -> DataFrame:
    return spatial.raster_values(net.nodes.select("node_id", "lat", "lon"), net.dem).select("node_id", r("value", 4).alias("value"))


@query("SELECT format('{:.2f}_{:.2f}', round_even(lat / (15 / 111.0::DOUBLE), 0) * (15 / 111.0::DOUBLE), round_even(lon / (15 / 111.0::DOUBLE), 0) * (15 / 111.0::DOUBLE)) AS tile_id, count(*) AS n_edges FROM edges e JOIN nodes ON node_id = u WHERE highway <> 'construction' GROUP BY 1")
def tile_store_counts(net) -> DataFrame:
    own = net.nodes.select(F.col("node_id").alias("u"), tiles.tile_id(F.col("lat"), F.col("lon")).alias("tile_id"))
    rows = net.edges.select("u", "v", "key", "highway").join(own, "u").withColumns({"region": F.lit("west"), "modes": F.lit("fast")})
    path = scratch(net.spark, "tiles")
    tables.write_tiles(rows, path)
    return tables.read_tiles(net.spark, path, "west", "fast").where("highway <> 'construction'").groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_edges"))


@query("SELECT t AS tile_id, count(DISTINCT node) AS n_nodes, (count(*) // 2)::BIGINT AS n_edges FROM (SELECT 'T' || (u // 1000) AS t, unnest([u, v]) AS node FROM edges) GROUP BY 1")
def build_summary(net) -> DataFrame:
    return tables.tile_stats(net.edges.select("u", "v", F.concat(F.lit("T"), F.floor(F.col("u") / 1000).cast("string")).alias("tile_id")))


_LIT = "CASE WHEN lit = 'yes' THEN 'lit' WHEN lit = 'no' THEN 'unlit' ELSE 'unknown' END"


@query(f"SELECT {_LIT} AS lit_status, CASE WHEN lit = 'yes' THEN 'all_night' WHEN lit = 'no' THEN 'unlit' ELSE 'unknown' END AS lighting_regime, coalesce(lit, 'unknown') AS lighting_regime_text, count(*) AS n FROM edges WHERE highway IS NOT NULL GROUP BY ALL")
def way_lighting(net) -> DataFrame:
    return tables.way_lighting_table(net.edges).groupBy("lit_status", "lighting_regime", "lighting_regime_text").agg(F.count(F.lit(1)).alias("n"))


_MERC = "(radians({lon}) * 6378137.0::DOUBLE)", "(ln(tan(radians({lat}) / 2 + pi() / 4)) * 6378137.0::DOUBLE)"


@query(
    f"""WITH m AS (SELECT key, {_MERC[0].format(lon='u_lon')} AS ax, {_MERC[1].format(lat='u_lat')} AS ay, {_MERC[0].format(lon='v_lon')} AS bx, {_MERC[1].format(lat='v_lat')} AS by_ FROM geo_edges WHERE coalesce(lit, 'unknown') <> 'no'),
    h AS (SELECT *, pi() * 6378137.0::DOUBLE AS half, 2 * pi() * 6378137.0::DOUBLE / 32768 AS size FROM m),
    t AS (SELECT *, unnest(range(floor((least(ax, bx) + half) / size)::BIGINT, floor((greatest(ax, bx) + half) / size)::BIGINT + 1)) AS tx FROM h),
    t2 AS (SELECT *, unnest(range(floor((half - greatest(ay, by_)) / size)::BIGINT, floor((half - least(ay, by_)) / size)::BIGINT + 1)) AS ty FROM t),
    s AS (SELECT *, list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda c: sign((bx - ax) * (half - size * (ty + c[2]) - ay) - (by_ - ay) * (size * (tx + c[1]) - half - ax))) AS sides FROM t2)
    SELECT 15 AS z, tx::INTEGER AS tile_x, ty::INTEGER AS tile_y, count(*) AS n FROM s WHERE list_min(sides) <= 0 AND list_max(sides) >= 0 GROUP BY ALL"""
)
def overlay_rows(net) -> DataFrame:
    table = tables.overlay_filter(tables.way_lighting_table(net.edges), "osm").where("lit_status <> 'unlit'").select("u", "v", "key")
    path = scratch(net.spark, "overlay")
    tables.write_map_tiles(tables.overlay_tiles(spatial.with_endpoints(table, net.nodes).select("u", "v", "key", "u_lat", "u_lon", "v_lat", "v_lon"), 15), path)
    return net.spark.read.parquet(path).groupBy("z", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT request_id, coalesce(distance, 0) AS distance, greenness, slope FROM requests")
def saved_request_weights(net) -> DataFrame:
    names = ["distance", "greenness", "water", "social", "quietness", "slope"]
    rows = net.requests.select("request_id", F.to_json(F.struct(*names)).alias("weights_json"))
    return tables.saved_requests(rows).select("request_id", "distance", "greenness", "slope")


_R = ("start_lat", "start_lon", "end_lat", "end_lon")


@query(f"SELECT request_id, round({hav(*_R)}, 4) AS far, round({bearing(*_R)}, 6) AS course, round((({bearing(*_R)} - 350 + 540) % 360) - 180, 6) AS turn FROM requests")
def distances_and_bearings(net) -> DataFrame:
    args = [F.col(c) for c in _R]
    course = geo.bearing(*args)
    return net.requests.select("request_id", r(geo.haversine(*args), 4).alias("far"), r(course).alias("course"), r(geo.bearing_difference(F.lit(350.0), course)).alias("turn"))


@query(f"SELECT request_id, round(6371000 * sqrt(pow(radians(end_lon - start_lon) * cos(radians(start_lat)), 2) + pow(radians(end_lat - start_lat), 2)), 4) AS flat, round({hav(*_R)}, 4) AS far FROM requests")
def flat_distances(net) -> DataFrame:
    args = [F.col(c) for c in _R]
    return net.requests.select("request_id", r(geo.equirectangular(*args, F.col("start_lat")), 4).alias("flat"), r(geo.haversine_atan2(*args), 4).alias("far"))


@query("SELECT node_id, round(x, 3) AS x, round(y, 3) AS y FROM nodes")
def projected_nodes(net) -> DataFrame:
    return net.nodes.select("node_id", r("x", 3).alias("x"), r("y", 3).alias("y"))


@query(
    """WITH p AS (SELECT request_id, radians(start_lat) AS a, start_lon AS o, radians(request_id * 7 % 360) AS t, (500 + request_id)::DOUBLE / 6371000 AS d FROM requests),
    q AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t)) AS b FROM p)
    SELECT request_id, round(degrees(b), 8) AS lat, round(o + degrees(atan2(sin(t) * sin(d) * cos(a), cos(d) - sin(a) * sin(b))), 8) AS lon FROM q"""
)
def projected_points(net) -> DataFrame:
    k = F.col("request_id")
    a, b = geo.project_point(F.col("start_lat"), F.col("start_lon"), (k * 7 % 360).cast("double"), (k + 500).cast("double"))
    return net.requests.select("request_id", r(a, 8).alias("lat"), r(b, 8).alias("lon"))


def _grid_sql() -> str:
    """The inverse series of the national grid and the shift between datums, a column for each step."""
    a, b, f0 = geo.AIRY_MAJOR, geo.AIRY_MINOR, geo.OSGB_SCALE
    n, e2 = (a - b) / (a + b), 1 - (b / a) ** 2
    d = lambda x: f"{x!r}::DOUBLE"
    lat0 = d(math.radians(49))
    terms = [(d(1 + n + 1.25 * n * n + 1.25 * n**3), None), (d(3 * n + 3 * n * n + 21 / 8 * n**3), 1), (d(15 / 8 * (n * n + n**3)), 2), (d(35 / 24 * n**3), 3)]
    arc = lambda p: f"({d(b * f0)} * ({terms[0][0]} * ({p} - {lat0}) - {terms[1][0]} * sin({p} - {lat0}) * cos({p} + {lat0}) + {terms[2][0]} * sin(2 * ({p} - {lat0})) * cos(2 * ({p} + {lat0})) - {terms[3][0]} * sin(3 * ({p} - {lat0})) * cos(3 * ({p} + {lat0}))))"
    steps = [("p0", f"(north + 100000) / {d(a * f0)} + {lat0}")] + [(f"p{i + 1}", f"p{i} + (north + 100000 - {arc(f'p{i}')}) / {d(a * f0)}") for i in range(4)]
    steps += [("t", "tan(p4)"), ("nu", f"{d(a * f0)} / sqrt(1 - {d(e2)} * pow(sin(p4), 2))"), ("rho", f"{d(a * f0 * (1 - e2))} / pow(1 - {d(e2)} * pow(sin(p4), 2), 1.5)"), ("k", "east - 400000")]
    steps += [("phi", "p4 - k*k*t/(2*rho*nu) + pow(k,4)*t/(24*rho*pow(nu,3))*(5 + 3*t*t + (nu/rho-1) - 9*t*t*(nu/rho-1)) - pow(k,6)*t/(720*rho*pow(nu,5))*(61 + 90*t*t + 45*pow(t,4))")]
    steps += [("lam", f"{d(math.radians(-2))} + (k/nu - pow(k,3)/(6*pow(nu,3))*(nu/rho + 2*t*t) + pow(k,5)/(120*pow(nu,5))*(5 + 28*t*t + 24*pow(t,4))) / cos(p4)")]
    steps += [("fl", f"{d(a)} / sqrt(1 - {d(e2)} * pow(sin(phi), 2))"), ("x", "fl * cos(phi) * cos(lam)"), ("y", "fl * cos(phi) * sin(lam)"), ("z", f"fl * {d(1 - e2)} * sin(phi)")]
    # fixed values of the transformation between the two datums: metres, parts per million, seconds of arc
    tx, ty, tz, ppm, rx, ry, rz = 446.448, -125.157, 542.060, -20.4894, 0.1502, 0.2470, 0.8421
    rx, ry, rz, m = *(d(math.radians(v / 3600)) for v in (rx, ry, rz)), d(1 + ppm / 1e6)
    w2 = geo.FLATTENING * (2 - geo.FLATTENING)
    steps += [("x2", f"x * {m} - y * {rz} + z * {ry} + {d(tx)}"), ("y2", f"x * {rz} + y * {m} - z * {rx} + {d(ty)}"), ("z2", f"y * {rx} - x * {ry} + z * {m} + {d(tz)}"), ("h", "sqrt(x2*x2 + y2*y2)"), ("q0", f"atan2(z2, h * {d(1 - w2)})")]
    steps += [(f"q{i + 1}", f"atan2(z2 + {d(geo.MAJOR * w2)} / sqrt(1 - {d(w2)} * pow(sin(q{i}), 2)) * sin(q{i}), h)") for i in range(4)]
    sql = "SELECT o_orderkey AS node_id, 350000.0::DOUBLE + o_orderkey % 997 AS east, 170000.0::DOUBLE + o_orderkey % 1009 AS north FROM orders"
    for name, formula in steps:
        sql = f"SELECT *, {formula} AS {name} FROM ({sql})"
    return f"SELECT node_id, round(degrees(q4), 6) AS lat, round(degrees(atan2(y2, x2)), 6) AS lon FROM ({sql})"


@query(_grid_sql())
def grid_to_degrees(net) -> DataFrame:
    rows = net.nodes.select("node_id", (F.lit(350_000.0) + F.col("node_id") % 997).alias("easting"), (F.lit(170_000.0) + F.col("node_id") % 1009).alias("northing"))
    return geo.osgb_to_wgs84(rows, "easting", "northing").select("node_id", r("lat").alias("lat"), r("lon").alias("lon"))


@query(
    """SELECT s.u, s.v, s.key, count(*) AS n, round(sum(sqrt(pow(s.mx - ux, 2) + pow(s.my - uy, 2))), 3) AS reach FROM samples s JOIN geo_edges e ON s.u = e.u AND s.v = e.v AND s.key = e.key GROUP BY 1, 2, 3"""
)
def sampled_lines(net) -> DataFrame:
    return _sampled(net, net.edges, ["u", "v", "key"])


def _sampled(net, edges: DataFrame, keys: list[str]) -> DataFrame:
    from strideway.operators import enrich

    # a line is placed and sampled once for all edges along it, from each of its ends; edges meet what was found
    lines, back = spatial.placed_lines(edges, net.nodes), F.col("u") > F.col("v")
    ends = F.explode(F.array(*[F.struct(F.lit(b).alias("back"), line.alias("points"), F.col(f"{e}x").alias("ox"), F.col(f"{e}y").alias("oy")) for b, line, e in ((False, F.col("points"), "u"), (True, F.reverse("points"), "v"))]))
    own = [*spatial.SHAPE, "back"]
    rows = enrich.edge_samples(lines.select(*spatial.SHAPE, ends.alias("o")).select(*spatial.SHAPE, "o.*"), [*own, "ox", "oy"], enrich.each_20_metres)
    found = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.hypot(F.col("mx") - F.col("ox"), F.col("my") - F.col("oy"))), 3).alias("reach"))
    return edges.withColumns(spatial.shape_keys(edges) | {"back": back}).select(*keys, *own).join(found, own).select(*keys, "n", "reach")


@query("SELECT geom_id, round(abs(sum((ax - nx) * (\"by\" - ny) - (bx - nx) * (ay - ny))) / 2, 2) AS area FROM sides WHERE kind = 'green' GROUP BY 1")
def polygon_areas(net) -> DataFrame:
    areas = spatial.outlined(net.polygons.where("kind = 'green'"))
    return areas.select("geom_id", r(geo.sides_area(F.col("outline")), 2).alias("area"))


_WALK = """NOT (highway IN ('motorway', 'construction') OR coalesce(area = 'yes', false)) AND NOT (highway IN ('cycleway', 'trunk') AND NOT (coalesce(foot IN ('yes', 'designated', 'permissive'), false) OR coalesce(designation = 'public_footpath', false)))
AND NOT (coalesce(foot = 'no', false) OR ((coalesce(access = 'private', false) OR (highway = 'service' AND coalesce(service = 'driveway', false))) AND NOT coalesce(foot IN ('yes', 'permissive', 'designated'), false)))"""
_GATES = "SELECT node_id FROM nodes WHERE barrier = 'gate' AND (locked = 'yes' OR access = 'private')"


@query(f"SELECT highway, count(*) AS n, round(sum(length), 3) AS metres FROM edges WHERE {_WALK} AND u NOT IN ({_GATES}) AND v NOT IN ({_GATES}) GROUP BY 1")
def walking_filter(net) -> DataFrame:
    return filters.walkable(net.edges, net.nodes).groupBy("highway").agg(F.count(F.lit(1)).alias("n"), r(F.sum("length"), 3).alias("metres"))


@query(f"SELECT count(*) AS n_edges, count(*) FILTER ({_WALK} AND u NOT IN ({_GATES}) AND v NOT IN ({_GATES})) AS n_kept, count(*) FILTER (NOT ({_WALK} AND u NOT IN ({_GATES}) AND v NOT IN ({_GATES}))) AS n_removed FROM edges")
def walking_filter_report(net) -> DataFrame:
    """Counted while the walkable edges are written."""
    kept, report = filters.counted_walkable(net.edges, net.nodes)
    written(kept, "walkable")
    return net.spark.createDataFrame([report()], "n_edges long, n_kept long, n_removed long")


@query(_GATES)
def impassable_gates(net) -> DataFrame:
    return filters.restricted_nodes(net.nodes)


@query("WITH b AS (SELECT min(least(ux, vx)) AS a, max(greatest(ux, vx)) AS b, min(least(uy, vy)) AS c, max(greatest(uy, vy)) AS d FROM geo_edges) SELECT light_id FROM lights, b WHERE x BETWEEN a - 15 AND b + 15 AND y BETWEEN c - 15 AND d + 15")
def lights_in_bounds(net) -> DataFrame:
    return filters.in_padded_bounds(net.lights, spatial.with_endpoints(net.edges, net.nodes), 15.0).select("light_id")


@query("WITH k AS (SELECT * FROM edges WHERE NOT (coalesce(access = 'private', false) OR coalesce(service = 'driveway', false) OR coalesce(sidewalk = 'separate', false))) SELECT node_id FROM nodes WHERE node_id IN (SELECT u FROM k) OR node_id IN (SELECT v FROM k) OR node_id = 0")
def quiet_network_nodes(net) -> DataFrame:
    footway = F.when(F.col("sidewalk") == "separate", "sidewalk")
    return filters.quiet_network(net.edges.withColumn("footway", footway), net.nodes, 0)[1].select("node_id")


@query("WITH k AS (SELECT node_id FROM nodes WHERE 6371000 * sqrt(pow(radians(lon - (-2.62)::DOUBLE) * cos(radians(51.42::DOUBLE)), 2) + pow(radians(lat - 51.42::DOUBLE), 2)) <= 2500) SELECT count(*) AS n FROM edges WHERE u IN (FROM k) AND v IN (FROM k)")
def cropped_edges(net) -> DataFrame:
    return filters.crop(net.nodes, net.edges, 51.42, -2.62, 5.0)[1].agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT request_id, list_filter([CASE WHEN is_loop AND NOT (target_m / 1000 BETWEEN 1 AND 30) THEN 'target' END, CASE WHEN profile = 'flying' THEN 'profile' END, CASE WHEN request_id % 5 = 4 THEN 'bias' END], lambda x: x IS NOT NULL) AS errors FROM requests)
    SELECT request_id, array_to_string(errors, ',') AS errors FROM e WHERE len(errors) > 0"""
)
def invalid_requests(net) -> DataFrame:
    bias = F.element_at(F.array(*[F.lit(b) for b in ("north", "NONE", "west", "east", "up")]), (F.col("request_id") % 5).cast("int") + 1)
    rows = net.requests.withColumn("bias", bias).withColumn("errors", filters.request_errors())
    return rows.where(F.size("errors") > 0).select("request_id", F.concat_ws(",", "errors").alias("errors"))


@query(
    """WITH p AS (SELECT s_suppkey AS id, s_suppkey % 12 AS w, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 25 END AS e, s_suppkey % 34 AS r, s_suppkey % 6 = 5 AS bad_time FROM supplier),
    x AS (SELECT *, CASE WHEN w = 0 THEN 'not positive' WHEN w > 9 THEN 'too fast' END AS ew, CASE WHEN e IS NULL THEN NULL WHEN e = 0 THEN 'not positive' WHEN e > 20 THEN 'too fast' END AS ee, CASE WHEN r = 0 THEN 'not positive' WHEN r > 30 THEN 'too fast' END AS er FROM p),
    y AS (SELECT *, CASE WHEN (CASE WHEN er IS NULL THEN r ELSE 12.5 END) < (CASE WHEN ee IS NULL THEN coalesce(e, 9.5) ELSE 9.5 END) THEN 'slower than easy' ELSE er END AS er2 FROM x)
    SELECT id AS request_id, concat_ws(';', 'walking_speed_kmh ' || ew, 'running_easy_speed_kmh ' || ee, 'running_race_speed_kmh ' || er2, CASE WHEN bad_time THEN 'client_updated_at no time' END) AS errors FROM y"""
)
def preference_validation(net) -> DataFrame:
    k = F.col("request_id")
    rows = net.requests.select(
        k, (k % 12).cast("string").alias("walking_speed_kmh"), F.when(k % 7 != 0, (k % 25).cast("string")).alias("running_easy_speed_kmh"), (k % 34).cast("string").alias("running_race_speed_kmh"),
        F.when(k % 6 == 5, "soon").otherwise("2026-01-02T03:04:05Z").alias("client_updated_at"), F.lit("KM").alias("unit"),
    )
    errors = F.transform(filters.preference_errors(), lambda e: F.concat_ws(" ", e["field"], e["error"]))
    return rows.select("request_id", F.concat_ws(";", errors).alias("errors"))


@query("SELECT u, v, key, (coalesce(lit = 'yes', false) AND NOT (key = 2)) AS prefer_lit, ((key = 3) AND NOT coalesce(surface = 'dirt', false)) AS prefer_dedicated_pavements FROM edges")
def canonical_preferences(net) -> DataFrame:
    return _canonical(net.edges)


def _canonical(edges: DataFrame) -> DataFrame:
    flags = {"prefer_lit": F.col("lit") == "yes", "heavily_avoid_unlit": F.col("key") == 2, "prefer_pedestrian": F.col("key") == 3, "prefer_nature_trails": F.col("surface") == "dirt"}
    out = filters.canonical_options(flags)
    return edges.select("u", "v", "key", out["prefer_lit"].alias("prefer_lit"), out["prefer_dedicated_pavements"].alias("prefer_dedicated_pavements"))


@query(
    """WITH d AS (SELECT request_id, unit, 23.44::DOUBLE * sin(radians(360 / 365.0::DOUBLE * (dayofyear(asked_at) - 81))) AS tilt, (start_lat + end_lat) / 2 AS la, (start_lon + end_lon) / 2 AS lo, hour(asked_at) + minute(asked_at) / 60.0::DOUBLE AS h, override FROM requests),
    w AS (SELECT *, degrees(acos(-tan(radians(la)) * tan(radians(tilt)))) / 15 AS half, (h + lo / 15 + 24) % 24 AS s FROM d)
    SELECT request_id, CASE WHEN lower(override) IN ('night', 'daylight') THEN lower(override) WHEN s >= 12 - half AND s < 12 + half THEN 'daylight' WHEN s >= 11.25 - half AND s < 12.75 + half THEN 'twilight' ELSE 'night' END AS context FROM w"""
)
def request_lighting_context(net) -> DataFrame:
    return net.requests.select("request_id", text.request_lighting(F.col("override"), *[F.col(c) for c in _R], F.col("asked_at")).alias("context"))


@query(
    """WITH p AS (SELECT request_id, unit, CASE profile WHEN 'walking' THEN 5.0::DOUBLE WHEN 'running_easy' THEN 9.5::DOUBLE WHEN 'running_race' THEN 12.5::DOUBLE END AS speed, CASE WHEN profile LIKE 'running%' THEN 'running' ELSE 'walking' END AS activity FROM requests WHERE profile <> 'flying'),
    q AS (SELECT *, 60.0::DOUBLE / speed * CASE WHEN unit = 'mi' THEN 1.609344::DOUBLE ELSE 1.0::DOUBLE END AS m FROM p),
    s AS (SELECT *, floor(m)::INTEGER AS w, round_even((m - floor(m)) * 60, 0)::INTEGER AS sec FROM q)
    SELECT request_id, activity, CASE WHEN unit = 'mi' THEN 'mph' ELSE 'km/h' END AS label, round(CASE WHEN unit = 'mi' THEN speed / 1.609344::DOUBLE ELSE speed END, 6) AS shown, (CASE WHEN sec = 60 THEN w + 1 ELSE w END) || ':' || lpad((CASE WHEN sec = 60 THEN 0 ELSE sec END)::VARCHAR, 2, '0') || ' min/' || unit AS pace FROM s"""
)
def movement_context(net) -> DataFrame:
    rows = net.requests.where("profile <> 'flying'").withColumn("speed", text.profile_speed(F.col("profile")))
    return rows.select("request_id", text.activity(F.col("profile")).alias("activity"), text.speed_label(F.col("unit")).alias("label"), r(text.in_unit(F.col("speed"), F.col("unit"))).alias("shown"), text.pace_text(F.col("speed"), F.col("unit")).alias("pace"))


@query("SELECT light_id, regime AS regime, words AS words, type AS type FROM (SELECT light_id, coalesce(regime, 'unknown') AS regime, words, type FROM lights)")
def cleaned_light_text(net) -> DataFrame:
    return net.lights.select("light_id", text.regime_name(F.col("lighting_regime")).alias("regime"), text.cleaned(F.col("lighting_regime_text")).alias("words"), text.cleaned(F.col("lit_tag_type")).alias("type"))


@query("SELECT event_type AS source, CASE event_type WHEN 'view' THEN 'part_night' WHEN 'click' THEN 'all_night' WHEN 'signup' THEN 'solar' WHEN 'purchase' THEN 'timed_window' ELSE 'unknown' END AS regime, count(*) AS n FROM events, size JOIN nodes ON node_id = event_id * 13 % size.n GROUP BY ALL")
def schedule_classes(net) -> DataFrame:
    return net.lights.select("source", text.schedule_class(F.col("lighting_regime_text")).alias("regime")).groupBy("source", "regime").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT way::VARCHAR AS raw, way::VARCHAR AS id, count(*) AS n FROM edges GROUP BY ALL")
def canonical_way_ids(net) -> DataFrame:
    decimal = F.concat(F.col("way_ids")[0], F.lit(".0"))
    return net.edges.select(F.col("way_ids")[0].alias("raw"), text.canonical_id(decimal).alias("id")).groupBy("raw", "id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS geom_id, replace(replace(p_name || ' <&> ' || p_brand, '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS name, trim(regexp_replace(lower(p_name || ' <&> ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def escaped_names(net) -> DataFrame:
    name = F.concat("p_name", F.lit(" <&> "), "p_brand")
    return net.table("part").select(F.col("p_partkey").alias("geom_id"), text.xml_escaped(name).alias("name"), text.slug(name).alias("slug"))


_T = "(15 / 111.0::DOUBLE)"
_TID = "format('{{:.2f}}_{{:.2f}}', round_even({a} / " + _T + ", 0) * " + _T + ", round_even({b} / " + _T + ", 0) * " + _T + ")"
_COVER = "list_sort(list_distinct([" + ", ".join(_TID.format(a=a, b=b) for a, b in (("y1", "x1"), ("y1", "x2"), ("y2", "x1"), ("y2", "x2"), ("(y1 + y2) / 2", "(x1 + x2) / 2"))) + "]))"
_HOLDS = "list_filter(tiles, lambda t: y1 >= split_part(t, '_', 1)::DOUBLE - {h} AND y2 <= split_part(t, '_', 1)::DOUBLE + {h} AND x1 >= split_part(t, '_', 2)::DOUBLE - {h} AND x2 <= split_part(t, '_', 2)::DOUBLE + {h})".format(h="(9.5 / 111.0::DOUBLE)")


def _tiles_sql(box: str) -> str:
    return f"WITH b AS ({box}), t AS (SELECT *, {_COVER} AS tiles FROM b), h AS (SELECT *, {_HOLDS} AS alone FROM t), o AS (SELECT request_id, s_lat, s_lon, CASE WHEN len(tiles) > 1 AND len(alone) > 0 THEN alone[1:1] ELSE tiles END AS tiles FROM h)"


@query(_tiles_sql("SELECT request_id, start_lat AS s_lat, start_lon AS s_lon, least(start_lat, end_lat) AS y1, greatest(start_lat, end_lat) AS y2, least(start_lon, end_lon) AS x1, greatest(start_lon, end_lon) AS x2 FROM requests") + " SELECT request_id, array_to_string(tiles, ' ') AS tiles FROM o")
def route_tile_sets(net) -> DataFrame:
    return net.requests.select("request_id", F.concat_ws(" ", tiles.route_tiles(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))).alias("tiles"))


_LB = "target_m / 1000 * 0.35::DOUBLE / 111"


@query(
    _tiles_sql(f"SELECT request_id, start_lat AS s_lat, start_lon AS s_lon, start_lat - {_LB} AS y1, start_lat + {_LB} AS y2, start_lon - {_LB} AS x1, start_lon + {_LB} AS x2 FROM requests WHERE is_loop")
    + ", e AS (SELECT request_id, s_lat, s_lon, unnest(tiles) AS tile_id FROM o), p AS (SELECT request_id, tile_id, row_number() OVER (PARTITION BY request_id ORDER BY pow(split_part(tile_id, '_', 1)::DOUBLE - s_lat, 2) + pow(split_part(tile_id, '_', 2)::DOUBLE - s_lon, 2), tile_id) AS place FROM e) SELECT request_id, tile_id, place::INTEGER AS place FROM p WHERE place <= 4"
)
def loop_tile_sets(net) -> DataFrame:
    rows = net.requests.where("is_loop").withColumn("tiles", tiles.loop_tiles(F.col("start_lat"), F.col("start_lon"), F.col("target_m")))
    return tiles.nearest_tiles(rows, ["request_id"], "tiles", "start_lat", "start_lon")


@query(
    f"WITH c AS (SELECT DISTINCT {_TID.format(a='lat', b='lon')} AS tile_id FROM nodes) SELECT tile_id, count(*) AS n FROM nodes, c WHERE lat BETWEEN split_part(tile_id, '_', 1)::DOUBLE - 9.5 / 111.0::DOUBLE AND split_part(tile_id, '_', 1)::DOUBLE + 9.5 / 111.0::DOUBLE AND lon BETWEEN split_part(tile_id, '_', 2)::DOUBLE - 9.5 / 111.0::DOUBLE AND split_part(tile_id, '_', 2)::DOUBLE + 9.5 / 111.0::DOUBLE GROUP BY 1"
)
def padded_tile_nodes(net) -> DataFrame:
    own = net.nodes.select(tiles.tile_id(F.col("lat"), F.col("lon")).alias("tile_id")).distinct()
    return tiles.in_tiles(net.nodes.select("node_id", "lat", "lon"), "lat", "lon").join(own, "tile_id", "left_semi").groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'T' || s // 500 AS tile_id FROM req0 WHERE s // 500 NOT IN (SELECT node_id // 500 FROM nodes WHERE node_id % 1000 < 500)")
def missing_tiles(net) -> DataFrame:
    name = lambda c: F.concat(F.lit("T"), F.floor(F.col(c) / 500).cast("string")).alias("tile_id")
    return tiles.missing_tiles(net.requests.select(name("start")), net.nodes.where("node_id % 1000 < 500").select(name("node_id")).distinct())


@query(
    "WITH t AS (SELECT u, v, key, 1 AS o, lit, surface FROM edges WHERE key < 4 UNION ALL SELECT u, v, key, 2, CASE WHEN way % 2 = 0 THEN 'new' END, NULL FROM edges WHERE key > 2) SELECT u, v, key, arg_max(lit, o) FILTER (lit IS NOT NULL) AS lit, arg_max(surface, o) FILTER (surface IS NOT NULL) AS surface FROM t GROUP BY 1, 2, 3"
)
def merged_tiles(net) -> DataFrame:
    first = net.edges.where("key < 4").select("u", "v", "key", F.lit("a").alias("tile_id"), "lit", "surface")
    second = net.edges.where("key > 2").select("u", "v", "key", F.lit("b").alias("tile_id"), F.when(F.col("way") % 2 == 0, "new").alias("lit"), F.lit(None).cast("string").alias("surface"))
    return tiles.merged(first.unionByName(second), ["u", "v", "key"])


@query(
    """SELECT route_id, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="strideway" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>Walk &amp; loop ' || route_id || '</name><trkseg>' ||
    string_agg(printf('<trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele></trkpt>', lat, lon, round(elevation, 1)), '' ORDER BY pos) || '</trkseg></trk></gpx>' AS gpx FROM places GROUP BY route_id"""
)
def gpx_tracks(net) -> DataFrame:
    from strideway.operators import routes

    rows = routes.coordinates(net.walks, net.nodes).withColumn("name", F.concat(F.lit("Walk & loop "), F.col("route_id").cast("string")))
    path = scratch(net.spark, "gpx")
    tables.write_documents(tables.gpx(written(rows, "tracks")), path, ["route_id"], "gpx")
    return tables.read_documents(net.spark, path, {"route_id": "long"}, "gpx")


@query("""SELECT request_id, format('{{"request_id":{},"start":{},"end":{},"is_loop":{},"target_m":{:.1f}}}', request_id, s, e, is_loop, target_m) AS payload FROM requests""")
def json_payloads(net) -> DataFrame:
    path = scratch(net.spark, "json")
    tables.write_documents(tables.as_json(net.requests.select("request_id", "start", "end", "is_loop", "target_m"), "request_id"), path, ["request_id"], "payload")
    return tables.read_documents(net.spark, path, {"request_id": "long"}, "payload")


_BOX = "SELECT request_id, least(start_lat, end_lat) - 0.02::DOUBLE AS y1, greatest(start_lat, end_lat) + 0.02::DOUBLE AS y2, least(start_lon, end_lon) - 0.9::DOUBLE AS x1, greatest(start_lon, end_lon) + 1.2::DOUBLE AS x2 FROM requests"
_HALF = "CASE WHEN {c} < 0 THEN '{minus}' ELSE '{plus}' END || printf('%0{n}d', abs({c}))"


@query(
    f"""WITH b AS ({_BOX}), r AS (SELECT request_id, unnest(range(floor(y1)::BIGINT, floor(y2)::BIGINT + 1)) AS a, x1, x2 FROM b), c AS (SELECT request_id, a, unnest(range(floor(x1)::BIGINT, floor(x2)::BIGINT + 1)) AS o FROM r)
    SELECT request_id, 'Copernicus_DSM_COG_10_' || {_HALF.format(c='a', minus='S', plus='N', n=2)} || '_00_' || {_HALF.format(c='o', minus='W', plus='E', n=3)} || '_00_DEM' AS tile FROM c"""
)
def dem_tiles(net) -> DataFrame:
    low = lambda c: F.least(f"start_{c}", f"end_{c}")
    high = lambda c: F.greatest(f"start_{c}", f"end_{c}")
    covered = tiles.dem_cover(low("lat") - 0.02, low("lon") - 0.9, high("lat") + 0.02, high("lon") + 1.2)
    return net.requests.select("request_id", F.explode(covered).alias("tile"))


@query(
    """SELECT request_id, left(array_to_string(['from-node-' || s, 'to', 'the-west-end-' || e, printf('%.1fkm', round(target_m / 1000, 1)), strftime(asked_at, '%Y-%m-%d')], '_'), 120) AS name FROM requests"""
)
def export_names(net) -> DataFrame:
    origin, target = F.concat(F.lit(" From node #"), F.col("start").cast("string")), F.concat(F.lit("The West End, "), F.col("end").cast("string"), F.lit("!"))
    return net.requests.select("request_id", tables.export_name(origin, target, F.col("target_m"), F.col("asked_at")).alias("name"))


@query("SELECT request_id, CASE request_id % 5 WHEN 4 THEN NULL WHEN 2 THEN 1704067200 + request_id * 3600 - 5400 ELSE 1704067200 + request_id * 3600 END AS seconds FROM requests")
def parsed_times(net) -> DataFrame:
    k, plain = F.col("request_id") % 5, F.date_format("asked_at", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, plain).when(k == 2, F.concat(plain, F.lit("+01:30"))).when(k == 3, F.date_format("asked_at", "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(F.concat(F.lit("at "), plain))
    return net.requests.select("request_id", F.unix_timestamp(text.timestamp_of(said)).alias("seconds"))
