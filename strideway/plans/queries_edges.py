"""Queries over the enrichment, aggregation and pricing of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.functions import cost, tags
from strideway.operators import enrich, filters, graphs, routes, spatial
from strideway.plans import build
from strideway.plans.net_sql import seg
from strideway.sources import tables

QUERIES: dict[str, tuple[Callable, str | None]] = {}
EDGE = ["u", "v", "key"]


def query(sql: str | None = None):
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def r(column, digits: int = 6):
    return F.round(column, digits)


def placed(net) -> DataFrame:
    return spatial.with_endpoints(net.edges, net.nodes)


_NOISE = "CASE WHEN highway IN ('motorway', 'trunk', 'primary', 'secondary') THEN 1.0::DOUBLE WHEN highway IN ('residential', 'service', 'footway', 'path', 'cycleway', 'pedestrian', 'track', 'steps', 'living_street') THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END"


@query(f"SELECT highway, {_NOISE} AS noise_factor, count(*) AS n FROM edges GROUP BY ALL")
def quietness(net) -> DataFrame:
    return enrich.add_quietness(net.edges).groupBy("highway", "noise_factor").agg(F.count(F.lit(1)).alias("n"))


_INSIDE = "SELECT geom_id, u, v, key, count(*) FILTER ((ay > my) <> (\"by\" > my) AND mx < (bx - ax) * (my - ay) / (\"by\" - ay) + ax) % 2 = 1 AND any_value(kind) <> 'water_line' AS inside"
_WATER = f"""SELECT p.u, p.v, p.key, min(d) AS d FROM ({_INSIDE}, greatest(min({seg('mx', 'my', 'ax', 'ay', 'bx', '"by"')}) - CASE WHEN any_value(kind) = 'water_line' THEN 10 ELSE 0 END, 0) AS far,
CASE WHEN inside THEN 0 ELSE far END AS d FROM geo_edges e JOIN sides s ON kind IN ('water', 'water_line') AND abs(s.nx - e.mx) < 590 AND abs(s.ny - e.my) < 420 GROUP BY geom_id, u, v, key) p GROUP BY 1, 2, 3"""


@query(f"WITH w AS ({_WATER}) SELECT e.u, e.v, e.key, round(least(1.0::DOUBLE, coalesce(d / 250, 1.0::DOUBLE)), 6) AS raw_water_cost FROM edges e LEFT JOIN w USING (u, v, key)")
def water(net) -> DataFrame:
    return enrich.add_water(net.edges, build.layers_of(net).water, net.nodes).select(*EDGE, r("raw_water_cost").alias("raw_water_cost"))


_NEAR_POIS = """pc AS MATERIALIZED (SELECT x, y, floor(x / 50)::BIGINT + i AS cx, floor(y / 50)::BIGINT + j AS cy FROM (SELECT *, unnest([-1, 0, 1]) AS i FROM (SELECT *, unnest([-1, 0, 1]) AS j FROM pois))),
    ec AS MATERIALIZED (SELECT u, v, key, mx, my, floor(mx / 50)::BIGINT AS cx, floor(my / 50)::BIGINT AS cy FROM geo_edges),
    c AS (SELECT u, v, key, count(*) AS n FROM ec JOIN pc USING (cx, cy) WHERE sqrt(pow(x - mx, 2) + pow(y - my, 2)) <= 50 GROUP BY 1, 2, 3)"""


@query(f"WITH {_NEAR_POIS} SELECT e.u, e.v, e.key, round(length / greatest(0.1::DOUBLE, coalesce(n, 0)), 4) AS raw_social_cost FROM edges e LEFT JOIN c USING (u, v, key)")
def social(net) -> DataFrame:
    return enrich.add_social(net.edges, net.pois, net.nodes).select(*EDGE, r("raw_social_cost", 4).alias("raw_social_cost"))


def _disc(radius: float, points: str, keys: str) -> str:
    """Area of discs within areas, as sectors and triangles for each side."""
    r2 = radius * radius
    sector = lambda ux, uy, vx, vy: f"({r2 / 2}::DOUBLE * atan2({ux} * {vy} - {uy} * {vx}, {ux} * {vx} + {uy} * {vy}))"
    return (
        f"j AS (SELECT {keys}, geom_id, ax - mx AS ax, ay - my AS ay, bx - mx AS bx, \"by\" - my AS b_y, bx - ax AS dx, \"by\" - ay AS dy FROM {points} p JOIN sides s ON kind = 'green' AND abs(s.nx - p.mx) < {radius + 330} AND abs(s.ny - p.my) < {radius + 160}), "
        f"q AS (SELECT *, dx * dx + dy * dy AS sq, ax * dx + ay * dy AS al, al * al - sq * (ax * ax + ay * ay - {r2}::DOUBLE) AS root, greatest(0::DOUBLE, least(1::DOUBLE, (-al - sqrt(greatest(root, 0))) / sq)) AS t1, greatest(0::DOUBLE, least(1::DOUBLE, (sqrt(greatest(root, 0)) - al) / sq)) AS t2, "
        f"ax + t1 * dx AS px, ay + t1 * dy AS py, ax + t2 * dx AS qx, ay + t2 * dy AS qy FROM j), "
        f"areas AS (SELECT {keys}, geom_id, abs(sum(CASE WHEN root <= 0 OR t1 >= t2 THEN {sector('ax', 'ay', 'bx', 'b_y')} ELSE {sector('ax', 'ay', 'px', 'py')} + (px * qy - py * qx) / 2 + {sector('qx', 'qy', 'bx', 'b_y')} END)) AS area FROM q GROUP BY ALL), "
        f"shares AS (SELECT {keys}, least(1::DOUBLE, sum(area) / (pi() * {r2}::DOUBLE)) AS share FROM areas GROUP BY ALL)"
    )


@query(f"WITH {_disc(50.0, 'geo_edges', 'u, v, key')} SELECT e.u, e.v, e.key, round(1 - coalesce(share, 0), 4) AS raw_green_cost FROM edges e LEFT JOIN shares USING (u, v, key)")
def green_fast(net) -> DataFrame:
    return enrich.green_processor("fast")(placed(net), build.layers_of(net).green).select(*EDGE, r("raw_green_cost", 4).alias("raw_green_cost"))


_SAMPLED = f"""samples_ AS MATERIALIZED (SELECT * FROM samples), {_disc(50.0, 'samples_', 'u, v, key, i_, n')}, t AS (SELECT u, v, key, sum(share) / any_value(n) AS share FROM shares GROUP BY 1, 2, 3)"""


@query(f"WITH {_SAMPLED} SELECT e.u, e.v, e.key, round(1 - coalesce(share, 0), 4) AS raw_green_cost FROM edges e LEFT JOIN t USING (u, v, key)")
def green_sampled(net) -> DataFrame:
    return enrich.add_green_sampled(net.edges, build.layers_of(net).green, net.nodes).select(*EDGE, r("raw_green_cost", 4).alias("raw_green_cost"))


@query()
def green_visible(net) -> DataFrame:
    layers = build.layers_of(net)
    return enrich.add_green_visible(net.edges, layers.green, layers.buildings, net.nodes).select(*EDGE, r("raw_green_cost", 4).alias("raw_green_cost"))


_SNAP = f"SELECT light_id, u, v, key, round(min({seg('l.x', 'l.y', 'ax', 'ay', 'bx', '\"by\"')}), 6) AS d FROM lights l JOIN segs s ON l.x BETWEEN least(ax, bx) - 15 AND greatest(ax, bx) + 15 AND l.y BETWEEN least(ay, \"by\") - 15 AND greatest(ay, \"by\") + 15 WHERE {seg('l.x', 'l.y', 'ax', 'ay', 'bx', '\"by\"')} <= 15 GROUP BY 1, 2, 3, 4"


@query(f"WITH p AS ({_SNAP}), b AS (SELECT light_id, min((d, u, v, key)) AS b FROM p GROUP BY 1) SELECT light_id, b[2] AS u, b[3] AS v, b[4] AS key FROM b")
def snapped_lights(net) -> DataFrame:
    return spatial.snapped(net.lights, net.edges, nodes=net.nodes).select("light_id", *EDGE)


_TOLD = f"p AS ({_SNAP}), b0 AS (SELECT light_id, min((d, u, v, key)) AS b FROM p GROUP BY 1), hit AS (SELECT light_id, b[2] AS u, b[3] AS v, b[4] AS key FROM b0), ways AS (SELECT DISTINCT light_id, way FROM hit JOIN edges USING (u, v, key)), told AS (SELECT light_id, e.u, e.v, e.key FROM ways JOIN edges e USING (way))"


@query(
    f"""WITH {_TOLD}, f AS (SELECT u, v, key, max_by(source, light_id) AS source, max_by(type, light_id) FILTER (type IS NOT NULL) AS type, max_by(regime, light_id) FILTER (regime IS NOT NULL) AS regime, max_by(words, light_id) FILTER (words IS NOT NULL) AS words FROM told JOIN lights USING (light_id) GROUP BY 1, 2, 3)
    SELECT CASE WHEN source IS NOT NULL THEN 'yes' ELSE lit END AS lit, source AS lit_source_detail, type AS lit_tag_type, coalesce(regime, lighting_regime) AS lighting_regime, words AS lighting_regime_text, count(*) AS n FROM edges LEFT JOIN f USING (u, v, key) GROUP BY ALL"""
)
def street_lights(net) -> DataFrame:
    out = enrich.add_lights(net.edges, net.lights, nodes=net.nodes)
    return out.groupBy("lit", "lit_source_detail", "lit_tag_type", "lighting_regime", "lighting_regime_text").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOLD}, c AS (SELECT light_id, count(*) AS n FROM told GROUP BY 1) SELECT (SELECT count(*) FROM lights) AS n_lights, (SELECT count(*) FROM c) AS n_matched, (SELECT count(*) FROM c WHERE n > 1) AS n_propagated, (SELECT count(DISTINCT (u, v, key)) FROM told) AS n_touched")
def street_light_report(net) -> DataFrame:
    return enrich.matching_report(net.lights, net.edges, nodes=net.nodes)


@query(
    f"""WITH c AS (SELECT light_id, lat, lon, source, coalesce(type, 'n/a') AS type, CASE source WHEN 'view' THEN 'part-night' WHEN 'click' THEN 'all night' WHEN 'signup' THEN 'none' ELSE 'unknown' END AS regime, coalesce(words, coalesce(type, 'n/a')) AS words FROM lights),
    l AS MATERIALIZED (SELECT *, radians(lon) * 6378137.0::DOUBLE AS mx, ln(tan(radians(lat + (light_id % 20) * 0.00001::DOUBLE) / 2 + pi() / 4)) * 6378137.0::DOUBLE AS my FROM c),
    mg AS MATERIALIZED (SELECT u, v, key, radians(a_lon) * 6378137.0::DOUBLE AS ax, ln(tan(radians(a_lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE AS ay, radians(b_lon) * 6378137.0::DOUBLE AS bx, ln(tan(radians(b_lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE AS b_y FROM segs),
    p AS (SELECT u, v, key, light_id, any_value(source) AS source FROM l JOIN mg ON mx BETWEEN least(ax, bx) - 15 AND greatest(ax, bx) + 15 AND my BETWEEN least(ay, b_y) - 15 AND greatest(ay, b_y) + 15 WHERE {seg('mx', 'my', 'ax', 'ay', 'bx', 'b_y')} <= 15 GROUP BY 1, 2, 3, 4),
    s AS (SELECT u, v, key, source, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT u, v, key, arg_min(source, (-n, source)) AS source, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2, 3)
    SELECT e.u, e.v, e.key, CASE WHEN n IS NOT NULL THEN 'lit' WHEN lit = 'yes' THEN 'lit' WHEN lit = 'no' THEN 'unlit' ELSE 'unknown' END AS lit_status, coalesce(source, 'osm') AS lit_source_detail, coalesce(n, 0) AS council_match_count FROM edges e LEFT JOIN m USING (u, v, key)"""
)
def council_overlay(net) -> DataFrame:
    """Lamps stand up to 34 units of spherical Mercator, or 21 metres, north of a node."""
    table = tables.way_lighting_table(net.edges.withColumns(spatial.shape_keys(net.edges)), spatial.SHAPE)
    lines = enrich.in_mercator(spatial.placed_lines(net.edges, net.nodes))
    lights = net.lights.withColumn("lat", F.col("lat") + F.col("light_id") % 20 * 0.00001)
    return enrich.merge_overlay(table, lights, lines).select(*EDGE, "lit_status", "lit_source_detail", "council_match_count")


_DEM = "dem AS (SELECT floor(lat * 3600) AS a, floor(lon * 3600) AS b, max(elevation) AS value FROM nodes GROUP BY 1, 2), hts AS (SELECT n.node_id, d.value FROM nodes n JOIN dem d ON floor(n.lat * 3600) = a AND floor(n.lon * 3600) = b)"
_SLOPE = "5.0::DOUBLE / greatest(0.1::DOUBLE, 6.0::DOUBLE * exp(-3.5::DOUBLE * abs({g} - (-0.05)::DOUBLE)))"


@query(f"WITH {_DEM} SELECT u, v, key, round(greatest(0, g), 6) AS uphill_gradient, round(greatest(0, -g), 6) AS downhill_gradient, round({_SLOPE.format(g='g')}, 5) AS slope_time_cost FROM (SELECT e.*, (b.value - a.value) / length AS g FROM edges e JOIN hts a ON a.node_id = u JOIN hts b ON b.node_id = v)")
def elevation(net) -> DataFrame:
    out = enrich.add_elevation(net.edges, net.nodes, net.dem)
    return out.select(*EDGE, r("uphill_gradient").alias("uphill_gradient"), r("downhill_gradient").alias("downhill_gradient"), r("slope_time_cost", 5).alias("slope_time_cost"))


def raw(net) -> DataFrame:
    """Edges with raw attributes from their numbers, some missing, for the normalisation."""
    way, key = F.col("way"), F.col("key")
    return enrich.add_quietness(net.edges).withColumns({
        "raw_green_cost": F.when(way % 7 != 0, (way % 101) / 80.0), "raw_water_cost": (way % 51) / 50.0, "raw_social_cost": F.col("length") / (key + 1), "slope_time_cost": ((F.col("u") + F.col("v")) % 11 + 5) / 10.0,
        "tile_id": F.floor(F.col("u") / 1000),
    })


_RAW = f"raw AS (SELECT u, v, key, CASE WHEN way % 7 <> 0 THEN (way % 101) / 80.0::DOUBLE END AS g, (way % 51) / 50.0::DOUBLE AS w, length / (key + 1) AS s, {_NOISE} AS q, ((u + v) % 11 + 5) / 10.0::DOUBLE AS e, u // 1000 AS tile FROM edges)"


def _scaled(c: str, over: str, invert: bool = False) -> str:
    low, high = f"min({c}) OVER ({over})", f"max({c}) OVER ({over})"
    share = f"({high} - {c}) / ({high} - {low})" if invert else f"({c} - {low}) / ({high} - {low})"
    return f"round(coalesce(CASE WHEN {c} IS NULL THEN NULL WHEN {high} = {low} THEN 0.0::DOUBLE ELSE {share} END, 0.5::DOUBLE), 6)"


_NORMS = [("norm_green", "g", False), ("norm_water", "w", False), ("norm_social", "s", False), ("norm_quiet", "q", True), ("norm_slope", "e", False)]


@query(f"WITH {_RAW} SELECT u, v, key, " + ", ".join(f"{_scaled(c, '', i)} AS {n}" for n, c, i in _NORMS) + " FROM raw")
def normalised_dynamic(net) -> DataFrame:
    return enrich.normalise(raw(net)).select(*EDGE, *[r(n).alias(n) for n, _, _ in _NORMS])


@query(f"WITH {_RAW} SELECT u, v, key, round(CASE WHEN g IS NULL THEN 0.5::DOUBLE ELSE least(1, g) END, 6) AS norm_green, round(w, 6) AS norm_water, " + ", ".join(f"{_scaled(c, '', i)} AS {n}" for n, c, i in _NORMS[2:]) + " FROM raw")
def normalised_static(net) -> DataFrame:
    return enrich.normalise(raw(net), "STATIC").select(*EDGE, *[r(n).alias(n) for n, _, _ in _NORMS])


@query(f"WITH {_RAW} SELECT u, v, key, " + ", ".join(f"{_scaled(c, 'PARTITION BY tile', i)} AS {n}" for n, c, i in _NORMS) + " FROM raw")
def normalised_by_tile(net) -> DataFrame:
    return enrich.normalise(raw(net), by=["tile_id"]).select(*EDGE, *[r(n).alias(n) for n, _, _ in _NORMS])


@query(f"WITH {_RAW} SELECT u, v, key, " + ", ".join(f"{_scaled(c, 'PARTITION BY tile', i)} AS {n}" for n, c, i in _NORMS[:2]) + " FROM raw")
def normalised_by_tile_window(net) -> DataFrame:
    return enrich.normalise_windowed(raw(net)).select(*EDGE, r("norm_green").alias("norm_green"), r("norm_water").alias("norm_water"))


@query(f"WITH {_RAW} SELECT round(min(g), 6) AS low_green, round(max(g), 6) AS high_green, round(min(s), 4) AS low_social, round(max(s), 4) AS high_social FROM raw")
def attribute_ranges(net) -> DataFrame:
    rows = enrich.attribute_ranges(raw(net))
    return rows.select(r("low_raw_green_cost").alias("low_green"), r("high_raw_green_cost").alias("high_green"), r("low_raw_social_cost", 4).alias("low_social"), r("high_raw_social_cost", 4).alias("high_social"))


@query(f"WITH {_RAW} SELECT least(floor(w / 0.2::DOUBLE), 4)::INTEGER AS bin, count(*) AS n, round(avg(g), 6) AS mean_green, count(*) FILTER (g < 0.5) AS greener FROM raw GROUP BY 1")
def attribute_histogram(net) -> DataFrame:
    rows = raw(net).withColumn("bin", F.least(F.floor(F.col("raw_water_cost") / 0.2), F.lit(4)).cast("int"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("raw_green_cost")).alias("mean_green"), F.count_if(F.col("raw_green_cost") < 0.5).alias("greener"))


@query(f"WITH {_RAW} SELECT round(100.0::DOUBLE * count(g) / count(*), 6) AS covered_pct, count(*) FILTER (g > 1 OR g < 0) AS outside, round(min(g), 6) AS least, round(avg(g), 6) AS mean, round(avg(g) FILTER (u % 100 < 2), 6) AS near_line, round(avg(g) FILTER (u % 100 > 7), 6) AS far_from_line FROM raw")
def attribute_coverage(net) -> DataFrame:
    g, column = F.col("raw_green_cost"), F.col("u") % 100
    return raw(net).agg(
        r(F.count(g) / F.count(F.lit(1)) * 100).alias("covered_pct"), F.count_if((g > 1) | (g < 0)).alias("outside"), r(F.min(g)).alias("least"), r(F.avg(g)).alias("mean"),
        r(F.avg(F.when(column < 2, g))).alias("near_line"), r(F.avg(F.when(column > 7, g))).alias("far_from_line"),
    )


@query(f"WITH {_RAW} SELECT least(floor(w / 0.1::DOUBLE), 9)::INTEGER AS bin, count(*) AS n FROM raw GROUP BY 1")
def water_histogram(net) -> DataFrame:
    """In tenths."""
    return raw(net).groupBy(F.least(F.floor(F.col("raw_water_cost") / 0.1), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH d AS (SELECT u, v, key, min({seg('mx', 'my', 'ax', 'ay', 'bx', '"by"')}) AS d FROM geo_edges e JOIN sides s ON kind = 'water_line' AND abs(s.nx - e.mx) < 560 AND abs(s.ny - e.my) < 560 GROUP BY 1, 2, 3)
    SELECT CASE WHEN d <= 80 THEN 'near' WHEN d <= 400 THEN 'between' ELSE 'beyond' END AS band, count(*) AS n, round(avg((way % 101) / 80.0::DOUBLE), 6) AS mean FROM edges LEFT JOIN d USING (u, v, key) GROUP BY 1"""
)
def water_line_bands(net) -> DataFrame:
    rows = enrich.line_bands(net.edges, net.polygons.where("kind = 'water_line'"), F.col("way") % 101 / 80.0, nodes=net.nodes)
    return rows.select("band", "n", r("mean").alias("mean"))


@query("WITH w AS (SELECT way, arg_min(struct_pack(h := highway, a := access, f := foot), (u, v, key)) AS w FROM edges GROUP BY 1) SELECT count(*) AS n_ways, count(*) FILTER (w.h IN ('motorway', 'trunk')) AS n_forbidden, count(*) FILTER (w.a = 'private' AND coalesce(w.f, '') NOT IN ('yes', 'designated', 'permissive')) AS n_private FROM w")
def ways_to_look_at(net) -> DataFrame:
    return filters.ways_to_look_at(net.edges)


@query("WITH w AS (SELECT way, arg_min(highway, (u, v, key)) AS highway FROM edges GROUP BY 1) SELECT highway, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, highway LIMIT 15")
def way_highway_counts(net) -> DataFrame:
    ways = net.edges.groupBy("way").agg(F.min_by("highway", F.struct(*EDGE)).alias("highway"))
    return ways.groupBy("highway").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "highway").limit(15)


@query("SELECT source, count(*) AS n FROM lights GROUP BY 1")
def light_source_counts(net) -> DataFrame:
    return net.lights.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH o AS (SELECT u AS node, count(*) AS c, array_to_string(list_sort(list_distinct(list(highway))), ',') AS highways, avg(norm_green) AS g, bool_or(highway IN ('motorway', 'trunk', 'primary')) AS t, bool_and(highway IN ('motorway', 'trunk', 'primary')) AS a FROM scored GROUP BY 1),
    i AS (SELECT v AS node, count(*) AS c FROM edges GROUP BY 1) SELECT node, coalesce(o.c, 0) + coalesce(i.c, 0) AS degree, highways, round(g, 6) AS mean_green, t AS touches_major, a AS all_major FROM o FULL JOIN i USING (node)"""
)
def node_profiles(net) -> DataFrame:
    return graphs.node_profile(scored(net)).select("node", "degree", F.concat_ws(",", "highways").alias("highways"), r("mean_green").alias("mean_green"), "touches_major", "all_major")


@query("SELECT node, count(DISTINCT other) AS degree FROM (SELECT u AS node, v AS other FROM edges UNION ALL SELECT v, u FROM edges) WHERE node <> other GROUP BY 1")
def undirected_degrees(net) -> DataFrame:
    return graphs.undirected_degree(net.edges)


@query("SELECT u, v, round(b.length, 4) AS length, b.key AS key, b.highway AS highway FROM best")
def best_parallel_edges(net) -> DataFrame:
    return routes.best_parallel(net.edges).select("u", "v", r("length", 4).alias("length"), "key", "highway")


def scored(net) -> DataFrame:
    """Edges with norms and gradients from their numbers, for the cost model."""
    way, u, v = F.col("way"), F.col("u"), F.col("v")
    return net.edges.withColumns({
        "norm_green": (way % 101) / 100.0, "norm_water": (way % 51) / 50.0, "norm_social": (F.col("key") % 5) / 4.0, "norm_quiet": F.when(way % 9 != 0, (way % 3) / 2.0), "norm_slope": ((u + v) % 11) / 10.0,
        "uphill_gradient": ((u * 7 + v) % 21) / 100.0, "downhill_gradient": ((u + v * 7) % 16) / 100.0,
    })


WEIGHTS = {"distance": 0.3, "greenness": 0.25, "water": 0.15, "social": 0.1, "quietness": 0.1, "slope": -0.1}
_LENGTH = "((length - low) / (high - low))"
_N = {"greenness": "norm_green", "water": "norm_water", "social": "norm_social", "quietness": "coalesce(norm_quiet, 0.5::DOUBLE)", "slope": "norm_slope"}
_WSM = f"(0.3::DOUBLE * {_LENGTH} + 0.25::DOUBLE * norm_green + 0.15::DOUBLE * norm_water + 0.1::DOUBLE * norm_social + 0.1::DOUBLE * {_N['quietness']} + 0.1::DOUBLE * (1 - norm_slope))"


def _priced(net, **more) -> DataFrame:
    weights = {k: F.lit(w) for k, w in WEIGHTS.items()}
    edges = scored(net)
    lengths = edges.where("length > 0").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    return edges.crossJoin(F.broadcast(lengths)).withColumn("cost", cost.edge_cost(F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0)), weights, **more)).drop("low", "high")


@query(f"SELECT u, v, key, round({_WSM}, 6) AS cost FROM scored, range_l")
def cost_weighted_sum(net) -> DataFrame:
    return _priced(net).select(*EDGE, r("cost").alias("cost"))


@query(
    f"""SELECT u, v, key, round(0.3::DOUBLE * {_LENGTH} + 0.7::DOUBLE * least(norm_green / 1.25::DOUBLE, norm_water / 1.15::DOUBLE, norm_social / 1.1::DOUBLE, {_N['quietness']} / 1.1::DOUBLE, (1 - norm_slope) / 1.1::DOUBLE) * (1 + 0.7::DOUBLE / 5), 6) AS cost FROM scored, range_l"""
)
def cost_weighted_min(net) -> DataFrame:
    return _priced(net, method="HYBRID_DISJUNCTIVE").select(*EDGE, r("cost").alias("cost"))


@query(f"SELECT u, v, key, round(0.3::DOUBLE * {_LENGTH} + 0.25::DOUBLE * least(norm_green, norm_water) + 0.1::DOUBLE * norm_social + 0.1::DOUBLE * {_N['quietness']} + 0.1::DOUBLE * (1 - norm_slope), 6) AS cost FROM scored, range_l")
def cost_combined_nature(net) -> DataFrame:
    return _priced(net, combine_nature=True).select(*EDGE, r("cost").alias("cost"))


@query(
    """WITH m AS (SELECT request_id, greatest(0.1::DOUBLE, coalesce(distance, 3)) AS d, * EXCLUDE (request_id, distance) FROM requests), t AS (SELECT *, d + greenness + water + social + quietness + abs(slope) AS t FROM m)
    SELECT request_id, round(d / t, 6) AS distance, round(greenness / t, 6) AS greenness, round(slope / t, 6) AS slope FROM t"""
)
def slider_weights(net) -> DataFrame:
    w = cost.slider_weights({k: F.col(k) for k in cost.FEATURES})
    return net.requests.select("request_id", *[r(w[k]).alias(k) for k in ("distance", "greenness", "slope")])


@query("SELECT request_id, CASE WHEN greenness - 2 < 0 THEN 'greenness' ELSE '' END AS errors FROM requests")
def weight_validation(net) -> DataFrame:
    own = {k: F.coalesce(F.col(k), F.lit(0.0)) - (2 if k == "greenness" else 0) for k in cost.FEATURES}
    return net.requests.select("request_id", F.concat_ws(",", cost.weight_errors(own)).alias("errors"))


_BASE = "CASE WHEN lit = 'yes' THEN 'lit' WHEN lit = 'no' THEN 'unlit' ELSE 'unknown' END"
_REGIME = "CASE WHEN lighting_regime IN ('Dusk to dawn', '24/7') THEN 'all_night' WHEN lighting_regime IN ('Part night', 'switch off at midnight') THEN 'part_night' ELSE 'unknown' END"
_CLASS = f"""CASE WHEN {_REGIME} = 'unknown' THEN {_BASE} WHEN {_REGIME} = 'all_night' THEN CASE WHEN {_BASE} = 'unlit' THEN 'unlit' ELSE 'lit' END
ELSE CASE WHEN {_BASE} = 'unlit' THEN 'unlit' WHEN {{late}} = 'limited' THEN 'limited' ELSE 'unlit' END END"""
_PATHS = "('cycleway', 'path', 'footway', 'pedestrian', 'track', 'steps')"


def _lit_factor(late: str, lit: float, limited: float, unlit: float, unknown: float) -> str:
    c = _CLASS.format(late=f"'{late}'")
    return f"(CASE {c} WHEN 'lit' THEN {lit}::DOUBLE WHEN 'limited' THEN {limited}::DOUBLE WHEN 'unlit' THEN {unlit}::DOUBLE ELSE CASE WHEN highway IN {_PATHS} THEN 1.0::DOUBLE ELSE {unknown}::DOUBLE END END)"


@query(f"SELECT u, v, key, {_CLASS.format(late=chr(39) + 'unlit' + chr(39))} AS at_night, {_CLASS.format(late=chr(39) + 'limited' + chr(39))} AS at_dusk, 'not_relevant' AS by_day FROM edges")
def effective_lighting(net) -> DataFrame:
    kind = lambda c: tags.effective_lit_class(F.lit(c))
    return net.edges.select(*EDGE, kind("night").alias("at_night"), kind("twilight").alias("at_dusk"), kind("daylight").alias("by_day"))


@query(f"SELECT u, v, key, {_lit_factor('unlit', 0.85, 1.3, 1.8, 1.2)} AS night, {_lit_factor('limited', 0.7, 2.5, 5.0, 3.0)} AS dusk_heavy, 1.0::DOUBLE AS day FROM edges")
def multiplier_lit(net) -> DataFrame:
    m = cost.lit_multiplier
    return net.edges.select(*EDGE, m(F.lit("night")).alias("night"), m(F.lit("twilight"), True).alias("dusk_heavy"), m(F.lit("daylight")).alias("day"))


_TIER = f"CASE WHEN highway IN {_PATHS} AND surface IN ('asphalt', 'paving_stones') THEN CASE WHEN foot = 'designated' AND bicycle = 'designated' THEN 'tier_a' WHEN foot = 'designated' OR bicycle = 'designated' THEN 'tier_b' WHEN foot = 'yes' OR bicycle = 'yes' THEN 'tier_c' ELSE 'none' END ELSE 'none' END"
_SURFACE = "CASE surface WHEN 'asphalt' THEN 1.0::DOUBLE WHEN 'paving_stones' THEN 1.0::DOUBLE WHEN 'gravel' THEN 1.3::DOUBLE WHEN 'dirt' THEN 2.0::DOUBLE ELSE 1.2::DOUBLE END"
_UNSAFE = "CASE WHEN highway IN ('primary', 'secondary', 'tertiary') AND NOT coalesce(sidewalk IN ('both', 'right', 'separate'), false) AND NOT coalesce(foot IN ('yes', 'designated'), false) THEN 3.5::DOUBLE ELSE 1.0::DOUBLE END"
_PEDESTRIAN = "CASE WHEN highway IN ('trunk', 'primary', 'secondary', 'tertiary') THEN 5.0::DOUBLE WHEN highway IN ('pedestrian', 'path', 'footway', 'cycleway', 'track', 'living_street') THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END"
_TIER_FACTOR = f"CASE {_TIER} WHEN 'tier_a' THEN 0.82::DOUBLE WHEN 'tier_b' THEN 0.9::DOUBLE WHEN 'tier_c' THEN 0.96::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"SELECT u, v, key, {_SURFACE} AS surface_factor, {_UNSAFE} AS unsafe_factor, {_PEDESTRIAN} AS pedestrian_factor, {_TIER} AS tier, {_TIER_FACTOR} AS tier_factor FROM edges")
def multipliers_simple(net) -> DataFrame:
    return net.edges.select(
        *EDGE, cost.surface_multiplier().alias("surface_factor"), cost.unsafe_multiplier().alias("unsafe_factor"), cost.pedestrian_multiplier().alias("pedestrian_factor"),
        tags.active_travel_tier().alias("tier"), cost.tier_multiplier().alias("tier_factor"),
    )


_ROADS = "highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary')"
_HARD, _SOFT = "surface IN ('asphalt', 'paving_stones')", "surface IN ('gravel', 'dirt')"


@query(
    f"""SELECT u, v, key, round((CASE WHEN {_ROADS} THEN 2.8::DOUBLE WHEN highway IN {_PATHS} OR highway = 'living_street' THEN 0.78::DOUBLE ELSE 1 END) * (CASE WHEN {_HARD} THEN 0.9::DOUBLE WHEN {_SOFT} THEN 1.35::DOUBLE ELSE 1 END) * (CASE {_TIER} WHEN 'tier_a' THEN 0.85::DOUBLE WHEN 'tier_b' THEN 0.92::DOUBLE ELSE 1 END), 6) AS dedicated,
    round((CASE WHEN {_ROADS} THEN 4.0::DOUBLE WHEN highway IN ('residential', 'unclassified', 'service', 'living_street') THEN 1.35::DOUBLE WHEN highway IN ('path', 'track', 'footway', 'steps') THEN 0.72::DOUBLE ELSE 1 END) * (CASE WHEN {_SOFT} THEN 0.78::DOUBLE WHEN {_HARD} THEN 1.35::DOUBLE ELSE 1 END) * (CASE WHEN highway IN ('path', 'track', 'footway', 'steps') AND surface IS NULL THEN 0.9::DOUBLE ELSE 1 END), 6) AS trails FROM edges"""
)
def multipliers_corridors(net) -> DataFrame:
    return net.edges.select(*EDGE, r(cost.dedicated_multiplier()).alias("dedicated"), r(cost.trail_multiplier()).alias("trails"))


_RUN = "(12.0::DOUBLE / greatest(0.1::DOUBLE, 15.0::DOUBLE * exp(-2.5::DOUBLE * abs(uphill_gradient - downhill_gradient - (-0.1)::DOUBLE))))"


@query(f"WITH c AS (SELECT u, v, key, {_RUN} AS c FROM scored) SELECT u, v, key, round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS norm_slope FROM c")
def running_slope(net) -> DataFrame:
    edges = scored(net)
    ranges = edges.agg(*[f(cost.tobler(F.col("uphill_gradient") - F.col("downhill_gradient"), "running")).alias(n) for n, f in (("low", F.min), ("high", F.max))])
    return edges.crossJoin(F.broadcast(ranges)).select(*EDGE, r(cost.running_slope(F.col("low"), F.col("high"))).alias("norm_slope"))


@query(f"SELECT u, v, round(min({_WSM} * {_lit_factor('unlit', 0.85, 1.3, 1.8, 1.2)} * {_PEDESTRIAN} * {_SURFACE} * {_UNSAFE} * {_TIER_FACTOR}), 6) AS cost FROM scored, range_l GROUP BY 1, 2")
def cost_with_preferences(net) -> DataFrame:
    rows = _priced(net, prefer_lit=True, prefer_pedestrian=True, prefer_paved=True, avoid_unsafe_roads=True)
    return rows.groupBy("u", "v").agg(r(F.min("cost")).alias("cost"))


@query(f"SELECT u, v, key, 'night' AS context, {_CLASS.format(late=chr(39) + 'unlit' + chr(39))} AS lit_class, {_TIER} AS tier, {_TIER_FACTOR} AS factor FROM edges")
def modifier_context(net) -> DataFrame:
    return _at_night(net.edges)


def _at_night(edges: DataFrame) -> DataFrame:
    night = F.lit("night")
    return edges.select(*EDGE, tags.lighting_context(night).alias("context"), tags.effective_lit_class(night).alias("lit_class"), tags.active_travel_tier().alias("tier"), cost.tier_multiplier().alias("factor"))


_WALK = """NOT (highway IN ('motorway', 'construction') OR coalesce(area = 'yes', false)) AND NOT (highway IN ('cycleway', 'trunk') AND NOT (coalesce(foot IN ('yes', 'designated', 'permissive'), false) OR coalesce(designation = 'public_footpath', false)))
AND NOT (coalesce(foot = 'no', false) OR ((coalesce(access = 'private', false) OR (highway = 'service' AND coalesce(service = 'driveway', false))) AND NOT coalesce(foot IN ('yes', 'permissive', 'designated'), false)))"""
_GATES = "(SELECT node_id FROM nodes WHERE barrier = 'gate' AND (locked = 'yes' OR access = 'private'))"


@query(
    f"""WITH w AS ({_WATER}), k AS (SELECT e.*, {_NOISE} AS q, least(1.0::DOUBLE, coalesce(d / 250, 1.0::DOUBLE)) AS wc FROM edges e LEFT JOIN w USING (u, v, key) WHERE {_WALK} AND e.u NOT IN {_GATES} AND e.v NOT IN {_GATES}),
    n AS (SELECT highway, (length - min(length) OVER ()) / (max(length) OVER () - min(length) OVER ()) AS l, (max(q) OVER () - q) / (max(q) OVER () - min(q) OVER ()) AS nq, (wc - min(wc) OVER ()) / (max(wc) OVER () - min(wc) OVER ()) AS nw FROM k)
    SELECT highway, count(*) AS n_edges, round(avg(0.5::DOUBLE * l + 0.3::DOUBLE * nw + 0.2::DOUBLE * nq), 5) AS mean_cost FROM n GROUP BY 1"""
)
def flagship_cost_by_highway(net) -> DataFrame:
    edges = build.build(net.nodes, net.edges, build.Layers(water=build.layers_of(net).water), build.Modes(green="OFF", lights=False, social=False, elevation=False))
    weights = {k: F.lit({"distance": 0.5, "water": 0.3, "quietness": 0.2}.get(k, 0.0)) for k in cost.FEATURES}
    lengths = edges.where("length > 0").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    priced = edges.crossJoin(F.broadcast(lengths)).withColumn("cost", cost.edge_cost(F.col("low"), F.col("high"), weights))
    return priced.groupBy("highway").agg(F.count(F.lit(1)).alias("n_edges"), r(F.avg("cost"), 5).alias("mean_cost"))


@query()
def legacy_loop_penalties(net) -> DataFrame:
    return cost.legacy_penalties(net.edges)


def _norm(c: str, invert: bool = False) -> str:
    low, high = f"min({c}) OVER ()", f"max({c}) OVER ()"
    share = f"({high} - {c}) / ({high} - {low})" if invert else f"({c} - {low}) / ({high} - {low})"
    return f"round(coalesce(CASE WHEN {high} = {low} THEN 0.0::DOUBLE ELSE {share} END, 0.5::DOUBLE), 5)"


@query(
    f"""WITH {_SAMPLED}, w AS ({_WATER}), {_NEAR_POIS}, {_DEM}, k AS (SELECT e.u, e.v, e.key, 1 - coalesce(t.share, 0) AS g, least(1.0::DOUBLE, coalesce(w.d / 250, 1.0::DOUBLE)) AS w, length / greatest(0.1::DOUBLE, coalesce(c.n, 0)) AS s,
    {_NOISE} AS q, {_SLOPE.format(g='((hb.value - ha.value) / length)')} AS e FROM edges e LEFT JOIN t USING (u, v, key) LEFT JOIN w USING (u, v, key) LEFT JOIN c USING (u, v, key) LEFT JOIN hts ha ON ha.node_id = e.u LEFT JOIN hts hb ON hb.node_id = e.v
    WHERE {_WALK} AND e.u NOT IN {_GATES} AND e.v NOT IN {_GATES}) SELECT u, v, key, """
    + ", ".join(f"{_norm(c, i)} AS {n}" for n, c, i in _NORMS) + " FROM k"
)
def full_build(net) -> DataFrame:
    edges = build.build(net.nodes, net.edges, build.layers_of(net))
    return edges.select(*EDGE, *[r(n, 5).alias(n) for n, _, _ in _NORMS])
