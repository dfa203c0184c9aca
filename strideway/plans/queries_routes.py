"""Queries over stored routes, path searches, network simplification and round trips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.functions import cost, geo, text
from strideway.operators import filters, graphs, loops, paths, regions, routes, spatial
from strideway.operators.materialise import written
from strideway.plans.net_sql import bearing, hav
from strideway.plans.queries_edges import _GATES, _LENGTH, _WALK, scored

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def r(column, digits: int = 6):
    return F.round(column, digits)


def stepped(net) -> DataFrame:
    return routes.walked(net.walks, net.edges, ["name", "highway", "way"])


@query("SELECT route_id, pos::INTEGER AS pos, u, v, round(length, 4) AS length, highway FROM walked")
def route_steps(net) -> DataFrame:
    return stepped(net).select("route_id", "pos", "u", "v", r("length", 4).alias("length"), "highway")


@query("SELECT route_id, count(length) AS n_edges, round(sum(length), 4) AS length, round(sum(length * 2), 4) AS cost, round(avg((way % 51) / 50.0::DOUBLE), 6) AS mean_water FROM walked GROUP BY 1")
def route_totals(net) -> DataFrame:
    out = routes.totals(stepped(net).withColumns({"cost": F.col("length") * 2, "norm_water": (F.col("way") % 51) / 50.0}))
    return out.select("route_id", "n_edges", r("length", 4).alias("length"), r("cost", 4).alias("cost"), r("mean_water").alias("mean_water"))


_AIR = hav("arg_min(lat, pos)", "arg_min(lon, pos)", "arg_max(lat, pos)", "arg_max(lon, pos)")


@query(
    f"""WITH m AS (SELECT route_id, sum(CASE WHEN length > 0 AND pos > 2 THEN length / (5000 / 60.0::DOUBLE) * CASE WHEN way % 2 = 0 THEN 1.2::DOUBLE ELSE 1 END END) AS t FROM walked GROUP BY 1), a AS (SELECT route_id, {_AIR} AS air FROM places GROUP BY 1)
    SELECT route_id, round(CASE WHEN t > 0 THEN t ELSE coalesce(air, 0) / (5000 / 60.0::DOUBLE) END, 6) AS minutes FROM walks LEFT JOIN m USING (route_id) LEFT JOIN a USING (route_id)"""
)
def route_minutes(net) -> DataFrame:
    """The way in, up to the third step, takes no time; what is left without a step counts by its distance."""
    rows = stepped(net).where("pos > 2").withColumn("slope_time_cost", F.when(F.col("way") % 2 == 0, 1.2))
    ends = routes.located(net.walks, net.nodes).groupBy("route_id").agg(*[f(c, "pos").alias(f"{n}_{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in ("lat", "lon")])
    air = geo.haversine(*(F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")))
    distances = net.walks.select("route_id").join(ends, "route_id", "left").select("route_id", air.alias("distance"))
    return routes.travel_minutes(rows, 5.0, distances).select("route_id", r("minutes").alias("minutes"))


@query("SELECT route_id, pos::INTEGER AS pos, round(sum(length) OVER (PARTITION BY route_id ORDER BY pos), 4) AS walked FROM walked")
def route_cumulative(net) -> DataFrame:
    return routes.cumulative(stepped(net)).select("route_id", "pos", r("walked", 4).alias("walked"))


@query(
    """WITH l AS (SELECT route_id, pos, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM places WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
    c AS (SELECT route_id, pos, CASE WHEN la IS NOT NULL THEN (degrees(atan2((lon - lo) * cos(radians((la + lat) / 2)), lat - la)) + 360) % 360 END AS course FROM l),
    d AS (SELECT route_id, ((course - lag(course) OVER (PARTITION BY route_id ORDER BY pos) + 540) % 360) - 180 AS t FROM c)
    SELECT route_id, count(*) FILTER (abs(t) > 60) AS sharp_turns, round(coalesce(sum(abs(t)) FILTER (abs(t) > 20), 0), 4) AS turned FROM d GROUP BY 1"""
)
def route_turns(net) -> DataFrame:
    return routes.turns(routes.located(net.walks, net.nodes)).select("route_id", "sharp_turns", r("turned", 4).alias("turned"))


@query("WITH c AS (SELECT route_id, lag(name) OVER w <> name AS a, lag(highway) OVER w <> highway AS b FROM walked WINDOW w AS (PARTITION BY route_id ORDER BY pos)) SELECT route_id, count(*) FILTER (a) AS name_changes, count(*) FILTER (b) AS type_changes FROM c GROUP BY 1")
def route_changes(net) -> DataFrame:
    return routes.changes(stepped(net))


@query("WITH n AS (SELECT route_id, row_number() OVER (PARTITION BY route_id, least(u, v), greatest(u, v) ORDER BY pos) AS k FROM steps) SELECT route_id, round(avg((k > 1)::INTEGER), 6) AS retraced FROM n GROUP BY 1")
def route_retraced(net) -> DataFrame:
    return routes.retraced_share(routes.steps(net.walks)).select("route_id", r("retraced").alias("retraced"))


_P = ("a.lat", "a.lon", "p.lat", "p.lon")


@query(
    f"""WITH d AS (SELECT p.route_id, p.pos, round({hav(*_P)}, 6) AS far, {bearing(*_P)} AS course FROM places p JOIN places a ON a.route_id = p.route_id AND a.pos = 0),
    t AS (SELECT route_id, arg_max(far, (far, -pos)) AS far, arg_max(course, (far, -pos)) AS course FROM d GROUP BY 1) SELECT route_id, CASE WHEN far >= 10 THEN round(course, 5) END AS bearing FROM t"""
)
def route_main_bearing(net) -> DataFrame:
    return routes.main_bearing(routes.located(net.walks, net.nodes)).select("route_id", r("bearing", 5).alias("bearing"))


_SETS = "sets AS (SELECT request_id, route_id, len(route) AS n, list_distinct(list_transform(range(1, len(route)), lambda i: route[i] || '>' || route[i + 1])) AS s FROM walks)"
_LIKE = "CASE WHEN a.n < 2 OR b.n < 2 THEN 0.0::DOUBLE ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE END"


@query(f"WITH {_SETS} SELECT a.request_id, a.route_id AS a, b.route_id AS b, round({_LIKE}, 6) AS similarity FROM sets a JOIN sets b ON a.request_id = b.request_id AND a.route_id < b.route_id")
def route_similarity(net) -> DataFrame:
    return routes.similar_pairs(net.walks).select("request_id", "a", "b", r("similarity").alias("similarity"))


@query("SELECT route_id, len(list_distinct(list(floor(lat / 0.00045::DOUBLE) || ':' || floor(lon / 0.00045::DOUBLE)))) AS cells FROM places GROUP BY 1")
def route_cells(net) -> DataFrame:
    return routes.coordinates(net.walks, net.nodes).select("route_id", F.size(routes.fingerprint(F.col("points"))).cast("long").alias("cells"))


@query(
    """WITH c AS (SELECT w.request_id, w.route_id, w.variant, list_distinct(list(floor(lat / 0.00045::DOUBLE) || ':' || floor(lon / 0.00045::DOUBLE))) AS s FROM places JOIN walks w USING (route_id) GROUP BY 1, 2, 3),
    p AS (SELECT a.request_id, a.variant AS x, b.variant AS y, len(list_intersect(a.s, b.s)) / greatest(len(list_distinct(list_concat(a.s, b.s))), 1)::DOUBLE > 0.5 AS alike FROM c a JOIN c b ON a.request_id = b.request_id AND a.variant < b.variant),
    k AS (SELECT request_id, bool_or(alike) FILTER (x = 0 AND y = 1) AS c01, bool_or(alike) FILTER (x = 0 AND y = 2) AS c02, bool_or(alike) FILTER (x = 1) AS c12 FROM p GROUP BY 1)
    SELECT request_id, route_id FROM c JOIN k USING (request_id) WHERE variant = 0 OR (variant = 1 AND NOT c01) OR (variant = 2 AND NOT c02 AND (c01 OR NOT c12))"""
)
def route_distinct(net) -> DataFrame:
    cells = routes.coordinates(net.walks, net.nodes).select("route_id", routes.fingerprint(F.col("points")).alias("cells"))
    return routes.distinct_routes(net.walks.select("route_id", "request_id").join(cells, "route_id"), 0.5)


@query("WITH q AS (SELECT *, round(abs(len - 600) / 600, 9) AS dev FROM (SELECT route_id, request_id, sum(length) AS len, sum(length * (way % 7)) AS scenic FROM walked JOIN walks USING (route_id) GROUP BY 1, 2)) SELECT route_id, row_number() OVER (PARTITION BY request_id ORDER BY round(scenic, 6), route_id) AS scenic_rank, round(0.6::DOUBLE * greatest(0, 1 - least(dev / 0.5, 1)) + 0.4::DOUBLE * greatest(0, 1 - scenic / max(scenic) OVER (PARTITION BY request_id)), 5) AS quality FROM q")
def route_quality(net) -> DataFrame:
    return _scored_walks(net).select("route_id", "scenic_rank", r("quality", 5).alias("quality"))


def _scored_walks(net) -> DataFrame:
    from pyspark.sql import Window

    rows = stepped(net).groupBy("route_id").agg(F.sum("length").alias("length"), r(F.sum(F.col("length") * (F.col("way") % 7))).alias("scenic_cost"))
    rows = rows.join(net.walks, "route_id").withColumn("deviation", F.abs(F.col("length") - 600) / 600)
    worst = F.max("scenic_cost").over(Window.partitionBy("request_id"))
    return routes.ranked(rows.withColumn("quality", routes.quality(F.col("deviation"), F.col("scenic_cost"), worst)))


@query("SELECT route_id, (0.8::DOUBLE * CASE WHEN variant * 0.1 > 0.15 THEN greatest(0.1::DOUBLE, 1 - variant * 0.1::DOUBLE) ELSE 1 END * CASE WHEN variant = 0 THEN 1 ELSE 0.3::DOUBLE + 0.7::DOUBLE * (variant / 2.0::DOUBLE) END)::DECIMAL(9, 6)::DOUBLE AS score FROM walks")
def route_penalties(net) -> DataFrame:
    k = F.col("variant")
    return net.walks.select("route_id", r(routes.penalised(F.lit(0.8), k * 0.1, F.when(k != 0, k / 2.0))).alias("score"))


@query(
    """SELECT route_id, array_to_string(list_reduce(list_transform(route, lambda x: [x]), lambda s, x: CASE WHEN len(s) >= 2 AND s[-2] = x[1] THEN s[1:len(s) - 1] ELSE list_concat(s, x) END), ',') AS route,
    array_to_string(list_filter(route, lambda x, i: (i - 1) % ceil(len(route) / 5.0)::BIGINT = 0 OR i = len(route)), ',') AS thin FROM walks"""
)
def route_without_spurs(net) -> DataFrame:
    rows = net.walks.select("route_id", routes.without_spurs(F.col("route")).alias("clean"), routes.thinned(F.col("route"), 5).alias("few"))
    return rows.select("route_id", *[F.concat_ws(",", F.transform(c, lambda n: n.cast("string"))).alias(name) for c, name in (("clean", "route"), ("few", "thin"))])


@query("SELECT route_id, array_to_string(list_concat(route, list_reverse(route)[2:]), ',') AS tour FROM walks")
def route_there_and_back(net) -> DataFrame:
    return net.walks.select("route_id", F.concat_ws(",", routes.joined_paths(F.col("route"), F.reverse("route")).cast("array<string>")).alias("tour"))


@query("SELECT s.route_id, pos::INTEGER AS pos, round(b.length, 2) AS length, b.highway AS highway, round(n.elevation, 1) AS u_elevation FROM steps s JOIN (SELECT u, v, arg_min(struct_pack(length := length, highway := highway), key) AS b FROM edges GROUP BY 1, 2) USING (u, v) JOIN nodes n ON n.node_id = s.u")
def route_edge_features(net) -> DataFrame:
    return routes.edge_features(net.walks, scored(net), net.nodes).select("route_id", "pos", "length", "highway", "u_elevation")


@query(
    f"""WITH {_SETS}, l AS (SELECT route_id, w.request_id, round(abs(sum(length) - 600) / 600, 9) AS dev, round(sum(length * (way % 7)), 6) AS scenic FROM walked JOIN walks w USING (route_id) GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(0.6::DOUBLE * greatest(0, 1 - least(dev / 0.5, 1)) + 0.4::DOUBLE * greatest(0, 1 - scenic / m), 9) DESC, route_id) AS turn FROM (SELECT *, max(scenic) OVER (PARTITION BY request_id) AS m FROM l)),
    u AS (SELECT q.request_id, q.route_id, row_number() OVER (PARTITION BY q.request_id ORDER BY {_LIKE}, q.turn) AS n FROM q JOIN q f ON f.request_id = q.request_id AND f.turn = 1 AND q.turn > 1 JOIN sets a ON a.route_id = f.route_id JOIN sets b ON b.route_id = q.route_id)
    SELECT request_id, route_id, 1 AS place FROM q WHERE turn = 1 UNION ALL SELECT request_id, route_id, 2 FROM u WHERE n = 1"""
)
def route_diverse(net) -> DataFrame:
    return routes.diverse(_scored_walks(net), 2)


@query()
def route_names(net) -> DataFrame:
    rows = _scored_walks(net)
    chosen = written(routes.diverse(rows, 3), "chosen").join(rows, ["request_id", "route_id"])
    chosen = chosen.withColumns({"bearing": (F.col("route_id") * 40 % 360).cast("double"), "corners": F.col("variant") + 2, "kind": F.lit("polygon")})
    return loops.named(chosen).select("request_id", "route_id", "place", "role", "scenic_rank", "of", "subtitle")


@query(
    """WITH l AS (SELECT request_id % 4 AS bias, route, (SELECT 600) AS target, len FROM walks JOIN (SELECT route_id, sum(length) AS len FROM walked GROUP BY 1) USING (route_id))
    SELECT bias, count(*) AS attempts, round(avg((route[1] = route[-1])::INTEGER) * 100, 4) AS closed_pct, round(avg(abs(len - target) / target * 100), 4) AS mean_error_pct, round(avg((len(list_distinct(route)) < len(route) - 1)::INTEGER) * 100, 4) AS crossing_pct FROM l GROUP BY 1"""
)
def loop_batch_report(net) -> DataFrame:
    lengths = stepped(net).groupBy("route_id").agg(F.sum("length").alias("length"))
    rows = net.walks.join(lengths, "route_id").withColumns({"bias": F.col("request_id") % 4, "target_m": F.lit(600.0)})
    return routes.loop_report(rows, ["bias"]).select("bias", "attempts", *[r(c, 4).alias(c) for c in ("closed_pct", "mean_error_pct", "crossing_pct")])


@query("SELECT request_id, ['Northbound', 'North-east', 'Eastbound', 'South-east', 'Southbound', 'South-west', 'Westbound', 'North-west'][(floor(((request_id * 37) % 360 + 22.5) / 45)::INTEGER) % 8 + 1] AS direction, ['Loop', 'Triangle', 'Quadrilateral', 'Pentagon', 'Hexagon', 'Polygon'][request_id % 6 + 1] AS shape FROM requests")
def shape_words(net) -> DataFrame:
    k = F.col("request_id")
    return net.requests.select("request_id", text.direction_word((k * 37 % 360).cast("double")).alias("direction"), text.shape_word(F.lit("polygon"), k % 6 + 2).alias("shape"))


_S = ("start_lat", "start_lon", "nlat", "nlon")


@query(f"SELECT request_id, (floor({bearing(*_S)} / 30)::INTEGER % 12) AS sector, round(sum(radius * (1 - {hav(*_S)} / 1500)), 3) AS weight FROM requests JOIN shapes ON kind = 'green' WHERE {hav(*_S)} <= 1500 GROUP BY ALL")
def sector_weights(net) -> DataFrame:
    return spatial.sector_weights(net.requests, _green_points(net), 1500.0).select("request_id", "sector", r("weight", 3).alias("weight"))


def _green_points(net) -> DataFrame:
    shapes = net.polygons.where("kind = 'green'")
    sizes = net.table("part").select(F.col("p_partkey").alias("geom_id"), (F.col("p_size") * 3 + 5).alias("area"))
    return shapes.join(sizes, "geom_id").select("lat", "lon", "area")


@query()
def loop_skeletons(net) -> DataFrame:
    asked = _loop_requests(net)
    sectors = spatial.sector_weights(asked, _green_points(net), 1500.0)
    candidates = loops.skeletons(loops.bearings(asked, sectors, variety=1), 1)
    return loops.waypoints(candidates).select("candidate_id", "place", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


def _loop_requests(net) -> DataFrame:
    bias = F.when(F.col("request_id") % 3 == 0, "east").otherwise("none")
    return net.requests.select("request_id", "start", "start_lat", "start_lon", F.lit(1500.0).alias("target_m"), bias.alias("bias"))


@query(f"SELECT request_id, arg_min(node_id, (round({hav('start_lat + 0.0001::DOUBLE', 'start_lon + 0.0001::DOUBLE', 'lat', 'lon')}, 6), node_id)) AS node_id FROM requests, nodes WHERE abs(lat - start_lat) < 0.01 AND abs(lon - start_lon) < 0.01 GROUP BY 1")
def nearest_node(net) -> DataFrame:
    points = net.requests.select("request_id", (F.col("start_lat") + 0.0001).alias("lat"), (F.col("start_lon") + 0.0001).alias("lon"))
    return spatial.nearest_nodes(points, ["request_id"], net.nodes).select("request_id", "node_id")


@query()
def paths_by_length(net) -> DataFrame:
    return paths.least_length_paths(net.requests, net.edges, net.nodes).select("request_id", "route", r("cost", 4).alias("metres"))


_METRES = f"""WITH RECURSIVE st AS MATERIALIZED (SELECT u, v, min(length) AS c FROM edges GROUP BY 1, 2),
    r AS MATERIALIZED (SELECT request_id, s, e, 3 * {hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} AS most FROM requests),
    t(request_id, node, g) USING KEY (request_id, node) AS (
      SELECT request_id, s, 0.0::DOUBLE FROM r UNION
      SELECT n.request_id, n.v, n.g FROM (SELECT t.request_id, st.v, min(t.g + st.c) AS g FROM t JOIN st ON st.u = t.node JOIN r ON r.request_id = t.request_id WHERE t.g + st.c <= r.most GROUP BY 1, 2) n
      LEFT JOIN recurring.t o ON o.request_id = n.request_id AND o.node = n.v WHERE o.g IS NULL OR n.g < o.g
    ) SELECT t.request_id, round(g, 4) AS metres FROM t JOIN r ON r.request_id = t.request_id AND node = e"""


@query(_METRES)
def path_metres(net) -> DataFrame:
    """Lengths only, as equally long paths may differ; the SQL follows paths up to three times the distance."""
    return paths.least_lengths(net.requests, net.edges, net.nodes).select("request_id", r("cost", 4).alias("metres"))


def _by_weights(net, wanted: DataFrame, keep: list) -> tuple:
    """Requests with weights from their sliders, the edges, and the cost of an edge for a request."""
    # written first, so that the network is derived once
    edges = written(scored(net).select("u", "v", "length", *cost.NORMS.values()), "edges")
    low, high = edges.where("length > 0").agg(F.min("length"), F.max("length")).first()
    weights = cost.slider_weights({k: F.col(k) for k in cost.FEATURES})
    asked = written(wanted.select(*keep, "start", "end", *[w.alias(k) for k, w in weights.items()]), "asked")
    step = lambda: cost.edge_cost(F.lit(low), F.lit(high), {k: F.col(k) for k in cost.FEATURES})
    return asked, edges, step, cost.weighted_parts(F.lit(low), F.lit(high))


def _weighted(net, asked: DataFrame, edges: DataFrame, step: Callable, parts: dict, routes: bool) -> DataFrame:
    """(request_id, cost, route): searches near the requests; by rounds where there is another cost function."""
    rest = lambda left: (paths.shortest_paths if routes else paths.least_costs)(left.select(asked.columns), edges, step)
    if cost.cost_function() is not cost.weighted_sum:
        return rest(asked)
    priced = edges.select("u", "v", *[c.alias(n) for n, c in parts.items()])
    return regions.least_paths(asked, priced, net.nodes, cost.weighted_costs, list(parts), rest, routes)


def _scenarios(net) -> tuple:
    wanted = paths.scenarios(net.requests.withColumn("distance", F.coalesce("distance", F.lit(3.0))))
    return _by_weights(net, wanted, [F.concat_ws(":", F.col("request_id").cast("string"), "scenario").alias("request_id")])


def _unlabelled(found: DataFrame) -> DataFrame:
    parts = F.split("request_id", ":")
    return found.withColumns({"scenario": parts[1], "request_id": parts[0].cast("long")})


def _cheapest(asked: str, step: str, edges: str = "SELECT * FROM scored, range_l") -> str:
    """SQL of the least cost of each row (id, s, e, ...) of ``asked`` over edges with a cost; what can't beat the best known way goes."""
    return f"""WITH RECURSIVE st AS MATERIALIZED ({edges}), r AS MATERIALIZED ({asked}),
    t(id, node, g) USING KEY (id, node) AS (
      SELECT id, s, 0.0::DOUBLE FROM r UNION
      SELECT n.id, n.v, n.g FROM (SELECT t.id, any_value(r.e) AS e, st.v, min(t.g + {step}) AS g FROM t JOIN st ON st.u = t.node JOIN r ON r.id = t.id GROUP BY t.id, st.v) n
      LEFT JOIN recurring.t o ON o.id = n.id AND o.node = n.v LEFT JOIN recurring.t b ON b.id = n.id AND b.node = n.e WHERE (o.g IS NULL OR n.g < o.g - 1e-12) AND (b.g IS NULL OR n.g < b.g)
    ) SELECT r.*, round(g, 6) AS cost FROM t JOIN r ON r.id = t.id AND node = e"""


_STEP = f"r.d * {_LENGTH} + r.g_ * norm_green + r.w * norm_water + r.c * norm_social + r.q * coalesce(norm_quiet, 0.5::DOUBLE) + abs(r.h) * CASE WHEN r.h >= 0 THEN norm_slope ELSE 1 - norm_slope END"
_SHARES = "d / z AS d, g / z AS g_, w / z AS w, c / z AS c, q / z AS q, h / z AS h FROM (SELECT *, d + g + w + c + q + abs(h) AS z FROM"
_SLIDERS = "SELECT request_id, s, e, greatest(0.1::DOUBLE, coalesce(distance, 3.0::DOUBLE)) AS d, greenness AS g, water AS w, social AS c, quietness AS q, slope AS h FROM requests"
_TOP = "CASE WHEN g >= greatest(w, q, c, h) OR greatest(g, w, q, c, h) <= 0 THEN 'g' WHEN w >= greatest(q, c, h) THEN 'w' WHEN q >= greatest(c, h) THEN 'q' WHEN c >= h THEN 'c' ELSE 'h' END"
_SCENARIOS = (
    f"SELECT request_id, s, e, scenario, CASE scenario WHEN 'baseline' THEN 1.0::DOUBLE WHEN 'extremist' THEN 0.1::DOUBLE ELSE d END AS d, "
    + ", ".join(f"CASE scenario WHEN 'baseline' THEN 0.0::DOUBLE WHEN 'extremist' THEN CASE WHEN top = '{c}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {c} END AS {c}" for c in "gwcqh")
    + f" FROM (SELECT *, {_TOP} AS top FROM ({_SLIDERS})), (SELECT unnest(['baseline', 'extremist', 'balanced']) AS scenario)"
)


@query(f"SELECT request_id, scenario, cost FROM ({_cheapest(f'SELECT request_id || scenario AS id, request_id, scenario, s, e, {_SHARES} ({_SCENARIOS}))', _STEP)})")
def path_costs_by_scenario(net) -> DataFrame:
    """What the baseline, extremist and balanced path of each request costs; equally dear paths may differ."""
    return _unlabelled(_weighted(net, *_scenarios(net), routes=False)).select("request_id", "scenario", r("cost").alias("cost"))


@query()
def paths_by_scenario(net) -> DataFrame:
    """The baseline, extremist and balanced path of each request."""
    return _unlabelled(_weighted(net, *_scenarios(net), routes=True)).select("request_id", "scenario", "route", r("cost").alias("cost"))


@query(f"SELECT request_id, cost FROM ({_cheapest(f'SELECT request_id AS id, request_id, s, e, {_SHARES} ({_SLIDERS}))', _STEP)})")
def path_costs_by_preference(net) -> DataFrame:
    return _weighted(net, *_by_weights(net, net.requests, ["request_id"]), routes=False).select("request_id", r("cost").alias("cost"))


@query()
def paths_by_preference(net) -> DataFrame:
    return _weighted(net, *_by_weights(net, net.requests, ["request_id"]), routes=True).select("request_id", "route", r("cost").alias("cost"))


@query(
    """SELECT request_id, scenario, CASE WHEN scenario = 'baseline' THEN 1.0::DOUBLE WHEN scenario = 'extremist' THEN 0.1::DOUBLE ELSE d END AS distance,
    CASE scenario WHEN 'baseline' THEN 0.0::DOUBLE WHEN 'balanced' THEN greenness ELSE CASE WHEN greenness >= greatest(water, social, quietness, slope) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS greenness,
    CASE scenario WHEN 'baseline' THEN 0.0::DOUBLE WHEN 'balanced' THEN slope ELSE CASE WHEN slope > greatest(greenness, water, social, quietness) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS slope
    FROM (SELECT *, coalesce(distance, 3.0::DOUBLE) AS d FROM requests), (SELECT unnest(['baseline', 'extremist', 'balanced']) AS scenario)"""
)
def route_scenarios(net) -> DataFrame:
    rows = net.requests.withColumn("distance", F.coalesce("distance", F.lit(3.0)))
    return paths.scenarios(rows).select("request_id", "scenario", "distance", "greenness", "slope")


@query()
def paths_compared(net) -> DataFrame:
    k = F.col("request_id")
    toggles = {t: k % (i + 2) == 0 for i, t in enumerate(paths.TOGGLES)}
    asked = paths.advanced_compare(net.requests.select("request_id", "start", "end", (k % 4 == 1).alias("sliders"), *[c.alias(t) for t, c in toggles.items()]))
    asked = written(asked.withColumn("request_id", F.concat_ws(":", k.cast("string"), "scenario")), "asked")
    edges = scored(net)
    low, high = edges.where("length > 0").agg(F.min("length"), F.max("length")).first()
    step = lambda: cost.compared_cost(F.col("scenario"), {t: F.col(t) for t in paths.TOGGLES})
    factors = cost.compared_factors(F.lit(low), F.lit(high))
    edges = written(edges.select("u", "v", "length", *[c.alias(n) for n, c in factors.items()]), "edges")
    rest = lambda left: paths.shortest_paths(left.select(asked.columns), edges, step)
    found = regions.least_paths(asked, edges, net.nodes, cost.compared_costs, ["length", *factors], rest)
    return found.select(F.split("request_id", ":")[0].cast("long").alias("request_id"), F.split("request_id", ":")[1].alias("scenario"), "route", r("cost").alias("cost"))


@query(
    f"""WITH RECURSIVE st AS MATERIALIZED (SELECT DISTINCT u, v FROM edges WHERE {_WALK} AND u NOT IN {_GATES} AND v NOT IN {_GATES}), t AS (SELECT request_id, s AS node FROM requests UNION SELECT request_id, v FROM t JOIN st ON u = node)
    SELECT r.request_id, t.node IS NOT NULL AS reachable FROM requests r LEFT JOIN t ON t.request_id = r.request_id AND t.node = r.e"""
)
def reachable_requests(net) -> DataFrame:
    return paths.reachable(net.requests.select("request_id", "start", "end"), filters.walkable(net.edges, net.nodes), net.nodes)


_WALKED = f"src AS MATERIALIZED (SELECT * FROM edges WHERE {_WALK} AND u NOT IN {_GATES} AND v NOT IN {_GATES})"
_PAIRS = "nb AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT u AS a, v AS b FROM src UNION ALL SELECT v, u FROM src) WHERE a <> b)"


@query(
    f"""WITH RECURSIVE {_WALKED}, {_PAIRS}, s AS (SELECT 0 AS k, a, b FROM nb UNION ALL
    SELECT k + 1, a, b FROM (SELECT *, min(least(da, db)) OVER () AS low FROM (SELECT *, count(*) OVER (PARTITION BY a) AS da, count(*) OVER (PARTITION BY b) AS db FROM s)) WHERE low <= 1 AND da > 1 AND db > 1)
    SELECT highway, count(*) AS n FROM src JOIN (SELECT a, b FROM s WHERE k = (SELECT max(k) FROM s)) ON a = u AND b = v GROUP BY 1"""
)
def dead_ends_removed(net) -> DataFrame:
    return graphs.without_dead_ends(filters.walkable(net.edges, net.nodes)).groupBy("highway").agg(F.count(F.lit(1)).alias("n"))


def _capped_sql() -> str:
    """Three rounds, each with what is left of the number of nodes that may go."""
    sql, left = f"WITH {_WALKED}, {_PAIRS}", "(SELECT greatest(count(DISTINCT a) // 20, 50) FROM nb)"
    for k in range(3):
        own = "nb" if not k else f"nb{k}"
        sql += f", e{k} AS MATERIALIZED (SELECT a FROM {own} WHERE a <> 0 GROUP BY a HAVING count(*) <= 1 ORDER BY a LIMIT ({left}))"
        sql += f", nb{k + 1} AS MATERIALIZED (SELECT * FROM {own} WHERE a NOT IN (SELECT a FROM e{k}) AND b NOT IN (SELECT a FROM e{k}))"
        left = f"{left} - (SELECT count(*) FROM e{k})"
    return f"{sql} SELECT highway, count(*) AS n FROM src JOIN nb3 ON a = u AND b = v GROUP BY 1"


@query(_capped_sql())
def dead_ends_removed_capped(net) -> DataFrame:
    return graphs.without_dead_ends(filters.walkable(net.edges, net.nodes), start=0, rounds=3).groupBy("highway").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {_WALKED}, {_PAIRS}, mid AS MATERIALIZED (SELECT a AS node FROM nb GROUP BY 1 HAVING count(*) = 2), c AS MATERIALIZED (SELECT u, v, min(length) AS length FROM src WHERE u <> v GROUP BY 1, 2),
    w AS (SELECT u AS a, u AS before, v AS node, length, 0 AS n FROM c WHERE u NOT IN (SELECT node FROM mid) UNION ALL
    SELECT w.a, w.node, c.v, w.length + c.length, w.n + 1 FROM w JOIN mid ON mid.node = w.node JOIN c ON c.u = w.node AND c.v <> w.before)
    SELECT a AS u, node AS v, round(length, 4) AS length, n AS n_inner FROM w WHERE node NOT IN (SELECT node FROM mid)"""
)
def contracted_chains(net) -> DataFrame:
    return graphs.chains(filters.walkable(net.edges, net.nodes)).select("u", "v", r("length", 4).alias("length"), F.size("inner").alias("n_inner"))


@query()
def consolidated_nodes(net) -> DataFrame:
    nodes = net.nodes.withColumn("x", F.col("x") / 4)
    groups = graphs.merge_groups(nodes, 20.0, 0)
    return graphs.consolidated(net.edges, written(groups, "groups")).groupBy("highway").agg(F.count(F.lit(1)).alias("n"))


@query()
def route_gaps_restored(net) -> DataFrame:
    gaps = graphs.gaps(routes.steps(net.walks.withColumn("route", routes.thinned(F.col("route"), 4))), net.nodes)
    return graphs.restored(written(gaps, "gaps"), net.edges, nodes=net.nodes).select("route_id", "pos", "route")


@query()
def loops_geometric(net) -> DataFrame:
    found = loops.loop_solver("geometric")(_loop_requests(net), written(net.nodes, "nodes"), written(scored(net), "edges"))
    return found.select("candidate_id", "request_id", "kind", r("length", 3).alias("length"), "route")


@query()
def loops_random_walk(net) -> DataFrame:
    placed = spatial.with_endpoints(net.edges, net.nodes)
    course = geo.bearing(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
    edges = written(placed.select("u", "v", "length", (F.col("way") % 101 / 100.0).alias("cost"), course.alias("course")), "edges")
    asked = net.requests.select("request_id", "start", F.lit(1200.0).alias("target_m"), (F.col("request_id") * 40 % 360).cast("double").alias("bearing"))
    walks = loops.random_walks(asked, edges)
    return loops.closed_walks(walks, edges, net.nodes).select("request_id", "attempt", r("length", 3).alias("length"), "route")


