"""Analytics of stored routes (route_id, route: node ids in order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.functions import cost, geo


def steps(routes: DataFrame) -> DataFrame:
    """(route_id, pos, u, v): pairs of following nodes, from the array itself, without a shuffle."""
    pairs = F.arrays_zip(F.slice("route", 1, F.greatest(F.size("route") - 1, F.lit(0))).alias("u"), F.slice("route", 2, F.size("route")).alias("v"))
    return routes.select("route_id", F.posexplode(pairs).alias("pos", "s")).select("route_id", "pos", "s.u", "s.v")


def best_parallel(edges: DataFrame, by: str = "length", columns: list[str] | None = None) -> DataFrame:
    """Of the edges between two nodes the one with the least ``by`` (then key)."""
    rest = columns or [c for c in edges.columns if c not in ("u", "v")]
    names = [by, "key", *[c for c in rest if c not in (by, "key")]]
    names = list(dict.fromkeys(names))
    best = edges.groupBy("u", "v").agg(F.min_by(F.struct(*names), F.struct(F.col(by).alias("first"), F.col("key").alias("second"))).alias("best"))
    return best.select("u", "v", *[F.col(f"best.{c}").alias(c) for c in names])


def first_parallel(edges: DataFrame) -> DataFrame:
    return best_parallel(edges, "key")


def walked(routes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Steps with columns of the shortest edge between their nodes."""
    best = best_parallel(edges, "length", ["length", *columns])
    return steps(routes).join(best, ["u", "v"], "left")


def totals(stepped: DataFrame) -> DataFrame:
    """(route_id, n_edges, length, cost, mean_water) of steps with length, cost and norm_water."""
    return stepped.groupBy("route_id").agg(F.count("length").alias("n_edges"), F.sum("length").alias("length"), F.sum("cost").alias("cost"), F.avg("norm_water").alias("mean_water"))


def travel_minutes(stepped: DataFrame, speed_kmh: float, distances: DataFrame | None = None, activity: str = "walking") -> DataFrame:
    """(route_id, minutes): each step at the speed, slowed by its slope: by its gradients where it has any, else by its
    ``slope_time_cost``. Routes of ``distances`` (route_id, distance) without a step that takes time need their distance's time."""
    per_minute = speed_kmh * 1000 / 60
    slope = F.coalesce("slope_time_cost", F.lit(1.0)) if "slope_time_cost" in stepped.columns else F.lit(1.0)
    if "uphill_gradient" in stepped.columns:
        known = F.col("uphill_gradient").isNotNull() | F.col("downhill_gradient").isNotNull()
        slope = F.when(known, cost.tobler(F.coalesce("uphill_gradient", F.lit(0.0)) - F.coalesce("downhill_gradient", F.lit(0.0)), activity)).otherwise(slope)
    walked = stepped.groupBy("route_id").agg(F.coalesce(F.sum(F.when(F.col("length") > 0, F.col("length") / per_minute * slope)), F.lit(0.0)).alias("minutes"))
    if distances is None:
        return walked
    by_distance = F.greatest(F.col("distance") / per_minute, F.lit(0.0))
    return distances.join(walked, "route_id", "left").select("route_id", F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(F.coalesce(by_distance, F.lit(0.0))).alias("minutes"))


def located(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route_id, pos, node_id, lat, lon, elevation)"""
    exploded = routes.select("route_id", F.posexplode("route").alias("pos", "node_id"))
    return exploded.join(nodes.select("node_id", "lat", "lon", "elevation"), "node_id").select("route_id", "pos", "node_id", "lat", "lon", "elevation")


def coordinates(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route_id, points): [{lat, lon, ele}] in order."""
    rows = located(routes, nodes).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", F.col("elevation").alias("ele")))).alias("p"))
    return rows.select("route_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), x["ele"].alias("ele"))).alias("points"))


def _in_order() -> Window:
    return Window.partitionBy("route_id").orderBy("pos")


def turns(places: DataFrame) -> DataFrame:
    """(route_id, sharp_turns, signed_turn, turned): changes of bearing along a route."""
    order = _in_order()
    course = geo.flat_bearing(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    rows = places.withColumn("course", course).withColumn("before", F.lag("course").over(order))
    change = geo.bearing_difference(F.col("before"), F.col("course"))
    return rows.withColumn("change", change).groupBy("route_id").agg(
        F.count_if(F.abs("change") > 60).alias("sharp_turns"), F.coalesce(F.sum("change"), F.lit(0.0)).alias("signed_turn"),
        F.coalesce(F.sum(F.when(F.abs("change") > 20, F.abs("change"))), F.lit(0.0)).alias("turned"),
    )


def changes(stepped: DataFrame) -> DataFrame:
    """(route_id, name_changes, type_changes): where both sides are known."""
    order = _in_order()
    differs = lambda c: F.lag(c).over(order) != F.col(c)
    rows = stepped.withColumns({"a": differs("name"), "b": differs("highway")})
    return rows.groupBy("route_id").agg(F.count_if("a").alias("name_changes"), F.count_if("b").alias("type_changes"))


def cumulative(stepped: DataFrame) -> DataFrame:
    """Steps with the distance walked so far."""
    return stepped.withColumn("walked", F.sum("length").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))


def retraced_share(stepped: DataFrame) -> DataFrame:
    """(route_id, retraced): the share of steps over ground already walked, in either direction."""
    ground = [F.least("u", "v"), F.greatest("u", "v")]
    per = stepped.groupBy("route_id", ground[0].alias("a"), ground[1].alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("route_id").agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("retraced"))


def ranked(candidates: DataFrame, by: str = "scenic_cost", keys: list[str] = ("request_id",)) -> DataFrame:
    return candidates.withColumn("scenic_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by, "route_id")))


def main_bearing(places: DataFrame) -> DataFrame:
    """(route_id, bearing): towards the farthest point of the route; null below 10 m."""
    first = Window.partitionBy("route_id").orderBy("pos")
    rows = places.withColumns({"lat0": F.first("lat").over(first), "lon0": F.first("lon").over(first)})
    args = (F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    rows = rows.withColumns({"far": F.round(geo.haversine(*args), 6), "course": geo.bearing(*args)})
    top = rows.groupBy("route_id").agg(F.max_by(F.struct("far", "course"), F.struct("far", -F.col("pos"))).alias("t"))
    return top.select("route_id", F.when(F.col("t.far") >= 10, F.col("t.course")).alias("bearing"))


def edge_set(route: Column) -> Column:
    """A route's directed steps as text."""
    pairs = F.zip_with(F.slice(route, 1, F.greatest(F.size(route) - 1, F.lit(0))), F.slice(route, 2, F.size(route)), lambda a, b: F.concat_ws(">", a.cast("string"), b.cast("string")))
    return F.array_distinct(pairs)


def edge_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two routes' steps; 0 below two nodes."""
    x, y = edge_set(a), edge_set(b)
    value = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.size(a) < 2) | (F.size(b) < 2), 0.0).otherwise(value)


def similar_pairs(routes: DataFrame) -> DataFrame:
    """(request_id, a, b, similarity): pairs of a request's routes; requests have few routes by contract of the source."""
    other = routes.select("request_id", F.col("route_id").alias("b"), F.col("route").alias("route_b"))
    pairs = routes.select("request_id", F.col("route_id").alias("a"), "route").join(other, "request_id").where("a < b")
    return pairs.select("request_id", "a", "b", edge_similarity(F.col("route"), F.col("route_b")).alias("similarity"))


def fingerprint(points: Column, size: float = 0.00045) -> Column:
    """The grid cells that a route's points {lat, lon} are in."""
    return F.array_distinct(F.transform(points, lambda p: F.concat_ws(":", F.floor(p["lat"] / size).cast("string"), F.floor(p["lon"] / size).cast("string"))))


def distinct_routes(routes: DataFrame, limit: float = 0.85) -> DataFrame:
    """Routes of each request that aren't too like an earlier kept one (in order of route_id).

    ``routes`` (request_id, route_id, cells). The choice is greedy, in an array for each request.
    """
    rows = routes.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("route_id", "cells"))).alias("all"))
    like = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    start = F.slice("all", 1, 0)
    kept = F.aggregate("all", start, lambda held, r: F.when(F.exists(held, lambda k: like(k["cells"], r["cells"]) > limit), held).otherwise(F.concat(held, F.array(r))))
    return rows.select("request_id", F.explode(F.transform(kept, lambda r: r["route_id"])).alias("route_id"))


def joined_paths(out: Column, back: Column) -> Column:
    """Two legs without their shared node twice."""
    return F.concat(out, F.slice(back, 2, F.size(back)))


def without_spurs(route: Column) -> Column:
    """A route without steps there and straight back, until there are none: one pass with a stack."""

    def push(stack: Column, node: Column) -> Column:
        n = F.size(stack)
        # try_element_at: a stack shorter than two has no such element
        return F.when((n >= 2) & (F.try_element_at(stack, F.lit(-2)) == node), F.slice(stack, 1, n - 1)).otherwise(F.concat(stack, F.array(node)))

    return F.aggregate(route, F.slice(route, 1, 0), push)


def thinned(points: Column, most: int = 80) -> Column:
    """At most about ``most`` points by a constant stride; the last one stays."""
    stride = F.greatest(F.lit(1), F.ceil(F.size(points) / most).cast("int"))
    return F.filter(points, lambda p, i: (i % stride == 0) | (i == F.size(points) - 1))


def separated_bearings(scores: Column, wanted: int, apart: float = 45.0) -> Column:
    """Bearings of the best sectors that lie apart; gaps are filled with right angles, then with even turns.

    ``scores``: 12 values. Sectors are taken by score, ties by their number.
    """
    order = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    bearings = F.concat(F.transform(order, lambda o: o["i"] * 30.0 + 15.0), F.array(*[F.lit(float(a)) for a in (0, 90, 180, 270)]))

    def take(held: Column, b: Column) -> Column:
        gap = lambda h: F.least(F.abs(h - b), F.lit(360.0) - F.abs(h - b))
        return F.when((F.size(held) < wanted) & ~F.exists(held, lambda h: gap(h) < apart), F.concat(held, F.array(b))).otherwise(held)

    chosen = F.aggregate(bearings, F.array().cast("array<double>"), take)
    forced = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.pmod(i * (360.0 / wanted), F.lit(360.0)))
    return F.slice(F.concat(chosen, F.slice(forced, F.size(chosen) + 1, wanted)), 1, wanted)


def smoothed(scores: Column) -> Column:
    """12 sector scores, each with half of its weight in itself and a quarter in each neighbour, around the circle."""
    at = lambda i: F.element_at(scores, (i % 12).cast("int") + 1)
    return F.transform(scores, lambda s, i: (at(i + 11) + s * 2 + at(i + 1)) / 4)


def quality(deviation: Column, scenic: Column, worst: Column) -> Column:
    """0.6 for keeping the distance, 0.4 for scenery."""
    near = F.greatest(F.lit(0.0), 1 - F.least(deviation / 0.5, F.lit(1.0)))
    fair = F.when(worst > 0, F.greatest(F.lit(0.0), 1 - scenic / worst)).otherwise(1.0)
    return near * 0.6 + fair * 0.4


def penalised(score: Column, overlap: Column, direction: Column) -> Column:
    """Quality less for retraced ground and for the wrong direction (match in [0, 1], null: no wish)."""
    once = score * F.when(overlap > 0.15, F.greatest(F.lit(0.1), 1 - overlap)).otherwise(1.0)
    return once * F.coalesce(direction * 0.7 + 0.3, F.lit(1.0))


def edge_features(routes: DataFrame, edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Attributes of each of a route's steps (of its first ``most``), of the first parallel edge, rounded as they are shown.

    A route has many steps, which Spark's estimate doesn't see: by it they would be collected in the driver and broadcast.
    """
    told = ["length", "highway", "surface", "lit", "norm_green", "norm_water", "norm_social", "norm_quiet", "norm_slope", "uphill_gradient", "downhill_gradient"]
    own = best_parallel(edges, "key", [c for c in told if c in edges.columns])
    out = steps(routes)
    out = (out if most is None else out.where(F.col("pos") < most)).hint("merge").join(own, ["u", "v"])
    for end in "uv":
        out = out.hint("merge").join(nodes.select(F.col("node_id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"), F.round("elevation", 1).alias(f"{end}_elevation")), end)
    shown = [F.round(c, 4).alias(c) for c in ("norm_green", "norm_water", "norm_social", "norm_quiet", "norm_slope") if c in out.columns]
    grades = [F.round(F.col(c) * 100, 2).alias(f"{c}_pct") for c in ("uphill_gradient", "downhill_gradient") if c in out.columns]
    return out.select("route_id", "pos", "u", "v", F.round("length", 2).alias("length"), "highway", "surface", "lit", "u_elevation", "v_elevation", *shown, *grades)


def diverse(candidates: DataFrame, k: int = 3) -> DataFrame:
    """Per request ``k`` candidates: the best, then those least like the chosen ones. (request_id, route_id, place)

    Candidates of a request are a short list, held in an array; requests go in parallel.
    """
    rows = candidates.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("q"), "route_id", "route"))).alias("pool"))
    chosen, rest = F.slice("pool", 1, 1), F.slice("pool", 2, F.size("pool"))
    rows = rows.withColumn("chosen", chosen).withColumn("rest", rest)
    for _ in range(k - 1):
        unlike = lambda r: F.array_min(F.transform("chosen", lambda c: 1 - edge_similarity(c["route"], r["route"])))
        scored = F.array_sort(F.transform("rest", lambda r, i: F.struct((-unlike(r)).alias("d"), i.alias("i"), r.alias("r"))))
        rows = rows.withColumn("best", F.when(F.size("rest") > 0, F.slice(scored, 1, 1)).otherwise(F.slice(scored, 1, 0)))
        rows = rows.withColumn("chosen", F.concat("chosen", F.transform("best", lambda b: b["r"])))
        rows = rows.withColumn("rest", F.filter("rest", lambda r, i: ~F.exists("best", lambda b: b["i"] == i))).drop("best")
    return rows.select("request_id", F.posexplode("chosen").alias("place", "c")).select("request_id", "c.route_id", (F.col("place") + 1).alias("place"))


def loop_report(loops: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: attempts, shares of closed and of self-crossing loops, mean error, and whether targets are met."""
    closed = F.element_at("route", 1) == F.element_at("route", -1)
    crosses = F.size(F.array_distinct("route")) < F.size("route") - 1
    off = F.abs(F.col("length") - F.col("target_m")) / F.col("target_m") * 100
    rows = loops.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), (F.avg(closed.cast("int")) * 100).alias("closed_pct"), F.avg(off).alias("mean_error_pct"), (F.avg(crosses.cast("int")) * 100).alias("crossing_pct"))
    return rows.withColumn("met", (F.col("closed_pct") >= 80) & (F.col("mean_error_pct") <= 25))
