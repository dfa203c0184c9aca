"""Walkability, clipping, and request checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strideway.functions import geo, tags

BIASES = ["north", "east", "south", "west", "none"]
SPEED_CAPS = {"walking_speed_kmh": 9.0, "running_easy_speed_kmh": 20.0, "running_race_speed_kmh": 30.0}
SPEED_DEFAULTS = {"walking_speed_kmh": 5.0, "running_easy_speed_kmh": 9.5, "running_race_speed_kmh": 12.5}


def restricted_nodes(nodes: DataFrame) -> DataFrame:
    """Ids of gates that can't be passed."""
    return nodes.where(tags.impassable_gate()).select("node_id")


def without_gates(edges: DataFrame, gates: DataFrame) -> DataFrame:
    """Edges that touch no such node. Spark broadcasts the ids if they are few, else it shuffles."""
    return edges.join(gates.withColumnRenamed("node_id", "u"), "u", "left_anti").join(gates.withColumnRenamed("node_id", "v"), "v", "left_anti")


def passable(nodes: DataFrame) -> DataFrame:
    """Nodes but for gates that can't be passed."""
    return nodes.where(~F.coalesce(tags.impassable_gate(), F.lit(False)))


def walkable(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The full walking filter: one pass over the tags, then the gates."""
    kept = edges.where(~tags.hard_excluded() & ~tags.conditional_rejected() & ~tags.access_restricted())
    return kept if nodes is None else without_gates(kept, restricted_nodes(nodes)).select(edges.columns)


#: Kinds of ways on which nobody walks.
FORBIDDEN = ["motorway", "motorway_link", "trunk", "trunk_link"]


def counted_walkable(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The edges that :func:`walkable` keeps, and a function that says how many there were, were kept and removed, once a
    job has read them: they are counted in the same pass."""
    before, after = Observation(), Observation()
    kept = walkable(edges.observe(before, F.count(F.lit(1)).alias("n")), nodes).observe(after, F.count(F.lit(1)).alias("n"))

    def report() -> dict[str, int]:
        n_edges, n_kept = before.get["n"], after.get["n"]
        return {"n_edges": n_edges, "n_kept": n_kept, "n_removed": n_edges - n_kept}

    return kept, report


def ways_to_look_at(edges: DataFrame, forbidden: list[str] = FORBIDDEN) -> DataFrame:
    """(n_ways, n_forbidden, n_private): distinct ways by their first edge; those of forbidden kinds, and private ones
    without a permission for walkers."""
    first = F.min_by(F.struct("highway", "access", "foot"), F.struct("u", "v", "key")).alias("w")
    ways = edges.groupBy("way_ids").agg(first).select("w.*")
    allowed = F.coalesce(F.col("foot").isin("yes", "designated", "permissive"), F.lit(False))
    return ways.agg(F.count(F.lit(1)).alias("n_ways"), F.count_if(F.col("highway").isin(forbidden)).alias("n_forbidden"), F.count_if((F.col("access") == "private") & ~allowed).alias("n_private"))


def in_padded_bounds(points: DataFrame, edges: DataFrame, margin: float) -> DataFrame:
    """Points within the edges' bounding box and a margin. The box is one row."""
    box = edges.agg(*[f(g(F.col(f"u{c}"), F.col(f"v{c}"))).alias(f"{n}_{c}") for c in "xy" for n, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))])
    inside = F.col("x").between(F.col("low_x") - margin, F.col("high_x") + margin) & F.col("y").between(F.col("low_y") - margin, F.col("high_y") + margin)
    return points.join(F.broadcast(box), inside).select(points.columns)


def quiet_network(edges: DataFrame, nodes: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """Edges without sidewalks, crossings, private ways and driveways, and the nodes that still have one (and the start)."""
    drop = F.coalesce(F.col("footway").isin("sidewalk", "crossing"), F.lit(False)) | F.coalesce(F.col("access") == "private", F.lit(False)) | F.coalesce(F.col("service") == "driveway", F.lit(False))
    kept = edges.where(~drop)
    used = kept.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return kept, nodes.join(used, "node_id", "left_semi").union(nodes.where(F.col("node_id") == start).join(used, "node_id", "left_anti"))


def crop_radius_km(kilometres: Column) -> Column:
    share = F.greatest(F.lit(0.55) - kilometres * 0.01, F.lit(0.2))
    return F.least(F.lit(5.0), F.greatest(F.lit(1.5), kilometres * share))


def crop(nodes: DataFrame, edges: DataFrame, lat: float, lon: float, kilometres: float) -> tuple[DataFrame, DataFrame]:
    """Nodes within the crop radius of a start, and the edges between them."""
    far = geo.equirectangular(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), F.lit(lat))
    inside = nodes.where(far <= crop_radius_km(F.lit(float(kilometres))) * 1000)
    ids = inside.select("node_id")
    return inside, edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")


def loop_accepted(kind: Column, distance: Column, target: Column, tolerance: float = 0.3) -> Column:
    """Polygons may be 5 % short and 15 % long; out-and-back walks off by a tolerance; none below a kilometre."""
    off = (distance - target) / target
    return (distance >= 1000) & F.when(kind == "out-and-back", F.abs(off) <= tolerance).otherwise(off.between(-0.05, 0.15))


def direct_candidates(candidates: DataFrame, legs: DataFrame, factor: float = 3.0) -> DataFrame:
    """Candidates none of whose legs is longer than ``factor`` times the straight line."""
    bad = legs.where(F.col("leg_m") > F.col("air_m") * factor).select("candidate_id").distinct()
    return candidates.join(bad, "candidate_id", "left_anti")


def request_errors() -> Column:
    """What is wrong with a request, as words; columns start, end, is_loop, target_m, profile, unit, bias."""
    km = F.col("target_m") / 1000
    checks = {
        "start": F.col("start").isNull(),
        "end": ~F.col("is_loop") & F.col("end").isNull(),
        "target": F.col("is_loop") & ~F.coalesce(km.between(1, 30), F.lit(False)),
        "profile": ~F.coalesce(F.lower("profile").isin("walking", "running_easy", "running_race"), F.lit(True)),
        "unit": ~F.coalesce(F.lower("unit").isin("km", "mi"), F.lit(True)),
        "bias": ~F.coalesce(F.lower("bias").isin(BIASES), F.lit(True)),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def preference_errors() -> Column:
    """Field to error of a preferences row (text columns); a null field wasn't given."""
    entries, valid = [], {}
    for field, cap in SPEED_CAPS.items():
        number = F.col(field).try_cast("double")
        error = F.when(F.col(field).isNull(), None).when(number.isNull(), "not numeric").when(number <= 0, "not positive").when(number > cap, "too fast")
        valid[field] = F.when(error.isNull(), F.coalesce(number, F.lit(SPEED_DEFAULTS[field]))).otherwise(SPEED_DEFAULTS[field])
        entries.append(F.struct(F.lit(field).alias("field"), error.alias("error")))
    slow = F.when(valid["running_race_speed_kmh"] < valid["running_easy_speed_kmh"], "slower than easy")
    entries[-1] = F.struct(F.lit("running_race_speed_kmh").alias("field"), F.coalesce(slow, entries[-1]["error"]).alias("error"))
    stamp = F.when(F.col("client_updated_at").isNotNull() & F.col("client_updated_at").try_cast("timestamp").isNull(), "no time")
    unit = F.when(F.col("unit").isNotNull() & ~F.lower("unit").isin("km", "mi"), "no unit")
    entries += [F.struct(F.lit("client_updated_at").alias("field"), stamp.alias("error")), F.struct(F.lit("unit").alias("field"), unit.alias("error"))]
    return F.filter(F.array(*entries), lambda e: e["error"].isNotNull())


def clamped_variety(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(value, F.lit(0))))


def canonical_options(flags: dict[str, Column]) -> dict[str, Column]:
    """Preference flags without contradictions; old names are taken over."""
    get = lambda k: F.coalesce(flags[k], F.lit(False)) if k in flags else F.lit(False)
    trails, heavy = get("prefer_nature_trails"), get("heavily_avoid_unlit")
    return {
        "prefer_nature_trails": trails,
        "heavily_avoid_unlit": heavy,
        "prefer_lit": get("prefer_lit") & ~heavy,
        "prefer_dedicated_pavements": (get("prefer_dedicated_pavements") | get("prefer_pedestrian")) & ~trails,
        "prefer_paved": get("prefer_paved") & ~trails,
        "avoid_unsafe_roads": get("avoid_unsafe_roads") | get("avoid_unsafe"),
    }
