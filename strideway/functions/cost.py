"""The cost model: weights, slope, weighted sums and preference multipliers, as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.functions import tags

FEATURES = ["distance", "greenness", "water", "social", "quietness", "slope"]
NORMS = {"greenness": "norm_green", "water": "norm_water", "social": "norm_social", "quietness": "norm_quiet", "slope": "norm_slope"}
NEUTRAL = 0.5
DEFAULT_DISTANCE, LEAST_DISTANCE = 3.0, 0.1
# Slope parameters (greatest speed, flat speed, decay, best grade) and multipliers.
ACTIVITIES = {"walking": (6.0, 5.0, 3.5, -0.05), "running": (15.0, 12.0, 2.5, -0.10)}
LIT = {"lit": 0.85, "limited": 1.3, "unlit": 1.8, None: 1.2}
LIT_HEAVY = {"lit": 0.70, "limited": 2.5, "unlit": 5.0, None: 3.0}
SURFACES = {
    1.0: ["paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones"],
    1.1: ["sett", "cobblestone", "cobblestone:flattened", "metal", "wood"],
    1.3: ["compacted", "fine_gravel", "gravel"],
    2.0: ["dirt", "earth", "ground", "mud", "sand", "grass", "grass_paver", "woodchips"],
}
SURFACE_DEFAULT, UNSAFE = 1.2, 3.5
TIERS = {"tier_a": 0.82, "tier_b": 0.90, "tier_c": 0.96}


def _is(column: Column, values: list[str]) -> Column:
    return F.coalesce(column.isin(values), F.lit(False))


def min_max(value: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """Scaled to [0, 1]; 0 where the range is empty, null for null."""
    share = (high - value) if invert else (value - low)
    return F.when(value.isNull(), None).when(high == low, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share / (high - low))))


def tobler(gradient: Column, activity: str = "walking") -> Column:
    """Time against flat ground; 1 on the flat for the exact flat speed."""
    top, flat, decay, best = ACTIVITIES[activity]
    return F.lit(flat) / F.greatest(F.exp(F.abs(gradient - best) * -decay) * top, F.lit(0.1))


def gradients(length: Column, start: Column, end: Column, activity: str = "walking") -> dict[str, Column]:
    """uphill_gradient, downhill_gradient, slope_time_cost and raw_slope_cost of an edge."""
    unknown = start.isNull() | end.isNull() | (length < 1)
    g = (end - start) / length
    known = lambda c, default: F.when(unknown, default).otherwise(c)
    return {
        "uphill_gradient": known(F.greatest(F.lit(0.0), g), 0.0),
        "downhill_gradient": known(F.greatest(F.lit(0.0), -g), 0.0),
        "slope_time_cost": known(tobler(g, activity), 1.0),
        "raw_slope_cost": known(F.abs(g), 0.0),
    }


def slider_weights(sliders: dict[str, Column]) -> dict[str, Column]:
    """Weights from sliders: distance defaults to 3 and is 0.1 at least, and sizes add up to 1."""
    merged = {k: F.coalesce(sliders.get(k, F.lit(None)).cast("double"), F.lit(DEFAULT_DISTANCE if k == "distance" else 0.0)) for k in FEATURES}
    merged["distance"] = F.greatest(F.lit(LEAST_DISTANCE), merged["distance"])
    total = sum((F.abs(c) for c in merged.values()), F.lit(0.0))
    return {k: c / total for k, c in merged.items()}


def weight_errors(weights: dict[str, Column]) -> Column:
    """Names of weights that may not be negative but are."""
    return F.array_compact(F.array(*[F.when(weights[k] < 0, F.lit(k)) for k in FEATURES if k != "slope"]))


def _slope_part(slope: Column, weight: Column) -> Column:
    """An avoided slope costs itself; a wanted one (weight below 0) costs its absence."""
    return F.when(weight >= 0, slope).otherwise(1 - slope)


def weighted_sum(length: Column, norms: dict[str, Column], weights: dict[str, Column], combine_nature: bool = False) -> Column:
    if combine_nature:
        nature = F.least(norms["greenness"], norms["water"]) * weights["greenness"]
    else:
        nature = norms["greenness"] * weights["greenness"] + norms["water"] * weights["water"]
    rest = norms["social"] * weights["social"] + norms["quietness"] * weights["quietness"]
    return length * weights["distance"] + nature + rest + F.abs(weights["slope"]) * _slope_part(norms["slope"], weights["slope"])


def weighted_min(length: Column, norms: dict[str, Column], weights: dict[str, Column], combine_nature: bool = False) -> Column:
    """Distance plus the best of the wanted features, heavier ones with an advantage."""
    green = (F.least(norms["greenness"], norms["water"]) if combine_nature else norms["greenness"], weights["greenness"])
    parts = [green, *([] if combine_nature else [(norms["water"], weights["water"])]), (norms["social"], weights["social"]), (norms["quietness"], weights["quietness"])]
    parts.append((_slope_part(norms["slope"], weights["slope"]), F.abs(weights["slope"])))
    best = F.least(*[F.when(w > 0, v / (w + 1)) for v, w in parts])
    total = sum((F.when(w > 0, w).otherwise(0.0) for _, w in parts), F.lit(0.0))
    count = sum((F.when(w > 0, 1).otherwise(0) for _, w in parts), F.lit(0))
    return length * weights["distance"] + F.when(count > 0, total * best * (total / count + 1)).otherwise(0.0)


CostFunction = Callable[..., Column]
_cost_functions: dict[str, CostFunction] = {"WSM_ADDITIVE": weighted_sum, "HYBRID_DISJUNCTIVE": weighted_min}


def register_cost_function(name: str, function: CostFunction) -> None:
    _cost_functions[name.upper()] = function


def cost_function(name: str = "WSM_ADDITIVE") -> CostFunction:
    if name.upper() not in _cost_functions:
        raise ValueError(f"unknown cost function {name}; there are {sorted(_cost_functions)}")
    return _cost_functions[name.upper()]


def weighted_parts(length_low: Column, length_high: Column) -> dict[str, Column]:
    """What weighted_costs needs of an edge."""
    return {"f_distance": min_max(F.col("length"), length_low, length_high)} | {f"f_{k}": F.coalesce(c, F.lit(NEUTRAL)) for k, c in NORMS.items()}


def weighted_costs(weights: dict, parts: dict[str, np.ndarray]) -> np.ndarray:
    """weighted_sum for one request and many edges with weighted_parts, in a task."""
    part = lambda k: parts[f"f_{k}"] * weights[k]
    slope = parts["f_slope"] if weights["slope"] >= 0 else 1 - parts["f_slope"]
    return part("distance") + (part("greenness") + part("water")) + (part("social") + part("quietness")) + abs(weights["slope"]) * slope


def lit_multiplier(context: Column, heavy: bool = False) -> Column:
    table = LIT_HEAVY if heavy else LIT
    kind = tags.effective_lit_class(context)
    unknown = F.when(tags.is_dedicated_path(), 1.0).otherwise(table[None])
    by_class = F.when(kind == "lit", table["lit"]).when(kind == "limited", table["limited"]).when(kind == "unlit", table["unlit"]).otherwise(unknown)
    return F.when(tags.lighting_context(context) == "daylight", 1.0).otherwise(by_class)


def surface_multiplier() -> Column:
    out = F.lit(SURFACE_DEFAULT)
    for factor, values in SURFACES.items():
        out = F.when(_is(tags.tag("surface"), values), factor).otherwise(out)
    return out


def unsafe_multiplier() -> Column:
    safe = _is(tags.tag("sidewalk"), tags.SAFE_SIDEWALKS) | _is(tags.tag("foot"), ["yes", "designated"])
    return F.when(_is(tags.tag("highway"), tags.UNSAFE_ROADS) & ~safe, UNSAFE).otherwise(1.0)


def dedicated_multiplier() -> Column:
    highway, surface, tier = tags.tag("highway"), tags.tag("surface"), tags.active_travel_tier()
    road = F.when(_is(highway, tags.VEHICLE_ROADS), 2.8).when(_is(highway, [*tags.DEDICATED_PATHS, "living_street"]), 0.78).otherwise(1.0)
    ground = F.when(_is(surface, tags.HARD_SURFACES), 0.90).when(_is(surface, tags.TRAIL_SURFACES), 1.35).otherwise(1.0)
    return road * ground * F.when(tier == "tier_a", 0.85).when(tier == "tier_b", 0.92).otherwise(1.0)


def trail_multiplier() -> Column:
    highway, surface = tags.tag("highway"), tags.tag("surface")
    trail = _is(highway, tags.TRAIL_HIGHWAYS)
    road = F.when(_is(highway, tags.VEHICLE_ROADS), 4.0).when(_is(highway, ["residential", "unclassified", "service", "living_street"]), 1.35).when(trail, 0.72).otherwise(1.0)
    ground = F.when(_is(surface, tags.TRAIL_SURFACES), 0.78).when(_is(surface, tags.HARD_SURFACES), 1.35).otherwise(1.0)
    return road * ground * F.when(trail & surface.isNull(), 0.90).otherwise(1.0)


def tier_multiplier() -> Column:
    tier = tags.active_travel_tier()
    out = F.lit(1.0)
    for name, factor in TIERS.items():
        out = F.when(tier == name, factor).otherwise(out)
    return out


def pedestrian_multiplier() -> Column:
    """Tags are compared as they are, without folding case."""
    roads = [r for r in tags.VEHICLE_ROADS if not r.startswith("motorway")]
    return F.when(_is(F.col("highway"), roads), 5.0).when(_is(F.col("highway"), ["pedestrian", "path", "footway", "cycleway", "track", "living_street"]), 0.2).otherwise(1.0)


def running_slope(low: Column, high: Column, activity: str = "running") -> Column:
    """The slope norm of an activity, from gradients and the range of its costs; else the walking norm."""
    walking = F.coalesce("norm_slope", F.lit(NEUTRAL))
    cost = tobler(F.coalesce("uphill_gradient", F.lit(0.0)) - F.coalesce("downhill_gradient", F.lit(0.0)), activity)
    known = F.col("uphill_gradient").isNotNull() | F.col("downhill_gradient").isNotNull()
    return F.when(known & (high > low), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cost - low) / (high - low)))).otherwise(walking)


def edge_cost(
    length_low: Column, length_high: Column, weights: dict[str, Column], *, method: str = "WSM_ADDITIVE", combine_nature: bool = False, context: Column | None = None,
    prefer_lit: bool = False, heavily_avoid_unlit: bool = False, prefer_pedestrian: bool = False, prefer_dedicated_pavements: bool = False, prefer_nature_trails: bool = False,
    prefer_paved: bool = False, avoid_unsafe_roads: bool = False, norm_slope: Column | None = None,
) -> Column:
    """The cost of an edge: the weighted norms, then each wanted preference's multiplier. Null without a length."""
    norms = {k: F.coalesce(c, F.lit(NEUTRAL)) for k, c in NORMS.items()}
    if norm_slope is not None:
        norms["slope"] = norm_slope
    cost = cost_function(method)(min_max(F.col("length"), length_low, length_high), norms, weights, combine_nature)
    if prefer_lit or heavily_avoid_unlit:
        cost = cost * lit_multiplier(F.lit("night") if context is None else context, heavily_avoid_unlit)
    for wanted, factor in ((prefer_pedestrian, pedestrian_multiplier), (prefer_dedicated_pavements, dedicated_multiplier), (prefer_nature_trails, trail_multiplier), (prefer_paved, surface_multiplier), (avoid_unsafe_roads, unsafe_multiplier)):
        if wanted:
            cost = cost * factor()
    if prefer_pedestrian or prefer_dedicated_pavements or prefer_paved or avoid_unsafe_roads:
        cost = cost * tier_multiplier()
    return cost


def compared_factors(length_low: Column, length_high: Column, context: Column | None = None) -> dict[str, Column]:
    """What compared_cost needs of an edge: its length's share of the weighted sum, alone, and the multiplier of each toggle."""
    night = F.lit("night") if context is None else context
    only_length = {k: F.lit(1.0 if k == "distance" else 0.0) for k in FEATURES}
    return {
        "f_length": edge_cost(length_low, length_high, only_length), "f_prefer_lit": lit_multiplier(night), "f_heavily_avoid_unlit": lit_multiplier(night, True), "f_prefer_pedestrian": pedestrian_multiplier(),
        "f_prefer_dedicated_pavements": dedicated_multiplier(), "f_prefer_nature_trails": trail_multiplier(), "f_prefer_paved": surface_multiplier(), "f_avoid_unsafe_roads": unsafe_multiplier(), "f_tier": tier_multiplier(),
    }


def compared_cost(scenario: Column, toggles: dict[str, Column]) -> Column:
    """The metres of an edge with compared_factors for the baseline; else its cost with the multipliers that are switched on."""
    on = lambda name: F.coalesce(toggles[name], F.lit(False))
    out = F.col("f_length") * F.when(on("heavily_avoid_unlit"), F.col("f_heavily_avoid_unlit")).when(on("prefer_lit"), F.col("f_prefer_lit")).otherwise(1.0)
    for name in ("prefer_pedestrian", "prefer_dedicated_pavements", "prefer_nature_trails", "prefer_paved", "avoid_unsafe_roads"):
        out = out * F.when(on(name), F.col(f"f_{name}")).otherwise(1.0)
    tiered = on("prefer_pedestrian") | on("prefer_dedicated_pavements") | on("prefer_paved") | on("avoid_unsafe_roads")
    return F.when(scenario == "baseline", F.col("length")).otherwise(out * F.when(tiered, F.col("f_tier")).otherwise(1.0))


def compared_costs(request: dict, factors: dict[str, np.ndarray]) -> np.ndarray:
    """compared_cost for one request and many edges with compared_factors, in a task."""
    if request["scenario"] == "baseline":
        return factors["length"]
    on = lambda name: request[name] is not None and bool(request[name])
    out = factors["f_length"]
    if on("heavily_avoid_unlit") or on("prefer_lit"):
        out = out * factors["f_heavily_avoid_unlit" if on("heavily_avoid_unlit") else "f_prefer_lit"]
    for name in ("prefer_pedestrian", "prefer_dedicated_pavements", "prefer_nature_trails", "prefer_paved", "avoid_unsafe_roads"):
        out = out * factors[f"f_{name}"] if on(name) else out
    tiered = on("prefer_pedestrian") or on("prefer_dedicated_pavements") or on("prefer_paved") or on("avoid_unsafe_roads")
    return out * factors["f_tier"] if tiered else out


# Penalties of the former loop solver; the value for other and for missing tags comes last.
LEGACY = {
    "highway": ({1.0: ["footway", "path", "pedestrian", "cycleway", "track", "bridleway", "steps"], 1.2: ["residential", "living_street", "service"], 1.5: ["unclassified", "tertiary", "tertiary_link"],
                 2.0: ["secondary", "secondary_link"], 2.5: ["primary", "primary_link"], 3.0: ["trunk", "trunk_link", "motorway", "motorway_link"]}, 1.5),
    "surface": ({1.0: ["paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones"], 1.1: ["sett", "cobblestone", "cobblestone:flattened", "metal", "wood"],
                 1.3: ["compacted", "fine_gravel", "gravel"], 2.0: ["dirt", "earth", "ground", "mud", "sand", "grass", "grass_paver", "woodchips"]}, 1.2),
    "lit": ({0.85: ["yes", "automatic", "24/7"], 1.3: ["limited", "disused"], 1.8: ["no"]}, 1.2),
}
LEGACY_UNSAFE = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link"]


def legacy_penalties(edges: DataFrame) -> DataFrame:
    """(u, v, road, surface, lit, unsafe): the least penalty of the parallel edges that have the tag; for safety, of the first that is a road without room for walkers."""
    out = []
    for name, (table, other) in LEGACY.items():
        penalty = F.lit(other)
        for factor, values in table.items():
            penalty = F.when(F.lower(name).isin(values), factor).otherwise(penalty)
        out.append(F.coalesce(F.min(F.when(F.col(name).isNotNull(), penalty)), F.lit(other)).alias("road" if name == "highway" else name))
    safe = F.coalesce(F.lower("sidewalk").isin("both", "left", "right", "yes", "separate"), F.lit(False)) | F.coalesce(F.lower("foot").isin("yes", "designated"), F.lit(False))
    unsafe = F.min(F.when(F.lower("highway").isin(LEGACY_UNSAFE), F.struct("key", F.when(safe, 1.0).otherwise(3.5).alias("factor"))))
    return edges.groupBy("u", "v").agg(*out, F.coalesce(unsafe["factor"], F.lit(1.0)).alias("unsafe"))
