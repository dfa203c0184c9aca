"""Map tags: walkability, noise, lighting and surface classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag lists that decide results.
EXCLUDED_HIGHWAYS = ["motorway", "motorway_link", "raceway", "proposed", "construction", "abandoned", "platform"]
CONDITIONAL_HIGHWAYS = ["cycleway", "trunk", "trunk_link"]
PEDESTRIAN_FOOT = ["yes", "designated", "permissive", "official"]
PEDESTRIAN_DESIGNATIONS = ["public_footpath", "public_bridleway", "restricted_byway", "byway_open_to_all_traffic", "permissive_footpath", "permissive_bridleway"]
RESTRICTED_ACCESS = ["private", "no", "military", "customers", "agricultural", "forestry", "delivery", "restricted"]
RESTRICTED_FOOT = ["no", "private", "restricted", "use_sidepath"]
EXPLICIT_ALLOW = ["yes", "permissive", "designated", "public"]
RESTRICTED_SERVICE = ["driveway", "parking_aisle", "private"]
NOISY = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link"]
QUIET = ["residential", "living_street", "footway", "path", "pedestrian", "cycleway", "track", "service", "bridleway", "steps"]
DEDICATED_PATHS = ["cycleway", "path", "footway", "pedestrian", "track", "bridleway", "steps"]
HARD_SURFACES = ["paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones"]
TRAIL_HIGHWAYS = ["path", "track", "bridleway", "footway", "steps"]
TRAIL_SURFACES = ["dirt", "earth", "ground", "mud", "sand", "grass", "grass_paver", "woodchips", "gravel", "fine_gravel", "compacted"]
UNSAFE_ROADS = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link"]
VEHICLE_ROADS = ["motorway", "motorway_link", "trunk", "trunk_link", *UNSAFE_ROADS]
SAFE_SIDEWALKS = ["both", "left", "right", "yes", "separate"]
ALL_NIGHT_HINTS = ["all night", "all_night", "allnight", "24/7", "24h", "24 hour", "dusk to dawn", "dusk-dawn", "sunset to sunrise"]
PART_NIGHT_HINTS = ["part night", "part_night", "partnight", "switch off", "switch_off", "switchoff", "midnight", "curfew"]


def tag(name: str) -> Column:
    """A tag in lower case without outer blanks; null stays null."""
    return F.lower(F.trim(F.col(name)))


def first_value(name: str) -> Column:
    """The first element of an array tag."""
    return F.col(name)[0]


def _is(column: Column, values: list[str]) -> Column:
    return F.coalesce(column.isin(values), F.lit(False))


def hard_excluded() -> Column:
    """Ways nobody may walk: areas and excluded highway values."""
    return _is(F.lower("highway"), EXCLUDED_HIGHWAYS) | _is(F.lower("area"), ["yes"])


def conditional_rejected() -> Column:
    """Ways that need a pedestrian tag and have none."""
    confirmed = _is(F.lower("foot"), PEDESTRIAN_FOOT) | _is(F.lower("designation"), PEDESTRIAN_DESIGNATIONS)
    return _is(F.lower("highway"), CONDITIONAL_HIGHWAYS) & ~confirmed


def access_restricted() -> Column:
    """Ways closed to walkers by foot, access or service tags."""
    allowed = _is(F.lower("foot"), EXPLICIT_ALLOW)
    private_service = _is(F.lower("highway"), ["service"]) & _is(F.lower("service"), RESTRICTED_SERVICE)
    return _is(F.lower("foot"), RESTRICTED_FOOT) | ((_is(F.lower("access"), RESTRICTED_ACCESS) | private_service) & ~allowed)


def impassable_gate() -> Column:
    """Nodes that are gates, and locked or restricted."""
    return _is(F.lower("barrier"), ["gate"]) & (_is(F.lower("locked"), ["yes"]) | _is(F.lower("access"), RESTRICTED_ACCESS))


def noise_factor(highway: Column) -> Column:
    """1 noisy, 2 quiet, 1.5 otherwise."""
    h = F.lower(highway)
    return F.when(_is(h, NOISY), 1.0).when(_is(h, QUIET), 2.0).otherwise(1.5)


def is_dedicated_path() -> Column:
    return _is(tag("highway"), DEDICATED_PATHS)


def lighting_context(value: Column) -> Column:
    """daylight, twilight or night (also for anything else)."""
    v = F.lower(F.trim(value))
    return F.when(_is(v, ["daylight", "twilight", "night"]), v).otherwise("night")


def regime_class(value: Column) -> Column:
    """all_night, part_night or unknown, by words in a regime tag."""
    v = F.lower(F.trim(value))
    has = lambda hints: F.greatest(*[F.coalesce(v.contains(h), F.lit(False)) for h in hints])
    return F.when(has(ALL_NIGHT_HINTS), "all_night").when(has(PART_NIGHT_HINTS), "part_night").otherwise("unknown")


def base_lit_class() -> Column:
    lit = tag("lit")
    return F.when(_is(lit, ["yes", "automatic", "24/7"]), "lit").when(_is(lit, ["limited", "disused"]), "limited").when(_is(lit, ["no"]), "unlit").otherwise("unknown")


def effective_lit_class(context: Column, regime: str = "lighting_regime") -> Column:
    """The riskier of the tagged class and the one that the regime implies in this context."""
    context = lighting_context(context)
    base, kind = base_lit_class(), regime_class(F.col(regime))
    implied = F.when(kind == "all_night", "lit").when(context == "twilight", "limited").otherwise("unlit")
    risk = lambda c: F.when(c == "lit", 0).when(c == "limited", 1).when(c == "unknown", 2).otherwise(3)
    merged = F.when((kind == "unknown"), base).when(base == "unknown", implied).when(risk(base) >= risk(implied), base).otherwise(implied)
    return F.when(context == "daylight", "not_relevant").otherwise(merged)


def active_travel_tier() -> Column:
    """tier_a, tier_b, tier_c or none: paved dedicated paths by their designations."""
    foot, bicycle = tag("foot"), tag("bicycle")
    both = _is(foot, ["designated"]), _is(bicycle, ["designated"])
    eligible = is_dedicated_path() & _is(tag("surface"), HARD_SURFACES)
    tier = F.when(both[0] & both[1], "tier_a").when(both[0] | both[1], "tier_b").when(_is(foot, ["yes"]) | _is(bicycle, ["yes"]), "tier_c").otherwise("none")
    return F.when(eligible, tier).otherwise("none")


def way_lighting(lit: Column) -> tuple[Column, Column]:
    """Lighting status and regime of a way by its raw tag."""
    status = F.when(_is(lit, ["yes", "true", "automatic", "24/7"]), "lit").when(_is(lit, ["no"]), "unlit").otherwise("unknown")
    return status, F.when(status == "lit", "all_night").otherwise(status)
