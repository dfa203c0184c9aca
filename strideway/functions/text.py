"""Text clean-up, column names, time stamps, units and words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_MILE = 1.609344
#: Solar model: degrees of tilt, day of the equinox, hours of twilight on each side.
TILT, EQUINOX, TWILIGHT = 23.44, 81, 0.75
SPEEDS = {"walking": 5.0, "running_easy": 9.5, "running_race": 12.5}


def resolve_column(columns: list[str], aliases: list[str]) -> str | None:
    """The column that an alias names: equal without case and signs, else one that contains it."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    by_name = {plain(c): c for c in columns}
    wanted = [a for a in map(plain, aliases) if a]
    exact = (by_name[a] for a in wanted if a in by_name)
    partly = (c for a in wanted for name, c in by_name.items() if a in name)
    return next(exact, None) or next(partly, None)


def cleaned(value: Column) -> Column:
    """Trimmed text; blank text and words for nothing become null."""
    v = F.trim(value)
    return F.when((v != "") & ~F.lower(v).isin("nan", "none", "na", "n/a"), v)


def lowered_or(value: Column, default: str) -> Column:
    """Lower-case text without outer blanks, or a default for nothing."""
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit(default))


def canonical_id(value: Column) -> Column:
    """A way id as text; whole numbers lose their decimals."""
    v = F.trim(value)
    number = v.try_cast("double")
    return F.when(v == "", None).when(number == F.floor(number), F.floor(number).cast("string")).otherwise(v)


def regime_name(value: Column) -> Column:
    """A regime in snake case; nothing and words for nothing are unknown."""
    v = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    return F.when(v.isNull() | v.isin("", "unknown", "none", "na", "n_a"), "unknown").otherwise(v)


def schedule_class(value: Column) -> Column:
    """Lighting regime of a council's free text: solar, all_night, timed_window, part_night or unknown."""
    v = F.lower(F.trim(value))
    return (
        F.when(v.isNull() | v.isin("", "n/a", "na", "none", "no current information"), "unknown")
        .when(v.contains("solar"), "solar")
        .when(v.contains("24 hour") | v.contains("sunset to sunrise"), "all_night")
        .when(v.rlike(r"\b[0-9]{3,4}\s*-\s*[0-9]{3,4}\b"), "timed_window")
        .when(v.contains("sunset"), "part_night")
        .otherwise("unknown")
    )


def slug(value: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def xml_escaped(value: Column) -> Column:
    # fixed values: the five references of XML, ampersand first
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def timestamp_of(value: Column) -> Column:
    """An ISO 8601 time as a timestamp (UTC session); anything else null."""
    return value.try_cast("timestamp")


def solar_hours(lat: Column, day: Column) -> tuple[Column, Column]:
    """Cosine of the hour angle of sunrise, and half the hours of daylight."""
    tilt = F.radians(F.sin(F.radians((day - EQUINOX) * (360.0 / 365.0))) * TILT)
    cosine = -F.tan(F.radians(F.greatest(F.lit(-89.0), F.least(F.lit(89.0), lat)))) * F.tan(tilt)
    return cosine, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) / 15.0


def solar_phase(lat: Column, lon: Column, when: Column) -> Column:
    """daylight, twilight or night at a place and time."""
    cosine, half = solar_hours(lat, F.dayofyear(when))
    hour = F.pmod(F.hour(when) + F.minute(when) / 60.0 + F.second(when) / 3600.0 + lon / 15.0, F.lit(24.0))
    rise, fall = 12.0 - half, half + 12.0
    day = (hour >= rise) & (hour < fall)
    dusk = (hour >= rise - TWILIGHT) & (hour < rise) | (hour >= fall) & (hour < fall + TWILIGHT)
    return F.when(cosine <= -1, "daylight").when(cosine >= 1, "night").when(day, "daylight").when(dusk, "twilight").otherwise("night")


def request_lighting(override: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, when: Column) -> Column:
    """A valid override, else the solar phase half-way."""
    o = F.lower(F.trim(override))
    return F.when(o.isin("daylight", "twilight", "night"), o).otherwise(solar_phase((lat1 + F.coalesce(lat2, lat1)) / 2, (lon1 + F.coalesce(lon2, lon1)) / 2, when))


def in_unit(kilometres: Column, unit: Column) -> Column:
    return F.when(unit == "mi", kilometres / KM_PER_MILE).otherwise(kilometres)


def speed_label(unit: Column) -> Column:
    return F.when(unit == "mi", "mph").otherwise("km/h")


def pace_text(speed: Column, unit: Column) -> Column:
    """Minutes and seconds for a kilometre or mile; seconds are rounded half to even."""
    seconds = F.lit(60.0) / speed * F.when(unit == "mi", KM_PER_MILE).otherwise(1.0)
    whole = F.floor(seconds)
    rest = F.rint((seconds - whole) * 60.0).cast("int")
    minute = F.when(rest == 60, whole + 1).otherwise(whole)
    text = F.format_string("%d:%02d min/%s", minute, F.when(rest == 60, 0).otherwise(rest), unit)
    return F.when(speed > 0, text).otherwise(F.concat(F.lit("n/a min/"), unit))


def profile_speed(profile: Column) -> Column:
    column = F.lit(None).cast("double")
    for name, speed in SPEEDS.items():
        column = F.when(profile == name, speed).otherwise(column)
    return column


def activity(profile: Column) -> Column:
    return F.when(profile.startswith("running"), "running").otherwise("walking")


def direction_word(degrees: Column) -> Column:
    """One of eight directions; null is any direction."""
    # fixed values: names in results
    names = ["Northbound", "North-east", "Eastbound", "South-east", "Southbound", "South-west", "Westbound", "North-west"]
    index = (F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45.0) % 8).cast("int")
    return F.when(degrees.isNull(), "Any direction").otherwise(F.element_at(F.array(*map(F.lit, names)), index + 1))


def shape_word(kind: Column, corners: Column) -> Column:
    """Name of a loop's shape."""
    return (
        F.when(F.lower(kind) == "out-and-back", "Out-and-back")
        .when(corners == 3, "Triangle").when(corners == 4, "Quadrilateral").when(corners == 5, "Pentagon").when(corners == 6, "Hexagon").when(corners >= 7, "Polygon")
        .otherwise("Loop")
    )
