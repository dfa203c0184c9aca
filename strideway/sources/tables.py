"""Scans and sinks: feature extraction, lamp feeds, tile store, overlay rows, GPX and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions import geo, tags, text
from strideway.operators.materialise import written

# Which tags make a feature.
GREEN = {"landuse": ["grass", "forest", "recreation_ground", "village_green", "allotments", "meadow"], "natural": ["wood", "scrub", "heath", "moor"], "leisure": ["park", "garden", "playground", "nature_reserve", "common"]}
WATER = {"natural": ["water", "wetland"], "landuse": ["reservoir", "basin"], "waterway": ["river", "canal", "riverbank", "stream"]}
WATERWAYS_SCANNED = ["river", "canal", "stream", "riverbank", "drain", "ditch"]
POIS = {
    "tourism": ["attraction", "viewpoint", "museum", "artwork", "gallery", "information", "picnic_site", "zoo", "theme_park"],
    "historic": ["castle", "monument", "memorial", "ruins", "archaeological_site", "church", "manor", "fort"],
    "amenity": ["cafe", "restaurant", "pub", "bar", "theatre", "cinema", "arts_centre", "library"],
}
LAMP_ALIASES = {"lat": ["latitude", "lat", "y"], "lon": ["longitude", "lon", "long", "x"], "lit": ["lit"], "east": ["easting", "eastings"], "north": ["northing", "northings"], "source": ["source", "council"], "regime": ["lighting_regime", "burning hours", "regime"]}
#: Half a river's width in metres: lines are that much nearer.
RIVER_HALF_WIDTH = 10.0


def has_any(rules: dict[str, list[str]]) -> Column:
    found = F.lit(False)
    for name, values in rules.items():
        found = found | F.coalesce(F.col(name).isin(values), F.lit(False))
    return found


def scan_network(nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float], buffer_km: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes in a box (min_lat, min_lon, max_lat, max_lon) with a buffer, and the edges between them."""
    by = buffer_km / 111.0
    inside = nodes.where(F.col("lat").between(box[0] - by, box[2] + by) & F.col("lon").between(box[1] - by, box[3] + by))
    ids = inside.select(F.col("node_id"))
    kept = edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
    return inside, kept


def grouped_features(features: DataFrame) -> DataFrame:
    """Features with any scanned tag and a geometry, and their group: water before green before poi."""
    poi = F.col("amenity").isNotNull() | F.col("shop").isNotNull() | F.col("tourism").isNotNull()
    water = has_any({k: v for k, v in WATER.items() if k != "waterway"}) | F.coalesce(F.col("waterway").isin(WATERWAYS_SCANNED), F.lit(False))
    green = has_any(GREEN)
    # scanned for six kinds of waterway, but grouped as water with any
    group = F.when(water | F.col("waterway").isNotNull(), "water").when(green, "green").when(poi, "poi").otherwise("other")
    return features.where((poi | water | green) & F.col("geom_type").isNotNull()).withColumn("feature_group", group)


def green_areas(features: DataFrame) -> DataFrame:
    return features.where(has_any(GREEN) & F.col("geom_type").isin("Polygon", "MultiPolygon"))


def water_features(features: DataFrame) -> DataFrame:
    """Water of any geometry; ``margin`` is what a line's distance is shortened by."""
    return features.where(has_any(WATER) & F.col("geom_type").isNotNull()).withColumn("margin", F.when(F.col("geom_type").isin("LineString", "MultiLineString"), RIVER_HALF_WIDTH).otherwise(0.0))


def points_of_interest(features: DataFrame) -> DataFrame:
    return features.where(has_any(POIS) & F.col("geom_type").isNotNull())


def street_lights(rows: DataFrame) -> DataFrame:
    """One row for each point of (multi)point lamps; lit is yes and source unknown by default."""
    points = rows.where("points is not null").withColumn("point", F.explode("points"))
    return points.select("light_id", "point.x", "point.y", F.coalesce("lit", F.lit("yes")).alias("lit"), F.coalesce("source", F.lit("unknown")).alias("source"))


def canonical_lights(feed: DataFrame, source: str) -> DataFrame:
    """A council's feed in canonical columns, found by their aliases; rows without a numeric place go."""
    name = {k: text.resolve_column(feed.columns, aliases) for k, aliases in LAMP_ALIASES.items()}
    number = lambda k: F.col(f"`{name[k]}`").cast("string").try_cast("double")
    if name["lat"] is not None and name["lon"] is not None:
        rows = feed.withColumns({"_lat": number("lat"), "_lon": number("lon")}).where("_lat is not null and _lon is not null")
        place = [F.col("_lat").alias("lat"), F.col("_lon").alias("lon")]
    elif name["east"] is not None and name["north"] is not None:  # metres of the British national grid
        metres = feed.drop("lat", "lon").withColumns({"east_m": number("east"), "north_m": number("north")}).where("east_m is not null and north_m is not null")
        # no condition on the result: it would be computed once more for each time that its steps refer to one another
        rows, place = geo.osgb_to_wgs84(metres, "east_m", "north_m"), [F.col("lat"), F.col("lon")]
    else:
        raise ValueError(f"no coordinates among {feed.columns}")
    column = lambda k, default: F.coalesce(text.cleaned(F.col(f"`{name[k]}`").cast("string")), F.lit(default)) if name[k] else F.lit(default)
    return rows.select(*place, F.lit(source).alias("source"), column("lit", "yes").alias("lit"), text.schedule_class(column("regime", "unknown")).alias("lighting_regime"))


def combined_lights(*feeds: DataFrame) -> DataFrame:
    """All feeds; missing columns are unknown, and rows of one source, status and place are one."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    words = [c for c, t in out.dtypes if t == "string"]
    return out.fillna("unknown", words).dropDuplicates(["source", "lit", "lat", "lon"])


def region_catalogue(index: DataFrame) -> DataFrame:
    """Regions of a feature collection: id, url and rings of each polygon; all rings but the first are holes."""
    rows = index.select(F.explode("features").alias("f"))
    corners = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = F.transform("f.geometry.coordinates", lambda ring, i: F.struct((i > 0).alias("hole"), corners(ring).alias("points")))
    return rows.select("f.properties.id", "f.properties.url", rings.alias("rings"))


def write_tiles(rows: DataFrame, path: str) -> None:
    """Store edges by region, build mode and tile, a folder each; tiles that are written again are replaced."""
    rows.repartition("region", "modes", "tile_id").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("region", "modes", "tile_id").parquet(path)


def read_tiles(spark: SparkSession, path: str, region: str, modes: str, tiles: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path).where((F.col("region") == region) & (F.col("modes") == modes))
    return rows if tiles is None else rows.where(F.col("tile_id").isin(tiles))


def tile_stats(rows: DataFrame) -> DataFrame:
    """Edges and distinct nodes of each tile."""
    ends = rows.select("tile_id", F.explode(F.array("u", "v")).alias("node"))
    counts = ends.groupBy("tile_id").agg(F.count_distinct("node").alias("n_nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("n_edges"))
    return counts


def way_lighting_table(edges: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Lighting rows of all ways with a highway tag, and what they have of ``keep``."""
    status, regime = tags.way_lighting(F.col("lit"))
    return edges.where("highway is not null").select(
        "u", "v", "key", status.alias("lit_status"), F.lit("osm").alias("lit_source_primary"), F.lit("osm").alias("lit_source_detail"), F.lit("osm_lit").alias("lit_tag_type"),
        regime.alias("lighting_regime"), F.coalesce("lit", status).alias("lighting_regime_text"), F.col("lit").alias("osm_lit_raw"), F.lit(0).cast("long").alias("council_match_count"), *keep,
    )


def overlay_filter(rows: DataFrame, source: str = "all", regime: str = "all") -> DataFrame:
    """Rows of a lighting source and regime."""
    primary, detail = (F.lower(F.coalesce(c, F.lit("osm"))) for c in ("lit_source_primary", "lit_source_detail"))
    if source.lower() == "osm":
        rows = rows.where((primary == "osm") | (detail == "osm") | (F.trim(F.coalesce("osm_lit_raw", F.lit(""))) != ""))
    elif source.lower() != "all":
        rows = rows.where((primary == source.lower()) | (detail == source.lower()))
    return rows if regime.lower() == "all" else rows.where(F.lower(F.coalesce("lighting_regime", F.lit("unknown"))) == regime.lower())


def overlay_tiles(lines: DataFrame, zoom: int) -> DataFrame:
    """A row for each map tile that a line's box meets and its segment crosses: adds z, tile_x, tile_y.

    ``lines`` has u_lat, u_lon, v_lat, v_lon; tiles come from arithmetic, not from a list of tiles.
    """
    ax, ay = geo.web_mercator(F.col("u_lat"), F.col("u_lon"))
    bx, by = geo.web_mercator(F.col("v_lat"), F.col("v_lon"))
    half = 3.141592653589793 * geo.MAJOR
    size = 2 * half / 2**zoom
    rows = lines.select("*", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    tile = lambda c, sign: F.floor((F.col(c) * sign + half) / size).cast("int")
    xs, ys = (tile("ax", 1), tile("bx", 1)), (tile("ay", -1), tile("by", -1))
    rows = rows.withColumn("tile_x", F.explode(F.sequence(F.least(*xs), F.greatest(*xs)))).withColumn("tile_y", F.explode(F.sequence(F.least(*ys), F.greatest(*ys))))
    left, low, right, high = geo.tile_envelope(F.lit(zoom), F.col("tile_x"), F.col("tile_y"))
    # a segment and a box: the box's corners lie on both sides of the segment's line
    side = lambda x, y: F.signum((F.col("bx") - F.col("ax")) * (y - F.col("ay")) - (F.col("by") - F.col("ay")) * (x - F.col("ax")))
    sides = [side(x, y) for x in (left, right) for y in (low, high)]
    return rows.where((F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)).withColumn("z", F.lit(zoom)).drop("ax", "ay", "bx", "by")


def gpx(routes: DataFrame) -> DataFrame:
    """(route_id, gpx): a track of each route; ``points`` holds {lat, lon, ele} in order, ``name`` its name."""
    point = lambda p: F.concat(
        F.format_string('<trkpt lat="%.6f" lon="%.6f">', p["lat"], p["lon"]), F.when(p["ele"].isNotNull(), F.format_string("<ele>%.1f</ele>", p["ele"])).otherwise(""), F.lit("</trkpt>")
    )
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="strideway" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    track = F.concat(F.lit(head), text.xml_escaped(F.col("name")), F.lit("</name><trkseg>"), F.concat_ws("", F.transform("points", point)), F.lit("</trkseg></trk></gpx>"))
    return routes.select("route_id", track.alias("gpx"))


def export_name(origin: Column, target: Column, distance_m: Column, day: Column) -> Column:
    """File name of an export."""
    return F.concat_ws("_", text.slug(origin), F.lit("to"), text.slug(target), F.format_string("%.1fkm", distance_m / 1000), F.date_format(day, "yyyy-MM-dd")).substr(1, 120)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, payload): each row as JSON."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("payload"))


def saved_requests(rows: DataFrame) -> DataFrame:
    """Saved queries with their weights (a JSON object) as six columns."""
    weights = F.from_json("weights_json", "map<string,double>")
    return rows.select("request_id", *[F.coalesce(F.element_at(weights, k), F.lit(0.0)).alias(k) for k in ("distance", "greenness", "water", "social", "quietness", "slope")])


def write_documents(rows: DataFrame, path: str, keys: list[str], content: str) -> None:
    """A text file for each row, in a folder of its keys. Files appear when the job commits; what is written again replaces
    the folder of its keys and no other, so a job can be repeated. Rows of the same keys share a folder."""
    own = rows.select(*keys, F.col(content).alias("value"))
    own.repartition(*keys).write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1).mode("overwrite").partitionBy(*keys).text(path)


def read_documents(spark: SparkSession, path: str, keys: dict[str, str], content: str) -> DataFrame:
    """What :func:`write_documents` wrote; ``keys`` with their types."""
    schema = ", ".join(["value string", *(f"{k} {t}" for k, t in keys.items())])
    rows = spark.read.schema(schema).text(path, wholetext=True)
    return rows.select(*keys, F.regexp_replace("value", r"\n\z", "").alias(content))


#: Map tiles of a block, across and down.
TILES_ACROSS = 64


def write_map_tiles(rows: DataFrame, path: str) -> None:
    """Overlay rows in a folder for each block of map tiles, in order of tiles (z, tile_x, tile_y), so that a tile is read from a
    part of its block's files: a folder for each tile would be more folders than rows where tiles are small. Tiles that are
    written again are replaced, the others of their block stay. A tile with many rows is written by several tasks."""
    tile, block = ["z", "tile_x", "tile_y"], ["block_z", "block_x", "block_y"]
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in tile]), F.lit(4)) if len(rows.columns) > len(tile) else F.lit(0)
    folder, spark = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path), rows.sparkSession
    own = rows.withColumns(_tile_block(F.col("z"), F.col("tile_x"), F.col("tile_y")))
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        rows = written(own, "tiles")
        old = spark.read.parquet(path).join(rows.select(*block).distinct(), block, "left_semi").join(rows.select(*tile).distinct(), tile, "left_anti")
        own = rows.unionByName(written(old, "kept"))
    own.repartition(*block, spread).sortWithinPartitions(*block, *tile).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*block).parquet(path)


def _tile_block(z: Column, x: Column, y: Column) -> dict[str, Column]:
    return {"block_z": z.cast("int"), "block_x": F.floor(x / TILES_ACROSS).cast("int"), "block_y": F.floor(y / TILES_ACROSS).cast("int")}


def read_map_tile(spark: SparkSession, path: str, z: int, x: int, y: int) -> DataFrame:
    tile = {"z": F.lit(z), "tile_x": F.lit(x), "tile_y": F.lit(y)}
    rows = spark.read.parquet(path)
    for name, value in (tile | _tile_block(*tile.values())).items():
        rows = rows.where(F.col(name) == value)
    return rows.drop("block_z", "block_x", "block_y")
