"""A street network derived from the driver's tables, in the schemas that the operators take.

Orders are nodes on a grid, line items edges in both directions, parts areas and lines, customers points of interest,
events lamps, suppliers route requests. Projected coordinates are metres in UTM zone 30.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions import geo

COLUMNS, LAT0, LON0, LAT_STEP, LON_STEP = 100, 51.40, -2.65, 0.0005, 0.0008
#: Degrees that the bends of lines are off, times -3 to 3.
BEND = 0.00002
HIGHWAYS = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "footway", "path", "cycleway", "pedestrian", "track", "steps", "living_street", "unclassified", "construction"]
SURFACES = ["asphalt", "gravel", "dirt", None, "paving_stones"]
FOOT = ["yes", "designated", "no", None, None, "permissive"]
BICYCLE = ["designated", "yes", None, "no"]
SIDEWALK = ["both", "no", None, "right", None, "none", "separate"]
REGIMES = [None, "Dusk to dawn", "Part night", None, "switch off at midnight", "solar", None, "24/7", None]
KINDS = {"ECONOMY": "green", "STANDARD": "green", "LARGE": "water", "MEDIUM": "building", "SMALL": "building", "PROMO": "water_line"}
#: A hole's and a second part's size and shift to the east, in radii of an area.
HOLE, PART = (0.4, 0.0), (0.5, 1.6)
EDGE_KEY = ["u", "v", "key"]


def pick(values: list[str | None], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int") + 1)


def place(node: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a node by its number."""
    return F.floor(node / COLUMNS) * LAT_STEP + LAT0, node % COLUMNS * LON_STEP + LON0


def _bent(u: Column, v: Column, way: Column) -> Column:
    """The line of every third way's edges in degrees, with a bend to either side; the others are straight (null)."""
    (lat1, lon1), (lat2, lon2), off = place(u), place(v), (way % 7 - 3) * BEND
    at = lambda k, side: F.struct((lat1 + (lat2 - lat1) * k / 3 + off * side).alias("lat"), (lon1 + (lon2 - lon1) * k / 3 + off * side).alias("lon"))
    return F.when(way % 3 == 0, F.array(at(0, 0), at(1, 1), at(2, -1), at(3, 0)))


#: Bytes of a Parquet file that one task reads, and of a shuffle that one task takes (Spark's defaults are 128 and 64 MB):
#: narrow rows of ids grow to some ten times that in a task's hash tables.
SPLIT, SHUFFLED = 16 << 20, 16 << 20


def bounded_tasks(spark: SparkSession, path: str) -> None:
    """More tasks for more input, for the whole session: a fixed number of shuffle partitions would make each task's rows
    grow with the input. Adaptive execution merges what is too small; a session that allows less to a task keeps that."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = files.getContentSummary(folder).getLength() if files.exists(folder) else 0
    conf = lambda key, default: spark.conf.get(key, default)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    many = int(conf(initial, conf("spark.sql.shuffle.partitions", "200")))
    spark.conf.set(initial, str(max(many, size // (SHUFFLED // 8) + 1)))
    for key, most in (("spark.sql.files.maxPartitionBytes", SPLIT), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED)):
        own = spark.sql(f"SET {key}").first()["value"]
        bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        if not own[:1].isdigit() or bytes_of(own) > most:
            spark.conf.set(key, str(most))


class Network:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        bounded_tasks(spark, f"{sf_dir}/lineitem.parquet")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def node_count(self) -> int:
        return self.table("orders").count()

    @cached_property
    def nodes(self) -> DataFrame:
        """node_id, lat, lon, x, y, elevation, barrier, locked, access"""
        n = F.col("o_orderkey")
        rows = self.table("orders").select(n.alias("node_id"), *[c.alias(a) for c, a in zip(place(n), ("lat", "lon"), strict=True)], (F.col("o_totalprice") % 100).alias("elevation"))
        x, y = geo.utm30(F.col("lat"), F.col("lon"))
        n = F.col("node_id")
        return rows.select(
            "node_id", "lat", "lon", x.alias("x"), y.alias("y"), "elevation", F.when(n % 97 == 0, "gate").alias("barrier"),
            F.when(n % 194 == 0, "yes").alias("locked"), F.when(n % 291 == 0, "private").alias("access"),
        )

    @cached_property
    def base_edges(self) -> DataFrame:
        """One direction of each edge, with tags."""
        u, key = F.col("l_orderkey"), F.col("l_linenumber")
        grouped = self.table("lineitem").groupBy(u.alias("u"), key.alias("key")).agg(F.min("l_partkey").alias("way"), F.min("l_suppkey").alias("supp"), F.min("l_discount").alias("slack"), F.min("l_returnflag").alias("flag"))
        right = (F.col("key") % 2 == 1) & (F.col("u") % COLUMNS < COLUMNS - 1)
        rows = grouped.withColumn("v", F.when(right, F.col("u") + 1).otherwise(F.col("u") + COLUMNS))
        rows = rows.join(self.table("orders").select(F.col("o_orderkey").alias("v")), "v", "left_semi")
        length = geo.haversine(*place(F.col("u")), *place(F.col("v"))) * (F.col("slack") + 1)
        way, key = F.col("way"), F.col("key")
        return rows.select(
            "u", "v", "key", length.alias("length"), F.array(way.cast("string")).alias("way_ids"), pick(HIGHWAYS, way % 16).alias("highway"),
            F.when(F.col("flag") == "A", "yes").when(F.col("flag") == "R", "no").alias("lit"), pick(SURFACES, way % 5).alias("surface"), pick(FOOT, (way + key) % 6).alias("foot"),
            F.when(F.col("supp") % 11 == 0, "private").alias("access"), F.concat(F.lit("W"), (way % 40).cast("string")).alias("name"), pick(["driveway", "alley", None], way % 3).alias("service"),
            F.when(way % 13 == 0, "public_footpath").alias("designation"), F.when(way % 101 == 0, "yes").alias("area"), pick(BICYCLE, (way + key * 2) % 4).alias("bicycle"),
            pick(SIDEWALK, way % 7).alias("sidewalk"), pick(REGIMES, way % 9).alias("lighting_regime"), way.alias("way"), _bent(F.col("u"), F.col("v"), way).alias("geometry"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Both directions of each edge."""
        turned = F.explode(F.array(F.struct("u", "v", F.lit(False).alias("back")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("back"))))
        rest = [c for c in self.base_edges.columns if c not in ("u", "v", "geometry")]
        line = F.when(F.col("uv.back"), F.reverse("geometry")).otherwise(F.col("geometry")).alias("geometry")
        return self.base_edges.select(turned.alias("uv"), *rest, "geometry").select("uv.u", "uv.v", *rest, line)

    def _at_node(self, rows: DataFrame, node: Column) -> DataFrame:
        """``rows`` with the coordinates of a node."""
        own = self.nodes.select(F.col("node_id").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
        return rows.withColumn("node", node).join(own, "node")

    @cached_property
    def polygons(self) -> DataFrame:
        """geom_id, kind (green, water, water_line, building), closed, rings: every third area has a hole, every fifth a part beside it; points: the first ring"""
        size = (F.col("p_partkey") % 5 + 4).cast("int")
        kind = F.lit(None).cast("string")
        for word, name in KINDS.items():
            kind = F.when(F.col("p_type").startswith(word), name).otherwise(kind)
        rows = self._at_node(self.table("part"), F.col("p_partkey") * 7 % self.node_count).withColumn("kind", kind)
        radius = F.col("p_size") * 3 + 5
        corners = F.when(F.col("kind") == "water_line", 2).otherwise(size)
        turn = lambda k: k * (2 * math.pi) / corners

        def ring(scale: float, shift: float) -> Column:
            """The corners at ``scale`` times the radius, ``shift`` times the radius to the east."""
            at = lambda k: F.struct((F.col("nx") + radius * shift + radius * scale * F.cos(turn(k))).alias("x"), (F.col("ny") + radius * scale * F.sin(turn(k))).alias("y"))
            return F.transform(F.sequence(F.lit(0), corners - 1), at)

        closed, k = F.col("kind") != "water_line", F.col("p_partkey")
        made = lambda when, hole, *at: F.when(when, F.struct(F.lit(hole).alias("hole"), ring(*at).alias("points")))
        rings = F.array_compact(F.array(made(F.lit(True), False, 1.0, 0.0), made(closed & (k % 3 == 0), True, *HOLE), made(closed & (k % 5 == 0), False, *PART)))
        return rows.select(F.col("p_partkey").alias("geom_id"), "kind", closed.alias("closed"), rings[0]["points"].alias("points"), rings.alias("rings"), F.col("nlat").alias("lat"), F.col("nlon").alias("lon"))

    @cached_property
    def features(self) -> DataFrame:
        """Raw features with tags: geom_id, geom_type and the seven tag columns."""
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("geom_id"), F.when(k % 23 == 0, None).otherwise(pick(["Polygon", "MultiPolygon", "LineString", "Point"], k % 4)).alias("geom_type"),
            pick(["grass", "forest", "reservoir", None, None, "residential", "meadow"], k % 7).alias("landuse"), pick(["wood", None, "water", None, "scrub", "wetland", None, None, "cliff"], k % 9).alias("natural"),
            pick(["park", None, None, "garden", None, "pitch", None, None], k % 8).alias("leisure"), F.when(k % 10 == 0, "river").when(k % 10 == 5, "drain").when(k % 10 == 3, "weir").alias("waterway"),
            pick(["cafe", None, None, "bench", None, "pub"], k % 6).alias("amenity"), F.when(k % 11 == 0, "bakery").alias("shop"), pick([None, None, "museum", None, "hotel"], k % 5).alias("tourism"),
            F.when(k % 14 == 0, "castle").alias("historic"),
        )

    @cached_property
    def pois(self) -> DataFrame:
        """poi_id, x, y, amenity"""
        rows = self._at_node(self.table("customer"), F.col("c_custkey") * 11 % self.node_count)
        return rows.select(F.col("c_custkey").alias("poi_id"), (F.col("nx") + (F.col("c_nationkey") - 12) * 2).alias("x"), F.col("ny").alias("y"), F.lower("c_mktsegment").alias("amenity"))

    @cached_property
    def lights(self) -> DataFrame:
        """light_id, x, y, lat, lon, source, lit, lit_tag_type, lighting_regime, lighting_regime_text; later ids are later rows."""
        rows = self._at_node(self.table("events"), F.col("event_id") * 13 % self.node_count)
        kind = F.col("event_type")
        regime = F.when(kind == "view", "Part-Night").when(kind == "click", "all night").when(kind == "signup", "none").when(kind == "error", "")
        return rows.select(
            F.col("event_id").alias("light_id"), F.col("nx").alias("x"), (F.col("ny") + F.col("value") % 30).alias("y"), F.col("nlat").alias("lat"), F.col("nlon").alias("lon"), kind.alias("source"),
            F.lit("yes").alias("lit"), F.when(kind == "purchase", "n/a").otherwise(F.concat(kind, F.lit("_point"))).alias("lit_tag_type"), regime.alias("lighting_regime"),
            F.when(kind == "view", "Sunset - 0000").when(kind == "click", "24 hours").when(kind == "signup", "solar unit").when(kind == "purchase", "0500-2300").alias("lighting_regime_text"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """request_id, start, end, start and end coordinates, six sliders, asked_at, profile, unit, override, is_loop, target_m"""
        k, n = F.col("s_suppkey"), self.node_count
        start = k * 149 % n
        step = k % 13
        end = F.least(start + F.least(step, F.lit(COLUMNS - 1) - start % COLUMNS) + (F.lit(12) - step) * COLUMNS, F.lit(n - 1))
        s = F.col("s_nationkey")
        lat1, lon1 = place(F.col("start"))
        lat2, lon2 = place(F.col("end"))
        return (
            self.table("supplier").withColumn("start", start).withColumn("end", end)
            .select(
                k.alias("request_id"), "start", "end", lat1.alias("start_lat"), lon1.alias("start_lon"), lat2.alias("end_lat"), lon2.alias("end_lon"),
                F.when(k % 3 == 0, None).otherwise((s % 6).cast("double")).alias("distance"), (s % 5).cast("double").alias("greenness"), (s % 4).cast("double").alias("water"),
                (s % 3).cast("double").alias("social"), (s % 2).cast("double").alias("quietness"), (s % 7 - 3).cast("double").alias("slope"),
                F.timestamp_seconds(F.lit(1704067200) + k * 3600).alias("asked_at"), pick(["walking", "running_easy", "running_race", "flying"], k % 4).alias("profile"),
                pick(["km", "mi"], k % 2).alias("unit"), pick([None, "night", "Daylight", "dim"], k % 4).alias("override"), (k % 2 == 0).alias("is_loop"), ((k % 35) * 1000.0).alias("target_m"),
            )
        )

    @cached_property
    def dem(self) -> DataFrame:
        """Raster cells: tile_lat, tile_lon, row, col, elevation (one arc second)"""
        row, col = F.floor(F.col("lat") * 3600), F.floor(F.col("lon") * 3600)
        cells = self.nodes.select(row.alias("r"), col.alias("c"), "elevation")
        tile = lambda c: F.floor(F.col(c) / 3600)
        return cells.groupBy(tile("r").alias("tile_lat"), tile("c").alias("tile_lon"), (F.col("r") - tile("r") * 3600).alias("row"), (F.col("c") - tile("c") * 3600).alias("col")).agg(F.max("elevation").alias("elevation"))

    @cached_property
    def walks(self) -> DataFrame:
        """Stored routes: route_id, request_id, route (node ids): staircases through the grid with a spur in some."""
        k, n = F.col("s_suppkey"), self.node_count
        rows = self.table("supplier").select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"), k.alias("request_id"), (k * 149 % n).alias("start"))
        turn = lambda i: F.when((i + F.col("variant")) % (F.col("variant") + 2) == 0, F.lit(COLUMNS)).otherwise(F.lit(1))
        steps = F.transform(F.sequence(F.lit(0), F.lit(11)), turn)
        path = F.aggregate(steps, F.array("start"), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
        back = F.when(F.col("request_id") % 4 == 1, F.slice(F.reverse(path), 2, 5)).otherwise(F.array().cast("array<bigint>"))
        return rows.select((F.col("request_id") * 3 + F.col("variant")).alias("route_id"), "request_id", "variant", F.filter(F.concat(path, back), lambda x: x < n).alias("route"))
