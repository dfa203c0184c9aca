"""What is written is read back, and writing again changes nothing else."""

from pyspark.sql import functions as F

from strideway.operators.materialise import scratch
from strideway.sources import tables


def test_documents_and_map_tiles(spark):
    rows = spark.createDataFrame([(i, f"<a>line {i}\nnext</a>" + "\n" * (i % 2)) for i in range(20)], "route_id long, gpx string")
    path = scratch(spark, "files")
    for _ in range(2):  # a job that is repeated
        tables.write_documents(rows, path, ["route_id"], "gpx")
    tables.write_documents(spark.createDataFrame([(3, "new")], rows.schema), path, ["route_id"], "gpx")
    found = {r.route_id: r.gpx for r in tables.read_documents(spark, path, {"route_id": "long"}, "gpx").collect()}
    assert found == {r.route_id: r.gpx for r in rows.collect()} | {3: "new"}
    tiles = rows.select(F.lit(15).alias("z"), (F.col("route_id") % 2).cast("int").alias("tile_x"), F.lit(7).alias("tile_y"), "route_id")
    for _ in range(2):
        tables.write_map_tiles(tiles, path + "-tiles")
    assert sorted(r.route_id for r in tables.read_map_tile(spark, path + "-tiles", 15, 1, 7).collect()) == list(range(1, 20, 2))
