"""Pruning in rounds, reachability near requests, and what isn't broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from strideway.operators import graphs, materialise, paths, routes
from strideway.operators.materialise import scratch
from strideway.sources import tables


def pruned(links, start=None, rounds=None, most=None):
    links, done = set(links), 0
    left = most if most is not None else max(len({n for e in links for n in e}) // 20, 50) if rounds is not None else None
    while rounds is None or done < rounds:
        around = {}
        for a, b in links:
            if a != b:
                around.setdefault(a, set()).add(b)
                around.setdefault(b, set()).add(a)
        ends = sorted(n for n, o in around.items() if len(o) <= 1 and n != start)[:left]
        links = {e for e in links if not set(e) & set(ends)}
        done, left = done + 1, None if left is None else left - len(ends)
        if not ends or left == 0:
            break
    return links


@pytest.mark.parametrize("more", [{}, {"start": 0}, {"start": 3, "rounds": 2}, {"rounds": 3, "most": 7}, {"most": 9}])
def test_dead_ends_in_rounds(spark, more):
    rng = random.Random(4)
    links = {(i, rng.randrange(max(i - 3, 0), i)) for i in range(1, 60)} | {(a, b) for a in range(60) for b in range(a) if rng.random() < 0.006} | {(70, 70), (71, 71), (71, 5), (80, 81), (81, 80)}
    edges = spark.createDataFrame([(a, b, f"W{a}") for a, b in sorted(links)], "u long, v long, name string")
    since = materialise.made()
    found = graphs.without_dead_ends(edges, **more)
    assert found.columns == edges.columns and {(r.u, r.v) for r in found.collect()} == pruned(links, **more)
    # edges aren't written in each round
    assert {p.rsplit("/", 1)[-1].split("-")[0] for p in materialise._made[since:]} <= {"pairs", "remaining", "gone"}


def test_requests_are_reached_without_components(spark, monkeypatch):
    links = [(i, i + 1) for i in range(30)] + [(i + 1, i) for i in range(0, 30, 2)] + [(50, 3), (7, 51)]
    nodes = spark.createDataFrame([(i, 51.0 + i % 32 * 0.0004, -2.1) for i in range(52)], "node_id long, lat double, lon double")
    asked = [(k, a, b) for k, (a, b) in enumerate([(0, 30), (30, 29), (30, 0), (3, 50), (50, 9), (51, 1), (4, 51), (6, 6), (40, 41)])]
    rows = lambda *more: {r.request_id: r.reachable for r in paths.reachable(spark.createDataFrame(asked, "request_id long, start long, end long"), spark.createDataFrame(links, "u long, v long"), *more).collect()}
    whole = rows()
    monkeypatch.setattr(paths, "components", lambda pairs: pytest.fail("the whole network"))
    assert rows(nodes) == whole and {whole[0], whole[2]} == {True, False}


def test_steps_of_routes_arent_broadcast(spark):
    edges = spark.createDataFrame([(1, 2, 0, 5.0, "path", "dirt", "no"), (2, 3, 0, 6.0, "path", "dirt", "no")], "u long, v long, key int, length double, highway string, surface string, lit string")
    nodes = spark.createDataFrame([(i, 51.0, 0.0, 3.0) for i in range(4)], "node_id long, lat double, lon double, elevation double")
    found = routes.edge_features(spark.createDataFrame([(9, [1, 2, 3])], "route_id long, route array<long>"), edges, nodes)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.pos, r.length) for r in found.orderBy("pos").collect()] == [(0, 5.0), (1, 6.0)]


def test_map_tiles_share_a_folder_and_are_replaced_alone(spark):
    tiles = spark.range(400).select(F.lit(15).alias("z"), (F.col("id") % 20 - 5).cast("int").alias("tile_x"), F.floor(F.col("id") / 20).cast("int").alias("tile_y"), F.col("id").alias("edge"))
    path = scratch(spark, "tiles")
    tables.write_map_tiles(tiles, path)
    tables.write_map_tiles(tiles.where("tile_x = 3 and tile_y = 4").withColumn("edge", F.lit(-1).cast("long")), path)
    assert [r.edge for r in tables.read_map_tile(spark, path, 15, 3, 4).collect()] == [-1] and [r.edge for r in tables.read_map_tile(spark, path, 15, -5, 0).collect()] == [0]
    rows = spark.read.parquet(path)
    assert rows.count() == 400 and rows.select("block_z", "block_x", "block_y").distinct().count() == 2
