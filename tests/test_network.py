"""Column functions, filters, routes, paths and graphs against known values and brute force."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute_sight as area
from strideway.functions import cost, geo, tags, text
from strideway.operators import enrich, filters, graphs, loops, paths, routes, spatial, tiles


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_two_way_choice(spark):
    edges = spark.createDataFrame([(1, 3, 100.0, 1.0), (1, 2, 150.0, 0.0), (2, 3, 150.0, 0.0)], "u long, v long, length double, norm_green double")
    for name in ("norm_water", "norm_social", "norm_quiet", "norm_slope"):
        edges = edges.withColumn(name, F.col("norm_green"))
    asked = spark.createDataFrame([(1, 1, 3)], "request_id long, start long, end long")
    for weights, route in (({"distance": 1.0}, [1, 3]), ({"distance": 0.2, "greenness": 0.6, "water": 0.2}, [1, 2, 3])):
        w = {k: F.lit(float(weights.get(k, 0))) for k in cost.FEATURES}
        # parallel lengths of 100 and 150 metres: the shorter one costs nothing, so add a constant that keeps hops dear
        priced = edges.withColumn("cost", cost.edge_cost(F.lit(0.0), F.lit(150.0), w))
        assert paths.shortest_paths(asked, priced).first()["route"] == route


def test_paths_against_dijkstra(spark):
    rng = random.Random(3)
    links = {(a, b): rng.uniform(1, 9) for a in range(12) for b in range(12) if a != b and rng.random() < 0.25}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "u long, v long, cost double")
    pairs = [(k, a, b) for k, (a, b) in enumerate([(0, 11), (3, 7), (5, 1)])]
    found = {r.request_id: r for r in paths.shortest_paths(spark.createDataFrame(pairs, "request_id long, start long, end long"), edges).collect()}
    for k, a, b in pairs:
        best, heap = {}, [(0.0, a)]
        while heap:
            g, n = heapq.heappop(heap)
            if n not in best:
                best[n] = g
                heap += [(g + w, y) for (x, y), w in links.items() if x == n]
                heapq.heapify(heap)
        assert (b in best) == (k in found)
        if b in best:
            route = found[k]["route"]
            assert found[k]["cost"] == pytest.approx(best[b]) and sum(links[x] for x in zip(route, route[1:], strict=False)) == pytest.approx(best[b])


def test_walking_filter(spark):
    cases = [("footway", None, None, None, None, None, True), ("motorway", "yes", None, None, None, None, False), ("cycleway", None, None, None, None, None, False), ("cycleway", "designated", None, None, None, None, True),
             ("trunk", None, None, None, "public_footpath", None, True), ("path", "no", None, None, None, None, False), ("path", None, "private", None, None, None, False), ("path", "yes", "private", None, None, None, True),
             ("service", None, None, "driveway", None, None, False), ("path", None, None, None, None, "yes", False), (None, None, None, None, None, None, True)]
    rows = [(i, 100 + i, 0, *c[:6]) for i, c in enumerate(cases)]
    edges = spark.createDataFrame(rows, "u long, v long, key int, highway string, foot string, access string, service string, designation string, area string")
    kept = {r.u for r in filters.walkable(edges).collect()}
    assert kept == {i for i, c in enumerate(cases) if c[6]}
    gates = spark.createDataFrame([(0, "gate", "yes", None), (10, "gate", None, None)], "node_id long, barrier string, locked string, access string")
    assert {r.u for r in filters.walkable(edges, gates).collect()} == kept - {0}


def test_scalars(spark):
    lit = lambda x: F.lit(float(x))
    row = one(
        spark, geo.haversine(lit(51.45), lit(-2.6), lit(51.46), lit(-2.6)).alias("d"), cost.tobler(lit(0)).alias("flat"), cost.tobler(lit(-0.05)).alias("down"), tiles.tile_id(lit(51.4567), lit(-2.5891)).alias("tile"),
        text.solar_phase(lit(51.4545), lit(-2.5879), F.lit("2026-06-21T12:00:00Z").cast("timestamp")).alias("noon"), text.solar_phase(lit(51.4545), lit(-2.5879), F.lit("2026-03-29T00:30:00Z").cast("timestamp")).alias("late"),
        text.pace_text(lit(5), F.lit("km")).alias("pace"), tags.noise_factor(F.lit("Primary")).alias("noise"),
    )
    assert row.d == pytest.approx(1111.95, abs=0.1) and row.flat == pytest.approx(5 / (6 * math.exp(-0.175))) and row.down == pytest.approx(5 / 6)
    assert (row.noon, row.late, row.pace, row.noise, row.tile) == ("daylight", "night", "12:00 min/km", 1.0, "51.49_-2.57")


def test_grid_reference_to_degrees(spark):
    rows = spark.createDataFrame([(651409.903, 313177.270)], "e double, n double")
    row = geo.osgb_to_wgs84(rows, "e", "n").first()
    assert row.lat == pytest.approx(52.6580, abs=2e-3) and row.lon == pytest.approx(1.7160, abs=2e-3)


def test_disc_area_against_sampling(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 6))
        ring = np.stack([20 + 40 * np.cos(angle), 10 + 30 * np.sin(angle)], 1)
        points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
        got = one(spark, geo.disc_ring_area(F.lit(0.0), F.lit(0.0), 50.0, points).alias("a")).a
        p = rng.uniform(-50, 50, (200_000, 2))
        a, b = ring, np.roll(ring, -1, axis=0)
        crosses = ((a[:, 1][:, None] > p[:, 1]) != (b[:, 1][:, None] > p[:, 1])) & (p[:, 0] < (b[:, 0] - a[:, 0])[:, None] * (p[:, 1] - a[:, 1][:, None]) / (b[:, 1] - a[:, 1])[:, None] + a[:, 0][:, None])
        assert got == pytest.approx(((crosses.sum(0) % 2 == 1) & (np.hypot(*p.T) <= 50)).mean() * 10_000, rel=0.05, abs=20)


def test_visible_area_of_a_full_view():
    reach = np.full((4, area.RAYS), 100.0)
    ring = np.array([(10, 10), (30, 10), (30, 30), (10, 30)], float)
    after = np.roll(ring, -1, axis=0)
    assert abs(area.star_overlaps(reach, *ring.T, *after.T).sum()) == pytest.approx(400)
    hits = area.wall_hits(np.array([5.0]), np.array([-1.0]), np.array([5.0]), np.array([1.0]))
    assert hits[0, 0] == pytest.approx(5) and np.isinf(hits[0, 36])


def test_spur_removal_and_similarity(spark):
    def reduced(route):
        while spur := next((i for i in range(len(route) - 2) if route[i] == route[i + 2]), None) is not None:
            i = next(i for i in range(len(route) - 2) if route[i] == route[i + 2])
            route = route[: i + 1] + route[i + 3 :]
        return route

    rng = random.Random(1)
    walks = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    walks = [[x for i, x in enumerate(w) if i == 0 or w[i - 1] != x] for w in walks]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(walks)], "route_id long, route array<long>")
    for r in rows.select("route", routes.without_spurs(F.col("route")).alias("out")).collect():
        assert r.out == reduced(r.route)
    a, b = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 3, 4)))
    assert one(spark, routes.edge_similarity(a, b).alias("s")).s == pytest.approx(1 / 3)


def test_normalisation(spark):
    rows = [(1, 2, 0.1, 0.2, 0.3, 2.0, 1.0), (2, 3, 0.9, 0.8, 0.7, 1.0, 2.5), (1, 3, 0.5, 0.5, None, 1.5, 1.5)]
    edges = spark.createDataFrame(rows, "u long, v long, raw_green_cost double, raw_water_cost double, raw_social_cost double, noise_factor double, slope_time_cost double")
    out = {(r.u, r.v): r for r in enrich.normalise(edges).collect()}
    assert out[1, 2].norm_green == 0 and out[2, 3].norm_green == 1 and out[1, 2].norm_quiet == 0 and out[1, 3].norm_social == 0.5
    with pytest.raises(ValueError):
        enrich.green_processor("nothing")
    with pytest.raises(ValueError):
        loops.loop_solver("nothing")


def test_graph_simplification(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (6, 7), (7, 4), (2, 8)]
    rows = [(a, b, 0, 10.0, "path", "x") for a, b in [*links, *[(b, a) for a, b in links]]]
    edges = spark.createDataFrame(rows, "u long, v long, key int, length double, highway string, name string")
    left = {(r.u, r.v) for r in graphs.without_dead_ends(edges).collect()}
    assert left == {(a, b) for a in (4, 6, 7) for b in (4, 6, 7) if a != b}
    chained = {(r.u, r.v): r for r in graphs.chains(edges).collect()}
    assert chained[2, 4]["inner"] == [3] and chained[2, 4].length == 20 and (1, 2) in chained
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 30.0, 0.0), (4, 12.0, 0.0)], "node_id long, x double, y double")
    groups = {r.node_id: r.kept_id for r in graphs.merge_groups(nodes, 10.0).collect()}
    assert groups[1] == groups[2] and groups.get(4, 4) != groups[1]


def test_nearest_nodes_reach_far(spark):
    nodes = spark.createDataFrame([(i, 51.0 + i * 0.01, -2.0 + i * 0.02) for i in range(30)], "node_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 51.001, -2.0), (2, 40.0, 10.0)], "id long, lat double, lon double")
    got = {r.id: r.node_id for r in spatial.nearest_nodes(points, ["id"], nodes).collect()}
    assert got[1] == 0 and got[2] in (0, 29)


def test_empty_tables(spark):
    edges = spark.createDataFrame([], "u long, v long, key int, length double, highway string, ux double, uy double, vx double, vy double, mx double, my double")
    pois = spark.createDataFrame([], "x double, y double")
    assert enrich.add_social(enrich.add_quietness(edges), pois).count() == 0
