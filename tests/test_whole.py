"""Registered queries work on all rows, and operators do the whole of what the reference does."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strideway.operators import loops
from strideway.sources.network import Network

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["modifier_context", "canonical_preferences", "sampled_lines"])
def test_queries_take_every_edge(spark, name):
    edges = Network(spark, DATA).edges.select("u", "v", "key")
    found = __spark_entry__.queries()[name](spark, DATA).select("u", "v", "key")
    assert found.exceptAll(edges).isEmpty() and edges.exceptAll(found).isEmpty()


def test_queries_take_every_light_in_bounds(spark):
    net, queries = Network(spark, DATA), __spark_entry__.queries()
    ends = net.edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().join(net.nodes, "node_id")
    a, b, c, d = ends.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    inside = {r.light_id for r in net.lights.where(F.col("x").between(a - 15, b + 15) & F.col("y").between(c - 15, d + 15)).collect()}
    assert {r.light_id for r in queries["lights_in_bounds"](spark, DATA).collect()} == inside


def test_loops_are_asked_for_every_request(spark, monkeypatch):
    seen = {}

    def solver(requests, nodes, edges, **more):
        seen["ids"], seen["more"] = {r.request_id for r in requests.collect()}, more
        return requests.select(F.lit("c").alias("candidate_id"), "request_id", F.lit("polygon").alias("kind"), F.lit(1.0).alias("length"), F.array("start").alias("route"))

    monkeypatch.setitem(loops._solvers, "GEOMETRIC", solver)
    __spark_entry__.queries()["loops_geometric"](spark, DATA).collect()
    assert seen["ids"] == {r.request_id for r in Network(spark, DATA).requests.collect()} and not {"candidates", "rounds"} & set(seen["more"])


def _snapped(spark, places, links, points, **more):
    """The nodes chosen for ``points`` of one loop from node 0; places in steps of 0.001 degrees, links both ways with a highway."""
    nodes = spark.createDataFrame([(n, 51.0 + y * 0.001, 0.0 + x * 0.001) for n, (x, y) in places.items()], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(a, b, h, 0.0) for u, v, h in links for a, b in ((u, v), (v, u))], "u long, v long, highway string, norm_green double")
    loop = spark.createDataFrame([("c", len(points) + 1, 0, 51.0, 0.0)], "candidate_id string, corners int, start long, start_lat double, start_lon double")
    rows = spark.createDataFrame([("c", i, 51.0 + y * 0.001, 0.0 + x * 0.001) for i, (x, y) in enumerate(points)], "candidate_id string, place int, lat double, lon double")
    return [r.node_id for r in loops.snapped_waypoints(loop, rows, nodes, loops.snap_profile(nodes, edges), **more).orderBy("place").collect()]


def test_snapping_goes_past_the_nearest(spark):
    # 60 dead ends around the point; the fit nodes 1 and 2 are further off
    places = {0: (0, 0), 1: (9, 0), 2: (9, 1), 3: (8, 0)} | {100 + i: (5 + i * 0.001, 0) for i in range(60)}
    links = [(0, 1, "path"), (1, 2, "path"), (2, 3, "path"), (1, 3, "path"), *[(100 + i, 3, "motorway") for i in range(60)]]
    assert _snapped(spark, places, links, [(5, 0)], flow=False)[0] in (1, 2, 3)
    assert _snapped(spark, places, links, [(5, 0)], flow=False, most=50) == []


def test_snapping_minds_turns_exits_and_secondary_roads(spark):
    # both ends of the square are as good by distance; node 1 touches a secondary road
    places = {0: (0, 0), 1: (4, 4), 2: (4, 5), 3: (4, 6), 4: (9, 9), 5: (3, 8)}
    links = [(0, 1, "path"), (1, 2, "secondary"), (2, 3, "path"), (0, 3, "path"), (1, 5, "path"), (3, 5, "path"), (3, 4, "path"), (0, 5, "path")]
    assert _snapped(spark, places, links, [(4, 4.2)], flow=False) == [3]
    # node 1 is nearest to the point, but lies beyond it: one would turn right round there
    places = {0: (0, 0), 1: (0, 9), 2: (4, 5), 3: (9, 0), 4: (0.1, 9.1), 5: (4.1, 5.1)}
    links = [(a, b, "path") for a, b in ((0, 1), (1, 4), (1, 2), (0, 2), (2, 5), (2, 3), (0, 3), (3, 5))]
    assert _snapped(spark, places, links, [(0.5, 8)], flow=False) == [1]
    assert _snapped(spark, places, links, [(0.5, 8), (9, 0)])[0] == 5


def test_random_walks_try_as_often_as_the_reference(spark):
    edges = spark.createDataFrame([(i, i + 1, 1000.0, 0.0, 0.0) for i in range(40)], "u long, v long, length double, cost double, course double")
    asked = spark.createDataFrame([(1, 0, 5_000.0, 0.0), (2, 0, 10_001.0, 0.0), (3, 0, 20_001.0, 0.0)], "request_id long, start long, target_m double, bearing double")
    walks = loops.random_walks(asked, edges).collect()
    assert {k: sorted(r.attempt for r in walks if r.request_id == k) for k in (1, 2, 3)} == {1: [*range(1, 21)], 2: [*range(1, 41)], 3: [*range(1, 61)]}
    # outward the walk ends with the first step that reaches its share
    assert {r.attempt: r.length for r in walks if r.request_id == 3 and r.attempt <= 6} == {1: 9000, 2: 10000, 3: 11000, 4: 12000, 5: 13000, 6: 9000}
