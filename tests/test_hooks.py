"""Registries of processors, costs and solvers; tile names; routes of scenarios; water-tight searches."""

import pytest
from pyspark.sql import functions as F

from strideway.functions import cost, text
from strideway.operators import enrich, loops, paths, tiles


def test_green_processors_can_be_added(spark):
    edges = spark.createDataFrame([(1, 2, 0)], "u long, v long, key int")
    enrich.register_processor("constant", lambda edges, green, buildings=None: edges.withColumn("raw_green_cost", F.lit(0.25)))
    assert enrich.green_processor("CONSTANT")(edges, None).first().raw_green_cost == 0.25
    with pytest.raises(ValueError, match="unknown green mode"):
        enrich.green_processor("nothing")


def test_loop_solvers_can_be_added(spark):
    loops.register_loop_solver("still", lambda requests, nodes, edges, **more: requests)
    assert loops.loop_solver("Still")("asked", None, None) == "asked"
    with pytest.raises(ValueError, match="unknown loop solver"):
        loops.loop_solver("nothing")


def test_cost_functions_can_be_added(spark):
    cost.register_cost_function("FIRST", lambda length, norms, weights, combine: F.lit(7.0))
    edges = spark.createDataFrame([(5.0, 0.1, 0.2, 0.3, 0.4, 0.5)], "length double, norm_green double, norm_water double, norm_social double, norm_quiet double, norm_slope double")
    weights = {k: F.lit(0.1) for k in cost.FEATURES}
    assert edges.select(cost.edge_cost(F.lit(0.0), F.lit(10.0), weights, method="FIRST").alias("c")).first().c == 7.0


def test_elevation_tiles(spark):
    rows = spark.createDataFrame([(51.4, -2.6, 51.5, -2.5), (-0.5, -0.5, 0.5, 0.5)], "a double, b double, c double, d double")
    found = [r.t for r in rows.select(tiles.dem_cover(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("t")).collect()]
    name = lambda lat, lon: f"Copernicus_DSM_COG_10_{lat}_00_{lon}_00_DEM"
    assert found == [[name("N51", "W003")], [name("S01", "W001"), name("S01", "E000"), name("N00", "W001"), name("N00", "E000")]]


def test_times_that_are_no_times_are_null(spark):
    rows = spark.createDataFrame([("2024-06-01T10:00:00Z",), ("2024-06-01T10:00:00+01:00",), ("soon",), (None,)], "said string")
    assert [r.s for r in rows.select(F.unix_timestamp(text.timestamp_of(F.col("said"))).alias("s")).collect()] == [1717236000, 1717232400, None, None]


def test_searches_over_many_edges_in_a_round(spark, monkeypatch):
    import random

    rng = random.Random(5)
    links = {(a, b): rng.randrange(1, 9) for a in range(40) for b in rng.sample(range(40), 3) if a != b}
    edges = spark.createDataFrame([(a, b, float(c)) for (a, b), c in links.items()], "u long, v long, cost double")
    asked = spark.createDataFrame([(i, i, 39 - i) for i in range(6)], "request_id long, start long, end long")
    best = {(a, a): 0 for a in range(40)}
    for _ in range(40):
        for (a, b), c in links.items():
            for s in range(6):
                if (s, a) in best and best[s, a] + c < best.get((s, b), 1e9):
                    best[s, b] = best[s, a] + c
    for hops in (1, 4):
        monkeypatch.setattr(paths, "HOPS", hops)
        for r in paths.shortest_paths(asked, edges).collect():
            assert r.cost == best[r.request_id, 39 - r.request_id] == sum(links[a, b] for a, b in zip(r.route, r.route[1:], strict=False))
            assert (r.route[0], r.route[-1]) == (r.request_id, 39 - r.request_id)
    with pytest.raises(RuntimeError, match="settled"):
        paths.shortest_paths(asked, edges, most_rounds=1)
