"""Steps of routes, penalties and compared paths, for all rows."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from strideway.functions import cost
from strideway.operators import graphs, paths, routes


def test_features_of_every_step(spark):
    n = 620
    edges = spark.createDataFrame([(i, i + 1, 0, 1.0, "path", None, None) for i in range(n)], "u long, v long, key int, length double, highway string, surface string, lit string")
    nodes = spark.createDataFrame([(i, 51.0, 0.0, 1.0) for i in range(n + 1)], "node_id long, lat double, lon double, elevation double")
    walks = spark.createDataFrame([(1, list(range(n + 1)))], "route_id long, route array<long>")
    assert {r.pos for r in routes.edge_features(walks, edges, nodes).collect()} == set(range(n))
    assert routes.edge_features(walks, edges, nodes, 8).count() == 8


def test_legacy_penalties_of_parallel_edges(spark):
    rows = [(1, 2, 0, "Primary", None, "no", None, None), (1, 2, 1, "footway", "mud", "yes", None, None), (1, 3, 0, "tertiary", "sett", None, "both", None), (1, 3, 1, "primary", "unknown", None, None, None),
            (2, 3, 0, None, None, None, None, None), (3, 1, 0, "motorway", "gravel", "disused", None, "yes"), (3, 2, 0, "secondary", None, "maybe", "no", "designated")]
    edges = spark.createDataFrame(rows, "u long, v long, key int, highway string, surface string, lit string, sidewalk string, foot string")
    found = {(r.u, r.v): (r.road, r.surface, r.lit, r.unsafe) for r in cost.legacy_penalties(edges).collect()}
    assert found == {(1, 2): (1.0, 2.0, 0.85, 3.5), (1, 3): (1.5, 1.1, 1.2, 1.0), (2, 3): (1.5, 1.2, 1.2, 1.0), (3, 1): (3.0, 1.3, 1.3, 1.0), (3, 2): (2.0, 1.2, 1.2, 1.0)}


def test_advanced_compare(spark):
    off = dict.fromkeys(paths.TOGGLES, False)
    rows = [Row(request_id=i, start=1, end=3, sliders=s, **(off | on)) for i, (s, on) in enumerate([(False, {"avoid_unsafe_roads": True}), (True, {"avoid_unsafe_roads": True}), (False, {}), (False, {"prefer_lit": True})])]
    both = paths.advanced_compare(spark.createDataFrame(rows))
    assert {(r.request_id, r.scenario) for r in both.collect()} == {(i, s) for i in (0, 3) for s in ("baseline", "advanced")}
    asked = both.where("request_id = 0").withColumn("request_id", F.col("scenario"))
    links = [(1, 3, 0, 100.0, "primary"), (1, 2, 0, 70.0, "footway"), (2, 3, 0, 70.0, "footway")]
    edges = spark.createDataFrame(links, "u long, v long, key int, length double, highway string")
    tagged = ("surface", "lit", "sidewalk", "foot", "bicycle", "designation", "lighting_regime", "access", "service", "norm_green", "norm_water", "norm_social", "norm_quiet", "norm_slope")
    edges = edges.withColumns({c: F.lit(None).cast("double" if c.startswith("norm") else "string") for c in tagged})
    edges = edges.select("u", "v", "length", *[c.alias(n) for n, c in cost.compared_factors(F.lit(0.0), F.lit(100.0)).items()])
    step = lambda: cost.compared_cost(F.col("scenario"), {t: F.col(t) for t in paths.TOGGLES})
    found = {r.request_id: r for r in paths.shortest_paths(asked, edges, step).collect()}
    assert found["baseline"].route == [1, 3] and found["baseline"].cost == 100 and found["advanced"].route == [1, 2, 3]


def test_paths_from_parents_and_over_chains(spark):
    parents = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (2, 5, None)], "request_id long, node long, parent long")
    goals = spark.createDataFrame([(1, 3), (2, 5)], "request_id long, end long")
    assert {r.request_id: r.route for r in paths.reconstructed(parents, goals).collect()} == {1: [1, 2, 3], 2: [5]}
    walks = spark.createDataFrame([(7, [1, 4, 5])], "route_id long, route array<long>")
    chained = spark.createDataFrame([(1, 4, 3.0, [2, 3]), (1, 4, 9.0, [8])], "u long, v long, length double, inner array<long>")
    assert graphs.expanded(walks, chained).first().route == [1, 2, 3, 4, 5]


def _greedy(places, radius, start):
    """Groups in order of ids, all nodes against all."""
    kept, taken = {}, set()
    for n, (x, y) in sorted(places.items()):
        if n in taken:
            continue
        group = [n]
        for m, (a, b) in sorted(places.items()):
            if m > n and m not in taken and all((a - places[g][0]) ** 2 + (b - places[g][1]) ** 2 <= radius**2 for g in group):
                group.append(m)
        taken |= set(group)
        cx, cy = (sum(places[g][i] for g in group) / len(group) for i in (0, 1))
        best = min(group, key=lambda g: (g != start, round((places[g][0] - cx) ** 2 + (places[g][1] - cy) ** 2, 6), g))
        kept |= dict.fromkeys(group, best)
    return kept


def test_groups_of_close_nodes_in_tasks_and_in_rounds(spark):
    rows = spark.range(150).select(F.col("id").alias("node_id"), (F.abs(F.xxhash64("id", F.lit(1))) % 9000 / 100).alias("x"), (F.abs(F.xxhash64("id", F.lit(2))) % 9000 / 100).alias("y"))
    places = {r.node_id: (r.x, r.y) for r in rows.collect()}
    wanted = _greedy(places, 10.0, 40)
    for most in (1000, 0):
        found = {r.node_id: r.kept_id for r in graphs.merge_groups(rows, 10.0, 40, most).collect()}
        assert {n: found.get(n, n) for n in places} == wanted


def test_groups_of_no_nodes(spark):
    assert graphs.merge_groups(spark.createDataFrame([], "node_id long, x double, y double")).count() == 0
