"""Queries over builds by tile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.operators.materialise import scratch
from strideway.plans import build
from strideway.plans.queries_edges import _GATES, _NOISE, _WALK, _WATER
from strideway.plans.queries_tables import _tiles_sql
from strideway.plans.tile_build import TileStore, for_requests

QUERIES: dict[str, tuple[Callable, str | None]] = {}
_SIDE = "split_part(tile_id, '_', {i})::DOUBLE"
_NEED = _tiles_sql("SELECT request_id, start_lat AS s_lat, start_lon AS s_lon, least(start_lat, end_lat) AS y1, greatest(start_lat, end_lat) AS y2, least(start_lon, end_lon) AS x1, greatest(start_lon, end_lon) AS x2 FROM requests")


def query(sql: str | None = None):
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def _norm(c: str, invert: bool = False) -> str:
    low, high = f"min({c}) OVER (PARTITION BY tile_id)", f"max({c}) OVER (PARTITION BY tile_id)"
    share = f"({high} - {c}) / ({high} - {low})" if invert else f"({c} - {low}) / ({high} - {low})"
    return f"CASE WHEN {high} = {low} THEN 0.0::DOUBLE ELSE {share} END"


@query(
    f"""{_NEED}, need AS (SELECT DISTINCT unnest(tiles) AS tile_id FROM o), w AS ({_WATER}),
    nt AS MATERIALIZED (SELECT node_id, tile_id FROM nodes, need WHERE abs(lat - {_SIDE.format(i=1)}) <= 9.5 / 111.0::DOUBLE AND abs(lon - {_SIDE.format(i=2)}) <= 9.5 / 111.0::DOUBLE),
    k AS (SELECT e.u, e.v, e.key, a.tile_id, {_NOISE} AS q, least(1.0::DOUBLE, coalesce(d / 250, 1.0::DOUBLE)) AS wc FROM edges e JOIN nt a ON a.node_id = e.u JOIN nt b ON b.node_id = e.v AND b.tile_id = a.tile_id
    LEFT JOIN w ON w.u = e.u AND w.v = e.v AND w.key = e.key WHERE {_WALK} AND e.u NOT IN {_GATES} AND e.v NOT IN {_GATES}),
    n AS (SELECT u, v, key, tile_id, {_norm('wc')} AS nw, {_norm('q', True)} AS nq FROM k)
    SELECT u, v, key, round(arg_max(nw, tile_id), 6) AS norm_water, round(arg_max(nq, tile_id), 6) AS norm_quiet, count(*) AS n_tiles FROM n GROUP BY 1, 2, 3"""
)
def tile_builds_merged(net) -> DataFrame:
    """The edges of all requests' tiles: built for every other request first, then only what the others still need."""
    modes = build.Modes(green="OFF", lights=False, social=False, elevation=False)
    store = TileStore(net.spark, scratch(net.spark, "tiles"), "west", modes)
    layers = build.Layers(water=build.layers_of(net).water)
    for_requests(store, net.requests.where("request_id % 2 = 0"), net.nodes, net.edges, layers)
    merged = for_requests(store, net.requests, net.nodes, net.edges, layers)
    tiles = store.edges(store.manifest()).groupBy("u", "v", "key").agg(F.count(F.lit(1)).alias("n_tiles"))
    return merged.join(tiles, ["u", "v", "key"]).select("u", "v", "key", F.round("norm_water", 6).alias("norm_water"), F.round("norm_quiet", 6).alias("norm_quiet"), "n_tiles")
