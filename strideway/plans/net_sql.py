"""The derived network in SQL, for comparison: common table expressions that queries pick from."""

from __future__ import annotations

import re

from strideway.functions import geo
from strideway.sources import network as net


def _pick(values: list[str | None], index: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}]::VARCHAR[])[({index}) + 1]"


def lat(node: str) -> str:
    return f"(floor({node} / 100.0) * 0.0005::DOUBLE + 51.40::DOUBLE)"


def lon(node: str) -> str:
    return f"(({node} % 100) * 0.0008::DOUBLE + (-2.65)::DOUBLE)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({c}) - radians({a})) / 2), 2) + "
        f"cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
    )


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


def seg(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Distance of a point from a segment."""
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    sq = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {sq} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {sq})) ELSE 0.0::DOUBLE END)"
    return f"sqrt(pow({px} - {ax} - {t} * {dx}, 2) + pow({py} - {ay} - {t} * {dy}, 2))"


def _utm_steps(first: str, columns: str, names: tuple[str, str, str]) -> dict[str, str]:
    """Three steps from the columns lat and lon of ``first`` to x and y."""
    e, radius, centre, (a1, a2, a3) = geo.krueger_terms()
    k = geo.SCALE * radius
    east = " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate((a1, a2, a3), 1))
    north = " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate((a1, a2, a3), 1))
    return {
        names[0]: f"SELECT *, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon + 3.0::DOUBLE) AS dl FROM {first}",
        names[1]: f"SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(t * t + 1)) AS eta FROM {names[0]}",
        names[2]: f"SELECT {columns}, (eta + {east}) * {k!r}::DOUBLE + {centre!r}::DOUBLE AS x, (xi + {north}) * {k!r}::DOUBLE AS y FROM {names[1]}",
    }


def _utm() -> dict[str, str]:
    flags = "CASE WHEN node_id % 97 = 0 THEN 'gate' END AS barrier, CASE WHEN node_id % 194 = 0 THEN 'yes' END AS locked, CASE WHEN node_id % 291 = 0 THEN 'private' END AS access"
    return {
        "n0": f"SELECT o_orderkey AS node_id, {lat('o_orderkey')} AS lat, {lon('o_orderkey')} AS lon, o_totalprice % 100 AS elevation FROM orders",
        **_utm_steps("n0", f"node_id, lat, lon, elevation, {flags}", ("n1", "n2", "nodes")),
    }


def _vertex(of: str, side: str) -> str:
    f = {"lat": lat, "lon": lon}[of]
    return f"{f('lo')} + ({f('hi')} - {f('lo')}) * k / m + {side}"


_OFF = "CASE WHEN m = 3 AND k = 1 THEN off WHEN m = 3 AND k = 2 THEN -off ELSE 0.0::DOUBLE END"


CTES: dict[str, str] = _utm() | {
    "g": "SELECT l_orderkey AS u, l_linenumber AS key, min(l_partkey) AS way, min(l_suppkey) AS supp, min(l_discount) AS slack, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2",
    "g2": "SELECT *, CASE WHEN key % 2 = 1 AND u % 100 < 99 THEN u + 1 ELSE u + 100 END AS v FROM g",
    "base": (
        f"SELECT u, v, key, {hav(lat('u'), lon('u'), lat('v'), lon('v'))} * (slack + 1) AS length, way, {_pick(net.HIGHWAYS, 'way % 16')} AS highway, CASE flag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' END AS lit, "
        f"{_pick(net.SURFACES, 'way % 5')} AS surface, {_pick(net.FOOT, '(way + key) % 6')} AS foot, CASE WHEN supp % 11 = 0 THEN 'private' END AS access, 'W' || (way % 40) AS name, "
        f"{_pick(['driveway', 'alley', None], 'way % 3')} AS service, CASE WHEN way % 13 = 0 THEN 'public_footpath' END AS designation, CASE WHEN way % 101 = 0 THEN 'yes' END AS area, "
        f"{_pick(net.BICYCLE, '(way + 2 * key) % 4')} AS bicycle, {_pick(net.SIDEWALK, 'way % 7')} AS sidewalk, {_pick(net.REGIMES, 'way % 9')} AS lighting_regime "
        "FROM g2 WHERE v IN (SELECT o_orderkey FROM orders)"
    ),
    "edges": "SELECT * FROM base UNION ALL SELECT v AS u, u AS v, * EXCLUDE (u, v) FROM base",
    "geo_edges": (
        "SELECT e.*, a.lat AS u_lat, a.lon AS u_lon, a.x AS ux, a.y AS uy, b.lat AS v_lat, b.lon AS v_lon, b.x AS vx, b.y AS vy, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my "
        "FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v"
    ),
    "verts0": (
        f"SELECT u, v, key, CASE WHEN u < v THEN k ELSE m - k END AS k, {_vertex('lat', _OFF)} AS lat, {_vertex('lon', _OFF)} AS lon "
        f"FROM (SELECT u, v, key, CASE WHEN way % 3 = 0 THEN 3 ELSE 1 END AS m, (way % 7 - 3) * {net.BEND!r}::DOUBLE AS off, least(u, v) AS lo, greatest(u, v) AS hi FROM edges), range(0, 4) r(k) WHERE k <= m"
    ),
    **_utm_steps("verts0", "u, v, key, k, lat, lon", ("verts1", "verts2", "verts")),
    "segs": (
        "SELECT a.u, a.v, a.key, a.k AS side, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\", a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon "
        "FROM verts a JOIN verts b ON a.u = b.u AND a.v = b.v AND a.key = b.key AND b.k = a.k + 1"
    ),
    "lens": (
        "SELECT *, sum(len) OVER (PARTITION BY u, v, key ORDER BY side) - len AS s0, sum(len) OVER (PARTITION BY u, v, key) AS metres, max(side) OVER (PARTITION BY u, v, key) AS last "
        "FROM (SELECT *, sqrt(pow(bx - ax, 2) + pow(\"by\" - ay, 2)) AS len FROM segs)"
    ),
    "sampling": (
        "SELECT *, unnest(range(CASE WHEN side = 0 THEN 0 ELSE floor(s0 / step)::BIGINT + 1 END, CASE WHEN side = last THEN n ELSE least(floor((s0 + len) / step)::BIGINT, n - 1) + 1 END)) AS i_ "
        "FROM (SELECT *, metres / (n - 1) AS step FROM (SELECT *, greatest(2, floor(metres / 20) + 1)::BIGINT AS n FROM lens))"
    ),
    "samples": "SELECT u, v, key, i_, n, ax + (bx - ax) * (i_ * step - s0) / len AS mx, ay + (\"by\" - ay) * (i_ * step - s0) / len AS my FROM sampling",
    "size": "SELECT count(*) AS n FROM orders",
    "shapes": (
        "SELECT p_partkey AS geom_id, CASE WHEN p_type LIKE 'ECONOMY%' OR p_type LIKE 'STANDARD%' THEN 'green' WHEN p_type LIKE 'LARGE%' THEN 'water' WHEN p_type LIKE 'PROMO%' THEN 'water_line' "
        "WHEN p_type LIKE 'MEDIUM%' OR p_type LIKE 'SMALL%' THEN 'building' END AS kind, p_size * 3 + 5 AS radius, n.x AS nx, n.y AS ny, n.lat AS nlat, n.lon AS nlon, "
        "CASE WHEN p_type LIKE 'PROMO%' THEN 2 ELSE p_partkey % 5 + 4 END AS corners FROM part, size JOIN nodes n ON n.node_id = p_partkey * 7 % size.n"
    ),
    "rings": (
        "SELECT *, 0 AS ring, radius AS r, nx AS cx FROM shapes UNION ALL "
        f"SELECT *, 1, radius * {net.HOLE[0]}::DOUBLE, nx FROM shapes WHERE geom_id % 3 = 0 AND kind <> 'water_line' UNION ALL "
        f"SELECT *, 2, radius * {net.PART[0]}::DOUBLE, nx + radius * {net.PART[1]}::DOUBLE FROM shapes WHERE geom_id % 5 = 0 AND kind <> 'water_line'"
    ),
    "sides0": (
        "SELECT geom_id, kind, ring, k, cx + r * cos(k * (2 * pi()) / corners) AS px, ny + r * sin(k * (2 * pi()) / corners) AS py, "
        "cx + r * cos(((k + 1) % corners) * (2 * pi()) / corners) AS qx, ny + r * sin(((k + 1) % corners) * (2 * pi()) / corners) AS qy, nx, ny, radius "
        "FROM rings, range(0, 8) r(k) WHERE k < corners AND NOT (kind = 'water_line' AND k = 1)"
    ),
    "sides": (  # holes go the other way
        "SELECT geom_id, kind, k, CASE WHEN ring = 1 THEN qx ELSE px END AS ax, CASE WHEN ring = 1 THEN qy ELSE py END AS ay, CASE WHEN ring = 1 THEN px ELSE qx END AS bx, CASE WHEN ring = 1 THEN py ELSE qy END AS \"by\", nx, ny, radius FROM sides0"
    ),
    "pois": "SELECT c_custkey AS poi_id, n.x + (c_nationkey - 12) * 2 AS x, n.y AS y, lower(c_mktsegment) AS amenity FROM customer, size JOIN nodes n ON n.node_id = c_custkey * 11 % size.n",
    "lights": (
        "SELECT event_id AS light_id, n.lat AS lat, n.lon AS lon, n.x AS x, n.y + value % 30 AS y, event_type AS source, CASE event_type WHEN 'view' THEN 'part_night' WHEN 'click' THEN 'all_night' END AS regime, "
        "CASE WHEN event_type <> 'purchase' THEN event_type || '_point' END AS type, CASE event_type WHEN 'view' THEN 'Sunset - 0000' WHEN 'click' THEN '24 hours' WHEN 'signup' THEN 'solar unit' WHEN 'purchase' THEN '0500-2300' END AS words "
        "FROM events, size JOIN nodes n ON n.node_id = event_id * 13 % size.n"
    ),
    "req0": "SELECT s_suppkey AS request_id, s_suppkey * 149 % n AS s, s_nationkey AS k, n FROM supplier, size",
    "requests": (
        "SELECT *, " + ", ".join(f"{f('s')} AS start_{c}, {f('e')} AS end_{c}" for c, f in (("lat", lat), ("lon", lon))) + ", CASE WHEN request_id % 3 = 0 THEN NULL ELSE (k % 6)::DOUBLE END AS distance, "
        "(k % 5)::DOUBLE AS greenness, (k % 4)::DOUBLE AS water, (k % 3)::DOUBLE AS social, (k % 2)::DOUBLE AS quietness, (k % 7 - 3)::DOUBLE AS slope, "
        f"to_timestamp(1704067200 + request_id * 3600) AT TIME ZONE 'UTC' AS asked_at, {_pick(['walking', 'running_easy', 'running_race', 'flying'], 'request_id % 4')} AS profile, {_pick(['km', 'mi'], 'request_id % 2')} AS unit, "
        f"{_pick([None, 'night', 'Daylight', 'dim'], 'request_id % 4')} AS override, request_id % 2 = 0 AS is_loop, ((request_id % 35) * 1000)::DOUBLE AS target_m "
        "FROM (SELECT *, least(s + least(request_id % 13, 99 - s % 100) + (12 - request_id % 13) * 100, n - 1) AS e FROM req0)"
    ),
    "walk0": (
        "SELECT request_id * 3 + v AS route_id, request_id, v AS variant, list_transform(range(0, 13), lambda i: (s + coalesce(list_sum(list_transform(range(0, i), lambda j: CASE WHEN (j + v) % (v + 2) = 0 THEN 100 ELSE 1 END)), 0))::BIGINT) AS p, n "
        "FROM req0, range(0, 3) r(v)"
    ),
    "walks": "SELECT route_id, request_id, variant, list_filter(CASE WHEN request_id % 4 = 1 THEN list_concat(p, list_reverse(p)[2:6]) ELSE p END, lambda x: x < n) AS route FROM walk0",
    "steps": "SELECT route_id, i - 1 AS pos, route[i] AS u, route[i + 1] AS v FROM walks, range(1, 20) r(i) WHERE i < len(route)",
    "places": "SELECT route_id, i - 1 AS pos, n.* FROM walks, range(1, 20) r(i) JOIN nodes n ON n.node_id = route[i] WHERE i <= len(route)",
    "best": "SELECT u, v, arg_min(struct_pack(length := length, key := key, highway := highway, name := name, way := way), (length, key)) AS b FROM edges GROUP BY u, v",
    "walked": "SELECT route_id, pos, s.u, s.v, b.length AS length, b.highway AS highway, b.name AS name, b.way AS way FROM steps s LEFT JOIN best USING (u, v)",
    "scored": (
        "SELECT *, (way % 101) / 100.0::DOUBLE AS norm_green, (way % 51) / 50.0::DOUBLE AS norm_water, (key % 5) / 4.0::DOUBLE AS norm_social, CASE WHEN way % 9 = 0 THEN NULL ELSE (way % 3) / 2.0::DOUBLE END AS norm_quiet, "
        "((u + v) % 11) / 10.0::DOUBLE AS norm_slope, ((u * 7 + v) % 21) / 100.0::DOUBLE AS uphill_gradient, ((u + v * 7) % 16) / 100.0::DOUBLE AS downhill_gradient FROM edges"
    ),
    "range_l": "SELECT min(length) FILTER (length > 0) AS low, max(length) FILTER (length > 0) AS high FROM edges",
}
_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def with_ctes(sql: str) -> str:
    """``sql`` behind the expressions that it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(_WORD.findall(text.lower())):
            if word in CTES and word not in needed and re.search(rf"\b(?:from|join|,)\s+{word}\b", text, re.I):
                needed.add(word)
                visit(CTES[word])

    visit(sql)
    body = ", ".join(f"{k} AS ({v})" for k, v in CTES.items() if k in needed)
    own = " ".join(sql.split())
    if not body:
        return own
    for head in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(head):
            return f"{head}{body}, {own[len(head):]}"
    return f"WITH {body} {own}"
