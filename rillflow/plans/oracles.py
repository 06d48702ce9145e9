"""SQL of the terrain queries that recur over the grid.

What spreads without an order (fill, flats) is a recursion that keeps the best value of
each cell; what follows flow is evaluated level by level, a cell's level being the length of
the longest path to it.  The parts that define cells, directions and links come from the registry.
"""

from __future__ import annotations

import math

import numpy as np

# The neighbours (with their direction) that a diagonal would cross; facets as side, corner, base and sign of the angle; pi.
_CROSSED = {2: ((1, 4), (3, 8)), 4: ((3, 6), (5, 2)), 6: ((7, 4), (5, 8)), 8: ((1, 6), (7, 2))}
_FACETS = ((1, 2, 0, 1), (3, 2, 1, -1), (3, 4, 1, 1), (5, 4, 2, -1), (5, 6, 2, 1), (7, 6, 3, -1), (7, 8, 3, 1), (1, 8, 4, -1))
_PI = "3.14159265359::DOUBLE"
_QUARTER = "atan2(1.0::DOUBLE, 1.0::DOUBLE)"


def _adjacent(name: str, of: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, s.k, s.len FROM {of} a, steps s, {of} b WHERE b.row = a.row + s.dr AND b.col = a.col + s.dc)"


def fill(height: str, four_way: bool = False, kept: str = "false") -> str:
    """adj and fill (id, w): least, over paths to the edge or a kept cell, of the path's highest cell."""
    ways = "AND k % 2 = 1" if four_way else ""
    return f"""{_adjacent("adj", "cells")},
    fill(id, w) USING KEY (id) AS (
        SELECT id, {height} FROM cells, (SELECT max(row) AS r, max(col) AS c FROM cells) WHERE row = 0 OR col = 0 OR row = r OR col = c OR {kept}
        UNION SELECT n.id, min(greatest(n.{height}, f.w)) FROM fill f JOIN adj ON adj.src = f.id {ways} JOIN cells n ON n.id = adj.dst LEFT JOIN recurring.fill o ON o.id = n.id
              WHERE o.id IS NULL OR greatest(n.{height}, f.w) < o.w GROUP BY n.id)"""


def d8_of(table: str) -> str:
    """g0 (id, row, col, z, p, slope): first directions over table (id, row, col, z)."""
    return f"""{_adjacent("near0", table)},
    best0 AS (SELECT a.id, count(*) AS n, max((a.z - b.z) / len) AS top, (list(k ORDER BY (a.z - b.z) / len DESC, CASE WHEN k % 2 = 1 THEN k ELSE k + 8 END))[1] AS k FROM near0 JOIN {table} a ON a.id = src JOIN {table} b ON b.id = dst GROUP BY a.id),
    g0 AS MATERIALIZED (SELECT c.id, c.row, c.col, c.z, CASE WHEN n = 8 THEN CASE WHEN top > 0 THEN k ELSE 0 END END AS p, CASE WHEN n = 8 THEN greatest(top, 0) END AS slope FROM {table} c JOIN best0 USING (id))"""


def _steps_of_flats(i: int, flat: str, drains: str, crossing: bool) -> str:
    """Artificial heights e{i} (id, z, p, e, a, b) of the cells of g{i}."""
    free = "true"
    if crossing:
        cases = " ".join(f"WHEN {k} THEN " + " AND ".join(f"coalesce((SELECT q.p FROM near0 x JOIN g{i} q ON q.id = x.dst WHERE x.src = n.src AND x.k = {at}) <> {to}, true)" for at, to in pairs) for k, pairs in _CROSSED.items())
        free = f"CASE n.k {cases} ELSE true END"
    own = lambda c: flat.format(f"{c}.p")
    return f"""pairs{i} AS MATERIALIZED (SELECT n.src, n.dst, c.z, d.z AS nz, coalesce({own("d")}, false) AS beside, coalesce({drains.format("d.p")}, false) AS drains, {free} AS free
        FROM near0 n JOIN g{i} c ON c.id = n.src JOIN g{i} d ON d.id = n.dst WHERE {own("c")}),
    low{i}(id, v) USING KEY (id) AS (
        SELECT src, min(CASE WHEN drains THEN 0 ELSE 1 END) FROM pairs{i} WHERE free AND (z >= nz AND drains OR z = nz AND NOT beside AND NOT drains) GROUP BY src
        UNION SELECT w.src, min(l.v) + 1 FROM low{i} l JOIN pairs{i} w ON w.dst = l.id AND w.free AND w.z = w.nz AND w.beside LEFT JOIN recurring.low{i} o ON o.id = w.src WHERE o.id IS NULL OR l.v + 1 < o.v GROUP BY w.src),
    high{i}(id, v) USING KEY (id) AS (
        SELECT DISTINCT src, 1 FROM pairs{i} WHERE nz > z
        UNION SELECT w.src, min(h.v) + 1 FROM high{i} h JOIN pairs{i} w ON w.dst = h.id AND w.beside LEFT JOIN recurring.high{i} o ON o.id = w.src WHERE o.id IS NULL OR h.v + 1 < o.v GROUP BY w.src),
    most{i} AS (SELECT coalesce((SELECT max(v) FROM low{i}), 0) + 2 AS pit, coalesce((SELECT max(v) FROM high{i}), 0) + 1 AS sweeps),
    e{i} AS MATERIALIZED (SELECT g.*, l.v AS a, h.v AS b, CAST(CASE WHEN {own("g")} THEN 1 + coalesce(l.v, pit) + CASE WHEN h.v IS NULL THEN 0 ELSE sweeps - h.v + 1 END ELSE 1 END AS DOUBLE) AS e
        FROM g{i} g CROSS JOIN most{i} LEFT JOIN low{i} l ON l.id = g.id LEFT JOIN high{i} h ON h.id = g.id)"""


def d8_flat_round(i: int) -> str:
    """g{i + 1}: g{i} with the directions that one round gives to flat cells, and the artificial heights as z while any are left."""
    order = "CASE WHEN k % 2 = 1 THEN k ELSE k + 8 END"
    return f"""{_steps_of_flats(i, "{} = 0", "{} > 0", True)},
    ways{i} AS (SELECT c.id, n.k, {order} AS pri, c.a, c.z - d.z AS fall, (c.e - d.e) / n.len AS tilt, coalesce(d.p = 0 AND d.b IS NOT NULL, false) AS rim FROM e{i} c JOIN near0 n ON n.src = c.id JOIN e{i} d ON d.id = n.dst WHERE c.p = 0),
    given{i} AS (SELECT id, coalesce(arg_min(k, pri) FILTER (NOT rim AND fall >= 0), (list(k ORDER BY tilt DESC, pri) FILTER (rim AND tilt > 0))[1], CASE WHEN any_value(a) IS NOT NULL THEN 0 END) AS q FROM ways{i} GROUP BY id),
    left{i} AS (SELECT count(*) AS n FROM given{i} WHERE q = 0),
    g{i + 1} AS MATERIALIZED (SELECT e.id, e.row, e.col, CASE WHEN n > 0 THEN e.e ELSE e.z END AS z, CASE WHEN e.p = 0 THEN q ELSE e.p END AS p, slope FROM e{i} e CROSS JOIN left{i} LEFT JOIN given{i} USING (id))"""


def dinf_flat_round(i: int) -> str:
    """g{i + 1}: as d8_flat_round, for angles; the facets are tried one after the other."""
    parts = [_steps_of_flats(i, "{} = -1", "{} >= 0", False)]
    wide = ", ".join(f"max(d.z) FILTER (n.k = {k}) AS z{k}, max(d.e) FILTER (n.k = {k}) AS e{k}, bool_or(coalesce(d.p = -1 AND d.b IS NOT NULL, false)) FILTER (n.k = {k}) AS i{k}" for k in range(1, 9))
    parts.append(f"f{i}_0 AS (SELECT c.id, c.z, c.e, c.a, {wide}, 0.0::DOUBLE AS steep, false AS ended, false AS diagonal, NULL::DOUBLE AS chosen FROM e{i} c JOIN near0 n ON n.src = c.id JOIN e{i} d ON d.id = n.dst WHERE c.p = -1 GROUP BY c.id, c.z, c.e, c.a)")

    def facet(z0: str, z1: str, z2: str) -> tuple[str, str]:
        angle = f"CASE WHEN {z0} = {z1} AND {z1} = {z2} THEN 0 ELSE atan2({z1} - {z2}, {z0} - {z1}) END"
        slope = f"CASE WHEN {angle} < 0 THEN {z0} - {z1} WHEN {angle} > {_QUARTER} THEN ({z0} - {z2}) / sqrt(2.0::DOUBLE) ELSE sqrt(({z0} - {z1}) * ({z0} - {z1}) + ({z1} - {z2}) * ({z1} - {z2})) END"
        return slope, f"CASE WHEN {angle} < 0 THEN 0 WHEN {angle} > {_QUARTER} THEN {_QUARTER} ELSE {angle} END"

    for j, (k1, k2, base, sign) in enumerate(_FACETS):
        turned = lambda a: f"({base} * {_PI} / 2 + {sign} * ({a}))"
        s, a = facet("z", f"z{k1}", f"z{k2}")
        s2, a2 = facet("e", "h1", "h2")
        parts.append(f"""f{i}_{j + 1} AS (SELECT * EXCLUDE (h1, h2, out, edge, corner, climb, s2, a2, steep, ended, diagonal, chosen),
            CASE WHEN climb THEN s2 ELSE steep END AS steep, ended OR (out AND NOT z{k1} > z) OR edge AS ended, diagonal OR (out AND z{k1} > z AND NOT diagonal) OR (corner AND NOT diagonal) AS diagonal,
            CASE WHEN climb THEN {turned("a2")} WHEN corner AND NOT diagonal THEN {turned(_QUARTER)} WHEN edge THEN {turned("0")} WHEN out AND (NOT z{k1} > z OR NOT diagonal) THEN {turned(a)} ELSE chosen END AS chosen
            FROM (SELECT *, NOT ended AND (i{k1} OR i{k2}) AND NOT edge AND NOT corner AND s2 > steep AS climb
                  FROM (SELECT *, {s2} AS s2, {a2} AS a2, NOT ended AND NOT i{k1} AND NOT i{k2} AND {s} >= 0 AS out, NOT ended AND NOT i{k1} AND i{k2} AND z >= z{k1} AS edge, NOT ended AND i{k1} AND NOT i{k2} AND z >= z{k2} AS corner
                        FROM (SELECT *, CASE WHEN i{k1} THEN e{k1} ELSE greatest(e, e{k2}) END AS h1, CASE WHEN i{k2} THEN e{k2} ELSE greatest(e, e{k1}) END AS h2 FROM f{i}_{j}))))""")
    parts.append(f"""given{i} AS MATERIALIZED (SELECT id, CASE WHEN chosen >= 0 THEN chosen WHEN a IS NOT NULL THEN -1 END AS q FROM f{i}_8),
    left{i} AS (SELECT count(*) AS n FROM given{i} WHERE q = -1),
    g{i + 1} AS MATERIALIZED (SELECT e.id, e.row, e.col, CASE WHEN n > 0 THEN e.e ELSE e.z END AS z, CASE WHEN e.p = -1 THEN q ELSE e.p END AS p, slope FROM e{i} e CROSS JOIN left{i} LEFT JOIN given{i} USING (id))""")
    return ",\n".join(parts)


def levels(edges: str, nodes: str) -> str:
    """lev (id, lev): length of the longest path of edges (src, dst) to each of nodes (id)."""
    return f"""climb(t, id) AS (SELECT 0, id FROM {nodes} UNION SELECT c.t + 1, e.dst FROM climb c JOIN {edges} e ON e.src = c.id),
    lev AS MATERIALIZED (SELECT id, max(t) AS lev FROM climb GROUP BY id)"""


def by_level(name: str, columns: dict[str, tuple[str, str]], edges: str, cells: str) -> str:
    """name (id, t, columns): each column's value on cells without sources (c), and from those of the sources (a, over edges e)."""
    first = ", ".join(f"CAST({x} AS DOUBLE)" for x, _ in columns.values())
    later = ", ".join(f"CAST({y} AS DOUBLE)" for _, y in columns.values())
    return f"""{name}(id, t, {", ".join(columns)}) USING KEY (id) AS (
        SELECT c.id, 0, {first} FROM lev JOIN {cells} c USING (id) WHERE lev = 0
        UNION SELECT x.id, any_value(x.lev), {later} FROM (SELECT max(t) AS t FROM {name}) m JOIN lev x ON x.lev = m.t + 1 JOIN {edges} e ON e.dst = x.id JOIN recurring.{name} a ON a.id = e.src JOIN {cells} c ON c.id = x.id GROUP BY x.id)"""


def _distances(down: bool) -> str:
    """All twelve distances: parts (links2 with h, v and s of a step) and the rows."""
    first, columns = ("CASE WHEN c.mark >= 1 THEN 0 END" if down else "0"), {}
    for part in "hvs":
        value = f"a.{{0}}_{part} + e.{part}"
        for stat in ("ave", "max", "min"):
            v = value.format(stat)
            found = f"sum(e.share * ({v})) / sum(e.share)" if stat == "ave" else f"{stat}({v})"
            if down:
                found = f"CASE WHEN any_value(c.mark) >= 1 THEN 0 WHEN bool_or(a.{stat}_{part} IS NULL) THEN NULL ELSE {found} END"
            columns[f"{stat}_{part}"] = (first, found)
    src, dst = ("dst", "src") if down else ("src", "dst")  # values move up or down the links
    hops = f"""hops AS MATERIALIZED (SELECT x.{src} AS src, x.{dst} AS dst, x.share, s.len AS h, abs(p.z - q.z) AS v, sqrt(s.len * s.len + (p.z - q.z) * (p.z - q.z)) AS s
        FROM (SELECT g.src, b.id AS dst, g.share, g.k FROM given g JOIN cells b ON b.row = g.r AND b.col = g.c WHERE g.share >= 1e-5) x JOIN steps s USING (k) JOIN cells p ON p.id = x.src JOIN cells q ON q.id = x.dst
        {"" if down else "JOIN dinf t ON t.id = x.dst WHERE t.ang IS NOT NULL"})"""
    nodes = "cells" if down else "(SELECT id FROM dinf WHERE ang IS NOT NULL)"
    state = "(SELECT id, ang, CASE WHEN ang IS NOT NULL THEN mark END AS mark FROM dinf)" if down else "dinf"
    rows = " UNION ALL ".join(
        f"SELECT d.row, d.col, '{kind}' AS kind, '{stat}' AS stat, CASE WHEN d.ang IS NOT NULL THEN round({'sqrt(%s_h * %s_h + %s_v * %s_v)' % ((stat,) * 4) if kind == 'p' else f'{stat}_{kind}'}, 6) END AS value FROM dinf d LEFT JOIN dist USING (id)"
        for kind in "hvps" for stat in ("ave", "max", "min")
    )
    return f", {hops}, {levels('hops', nodes)}, {by_level('dist', columns, 'hops', state)} {rows}"


def _stability(slope: str, area: str) -> str:
    """si and sat by the same quadrature: w between the points where the integrand's pieces change, 24 Gauss points each."""
    x, weight = np.polynomial.legendre.leggauss(24)
    gauss = ", ".join(f"({float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for a, b in zip(x, weight))
    rad = lambda d: f"tan(radians({d}::DOUBLE))"
    # the table's defaults: tmin = tmax = 2.708, c 0 to 0.25, phi 30 to 45, density 2000
    below = lambda k: (
        f"(CASE WHEN {k} * t2 - {k} * t1 < 1e-12 AND {k} * t1 - {k} * t2 < 1e-12 THEN least(greatest((need - least({k} * t1, {k} * t2)) / 0.25, 0), 1) "
        f"ELSE least(greatest((half(need - least({k} * t1, {k} * t2)) - half(need - greatest({k} * t1, {k} * t2))) / abs({k} * t2 - {k} * t1), 0), 1) END)"
    )

    def spelled(text: str) -> str:
        """half(x): the integral of P(C < x)."""
        out, at = "", 0
        while (i := text.find("half(", at)) >= 0:
            depth, j = 1, i + 5
            while depth:
                depth += {"(": 1, ")": -1}.get(text[j], 0)
                j += 1
            arg = text[i + 5 : j - 1]
            out += text[at:i] + f"(0.5 * pow(least(greatest({arg}, 0), 0.25), 2) / 0.25 + greatest({arg} - 0.25, 0))"
            at = j
        return out + text[at:]

    whole = spelled(below("(co * (1 - r))"))
    inner = spelled(below("(co * (1 - w * r))"))
    safety = lambda w, c, t: f"(({c} + co * (1 - least({w}, 1.0) * r) * {t}) / need)"
    breaks = " UNION ALL ".join(f"SELECT id, (1 - (need - {c}) / (co * {t})) / r FROM cell" for c in ("0.0", "0.25") for t in ("t1", "t2"))
    return f"""gauss(x, g) AS (VALUES {gauss}),
    cell AS MATERIALIZED (SELECT id, s, a, sin(atan(s)) AS need, cos(atan(s)) AS co, 0.5::DOUBLE AS r, {rad(30)} AS t1, {rad(45)} AS t2, a * 0.0009::DOUBLE / 2.708 / sin(atan(s)) AS w1, a * 0.00135::DOUBLE / 2.708 / sin(atan(s)) AS w2
        FROM (SELECT id, CAST({slope} AS DOUBLE) AS s, CAST({area} AS DOUBLE) AS a FROM input) WHERE s > 0 AND a >= 0),
    cases AS MATERIALIZED (SELECT *, {safety("w1", "0.25", "t2")} AS top, {safety("w2", "0.0", "t1")} AS worst, {whole} AS flooded FROM cell),
    breaks AS (SELECT id, w1 AS m FROM cell UNION ALL SELECT id, least(w2, 1.0) FROM cell UNION ALL {breaks}),
    pieces AS (SELECT id, m AS lo, lead(m) OVER (PARTITION BY id ORDER BY m) AS hi FROM (SELECT DISTINCT id, m FROM breaks JOIN cell USING (id) WHERE m >= w1 AND m <= least(w2, 1.0))),
    nodes AS (SELECT id, need, co, r, t1, t2, (hi - lo) / 2 * x + (lo + hi) / 2 AS w, g * (hi - lo) / 2 AS g FROM pieces JOIN cell USING (id), gauss WHERE hi IS NOT NULL AND w1 < 1),
    summed AS (SELECT id, sum({inner} * g) AS v FROM nodes GROUP BY id),
    judged AS (SELECT c.id, CASE WHEN w1 > 1 THEN 3.0 WHEN w2 > 1 THEN 2.0 ELSE w2 END AS sat,
        CASE WHEN top < 1 THEN 0 WHEN worst >= 1 THEN least(worst, 10.0) WHEN w1 >= 1 THEN 1 - flooded
             WHEN w2 - w1 < 1e-12 THEN 1 - {spelled(below("(co * (1 - w1 * r))"))} ELSE 1 - (coalesce(v, 0) + greatest(w2 - 1.0, 0) * flooded) / (w2 - w1) END AS si FROM cases c LEFT JOIN summed USING (id))
    SELECT row, col, round(CASE WHEN s = 0 AND a IS NOT NULL THEN 10.0 ELSE si END, 6) AS si, round(CASE WHEN s = 0 AND a IS NOT NULL THEN 3.0 ELSE sat END, 6) AS sat
    FROM (SELECT row, col, id, CAST({slope} AS DOUBLE) AS s, CAST({area} AS DOUBLE) AS a FROM input) LEFT JOIN judged USING (id)"""


def _drops(thresholds: list[float], order: str = "ends") -> str:
    """drops: one row for each of thresholds (limits), from reach (id, pos), area (id, n) and the outlets in the last row but one."""
    values = ", ".join(f"({float(x)!r}::DOUBLE)" for x in thresholds)
    return f"""limits(x) AS (VALUES {values}),
    last AS (SELECT max(row) - 1 AS r FROM cells),
    outs AS (SELECT id FROM d8, last WHERE row = r AND p IS NOT NULL),
    used AS MATERIALIZED (SELECT DISTINCT r.id FROM reach r JOIN outs o ON o.id = r.pos),
    total AS (SELECT sum(a.n)::DOUBLE AS area FROM outs o JOIN area a USING (id) LEFT JOIN (SELECT e.src, s.n FROM steps_to e JOIN {order} s ON s.id = e.dst) d ON d.src = o.id WHERE d.n IS NULL OR d.n < (SELECT min(x) FROM limits)),
    on_stream AS MATERIALIZED (SELECT x, s.id, s.n FROM limits JOIN {order} s ON s.n >= x JOIN used USING (id)),
    flow_on AS MATERIALIZED (SELECT a.x, e.src, e.dst, e.len, e.k FROM on_stream a JOIN edges e ON e.src = a.id JOIN on_stream b ON b.id = e.dst AND b.x = a.x),
    rise(x, t, id) AS (SELECT x, 0, id FROM on_stream UNION SELECT r.x, r.t + 1, f.dst FROM rise r JOIN flow_on f ON f.x = r.x AND f.src = r.id),
    high AS MATERIALIZED (SELECT x, id, max(t) AS lev FROM rise GROUP BY x, id),
    net(x, id, t, o, head) USING KEY (x, id) AS (
        SELECT h.x, h.id, 0, 1, c.z FROM high h JOIN cells c USING (id) WHERE lev = 0
        UNION SELECT x, id, any_value(lev), max(o), coalesce((list(head ORDER BY pri) FILTER (o_up = o))[1], any_value(z)) FROM (
            SELECT h.x, h.id, h.lev, c.z, a.o AS o_up, a.head, (f.k + 3) % 8 + 1 AS pri,
                   greatest(max(a.o) OVER w, coalesce(nth_value(a.o, 2) OVER (PARTITION BY h.x, h.id ORDER BY a.o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) + 1) AS o
            FROM (SELECT max(t) AS t FROM net) m JOIN high h ON h.lev = m.t + 1 JOIN flow_on f ON f.x = h.x AND f.dst = h.id JOIN recurring.net a ON a.x = f.x AND a.id = f.src JOIN cells c ON c.id = h.id WINDOW w AS (PARTITION BY h.x, h.id)) GROUP BY x, id),
    fallen AS (SELECT f.x, a.o, a.head - c.z AS d FROM flow_on f JOIN net a ON a.x = f.x AND a.id = f.src JOIN net b ON b.x = f.x AND b.id = f.dst JOIN cells c ON c.id = f.dst WHERE a.o < b.o),
    sums AS (SELECT x, count(*) FILTER (o = 1) AS n1, sum(d) FILTER (o = 1) AS d1, sum(d * d) FILTER (o = 1) AS q1, count(*) FILTER (o > 1) AS n2, sum(d) FILTER (o > 1) AS d2, sum(d * d) FILTER (o > 1) AS q2 FROM fallen GROUP BY x),
    lengths AS (SELECT x, sum(len) AS len FROM flow_on GROUP BY x),
    spread AS (SELECT *, greatest(q1 - d1 * d1 / n1, 0) AS s1, greatest(q2 - d2 * d2 / n2, 0) AS s2 FROM sums JOIN lengths USING (x) CROSS JOIN total WHERE n1 > 1 AND n2 > 1),
    drops AS MATERIALIZED (SELECT x AS threshold, len / area AS drain_density, n1 AS n_first, n2 AS n_high, d1 / n1 AS mean_first, d2 / n2 AS mean_high, sqrt(s1 / (n1 - 1)) AS sd_first, sqrt(s2 / (n2 - 1)) AS sd_high,
        CASE WHEN s1 + s2 > 0 THEN (d1 / n1 - d2 / n2) / (sqrt((s1 + s2) / (n1 + n2 - 2)) * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) END AS t FROM spread)"""


def network(limit: int) -> str:
    """net (the rows of the stream network), member (cell, link) and onc (stream cells) from reach (id, pos), d8 and edges, where at least limit cells drain through."""
    order = {"o": ("1", "greatest(max(a.o), coalesce((list(a.o ORDER BY a.o DESC))[2], 0) + 1)")}
    merge = "list_reduce(list_transform(u[1:s.k + 1], lambda q: q.o), lambda x, y: greatest(greatest(x, y), least(x, y) + 1))"
    return f"""area AS MATERIALIZED (SELECT pos AS id, count(*) AS n FROM reach GROUP BY pos),
    onc AS MATERIALIZED (SELECT id FROM area WHERE n >= {limit}),
    sedge AS MATERIALIZED (SELECT e.src, e.dst, e.len FROM edges e JOIN onc a ON a.id = e.src JOIN onc b ON b.id = e.dst),
    feeds AS MATERIALIZED (SELECT id, count(e.src) AS n FROM onc LEFT JOIN sedge e ON e.dst = id GROUP BY id),
    heads AS (SELECT id FROM feeds WHERE n <> 1),
    tails AS MATERIALIZED (SELECT id, e.dst, e.len FROM onc LEFT JOIN sedge e ON e.src = id WHERE e.dst IS NULL OR e.dst IN (SELECT id FROM heads)),
    way(id, pos, len, hops) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM onc UNION ALL SELECT w.id, e.dst, w.len + e.len, w.hops + 1 FROM way w JOIN sedge e ON e.src = w.pos),
    out_of AS MATERIALIZED (SELECT id, max(len) AS len FROM way GROUP BY id),
    tail_of AS MATERIALIZED (SELECT w.id, arg_min(w.pos, w.hops) AS tail, min(w.len) AS len FROM way w JOIN tails t ON t.id = w.pos GROUP BY w.id),
    numbered AS MATERIALIZED (SELECT h.id AS head, tail, len, row_number() OVER (ORDER BY h.id) - 1 AS link FROM heads h JOIN tail_of USING (id)),
    member AS MATERIALIZED (SELECT t.id, n.link FROM tail_of t JOIN numbered n USING (tail)),
    {levels("sedge", "onc")}, {by_level("strahler", order, "sedge", "onc")},
    springs AS (SELECT w.pos AS id, count(*) AS n FROM way w JOIN feeds f ON f.id = w.id AND f.n = 0 GROUP BY w.pos),
    links1 AS MATERIALIZED (SELECT n.link, n.head, coalesce(t.dst, n.tail) AS fin, n.len + coalesce(t.len, 0) AS length, CAST(s.o AS INT) AS o, m.n AS magnitude, p.z - q.z AS fall, sqrt(pow(p.row - q.row, 2) + pow(p.col - q.col, 2)) AS straight, a.n AS up, b.n AS down, d.len AS dout
        FROM numbered n JOIN tails t ON t.id = n.tail JOIN strahler s ON s.id = n.head JOIN springs m ON m.id = n.head JOIN cells p ON p.id = n.head JOIN cells q ON q.id = coalesce(t.dst, n.tail) JOIN area a ON a.id = n.head JOIN area b ON b.id = n.tail JOIN out_of d ON d.id = coalesce(t.dst, n.tail)),
    joins AS (SELECT b.link AS below, b.head, list({{'link': a.link, 'o': a.o, 'm': a.magnitude}} ORDER BY a.o DESC, a.link) AS u FROM links1 a JOIN links1 b ON b.head = a.fin WHERE a.fin <> a.head GROUP BY ALL),
    steps_up AS (SELECT below, head, u, unnest(range(1, greatest(len(u), 2))) AS k FROM joins),
    extra AS (SELECT below, k, (SELECT count(*) FROM links1) + row_number() OVER (ORDER BY below, k) - 1 AS link FROM steps_up WHERE k < len(u) - 1),
    ups AS MATERIALIZED (SELECT coalesce(e.link, s.below) AS link, CASE WHEN s.k = 1 THEN u[1].link ELSE f.link END AS us1, CASE WHEN len(u) = 1 THEN -1 ELSE u[s.k + 1].link END AS us2, e.link IS NOT NULL AS made, s.head,
        CASE WHEN e.link IS NOT NULL THEN {merge} END AS o, list_sum(list_transform(u[1:s.k + 1], lambda q: q.m)) AS m FROM steps_up s LEFT JOIN extra e ON e.below = s.below AND e.k = s.k LEFT JOIN extra f ON f.below = s.below AND f.k = s.k - 1),
    downs AS (SELECT us1 AS link, link AS dslink FROM ups WHERE us1 >= 0 UNION ALL SELECT us2, link FROM ups WHERE us2 >= 0),
    whole AS (SELECT link, head, fin, o, magnitude, length, fall, CASE WHEN length > 0 THEN fall / length ELSE 0 END AS slope, straight, up, down, dout AS d1, dout + length AS d2, dout + length / 2 AS d3 FROM links1
        UNION ALL SELECT u.link, u.head, u.head, CAST(u.o AS INT), CAST(u.m AS BIGINT), 0, 0, 0, 0, b.up, b.up, b.dout + b.length, b.dout + b.length, b.dout + b.length FROM ups u JOIN links1 b ON b.head = u.head WHERE u.made),
    net AS MATERIALIZED (SELECT CAST(w.link AS BIGINT) AS link, CAST(coalesce(d.dslink, -1) AS BIGINT) AS dslink, CAST(coalesce(u.us1, -1) AS BIGINT) AS us1, CAST(coalesce(u.us2, -1) AS BIGINT) AS us2, -1 AS dsnode, w.o AS strmorder, CAST(w.magnitude AS BIGINT) AS magnitude, length, fall AS drop, slope,
        straight AS straightl, CAST(up AS DOUBLE) AS uscontarea, CAST(down AS DOUBLE) AS dscontarea, d1 AS doutend, d2 AS doutstart, d3 AS doutmid, h.row AS hr, h.col AS hc, e.row AS er, e.col AS ec
        FROM whole w JOIN cells h ON h.id = w.head JOIN cells e ON e.id = w.fin LEFT JOIN ups u ON u.link = w.link LEFT JOIN downs d ON d.link = w.link)"""


def terrain(cells: str, steps: str, d8: str, reach: str, angle: str, shares: str, valley: str) -> dict[str, str]:
    """The SQL of the queries, by name."""
    base = f"WITH RECURSIVE {cells}, {steps}"
    rough = "s0 AS (SELECT id, row, col, rough AS z FROM cells)"
    filled = f"{fill('rough')}, s0 AS MATERIALIZED (SELECT c.id, c.row, c.col, w AS z FROM cells c JOIN fill USING (id))"
    facets = "nb0 AS (SELECT c.id, {}, count(*) AS n FROM s0 c JOIN near0 n ON n.src = c.id JOIN s0 d ON d.id = n.dst GROUP BY c.id)".format(", ".join(f"max(d.z) FILTER (n.k = {k}) AS z{k}" for k in range(1, 9)))
    tilts = " UNION ALL ".join(f"SELECT c.id, {j} AS i, {base_} AS base, {sign} AS sign, c.z - z{a} AS s1, z{a} - z{b} AS s2, c.z - z{b} AS s3 FROM s0 c JOIN nb0 USING (id) WHERE n = 8" for j, (a, b, base_, sign) in enumerate(_FACETS))
    dinf_start = f"""{_adjacent("near0", "s0")}, {facets}, tilts AS ({tilts}),
    turned AS (SELECT *, CASE WHEN s1 = 0 AND s2 = 0 THEN 0 ELSE atan2(s2, s1) END AS a FROM tilts),
    sloped AS (SELECT id, i, base, sign, CASE WHEN a < 0 THEN s1 WHEN a > {_QUARTER} THEN s3 / sqrt(2.0::DOUBLE) ELSE sqrt(s1 * s1 + s2 * s2) END AS slope, CASE WHEN a < 0 THEN 0 WHEN a > {_QUARTER} THEN {_QUARTER} ELSE a END AS turn FROM turned),
    steepest AS (SELECT id, max(slope) AS top, (list(base * {_PI} / 2 + sign * turn ORDER BY slope DESC, i))[1] AS angle FROM sloped GROUP BY id),
    g0 AS MATERIALIZED (SELECT c.*, CASE WHEN q.top > 0 THEN q.angle WHEN q.top IS NOT NULL THEN -1 END AS p, CASE WHEN q.top IS NOT NULL THEN greatest(q.top, 0) END AS slope FROM s0 c LEFT JOIN steepest q USING (id))"""
    flow = f"WITH RECURSIVE {shares}"
    alive = "(SELECT id FROM dinf WHERE ang IS NOT NULL)"
    out = {
        "pit_remove": f"{base}, {fill('rough')} SELECT row, col, w AS value FROM cells LEFT JOIN fill USING (id)",
        "pit_remove_four_way_masked": f"{base}, {fill('rough', True, 'mark = 1')} SELECT row, col, w AS value FROM cells LEFT JOIN fill USING (id)",
        "d8_flats": f"{base}, {filled}, {d8_of('s0')}, {d8_flat_round(0)}, {d8_flat_round(1)} SELECT row, col, CAST(p AS INT) AS p FROM g2",
        "d8_flowdir": f"{base}, {rough}, {d8_of('s0')}, {d8_flat_round(0)}, {d8_flat_round(1)} SELECT row, col, CAST(p AS INT) AS p, round(slope, 6) AS slope FROM g2",
        "dinf_flats": f"{base}, {filled}, {dinf_start}, {dinf_flat_round(0)}, {dinf_flat_round(1)} SELECT row, col, round(p, 6) AS ang, round(slope, 6) AS slope FROM g2",
    }
    # flow over links of which each cell's value is a function of its donors' values
    moved = "least(coalesce(sum(e.share * a.tla), 0) + any_value(c.weight), any_value(c.height))"
    came, load = "sum(e.share * a.tla)", "sum(e.share * a.tla * a.ctpt)"
    mixed = f"CASE WHEN {moved} >= {came} THEN {load} + any_value(c.decay) * ({moved} - {came}) ELSE {load} * {moved} / CASE WHEN {came} > 0 THEN {came} ELSE 1 END END"
    transport = {
        "tla": ("least(c.weight, c.height)", moved),
        "tdep": ("c.weight - least(c.weight, c.height)", f"{came} + any_value(c.weight) - {moved}"),
        "ctpt": ("CASE WHEN least(c.weight, c.height) > 0 THEN c.decay * least(c.weight, c.height) / least(c.weight, c.height) ELSE 0 END", f"CASE WHEN {moved} > 0 THEN {mixed} / {moved} ELSE 0 END"),
    }
    out["dinf_trans_lim_accum"] = f"{flow}, {levels('links', alive)}, {by_level('moves', transport, 'links', 'dinf')} SELECT row, col, round(tla, 6) AS tla, round(tdep, 6) AS tdep, round(ctpt, 6) AS ctpt FROM dinf LEFT JOIN moves USING (id)"
    runoff = {"v": ("greatest(0, c.weight - c.decay)", "greatest(0, sum(e.share * a.v) + any_value(c.weight) - any_value(c.decay))")}
    out["ret_lim_flow"] = f"{flow}, {levels('links', alive)}, {by_level('runoff', runoff, 'links', 'dinf')} SELECT row, col, round(v, 4) AS value FROM dinf LEFT JOIN runoff USING (id)"
    # runout: of the donors' sources the one under the steepest angle
    path, beta = "(a.dm + e.len)", "degrees(atan((a.sz - c.z) / (a.dm + e.len)))"
    seed = lambda own: f"CASE WHEN c.mark > 0 THEN {own} END"
    step = lambda own, found: f"CASE WHEN any_value(c.mark) > 0 THEN {own} ELSE (list({found} ORDER BY {beta} DESC, e.back) FILTER (a.rz >= 18 AND {beta} >= 18))[1] END"
    runout = {"rz": (seed("18"), step("18", beta)), "dm": (seed("0"), step("0", path)), "sz": (seed("c.z"), step("any_value(c.z)", "a.sz"))}
    out["dinf_avalanche"] = (
        f"{flow}, strong AS MATERIALIZED (SELECT l.src, l.dst, s.len, (k + 3) % 8 + 1 AS back FROM links l JOIN steps s USING (k) WHERE share >= 0.2), {levels('strong', alive)}, {by_level('runout', runout, 'strong', 'dinf')} "
        "SELECT row, col, round(rz, 6) AS rz, round(dm, 6) AS dm FROM dinf LEFT JOIN runout USING (id)"
    )
    out["dinf_dist_down"], out["dinf_dist_up"] = flow + _distances(True), flow + _distances(False)
    # D8 networks
    masked = f"m AS (SELECT d.id FROM d8 d JOIN cells c USING (id) WHERE d.p IS NOT NULL AND c.sca >= 0), linked AS MATERIALIZED (SELECT e.src, e.dst FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst)"
    order = {"o": ("1", "greatest(max(a.o), coalesce((list(a.o ORDER BY a.o DESC))[2], 0) + 1)")}
    out["grid_net_order"] = f"WITH RECURSIVE {d8}, {masked}, {levels('linked', 'm')}, {by_level('net', order, 'linked', 'cells')} SELECT row, col, CAST(o AS INT) AS gord FROM cells LEFT JOIN net USING (id)"
    sizes = "area AS MATERIALIZED (SELECT pos AS id, count(*) AS n FROM reach GROUP BY pos), steps_to AS (SELECT a.id AS src, b.id AS dst FROM d8 a JOIN steps s ON s.k = a.p JOIN cells b ON b.row = a.row + s.dr AND b.col = a.col + s.dc)"
    logs = lambda lo, hi, n: [lo * math.exp((math.log(hi) - math.log(lo)) / (n - 1)) ** i for i in range(n)]
    columns = ", ".join(f"round({c}, 6) AS {c}" for c in ("threshold", "drain_density", "mean_first", "mean_high", "sd_first", "sd_high", "t"))
    out["drop_analysis"] = f"WITH RECURSIVE {reach}, {sizes}, {_drops(logs(5, 100, 6), 'area')} SELECT {columns}, n_first, n_high FROM drops"
    optimum = lambda high: f"limit_(x) AS (SELECT coalesce(min(threshold) FILTER (abs(t) < 2), max(threshold), {high}) FROM drops)"
    out["wf_drop_stream"] = f"WITH RECURSIVE {reach}, {sizes}, {_drops(logs(5, 100, 5), 'area')}, {optimum(100)} SELECT d.row, d.col, CASE WHEN d.p IS NOT NULL THEN CAST(a.n >= x AS INT) END AS value FROM d8 d CROSS JOIN limit_ LEFT JOIN area a USING (id)"
    inner = valley.split(", size AS", 1)[1].replace("near AS (", "vnear AS (").replace("JOIN near USING", "JOIN vnear USING")
    valleys = "valley AS (SELECT s.id, CAST(s.inner_cell AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.r IN (s.row - 1, s.row) AND b.c IN (s.col - 1, s.col) AND s.v >= b.top) AS INT) AS v FROM soft s)"
    out["wf_peuker_douglas_stream"] = (
        f"WITH RECURSIVE {reach}, size AS{inner}, {valleys}, ssa AS MATERIALIZED (SELECT r.pos AS id, sum(v.v) AS n FROM reach r JOIN valley v USING (id) JOIN outs_up USING (id) GROUP BY r.pos), {sizes}, {_drops(logs(2, 50, 5), 'ssa')}, {optimum(50)} "
        "SELECT d.row, d.col, CAST(s.n >= x AS INT) AS value FROM d8 d CROSS JOIN limit_ LEFT JOIN ssa s ON s.id = d.id"
    ).replace("ssa AS MATERIALIZED", "last_row AS (SELECT max(row) - 1 AS r FROM cells), outs_up AS MATERIALIZED (SELECT DISTINCT q.id FROM reach q JOIN d8 o ON o.id = q.pos JOIN last_row ON o.row = r), ssa AS MATERIALIZED", 1)
    digits = ("length", "drop", "slope", "straightl", "doutend", "doutstart", "doutmid")
    out["stream_net"] = f"WITH RECURSIVE {reach}, {network(40)} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in digits)}) FROM net"
    out["stream_watershed"] = (
        f"WITH RECURSIVE {reach}, {network(40)}, enters AS (SELECT r.id, arg_min(r.pos, r.hops) AS pos FROM reach r JOIN onc o ON o.id = r.pos GROUP BY r.id) "
        "SELECT row, col, CAST(link AS BIGINT) AS value FROM cells c LEFT JOIN enters e USING (id) LEFT JOIN member m ON m.id = e.pos"
    )
    out["catch_outlets"] = (
        f"""WITH RECURSIVE {reach}, {network(40)}, walk(root, link, path, last, given) AS (
            SELECT link, link, '', 0.0::DOUBLE, true FROM net WHERE dslink < 0
            UNION ALL SELECT w.root, n.link, w.path || CASE WHEN n.link = u.us1 THEN '0' ELSE '1' END, CASE WHEN n.doutstart - w.last > 20 AND n.us1 >= 0 THEN n.doutstart ELSE w.last END, n.doutstart - w.last > 20 AND n.us1 >= 0
                      FROM walk w JOIN net u ON u.link = w.link JOIN net n ON n.link IN (u.us1, u.us2) WHERE n.uscontarea > 100),
        kept AS (SELECT *, row_number() OVER (ORDER BY root, path) AS id FROM walk WHERE given)
        SELECT k.link, CAST(CASE WHEN path = '' THEN n.er + coalesce(s.dr, 0) ELSE n.hr END AS INT) AS row, CAST(CASE WHEN path = '' THEN n.ec + coalesce(s.dc, 0) ELSE n.hc END AS INT) AS col, round(CASE WHEN path = '' THEN n.doutend ELSE n.doutstart END, 6) AS dist, CAST(k.id AS INT) AS id
        FROM kept k JOIN net n ON n.link = k.link LEFT JOIN d8 d ON d.row = n.er AND d.col = n.ec LEFT JOIN steps s ON s.k = d.p"""
    )
    out["wf_slope_area_stream"] = (
        f"WITH RECURSIVE {reach} SELECT d.row, d.col, CAST(v >= 20 AS INT) AS value FROM d8 d LEFT JOIN (SELECT r.pos AS id, max(CASE WHEN c.slp >= 0 AND c.sca >= 0 THEN c.slp * c.slp * c.sca END) AS v FROM reach r JOIN cells c ON c.id = r.id GROUP BY r.pos) USING (id)"
    )
    spread = {"v": ("c.weight", "sum(e.share * a.v) + any_value(c.weight)")}
    conc = {"cc": ("CASE WHEN c.q > 0 THEN CASE WHEN c.mark > 0 THEN 1 ELSE 0 END END", "CASE WHEN any_value(c.q) > 0 THEN CASE WHEN any_value(c.mark) > 0 THEN 1 ELSE coalesce(sum(e.share * a.cc * e.q * e.decay), 0) / any_value(c.q) END END")}
    out["wf_conc_limited"] = (
        f"{flow}, {levels('links', alive)}, {by_level('discharge', spread, 'links', 'dinf')}, wet AS MATERIALIZED (SELECT f.*, d.v AS q FROM dinf f JOIN discharge d USING (id)), loads AS MATERIALIZED (SELECT l.*, w.q, w.decay FROM links l JOIN wet w ON w.id = l.src), "
        f"{by_level('conc', conc, 'loads', 'wet')} SELECT row, col, round(cc, 6) AS value FROM dinf LEFT JOIN conc USING (id)"
    )
    out["sinmap_si"] = f"{base}, input AS (SELECT row, col, id, slp, sca FROM cells), {_stability('slp', 'sca')}"
    specific = {"v": ("1", "sum(e.share * a.v) + 1")}
    out["wf_stability_index"] = f"{flow}, {levels('links', alive)}, {by_level('area', specific, 'links', 'dinf')}, input AS (SELECT row, col, id, slp, v AS sca FROM dinf LEFT JOIN area USING (id)), {_stability('slp', 'sca')}"
    return out


def oblong(d8: str, reach: str, angle: str, shares: str) -> dict[str, str]:
    """The SQL of queries on cells of 30 by 20 with NULL cells, put together from that of square ones."""
    changes = [
        ("(1, 0, 1, 1.0::DOUBLE, 1)", "(1, 0, 1, 30.0::DOUBLE, 1)"), ("(5, 0, -1, 1.0::DOUBLE, 3)", "(5, 0, -1, 30.0::DOUBLE, 3)"), ("(3, -1, 0, 1.0::DOUBLE, 2)", "(3, -1, 0, 20.0::DOUBLE, 2)"), ("(7, 1, 0, 1.0::DOUBLE, 4)", "(7, 1, 0, 20.0::DOUBLE, 4)"),
        ("sqrt(2.0::DOUBLE)", "sqrt(1300.0::DOUBLE)"), ("count(*) AS n, max(slope)", "count(slope) AS n, max(slope)"),
        ("CAST(8 * (2000", "CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 50 <> 0 THEN CAST(8 * (2000"), ("% 7 AS DOUBLE) AS z", "% 7 AS DOUBLE) END AS z"),
        ("count(*) AS n\n       FROM cells c, steps s, cells n", "CASE WHEN any_value(c.z) IS NOT NULL THEN count(n.z) END AS n\n       FROM cells c, steps s, cells n"),
        ("c.z - f.e1 AS s1, f.e1 - f.e2 AS s2, c.z - f.e2 AS s3", "(c.z - f.e1) / f.d1 AS s1, (f.e1 - f.e2) / f.d2 AS s2, c.z - f.e2 AS s3, atan2(f.d2, f.d1) AS most"),
        ("f(i, e1, e2, base, sign)", "f0(i, e1, e2, base, sign), LATERAL (SELECT f0.*, CASE WHEN f0.i IN (1, 4, 5, 8) THEN 30.0::DOUBLE ELSE 20 END AS d1, CASE WHEN f0.i IN (1, 4, 5, 8) THEN 20.0::DOUBLE ELSE 30 END AS d2) f"),
        ("a > atan2(1.0::DOUBLE, 1.0::DOUBLE)", "a > most"), ("THEN atan2(1.0::DOUBLE, 1.0::DOUBLE) ELSE a END", "THEN most ELSE a END"),
    ]
    t = "atan2(20.0::DOUBLE, 30.0::DOUBLE)"
    edges = ["0", t, f"{_PI} / 2", f"{_PI} - {t}", _PI, f"{_PI} + {t}", f"{_PI} * 1.5", f"{_PI} * 2 - {t}", f"{_PI} * 2"]
    marks = ", ".join(f"({k}, {edges[k - 2] if k > 1 else f'-{t}'}, {edges[k - 1]}, {edges[k]})" for k in range(1, 9))
    changes.append((f"marks AS (SELECT k, dr, dc, CASE WHEN k = 1 THEN -q ELSE (k - 2) * q END AS lo, (k - 1) * q AS mid, k * q AS hi FROM (SELECT *, {_PI} / 4 AS q FROM steps))", f"marks AS (SELECT k, dr, dc, lo, mid, hi FROM steps JOIN (VALUES {marks}) v(k, lo, mid, hi) USING (k))"))

    def changed(sql: str) -> str:
        for a, b in changes:
            sql = sql.replace(a, b)
        return f"WITH RECURSIVE {sql}"

    lengths = "SELECT d.row, d.col, round(plen, 6) AS plen, round(tlen, 6) AS tlen FROM d8 d LEFT JOIN (SELECT r.pos AS id, max(r.len) AS plen, coalesce(sum(e.len) FILTER (r.hops > 0), 0) AS tlen FROM reach r LEFT JOIN edges e ON e.src = r.id GROUP BY r.pos) USING (id)"
    mass = "mass(t, id, v) AS (SELECT 0, id, 30.0::DOUBLE FROM dinf WHERE ang IS NOT NULL UNION ALL SELECT m.t + 1, l.dst, sum(m.v * l.share) FROM mass m JOIN links l ON l.src = m.id GROUP BY m.t + 1, l.dst)"
    return {
        "d8_slope_dir_oblong": f"{changed(d8)} SELECT row, col, CAST(p AS INT) AS p, round(slope, 6) AS slope FROM d8",
        "grid_net_oblong": f"{changed(reach)} {lengths}",
        "dinf_flowdir_oblong": f"{changed(angle)} SELECT row, col, round(ang, 6) AS ang, round(slope, 6) AS slope FROM dinf",
        "area_dinf_oblong": f"{changed(shares)}, {mass} SELECT d.row, d.col, round(s.v, 5) AS value FROM dinf d LEFT JOIN (SELECT id, sum(v) AS v FROM mass GROUP BY id) s USING (id)",
    }
