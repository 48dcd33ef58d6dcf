"""DuckDB text of the terrain views (see sources/views.py) and of shared scores, for the oracle statements."""

from __future__ import annotations


def _values(rows, columns: str) -> str:
    def one(v) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v!r}E0" if isinstance(v, float) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def views() -> str:
    from cellgrove.sources import dimensions as d

    names = [c.split()[0] for c in d.LIMIT_COLUMNS.split(", ")]
    base = [c.split()[0] for c in d.BASELINE_COLUMNS.split(", ")]
    return f"""WITH n0 AS (SELECT count(*) AS n FROM orders),
grid AS (SELECT n, h, CAST(FLOOR(n / h) AS BIGINT) AS w FROM n0, (SELECT max(o_orderkey + 1) AS h FROM orders, n0 WHERE (o_orderkey + 1) * (o_orderkey + 1) <= n AND n % (o_orderkey + 1) = 0)),
base0 AS (SELECT o_orderkey AS node_id, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS p, o_custkey AS k, CAST(FLOOR(o_orderkey / w) AS BIGINT) AS "row", o_orderkey % w AS col FROM orders, grid),
base1 AS (SELECT *, p % 3001 AS b02, CAST(FLOOR(p / 7) AS BIGINT) % 3001 AS b03, CAST(FLOOR(p / 13) AS BIGINT) % 3001 AS b04, CAST(FLOOR(p / 29) AS BIGINT) % 6001 AS b08 FROM base0),
cells AS (SELECT *, 4.9755E0 - "row" * 0.000277778E0 AS lat, -61.6138E0 + col * 0.000277778E0 AS lon, 800 + 3 * "row" + 2 * col + p % 41 AS elevation_m, (k % 60) / 100.0E0 AS slope,
 (b08 - b04) / (1 + b08 + b04) AS ndvi, (b03 - b08) / (1 + b03 + b08) AS ndwi, CASE WHEN p % 211 = 0 THEN 1 ELSE 0 END AS water_mask, (p % 201 - 100) / 100.0E0 AS tpi, (p % 301) / 100.0E0 AS tri, CASE WHEN node_id % 30 = 0 THEN 1 ELSE 0 END AS lidar_available FROM base1),
limits AS (SELECT * FROM {_values(d.LIMITS, ", ".join(names))}),
limits_baseline AS (SELECT * FROM {_values(d.BASELINE_LIMITS, ", ".join(base))}),
classes AS (SELECT * FROM {_values(tuple(d.CLASSES.items()), "y, description")}),
ranges AS (SELECT * FROM {_values(d.RANGES, "feature, low, high")}),
offsets AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) AS a(dr), (VALUES (-1), (0), (1)) AS b(dc)),
edges AS (SELECT node_id AS src, ("row" + dr) * w + col + dc AS dst, 30.0E0 * sqrt(abs(dr) + abs(dc)) AS dist, dr, dc FROM cells, offsets, grid WHERE "row" + dr BETWEEN 0 AND h - 1 AND col + dc BETWEEN 0 AND w - 1),
labels_all AS (SELECT c.*, l.*, CASE WHEN slope * 90.0E0 > slope_2 OR ndwi > ndwi_water OR water_mask > 0.5E0 OR ndvi > ndvi_2 THEN 3 WHEN slope * 90.0E0 > slope_1 OR ndvi > ndvi_1 OR ndwi > ndwi_wet THEN 2 ELSE 1 END AS y FROM cells c, limits l),
labels_cell AS (SELECT node_id, profile, y FROM labels_all),
baseline_cell AS (SELECT node_id, profile, CASE WHEN slope > slope_2 OR ndwi > 0.3E0 OR water_mask > 0.5E0 THEN 3 WHEN slope > slope_1 OR ndvi > ndvi_1 THEN 2 ELSE 1 END AS y FROM cells, limits_baseline),
weights AS (SELECT node_id, 1 + p % 97 AS a, 1 + CAST(FLOOR(p / 97) AS BIGINT) % 97 AS b, 1 + CAST(FLOOR(p / 9409) AS BIGINT) % 97 AS g FROM cells),
probs AS (SELECT node_id, a / (a + b + g) AS p1, b / (a + b + g) AS p2, g / (a + b + g) AS p3 FROM weights),
profile_probs AS (SELECT node_id, 'a_pe' AS profile, p1, p2, p3 FROM probs UNION ALL SELECT node_id, 'motorizada', p2, p3, p1 FROM probs UNION ALL SELECT node_id, 'mecanizada', p3, p1, p2 FROM probs UNION ALL SELECT node_id, 'blindada', p1, p3, p2 FROM probs),
entropies AS (SELECT *, -p1 * ln(p1 + 1e-8) - p2 * ln(p2 + 1e-8) - p3 * ln(p3 + 1e-8) AS raw, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS top FROM profile_probs),
preds AS (SELECT e.node_id, e.profile, l.y, m.model, CASE m.model WHEN 'gnn' THEN CASE WHEN c.p % 5 = 0 THEN e.top ELSE l.y END WHEN 'rule' THEN r.y WHEN 'rf' THEN CASE WHEN c.p % 11 = 0 THEN 1 + l.y % 3 ELSE l.y END ELSE CASE WHEN c.p % 7 = 0 THEN 1 + (l.y + 1) % 3 ELSE l.y END END AS pred
 FROM entropies e JOIN labels_cell l USING (node_id, profile) JOIN baseline_cell r USING (node_id, profile) JOIN cells c USING (node_id), (VALUES ('gnn'), ('rule'), ('rf'), ('mlp')) AS m(model)),
wide AS (SELECT node_id, profile, max(y) AS y, max(CASE WHEN model = 'gnn' THEN pred END) AS gnn, max(CASE WHEN model = 'rule' THEN pred END) AS rule, max(CASE WHEN model = 'rf' THEN pred END) AS rf, max(CASE WHEN model = 'mlp' THEN pred END) AS mlp FROM preds GROUP BY node_id, profile),
zones AS (SELECT p.*, CASE WHEN abs(ndvi - ndvi_1) <= 0.02E0 THEN 'close' WHEN abs(ndvi - ndvi_1) <= 0.05E0 THEN 'near' ELSE 'far' END AS zone, CASE WHEN slope < 0.35E0 - 0.05E0 THEN 'flat' WHEN slope > 0.35E0 + 0.05E0 THEN 'steep' ELSE 'transition' END AS slope_zone FROM preds p JOIN cells USING (node_id) JOIN limits USING (profile)),
scenes AS (SELECT l_linenumber AS scene_id, CAST(l_linenumber * 7 % 10 AS INTEGER) AS cloud, "row", col, max(CASE WHEN l_quantity < 5 THEN 0 ELSE CAST(FLOOR(l_extendedprice) AS BIGINT) % 10000 END) AS dn FROM lineitem JOIN cells ON l_orderkey = node_id GROUP BY ALL),
points AS (SELECT event_id, node_id, lat, lon, elevation_m + CAST(FLOOR(value) AS BIGINT) % 50 AS elevation, CASE WHEN event_type IN ('error', 'purchase') THEN 'GEDI' ELSE 'ICESat-2' END AS source, CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS quality FROM (SELECT *, event_id % n AS spot FROM events, n0) JOIN cells ON spot = node_id),
blocks AS (SELECT node_id, CAST(FLOOR((lat - lat0) / (0.5E0 / 111.0E0)) * 1000 + FLOOR((lon - lon0) / (0.5E0 / 85.0E0)) AS BIGINT) AS block_id FROM cells, (SELECT min(lat) AS lat0, min(lon) AS lon0 FROM cells)),
ranked AS (SELECT block_id, row_number() OVER (ORDER BY (block_id * 7919 + 42) % 10007, block_id) AS rn, count(*) OVER () AS nb FROM (SELECT DISTINCT block_id FROM blocks)),
splits AS (SELECT block_id, CASE WHEN rn <= FLOOR(nb * 0.7E0) THEN 'train' WHEN rn <= FLOOR(nb * 0.7E0) + FLOOR(nb * 0.15E0) THEN 'val' ELSE 'test' END AS split FROM ranked),
cell_splits AS (SELECT node_id, block_id, split FROM blocks JOIN splits USING (block_id))"""


def scores(keys: str, source: str, where: str = "TRUE", columns: str = "n, ROUND(accuracy, 6) AS accuracy, ROUND(macro_f1, 6) AS macro_f1, ROUND(weighted_f1, 6) AS weighted_f1") -> str:
    """n, accuracy, macro and weighted F1 by keys over rows with y and pred."""
    parts = ", ".join(f"sum(CASE WHEN y = {c} AND pred = {c} THEN 1 ELSE 0 END) AS t{c}, sum(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS s{c}, sum(CASE WHEN pred = {c} THEN 1 ELSE 0 END) AS q{c}" for c in (1, 2, 3))
    f1 = [f"(CASE WHEN s{c} + q{c} > 0 THEN 2.0E0 * t{c} / (s{c} + q{c}) ELSE 0.0E0 END)" for c in (1, 2, 3)]
    present = " + ".join(f"(CASE WHEN s{c} + q{c} > 0 THEN 1 ELSE 0 END)" for c in (1, 2, 3))
    macro = f"({' + '.join(f1)}) / ({present})"
    weighted = f"({' + '.join(f'{x} * s{c}' for x, c in zip(f1, (1, 2, 3), strict=True))}) / (s1 + s2 + s3)"
    return f"SELECT {keys}, {columns} FROM (SELECT *, (t1 + t2 + t3) / n AS accuracy, {macro} AS macro_f1, {weighted} AS weighted_f1 FROM (SELECT {keys}, count(*) AS n, {parts} FROM {source} WHERE {where} GROUP BY {keys}))"
