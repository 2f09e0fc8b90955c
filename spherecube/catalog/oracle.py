"""The registered queries in SQL over the given tables."""

from __future__ import annotations

from itertools import permutations

from .oracle_frames import FEATURES, ORDER_FEATURES, quarter, with_frames, zscore

_SQL: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def add(name: str, select: str, *frames: str) -> None:
    _SQL[name] = with_frames(select, *frames) if frames else select.strip()


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded expression, off the exact half and without a negative zero."""
    return f"round(({expr})::DOUBLE + 3.7e-{digits + 3}::DOUBLE, {digits}) + 0.0::DOUBLE AS {name or expr}"


def rs(cols: list[str], digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in cols)


VALUES = '"values"'
V2 = r(VALUES, VALUES, 2)
V4 = r(VALUES, VALUES, 4)
V6 = r(VALUES, VALUES, 6)

# --- assembling and reshaping ---------------------------------------------------------------------------------------

for _name in ("assemble_cube", "full_outer_features", "bind_by_key"):
    add(_name, f"SELECT geo, time, {rs(FEATURES)} FROM raw", "raw")

add("cube_to_long", f"SELECT geo, time, var_id, {r('value')} FROM raw_long", "raw_long")

add("key_unite_separate", f"""
SELECT geo || '_' || time AS space_time, geo, substr(time, 1, 4) AS year, substr(time, 6) AS quarter,
  nullif(regexp_extract(geo, '^[A-Za-z\\[\\\\\\]^_`]+'), '') AS country, {r('ord_value')} FROM raw""", "raw")

add("unite_missing", """
SELECT coalesce(CASE WHEN V2 IS NOT NULL THEN 'code ' || V2 END, 'NA') || '_' || V3 AS pair, count(*) AS n
FROM codes GROUP BY 1""", "codes")

add("union_named", f"""
SELECT 'orders' AS source, geo, time, {rs(ORDER_FEATURES)}, NULL::DOUBLE AS ship_qty, NULL::DOUBLE AS ship_disc
FROM order_cells
UNION ALL
SELECT 'lines', geo, time, NULL, NULL, NULL, NULL, {rs(['ship_qty', 'ship_disc'])} FROM ship_cells""",
    "order_cells", "ship_cells")

ALL_QUARTERS = f"""(SELECT DISTINCT {quarter('day')} AS time, day AS quarter_start,
  (row_number() OVER (ORDER BY day) - 1)::INTEGER AS ord
FROM (SELECT unnest(range(date_trunc('quarter', min(o_orderdate))::TIMESTAMP, max(o_orderdate)::TIMESTAMP
  + INTERVAL 1 DAY, INTERVAL 3 MONTH))::DATE AS day FROM orders))"""

add("complete_grid", f"""
SELECT g.geo3 AS geo, q.time, {r('ord_value')}
FROM regions g CROSS JOIN {ALL_QUARTERS} q LEFT JOIN order_cells o ON o.geo = g.geo3 AND o.time = q.time""",
    "regions", "order_cells")

add("expected_cells", f"""
SELECT (SELECT count(*) FROM order_cells) AS observed,
  (SELECT count(*) FROM regions) * (SELECT count(*) FROM {ALL_QUARTERS}) AS expected""", "regions", "order_cells")

_geos = [f"R{k}" for k in range(5)]
add("prefix_pivot", f"""
SELECT date_diff('day', DATE '1970-01-01', TIME_PERIOD)::INTEGER AS days,
  date_diff('day', DATE '1990-01-01', TIME_PERIOD)::INTEGER AS days_1990,
  {', '.join(r(f"max(CASE WHEN geo = '{g}' THEN {VALUES} END)", f'geo_{g}', 2) for g in _geos)}
FROM yearly GROUP BY TIME_PERIOD""", "yearly")

_matrix = f"""
SELECT n.geo1 AS geo, t.time, 'price' AS var_id, {r('s.v', 'value', 2)}
FROM (SELECT DISTINCT geo1 FROM customers) n CROSS JOIN (SELECT DISTINCT time FROM sales) t
LEFT JOIN (SELECT geo1, time, sum(price) AS v FROM sales GROUP BY ALL) s ON s.geo1 = n.geo1 AND s.time = t.time"""
add("cube_from_matrix", _matrix, "customers", "sales")
add("cube_from_arrays", _matrix, "customers", "sales")

add("version_long", """
SELECT c_custkey, 'A' AS version, geo3 AS ID, country AS NAME FROM customers
UNION ALL SELECT c_custkey, 'B', geo2, NULL FROM customers
UNION ALL SELECT c_custkey, 'C', geo1, geo0 FROM customers""", "customers")

add("nest_unnest", f"SELECT priority, id, geo3, {r('price')} FROM sales", "sales")
add("nest_sizes", "SELECT priority, count(*) AS n, TRUE AS bounded FROM sales GROUP BY priority", "sales")

# --- sources and sinks ------------------------------------------------------------------------------------------------

add("read_axis", f"SELECT time AS label, ord FROM {ALL_QUARTERS}")
add("read_feature_catalog", """
SELECT p_type AS sphere, p_partkey::VARCHAR AS var_id, p_name AS label, CASE WHEN p_size > 10 THEN p_brand END AS description
FROM part""")
add("read_region_table", "SELECT geo3, geo2, geo1, geo0 FROM regions", "regions")
add("read_csv_dir", f"SELECT country, year, domain, cca_axis, {r('value', digits=4)} FROM axes", "axes")
add("csv_roundtrip", "SELECT V1, V2 FROM codes WHERE V1 IS NOT NULL AND V2 IS NOT NULL", "codes")
add("read_indicators", f"""
SELECT code, freq, geo, TIME_PERIOD, {V4}, priority, status FROM indicator
UNION ALL SELECT code, freq, geo, TIME_PERIOD, {V4}, NULL, status FROM indicator_annual""", "indicator", "indicator_annual")
add("read_region_levels", "SELECT geo, level::INTEGER AS level FROM levels", "levels")

_conformed = f"""
SELECT v.var, g.geo2 AS geo, q.time, {{value}}
FROM (SELECT DISTINCT var FROM monthly) v CROSS JOIN (SELECT DISTINCT geo2 FROM regions) g CROSS JOIN {ALL_QUARTERS} q
LEFT JOIN (SELECT var, geo, {quarter('TIME_PERIOD')} AS time, min({VALUES}) AS m
  FROM monthly WHERE {VALUES} IS NOT NULL GROUP BY ALL) c
  ON c.var = v.var AND c.geo = g.geo2 AND c.time = q.time"""
add("conform_to_axes", _conformed.format(value=r("coalesce(m, -1.0)", VALUES, 2)), "monthly", "regions")
add("write_cube_roundtrip", _conformed.format(value=r("m", VALUES, 2)), "monthly", "regions")
add("split_write_roundtrip", f"""
SELECT code || '_' || priority || '_' || status AS descriptor, geo, TIME_PERIOD, {V2} FROM indicator""", "indicator")

_tile_cells = f"""
SELECT v.var, g.geo3 AS geo, q.time, {r('l.value', VALUES, 2)}
FROM (SELECT DISTINCT var_id AS var FROM raw_long WHERE var_id IN ('ord_value', 'ord_count', 'nama_net', 'fin_share')) v
CROSS JOIN regions g CROSS JOIN {ALL_QUARTERS} q
LEFT JOIN raw_long l ON l.var_id = v.var AND l.geo = g.geo3 AND l.time = q.time"""
add("tile_roundtrip", _tile_cells, "regions", "raw_long")
add("tile_slice_time", _tile_cells + " WHERE q.time IN ('1998-Q2', '1996-Q1')", "regions", "raw_long")
add("tile_slice_region", _tile_cells + """
WHERE g.geo3 IN (SELECT min_by(geo3, c_custkey) FROM customers UNION ALL SELECT max_by(geo3, c_custkey) FROM customers)""", "regions", "raw_long")

# --- time and space ---------------------------------------------------------------------------------------------------

add("quarter_axis", f"SELECT time, ord, quarter_start FROM {ALL_QUARTERS}")

_strict = f"CASE WHEN count({VALUES}) = count(*) THEN avg({VALUES}) END"
_month = """SELECT var, geo, {q} AS time, {agg} AS v FROM monthly GROUP BY ALL"""
add("resample_month_to_quarter", f"""
SELECT var, geo, time, {r('v', VALUES)} FROM ({_month.format(q=quarter('TIME_PERIOD'), agg=_strict)})""", "monthly")
_year_rows = f"""
SELECT var, geo, year(TIME_PERIOD) || '-Q' || q AS time, {VALUES} AS v FROM yearly CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q)"""
add("resample_year_to_quarter", f"SELECT var, geo, time, {r('v', VALUES, 2)} FROM ({_year_rows})", "yearly")
for _name, _agg in (("resample_time_mixed", _strict), ("resample_time_custom", f"max({VALUES})"), ("resample_time_median", f"median({VALUES})")):
    add(_name, f"""
SELECT var, geo, time, {r('v', VALUES, 4)} FROM (
  {_month.format(q=quarter('TIME_PERIOD'), agg=_agg)}
  UNION ALL {_year_rows}
  UNION ALL SELECT var, geo, {quarter('TIME_PERIOD')}, {VALUES} FROM quarterly)""", "mixed_freq")

add("region_parents", """
SELECT geo AS geo3, substr(geo, 1, 4) AS geo2, substr(geo, 1, 3) AS geo1, substr(geo, 1, 2) AS geo0
FROM levels WHERE level = 3""", "levels")
add("region_levels", "SELECT geo, level::INTEGER AS level FROM levels", "levels")
add("attach_level", f"""
SELECT m.geo, var, time, {V2}, level::INTEGER AS level FROM mixed_level m JOIN levels USING (geo)""", "mixed_level", "levels")

_counts = """(SELECT var, level, count(*) AS n FROM (SELECT DISTINCT var, geo FROM mixed_level) JOIN levels USING (geo)
  GROUP BY ALL)"""
_majority = f"(SELECT DISTINCT ON (var) var, level FROM {_counts} ORDER BY var, n DESC, level)"
add("majority_level", f"SELECT var, level::INTEGER AS level FROM {_majority}", "mixed_level", "levels")
add("infer_level", f"SELECT var, max(level)::INTEGER AS level FROM {_counts} GROUP BY var", "mixed_level", "levels")

for _level in (2, 0):
    add(f"expand_level{_level}", f"""
SELECT 'v' AS var, g.geo3 AS geo, s.time, {r('s.v', VALUES, 2)}
FROM regions g JOIN (SELECT geo{_level} AS code, time, sum(price) AS v FROM sales GROUP BY ALL) s ON s.code = g.geo{_level}""",
        "regions", "sales")

_segments = "(SELECT geo2 AS code, time, sum(price) AS v FROM sales GROUP BY ALL)"
for _name in ("expand_finest_right", "resample_space_finest"):
    add(_name, f"""
SELECT g.geo3 AS geo, s.time, {r('s.v', VALUES, 2)} FROM settled g LEFT JOIN {_segments} s ON s.code = g.geo2""", "settled", "sales")

add("resample_space_majority", f"""
SELECT var, geo, time, {V2} FROM mixed_level m JOIN {_majority} j USING (var) WHERE j.level = 3
UNION ALL
SELECT m.var, t.leaf, m.time, {r('m.' + VALUES, VALUES, 2)} FROM mixed_level m JOIN {_majority} j USING (var)
JOIN tree t ON t.parent = m.geo AND t.level = j.level""", "mixed_level", "levels", "tree")

_ingested = f"""
SELECT code || '_' || priority || '_' || status AS var, leaf AS geo, {quarter('TIME_PERIOD')} AS time, {V4}
FROM indicator JOIN tree ON parent = geo AND level = 2
UNION ALL
SELECT code || '_' || status, leaf, year(TIME_PERIOD) || '-Q' || q, {V4}
FROM indicator_annual JOIN tree ON parent = geo AND level = 0 CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q)"""
add("ingest_datasets", _ingested, "indicator", "indicator_annual", "tree")
add("ingest_and_store", f"""
SELECT v.var, g.geo3 AS geo, q.time, i.{VALUES}
FROM (SELECT DISTINCT var FROM ({_ingested})) v CROSS JOIN regions g CROSS JOIN {ALL_QUARTERS} q
LEFT JOIN ({_ingested}) i ON i.var = v.var AND i.geo = g.geo3 AND i.time = q.time""", "indicator", "indicator_annual", "tree")

# --- datasets and catalogue -------------------------------------------------------------------------------------------

_profile = """
SELECT 'ord_val' AS code, 'code,freq,unit,geo,TIME_PERIOD,values,priority,status' AS columns, min(freq) AS freq,
  max(level)::INTEGER AS level, count(DISTINCT priority || '_' || status) AS vars
FROM indicator LEFT JOIN levels USING (geo)
UNION ALL
SELECT 'ord_avg', 'code,freq,unit,geo,TIME_PERIOD,values,status', min(freq), max(level)::INTEGER, count(DISTINCT status)
FROM indicator_annual LEFT JOIN levels USING (geo)"""
add("dataset_profile", _profile, "indicator", "indicator_annual", "levels")
add("dataset_titles", f"""
SELECT code, level, CASE WHEN code = 'ord_val' THEN 'Value of orders' END AS title FROM ({_profile})""",
    "indicator", "indicator_annual", "levels")
add("count_variables", "SELECT count(DISTINCT priority || '_' || status) AS vars FROM indicator", "indicator")

add("feature_defaults", "SELECT sphere, var_id, label, description FROM features", "features")
add("features_for_spheres", "SELECT label FROM features WHERE sphere IN ('bio', 'socio')", "features")
add("xy_features", """
SELECT CASE sphere WHEN 'bio' THEN 'x' ELSE 'y' END AS side, var_id FROM features
WHERE sphere IN ('bio', 'socio') AND label IN ('Value', 'Orders', 'Net', 'Discount')""", "features")
add("features_table", "SELECT sphere, label, description FROM features", "features")
add("detrend_choice", """
SELECT var_id, label = 'Value' AS detrend FROM features WHERE label IN ('Value', 'Net', 'Quantity')""", "features")

# --- normalising ------------------------------------------------------------------------------------------------------

add("column_moments", f"""
SELECT var_id, count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')} FROM raw_long GROUP BY var_id""",
    "raw_long")
add("coverage", f"""
SELECT var_id, count(value) AS n, {r('1 - count(value) / any_value(cells)', 'missing')},
  1 - count(value) / any_value(cells) <= 0.5 AS complete
FROM raw_long CROSS JOIN (SELECT (SELECT count(*) FROM regions) * (SELECT count(*) FROM {ALL_QUARTERS}) AS cells)
GROUP BY var_id""", "raw_long", "regions")
add("map_columns", f"""
SELECT substr(geo, 1, 3) AS geo1, count(*) FILTER (nama_net IS NULL OR nama_net <= 0) AS no_net, count(ship_qty) AS shipped,
  {r('sum(round(ord_value / 2, 6))', 'half_value', 2)} FROM raw GROUP BY 1""", "raw")
add("zscore_impute", "SELECT geo, time, " + ", ".join(r(zscore(c), c) for c in FEATURES) + " FROM raw", "raw")
add("scaled_cube", f"SELECT geo, time, {rs(FEATURES)} FROM scaled", "scaled")


def demeaned(part: str, table: str = "raw") -> str:
    cols = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {part}) AS {c}" for c in FEATURES)
    return f"SELECT geo, time, {cols} FROM {table}"


YEAR, SEASON = "geo, substr(time, 1, 4)", "geo, substr(time, 6)"
add("demean_by", f"SELECT geo, time, {rs(FEATURES)} FROM ({demeaned('time')})", "raw")
add("detrend_season", f"SELECT geo, time, {rs(FEATURES)} FROM ({demeaned(SEASON)})", "raw")
add("detrend_year", f"SELECT geo, time, {rs(FEATURES)} FROM ({demeaned(YEAR)})", "raw")
add("detrend_both", f"SELECT geo, time, {rs(FEATURES)} FROM ({demeaned(SEASON, '(' + demeaned(YEAR) + ')')})", "raw")
add("detrended_cube", f"SELECT geo, time, {rs(FEATURES)} FROM detrended", "detrended")
add("detrended_long", f"""
SELECT geo, make_date(substr(time, 1, 4)::INTEGER, (substr(time, 7)::INTEGER - 1) * 3 + 1, 1) AS time, var_id,
  {r('value')}, sphere, label, description
FROM (SELECT * FROM detrended UNPIVOT (value FOR var_id IN ({', '.join(FEATURES)}))) JOIN features USING (var_id)""",
    "detrended", "features")
add("processed_cube", f"""
SELECT geo, time, {rs(['d.ord_value', 'd.ship_qty'])}, {rs(['s.ord_count', 's.nama_net'])}
FROM detrended d JOIN scaled s USING (geo, time)""".replace("AS d.", "AS ").replace("AS s.", "AS "), "detrended", "scaled")
add("build_cubes", " UNION ALL ".join(
    f"SELECT '{k}' AS cube, geo, time, {rs(FEATURES)} FROM {k}" for k in ("raw", "scaled", "detrended")),
    "raw", "scaled", "detrended")

# --- canonical correlation --------------------------------------------------------------------------------------------


def two_by_two(table: str, x: list[str], y: list[str], tag: str = "") -> str:
    """Tables that end in `m<tag>`: n, the correlations r1, r2 and for each axis k the coefficients xk1, xk2, yk1, yk2.

    Closed form of the two-against-two case: the squared correlations are the eigenvalues of a 2 x 2 matrix, the x
    coefficients its vectors, the y coefficients their regression, all scaled to unit norm of the centred scores.
    """
    (x1, x2), (y1, y2) = x, y
    steps = {
        "cov": f"""SELECT count(*) AS n, var_samp({x1}) AS a, covar_samp({x1}, {x2}) AS b, var_samp({x2}) AS c,
  var_samp({y1}) AS d, covar_samp({y1}, {y2}) AS e, var_samp({y2}) AS f,
  covar_samp({x1}, {y1}) AS p, covar_samp({x1}, {y2}) AS q, covar_samp({x2}, {y1}) AS s, covar_samp({x2}, {y2}) AS t
  FROM {table}""",
        "dets": "SELECT *, a * c - b * b AS dx, d * f - e * e AS dy FROM cov{tag}",
        "g": """SELECT *, ((p * f - q * e) * p + (q * d - p * e) * q) / dy AS g11,
  ((p * f - q * e) * s + (q * d - p * e) * t) / dy AS g12, ((s * f - t * e) * s + (t * d - s * e) * t) / dy AS g22
  FROM dets{tag}""",
        "k": """SELECT *, (c * g11 - b * g12) / dx AS k11, (c * g12 - b * g22) / dx AS k12,
  (a * g12 - b * g11) / dx AS k21, (a * g22 - b * g12) / dx AS k22 FROM g{tag}""",
        "l": """SELECT *, (k11 + k22 + sqrt((k11 - k22) ** 2 + 4 * k12 * k21)) / 2 AS l1,
  (k11 + k22 - sqrt((k11 - k22) ** 2 + 4 * k12 * k21)) / 2 AS l2 FROM k{tag}""",
        "v": """SELECT *, """ + ", ".join(f"""
  CASE WHEN abs(k12) + abs(l{i} - k11) >= abs(l{i} - k22) + abs(k21) THEN k12 ELSE l{i} - k22 END AS u{i}1,
  CASE WHEN abs(k12) + abs(l{i} - k11) >= abs(l{i} - k22) + abs(k21) THEN l{i} - k11 ELSE k21 END AS u{i}2"""
            for i in (1, 2)) + " FROM l{tag}",
        "h": """SELECT *, """ + ", ".join(f"""
  sign(CASE WHEN abs(u{i}1) >= abs(u{i}2) THEN u{i}1 ELSE u{i}2 END)
    / sqrt((n - 1) * (a * u{i}1 * u{i}1 + 2 * b * u{i}1 * u{i}2 + c * u{i}2 * u{i}2)) AS h{i}""" for i in (1, 2))
            + " FROM v{tag}",
        "w": """SELECT *, """ + ", ".join(f"""
  u{i}1 * h{i} AS x{i}1, u{i}2 * h{i} AS x{i}2,
  (f * (p * u{i}1 + s * u{i}2) - e * (q * u{i}1 + t * u{i}2)) * h{i} AS w{i}1,
  (d * (q * u{i}1 + t * u{i}2) - e * (p * u{i}1 + s * u{i}2)) * h{i} AS w{i}2""" for i in (1, 2)) + " FROM h{tag}",
        "m": """SELECT n, sqrt(greatest(l1, 0)) AS r1, sqrt(greatest(l2, 0)) AS r2, """ + ", ".join(f"""
  x{i}1, x{i}2,
  w{i}1 / sqrt((n - 1) * (d * w{i}1 * w{i}1 + 2 * e * w{i}1 * w{i}2 + f * w{i}2 * w{i}2)) AS y{i}1,
  w{i}2 / sqrt((n - 1) * (d * w{i}1 * w{i}1 + 2 * e * w{i}1 * w{i}2 + f * w{i}2 * w{i}2)) AS y{i}2""" for i in (1, 2))
            + " FROM w{tag}",
    }
    return ",\n".join(f"{n}{tag} AS ({sql.replace('{tag}', tag)})" for n, sql in steps.items())


X, Y = ["ord_value", "ord_count"], ["nama_net", "fin_share"]


def add_cca(name: str, select: str, *frames: str) -> None:
    sql = with_frames("SELECT 1", *frames, "order_scaled")
    head = sql[: sql.rindex("\nSELECT 1")]
    _SQL[name] = f"{head},\n{two_by_two('order_scaled', X, Y)}\n{select.strip()}"


FWD = {k: f"ord_value * x{k}1 + ord_count * x{k}2" for k in (1, 2)}
REV = {k: f"nama_net * y{k}1 + fin_share * y{k}2" for k in (1, 2)}
SCORED = "order_scaled CROSS JOIN m"

add("cross_moments", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'covar_samp({a}, {b})', 'cov')} FROM order_scaled"
    for a in [*X, *Y] for b in [*X, *Y]), "order_scaled")
add_cca("cca_correlations", f"""
SELECT 1 AS axis, {r('r1', 'correlation')} FROM m UNION ALL SELECT 2, {r('r2', 'correlation')} FROM m""")
add_cca("cca_scores_fwd", f"""
SELECT geo, time, {r(FWD[1], 'CCA1', 8)}, {r(FWD[2], 'CCA2', 8)}, regexp_extract(geo, '^[A-Z]+') AS country FROM {SCORED}""")
add_cca("cca_match_scores", f"""
SELECT geo, time, {r(FWD[1], 'fwd_CCA1', 8)}, {r(FWD[2], 'fwd_CCA2', 8)}, {r(REV[1], 'rev_CCA1', 8)},
  {r(REV[2], 'rev_CCA2', 8)} FROM {SCORED}""")


def loadings(x: list[str], side: str, table: str = "m", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS var_id, {r(f'{side}1{i}', 'CCA1', 8)}, {r(f'{side}2{i}', 'CCA2', 8)} FROM {table}"
        for i, c in enumerate(x, 1))


add_cca("cca_loadings", loadings(X, "x"))



def canonical_correlations(x: list[str], y: list[str], table: str) -> str:
    """Tables ending in `cor` (c1, c2, c3): canonical correlations of any features with three others.

    Covariances, their Cholesky factors entry by entry, the whitened cross-covariance by forward substitution, and the
    eigenvalues of its 3 x 3 Gram matrix by the trigonometric formula.
    """
    names, tables, last = [*x, *y], [], "s0"
    p, q = len(x), len(y)
    cov = lambda a, b: f"s_{min(a, b)}_{max(a, b)}"
    entries = [f"covar_samp({names[a]}, {names[b]}) AS {cov(a, b)}" for a in range(p + q) for b in range(a, p + q)]
    tables.append(f"s0 AS (SELECT {', '.join(entries)} FROM {table})")

    def add_columns(columns: list[str]) -> None:
        nonlocal last
        new = f"s{len(tables)}"
        tables.append(f"{new} AS (SELECT *, {', '.join(columns)} FROM {last})")
        last = new

    for side, start, size in (("l", 0, p), ("k", p, q)):
        for j in range(size):
            done = " + ".join([f"{side}_{j}_{m} * {side}_{j}_{m}" for m in range(j)] or ["0"])
            add_columns([f"sqrt({cov(start + j, start + j)} - ({done})) AS {side}_{j}_{j}"])
            below = []
            for r_ in range(j + 1, size):
                done = " + ".join([f"{side}_{r_}_{m} * {side}_{j}_{m}" for m in range(j)] or ["0"])
                below.append(f"({cov(start + r_, start + j)} - ({done})) / {side}_{j}_{j} AS {side}_{r_}_{j}")
            if below:
                add_columns(below)
    for r_ in range(p):  # rows whitened on the left, then columns on the right
        add_columns([f"({cov(r_, p + c)} - ({' + '.join([f'l_{r_}_{m} * w_{m}_{c}' for m in range(r_)] or ['0'])})) / l_{r_}_{r_} AS w_{r_}_{c}" for c in range(q)])
    for c in range(q):
        add_columns([f"(w_{r_}_{c} - ({' + '.join([f'k_{c}_{m} * v_{r_}_{m}' for m in range(c)] or ['0'])})) / k_{c}_{c} AS v_{r_}_{c}" for r_ in range(p)])
    add_columns([f"{' + '.join(f'v_{m}_{a} * v_{m}_{b}' for m in range(p))} AS g{a}{b}" for a in range(3) for b in range(a, 3)])
    add_columns(["(g00 + g11 + g22) / 3 AS mean"])
    add_columns(["sqrt(((g00 - mean) ** 2 + (g11 - mean) ** 2 + (g22 - mean) ** 2 + 2 * (g01 ** 2 + g02 ** 2 + g12 ** 2)) / 6) AS size"])
    add_columns(["""acos(greatest(-1, least(1, ((g00 - mean) * ((g11 - mean) * (g22 - mean) - g12 ** 2) - g01 * (g01 * (g22 - mean) - g12 * g02)
  + g02 * (g01 * g12 - (g11 - mean) * g02)) / (2 * size ** 3)))) / 3 AS angle"""])
    turn = (0, 4, 2)
    tables.append("cor AS (SELECT " + ", ".join(f"sqrt(greatest(mean + 2 * size * cos(angle + {t} * pi() / 3), 0)) AS c{k}" for k, t in enumerate(turn, 1)) + f" FROM {last})")
    return ",\n".join(tables)


_many_x, _many_y = ["ord_value", "ord_count", "ord_size", "nama_net", "fin_share"], ["ship_qty", "ship_disc", "ship_sq"]
_many = with_frames("SELECT 1", "raw")
_many = _many[: _many.rindex("\nSELECT 1")] + f""",
many AS (SELECT {', '.join(f'{zscore(c)} AS {c}' for c in [*_many_x, *_many_y])}
  FROM (SELECT *, ord_value / ord_count AS ord_size, ship_qty ** 2 AS ship_sq FROM raw)),
""" + canonical_correlations(_many_x, _many_y, "many")
_SQL["cca_many"] = _many + "\n" + " UNION ALL ".join(f"SELECT {k} AS axis, {r(f'c{k}', 'correlation')} FROM cor" for k in (1, 2, 3))

SPHERES = {"atmo": ["ship_qty", "ship_disc"], "bio": ["ord_value", "ord_count"], "socio": ["nama_net", "fin_share"]}
_pairs = list(permutations(SPHERES, 2))
_pair_models = ",\n".join(two_by_two("scaled", SPHERES[a], SPHERES[b], f"_{a}_{b}") for a, b in _pairs)
_pair_head = with_frames("SELECT 1", "scaled", "features")
_pair_head = _pair_head[: _pair_head.rindex("\nSELECT 1")] + ",\n" + _pair_models
_SQL["pairwise_cca"] = _pair_head + "\n" + " UNION ALL ".join(
    loadings(SPHERES[a], "x", f"m_{a}_{b}", f"'{a}' AS x, '{b}' AS y, ") for a, b in _pairs)
_SQL["pairwise_scores"] = _pair_head + "\n" + " UNION ALL ".join(
    f"""SELECT '{a}' AS x, '{b}' AS y, geo, time, {r(f'{SPHERES[a][0]} * x11 + {SPHERES[a][1]} * x12', 'CCA1', 8)},
  {r(f'{SPHERES[a][0]} * x21 + {SPHERES[a][1]} * x22', 'CCA2', 8)}, regexp_extract(geo, '^[A-Z]+') AS country
FROM scaled CROSS JOIN m_{a}_{b}""" for a, b in _pairs)

_SQL["pairwise_loadings_view"] = _pair_head + "\n" + f"""SELECT l.*, f.* EXCLUDE (var_id) FROM (
SELECT x, y, var_id, {r('CCA1', digits=8)}, {r('CCA2', digits=8)}, row_number() OVER (PARTITION BY x, y ORDER BY CCA1, var_id) AS ord FROM (
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, '{c}' AS var_id, x1{i} AS CCA1, x2{i} AS CCA2 FROM m_{a}_{b}"
    for a, b in _pairs for i, c in enumerate(SPHERES[a], 1)) + ")) l JOIN features f USING (var_id)"
_SQL["pairwise_biplot"] = _pair_head + "\n" + " UNION ALL ".join(
    f"""SELECT '{a}' AS x, '{b}' AS y, '{c}' AS var_id, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, {r(f'x1{i} * 2 - s1', 'xend', 8)}, {r(f'x2{i} * 2 - s2', 'yend', 8)}
FROM m_{a}_{b} CROSS JOIN (SELECT avg({SPHERES[a][0]} * x11 + {SPHERES[a][1]} * x12) AS s1, avg({SPHERES[a][0]} * x21 + {SPHERES[a][1]} * x22) AS s2
  FROM scaled CROSS JOIN m_{a}_{b})""" for a, b in _pairs for i, c in enumerate(SPHERES[a], 1))

add("sphere_pairs", """
SELECT a.sphere AS x, b.sphere AS y, a.n FROM
  (SELECT sphere, count(*) AS n FROM (
    SELECT 'atmo' AS sphere, coalesce(ship_qty, ship_disc) AS v FROM raw
    UNION ALL SELECT 'bio', coalesce(ord_value, ord_count) FROM raw
    UNION ALL SELECT 'socio', coalesce(nama_net, fin_share) FROM raw) WHERE v IS NOT NULL GROUP BY sphere) a
JOIN (VALUES ('atmo'), ('bio'), ('socio')) b(sphere) ON a.sphere <> b.sphere""", "raw")
add("common_observations", """
SELECT geo, time FROM order_cells INTERSECT SELECT geo, time FROM ship_cells""", "order_cells", "ship_cells")
add_cca("biplot_loadings", f"""
SELECT var_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, {r('l1 * 2 - s1', 'xend', 8)}, {r('l2 * 2 - s2', 'yend', 8)}
FROM (SELECT 'ord_value' AS var_id, x11 AS l1, x21 AS l2 FROM m UNION ALL SELECT 'ord_count', x12, x22 FROM m)
CROSS JOIN (SELECT avg({FWD[1]}) AS s1, avg({FWD[2]}) AS s2 FROM {SCORED})""")
add_cca("score_means", f"""
SELECT {r(f'avg({FWD[1]})', 'CCA1', 4)}, {r(f'avg({FWD[2]})', 'CCA2', 4)} FROM order_cells CROSS JOIN m""", "order_cells")
add_cca("scores_view", f"""
SELECT geo || '_' || time AS name, {r(FWD[1], 'fwd', 8)}, {r(REV[1], 'rev', 8)},
  regexp_matches(geo || '_' || time, '^R1.*_199[67]') AS highlight FROM {SCORED}""")
add_cca("loadings_view", f"""
SELECT * FROM ({loadings(X, 'x')} UNION ALL {loadings(Y, 'y')}) JOIN features USING (var_id)""", "features")
add_cca("trajectories_view", " UNION ALL ".join(f"""
SELECT geo, time, geo || time AS name, regexp_matches(geo || time, '^R2') AS highlight, '{way}' AS direction,
  {r(score[1], 'CCA1', 8)}, {r(score[2], 'CCA2', 8)} FROM {SCORED}""" for way, score in (("bio-socio", FWD), ("socio-bio", REV))))
for _name in ("map_view_feature", "map_view_label"):
    add(_name, f"""
SELECT g.geo3 AS geo, {r('v.ord_value', 'value')}, {r('max(abs(v.ord_value)) OVER ()', 'value_limit')}
FROM regions g LEFT JOIN (SELECT geo, ord_value FROM order_scaled WHERE time = '1998-Q2') v ON v.geo = g.geo3""",
    "regions", "order_scaled")
add_cca("map_view_score", f"""
SELECT g.geo3 AS geo, {r('v.s', 'value', 8)}, {r('max(abs(v.s)) OVER ()', 'value_limit', 8)}
FROM regions g LEFT JOIN (SELECT geo, {REV[1]} AS s FROM {SCORED} WHERE time = '1998-Q2') v ON v.geo = g.geo3""", "regions")
add_cca("timeseries_view", f"""
SELECT geo, make_date(substr(time, 1, 4)::INTEGER, (substr(time, 7)::INTEGER - 1) * 3 + 1, 1) AS time, feature, {r('value', digits=8)}
FROM (SELECT geo, time, {', '.join(ORDER_FEATURES)}, {FWD[1]} AS fwd_CCA1, {FWD[2]} AS fwd_CCA2, {REV[1]} AS rev_CCA1,
  {REV[2]} AS rev_CCA2 FROM {SCORED} WHERE geo = (SELECT min(geo) FROM order_scaled WHERE time = '1998-Q2'))
UNPIVOT (value FOR feature IN ({', '.join(ORDER_FEATURES)}, fwd_CCA1, fwd_CCA2, rev_CCA1, rev_CCA2))""")

# --- density and factors ----------------------------------------------------------------------------------------------


def density(points: str, x: str, y: str, grid_n: int, at: int, digits: int) -> str:
    def bandwidth(c: str) -> str:
        iqr = f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.34"
        return f"1.06 * least(stddev_samp({c}), nullif({iqr}, 0)) * power(count(*), -0.2)"

    return f"""
SELECT {r('gx', 'x', at)}, {r('gy', 'y', at)}, {r('sum(exp(-0.5 * (((px - gx) / hx) ** 2 + ((py - gy) / hy) ** 2))) / (2 * pi() * any_value(n * hx * hy))', 'density', digits)}
FROM (SELECT {x} AS px, {y} AS py FROM {points}) CROSS JOIN (
  SELECT n, hx, hy, x0 + i * (x1 - x0) / {grid_n - 1} AS gx, y0 + j * (y1 - y0) / {grid_n - 1} AS gy
  FROM (SELECT count(*) AS n, min(c) AS x0, max(c) AS x1, min(e) AS y0, max(e) AS y1, {bandwidth('c')} AS hx, {bandwidth('e')} AS hy
    FROM (SELECT {x} AS c, {y} AS e FROM {points}))
  CROSS JOIN range({grid_n}) t(i) CROSS JOIN range({grid_n}) u(j))
GROUP BY gx, gy"""


add("density2d", density("order_scaled", "ord_value", "fin_share", 100, 6, 6), "order_scaled")
add_cca("density2d_highlight", density(f"(SELECT * FROM {SCORED} WHERE starts_with(geo, 'R1'))", FWD[1], FWD[2], 100, 8, 4))

add_cca("trajectories_density", " UNION ALL ".join(f"""
SELECT '{way}' AS direction, x AS CCA1, y AS CCA2, density FROM ({density(SCORED, score[1], score[2], 100, 8, 4)})"""
    for way, score in (("bio-socio", FWD), ("socio-bio", REV))))
_iqr = "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.34"
_deviation = "1.06 * least(stddev_samp({c}), nullif(" + _iqr + ", 0)) * power(count(*), -0.2)"
add("density_by_nation", f"""
SELECT nation, {r('gx', 'x')}, {r('gy', 'y')},
  {r('sum(exp(-0.5 * (((ord_value - gx) / hx) ** 2 + ((fin_share - gy) / hy) ** 2))) / any_value(2 * pi() * n * hx * hy)', 'density')}
FROM (SELECT geo[1:3] AS nation, ord_value, fin_share FROM order_scaled) JOIN (
  SELECT nation, n, hx, hy, x0 + i * (x1 - x0) / 19 AS gx, y0 + j * (y1 - y0) / 19 AS gy
  FROM (SELECT geo[1:3] AS nation, count(*) AS n, min(ord_value) AS x0, max(ord_value) AS x1, min(fin_share) AS y0, max(fin_share) AS y1,
      {_deviation.format(c='ord_value')} AS hx, {_deviation.format(c='fin_share')} AS hy FROM order_scaled GROUP BY 1)
  CROSS JOIN range(20) t(i) CROSS JOIN range(20) u(j)) USING (nation)
GROUP BY nation, gx, gy""", "order_scaled")

add("pca_2", f"""
SELECT name, {r('sqrt(0.5)', 'PC1')}, CASE name WHEN 'ord_value' THEN {r('sqrt(0.5)', 'PC2').split(' AS ')[0]}
  ELSE -({r('sqrt(0.5)', 'PC2').split(' AS ')[0]}) END AS PC2,
  {r('(SELECT 1 + abs(corr(ord_value, ord_count)) FROM order_scaled)', 'first_variance')}
FROM (VALUES ('ord_value'), ('ord_count')) t(name)""", "order_scaled")
add("pca_2_scores", f"""
SELECT geo, time, {r('(zv + zc) * sqrt(0.5)', 'PC1')}, {r('(zv - zc) * sqrt(0.5)', 'PC2')}
FROM (SELECT geo, time, {zscore('ord_value')} AS zv, {zscore('ord_count')} AS zc FROM order_cells)""", "order_cells")



def three_components(x: str, y: str, z: str, table: str) -> str:
    """Tables ending in `pc`: means, deviations and first two component vectors (v11 .. v23) of three columns.

    Closed form of the eigenvalues of a 3 x 3 correlation matrix; a vector is the cross product of two rows.
    """
    def vector(k: int) -> str:
        e = f"(1 - l{k})"
        return f"a * c - b * {e} AS v{k}1, a * b - c * {e} AS v{k}2, {e} * {e} - a * a AS v{k}3"

    def scale(k: int) -> str:
        a, b, c = (f"v{k}{i}" for i in (1, 2, 3))
        top = f"CASE greatest(abs({a}), abs({b}), abs({c})) WHEN abs({a}) THEN {a} WHEN abs({b}) THEN {b} ELSE {c} END"
        return f"sign({top}) / sqrt({a} * {a} + {b} * {b} + {c} * {c}) AS s{k}"

    moments = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS d{i}" for i, c in enumerate((x, y, z), 1))
    return f"""
pc0 AS (SELECT {moments}, corr({x}, {y}) AS a, corr({x}, {z}) AS b, corr({y}, {z}) AS c FROM {table}),
pc1 AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM pc0),
pc2 AS (SELECT *, acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 AS phi FROM pc1),
pc3 AS (SELECT *, 1 + 2 * p * cos(phi) AS l1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM pc2),
pc4 AS (SELECT *, 3 - l1 - l3 AS l2 FROM pc3),
pc5 AS (SELECT *, {vector(1)}, {vector(2)} FROM pc4),
pc AS (SELECT *, {scale(1)}, {scale(2)} FROM pc5)"""


def _component(k: int) -> str:
    terms = zip(("Biosphere", "Atmosphere", "Socioeconomics"), (1, 2, 3))
    return " + ".join(f"({c} - m{i}) / d{i} * v{k}{i} * s{k}" for c, i in terms)


_path = "path AS (SELECT * FROM domains_wide WHERE country = 'NATION_1' AND cca_axis = 'CCA1')"
_head = with_frames("SELECT 1", "domains_wide")
_SQL["pca_3"] = f"""{_head[: _head.rindex(chr(10) + 'SELECT 1')]},
{_path}, {three_components('Biosphere', 'Atmosphere', 'Socioeconomics', 'path')}
SELECT country, year, {r(_component(1), 'PC1')}, {r(_component(2), 'PC2')} FROM path CROSS JOIN pc WHERE year <= 1999"""

# --- country study ----------------------------------------------------------------------------------------------------

DOMAINS = ["Biosphere", "Atmosphere", "Socioeconomics"]
AXES = ["CCA1", "CCA2", "CCA3"]
_axes_wide = ", ".join(r(f"max(CASE WHEN cca_axis = '{a}' THEN value END)", a, 4) for a in AXES)

add("parse_axis_names", f"SELECT country, year, domain, cca_axis, {r('value', digits=4)} FROM axes", "axes")
add("country_current", f"""
SELECT country, year, domain, cca_axis, {r('value', digits=4)} FROM axes
WHERE country IN ('NATION_1', 'NATION_4', 'NATION_7') AND year BETWEEN 1996 AND 1999""", "axes")
add("country_domains", f"SELECT country, year, {rs(DOMAINS, 4)} FROM domains_wide WHERE cca_axis = 'CCA1'", "domains_wide")
add("country_axes", f"""
SELECT country, year, domain, {_axes_wide} FROM axes WHERE domain = 'Atmosphere' GROUP BY country, year, domain""", "axes")
add("country_plane", f"SELECT country, year, domain, {_axes_wide} FROM axes GROUP BY country, year, domain", "axes")
add("country_time", f"SELECT country, domain, year, {r('value', digits=4)} FROM axes WHERE cca_axis = 'CCA1'", "axes")
add("country_panel", f"""
SELECT cca_axis, country, year, {rs(DOMAINS, 4)} FROM domains_wide WHERE country IN ('NATION_1', 'NATION_4')""", "domains_wide")
add("events_by_year", f"""
SELECT country, year, domain, cca_axis, {r('value', digits=4)}, event, during_event FROM flagged""", "flagged")
add("event_text", """
SELECT country, year, string_agg(DISTINCT event, ', ' ORDER BY event) AS events
FROM flagged WHERE event IS NOT NULL GROUP BY country, year""", "flagged")
add("event_caption", """
SELECT country, year, string_agg(DISTINCT event, ', ' ORDER BY event) AS events
FROM flagged WHERE event IS NOT NULL AND country = 'NATION_1' AND year = 1998 GROUP BY country, year""", "flagged")
add("abs_lag_diff", f"""
SELECT country, year, {r('abs(CCZ1 - lag(CCZ1) OVER (PARTITION BY country ORDER BY year))', 'derivative', 4)}
FROM axes_wide""", "axes_wide")
add("abs_lag_region", f"""
SELECT geo, time, {r('abs(ord_value - lag(ord_value) OVER (PARTITION BY geo ORDER BY time))', 'change')} FROM order_cells""",
    "order_cells")
add("events_interval_join", """
SELECT s.geo2, s.id, c.id AS campaign, date_diff('day', c.day, s.day)::INTEGER AS days_in
FROM sales s JOIN sales c ON c.geo2 = s.geo2 AND c.priority = '1-URGENT'
  AND s.day BETWEEN c.day AND c.day + (c.id % 90)::INTEGER""", "sales")
add("trajectory_state", f"""
SELECT country, year, {r('Biosphere', digits=4)},
  CASE WHEN year = 1998 AND country = 'NATION_1' THEN 'current_point' WHEN country = 'NATION_1' THEN 'normal'
    WHEN year = 1998 THEN 'current_year' ELSE 'normal' END AS point_group,
  CASE WHEN country = 'NATION_1' AND year <= 1998 THEN 'current_country' END AS path_group,
  CASE WHEN year = 1998 THEN country END AS country_label,
  CASE WHEN year = 1998 AND country = 'NATION_1' THEN 2.5 ELSE 1.0 END::DOUBLE AS point_size,
  CASE WHEN year <> 1998 THEN 1 WHEN country = 'NATION_1' THEN 4 ELSE 3 END::INTEGER AS plot_order
FROM domains_wide WHERE cca_axis = 'CCA1'""", "domains_wide")
add("year_labels", f"""
SELECT country, year, CASE WHEN year % 5 = 0 THEN year END AS label, {rs(DOMAINS, 4)}
FROM domains_wide WHERE cca_axis = 'CCA1' AND country = 'NATION_1'""", "domains_wide")

# --- vintages ---------------------------------------------------------------------------------------------------------

add("crosswalk_chain", """
SELECT V4, coalesce(ab.V3, cd.V3) AS V3, V2, V1
FROM (SELECT V1, coalesce(a.V2, b.V2) AS V2, V3
  FROM (SELECT V1, V2 FROM codes WHERE V2 IS NOT NULL) a
  FULL JOIN (SELECT V2, V3 FROM codes WHERE V2 IS NOT NULL) b ON a.V2 = b.V2) ab
FULL JOIN (SELECT V3, V4 FROM codes WHERE V4 IS NOT NULL) cd ON ab.V3 = cd.V3""", "codes")

_overlap = "SELECT DISTINCT ON (a) a, {o} AS other, count(*) AS n FROM cells GROUP BY a, {o} ORDER BY a, n DESC, other"
add("largest_overlap", f"SELECT a AS region, other, n::DOUBLE AS overlap FROM ({_overlap.format(o='b')})", "cells")
add("largest_overlap_of_covers", f"SELECT a AS region, other, n::DOUBLE AS overlap FROM ({_overlap.format(o='b')})", "cells")
add("overlap_of_covers", "SELECT b AS a, d AS b, count(*)::DOUBLE AS area FROM cells GROUP BY b, d", "cells")
_SQL["harmonised_ids"] = with_frames("""
SELECT 1""", "split").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT 1", "")  + """, links AS (
  SELECT coalesce('W1/' || W1, 'W2/' || W2) AS a, coalesce('W2/' || W2, 'W1/' || W1) AS b FROM split
  UNION SELECT coalesce('W2/' || W2, 'W3/' || W3), coalesce('W3/' || W3, 'W2/' || W2) FROM split),
both_ways AS (SELECT a, b FROM links WHERE a IS NOT NULL UNION SELECT b, a FROM links WHERE a IS NOT NULL),
reached(node, far) AS (SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reached r JOIN both_ways l ON l.a = r.far),
named AS (SELECT node, min(least(node, far)) AS area FROM reached GROUP BY node)
SELECT split_part(node, '/', 1) AS vintage, split_part(node, '/', 2) AS code,
  split_part(area, '/', 1) AS area_vintage, split_part(area, '/', 2) AS area_code FROM named"""
add("crosswalk_by_overlap", f"""
SELECT space_id, version, region FROM (
  SELECT row_number() OVER (ORDER BY b.a) AS space_id, b.a AS A, b.other AS B, c.other AS C
  FROM ({_overlap.format(o='b')}) b JOIN ({_overlap.format(o='c')}) c ON b.a = c.a)
UNPIVOT INCLUDE NULLS (region FOR version IN (A, B, C))""", "cells")
add("assign_id", "SELECT geo, time, row_number() OVER (ORDER BY time, geo) AS id FROM order_cells", "order_cells")

# --- keys, filters, sets ----------------------------------------------------------------------------------------------

add("first_per_key", f"""
SELECT DISTINCT ON (geo3) geo3, day, id, {r('price')}, status FROM sales ORDER BY geo3, day, id""", "sales")
add("top_per_group", f"""
SELECT DISTINCT ON (geo2) geo2, id, {r('price')} FROM sales s ORDER BY geo2, s.price DESC, id DESC""", "sales")
add("slice_rows", f"""
SELECT id, {r('price')} FROM (SELECT id, price, row_number() OVER (ORDER BY price, id) AS n FROM sales) WHERE n IN (1, 3, 5)""",
    "sales")
add("head_n", f"""
SELECT id, {r('price')} FROM (SELECT id, price FROM sales ORDER BY price DESC, id LIMIT 20)""", "sales")

_by_status = {s: f"""(SELECT geo2, CASE WHEN year(day) > 1995 THEN time END AS time, sum(price) AS v FROM sales
  WHERE status = '{s}' GROUP BY ALL)""" for s in "FOP"}
add("natural_left_chain", f"""
SELECT f.geo2, f.time, {r('f.v', 'value_F', 2)}, {r('o.v', 'value_O', 2)}, {r('p.v', 'value_P', 2)}
FROM {_by_status['F']} f
LEFT JOIN {_by_status['O']} o ON o.geo2 = f.geo2 AND o.time IS NOT DISTINCT FROM f.time
LEFT JOIN {_by_status['P']} p ON p.geo2 = f.geo2 AND p.time IS NOT DISTINCT FROM f.time""", "sales")
add("level_reorder", """
SELECT geo3, row_number() OVER (ORDER BY low, geo3) AS ord FROM (SELECT geo3, min(day) AS low FROM sales GROUP BY geo3)""", "sales")
add("level_order_within", """
SELECT country, geo3, row_number() OVER (PARTITION BY country ORDER BY low, geo3) AS ord
FROM (SELECT country, geo3, min(day) AS low FROM sales GROUP BY country, geo3)""", "sales")
add("price_quantiles", f"""
SELECT status, count(*) AS n, {', '.join(r(f'quantile_cont(price, 0.{p // 10})', f'q{p}', 4) for p in (10, 50, 90))} FROM sales GROUP BY status""", "sales")


def gap_sql(key: str, cells: str) -> str:
    """Islands of missing cells of (key, feature, ord, gap)."""
    return f"""
SELECT {key}, feature, sum(size)::BIGINT AS n, coalesce(sum(size) FILTER (gap), 0)::BIGINT AS missing, count(*) FILTER (gap) AS gaps,
  coalesce(max(size) FILTER (gap), 0) AS longest, coalesce(max(size) FILTER (gap AND first = 0), 0) AS lead,
  coalesce(max(size) FILTER (gap AND last = whole), 0) AS trail
FROM (SELECT {key}, feature, gap, count(*) AS size, min(ord) AS first, max(ord) AS last, any_value(whole) AS whole
  FROM (SELECT *, ord - row_number() OVER (PARTITION BY {key}, feature, gap ORDER BY ord) AS island, max(ord) OVER () AS whole FROM ({cells}))
  GROUP BY {key}, feature, gap, island)
GROUP BY {key}, feature"""


add("gap_runs", gap_sql("geo", f"""
SELECT g.geo, f.feature, q.ord, l.value IS NULL AS gap
FROM (SELECT DISTINCT geo FROM raw) g CROSS JOIN (SELECT unnest({FEATURES!r}) AS feature) f CROSS JOIN {ALL_QUARTERS} q
LEFT JOIN raw_long l ON l.geo = g.geo AND l.time = q.time AND l.var_id = f.feature"""), "raw", "raw_long")
add("gap_runs_daily", gap_sql("geo2", """
SELECT g.geo2, f.feature, date_diff('day', a.first, q.day)::BIGINT AS ord,
  CASE f.feature WHEN 'price' THEN c.price IS NULL ELSE c.urgent IS NULL END AS gap
FROM (SELECT DISTINCT geo2 FROM sales) g CROSS JOIN (VALUES ('price'), ('urgent')) f(feature)
CROSS JOIN (SELECT min(day) AS first FROM sales) a
CROSS JOIN (SELECT unnest(range(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM sales) q
LEFT JOIN (SELECT geo2, day, sum(price) AS price, sum(CASE WHEN priority = '1-URGENT' THEN price END) AS urgent FROM sales GROUP BY ALL) c
  ON c.geo2 = g.geo2 AND c.day = q.day"""), "sales")
_moment_columns = {"ord_value": "ord_value / 1e5", "ord_count": "ord_count", "fin_share": "fin_share", "ship_qty": "ship_qty / 100", "ship_disc": "ship_disc"}
add("moments_merged", " UNION ALL ".join(f"""
SELECT time[6:7] AS season, '{a}' AS x, '{b}' AS y, count(*) AS n, {r(f'avg({_moment_columns[a]})', 'mean_x')}, {r(f'avg({_moment_columns[b]})', 'mean_y')},
  {r(f'covar_samp({_moment_columns[a]}, {_moment_columns[b]})', 'cov')}
FROM raw WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY season"""
    for i, a in enumerate(_moment_columns) for b in list(_moment_columns)[i:]), "raw")
add("category_order", """
SELECT status, count(*) AS n, CASE status WHEN 'P' THEN 1 WHEN 'O' THEN 2 END::INTEGER AS ord FROM sales GROUP BY status""", "sales")
add("lookup_first", f"""
SELECT priority, n, {r("n / max(CASE WHEN priority = '1-URGENT' THEN n END) OVER ()", 'share')}
FROM (SELECT priority, count(*) AS n FROM sales GROUP BY priority)""", "sales")

_filters = {
    "equal": "status = 'F' AND priority = '5-LOW'",
    "member": "year(day) < 1998",
    "absent": "year(day) >= 1998",
    "in_not_in": "status IN ('F', 'O') AND priority NOT IN ('5-LOW', '1-URGENT')",
    "range": "year(day) BETWEEN 1996 AND 1998 AND status IN ('F', 'P')",
    "prefix": "starts_with(geo3, 'R1') OR country = 'NATION_7'",
    "pattern": "regexp_matches(geo3 || '_' || time, '^R2.*-Q3$')",
    "upto": "year(day) <= 1997",
}
add("axis_filters", " UNION ALL ".join(
    f"SELECT '{k}' AS filter, geo2, count(*) AS n FROM sales WHERE {cond} GROUP BY geo2" for k, cond in _filters.items()), "sales")
add("drop_missing", f"""
SELECT 'any' AS rule, count(*) AS n FROM raw WHERE ord_value IS NOT NULL AND ord_count IS NOT NULL AND nama_net IS NOT NULL
  AND fin_share IS NOT NULL AND ship_qty IS NOT NULL AND ship_disc IS NOT NULL
UNION ALL SELECT 'positioned', count({VALUES}) FROM monthly""", "raw", "monthly")
add("slice_mode", f"""
SELECT geo, time, var_id, {r('value')} FROM raw_long WHERE time = '1998-Q2' OR var_id = 'ship_disc'""", "raw_long")
add("subset_features", f"SELECT geo, time, {rs(['ord_value', 'ship_disc'])} FROM raw", "raw")
add("set_operations", """
SELECT CASE WHEN o.geo IS NULL THEN 'only_lines' WHEN s.geo IS NULL THEN 'only_orders' ELSE 'both' END AS part,
  coalesce(o.time, s.time) AS time, count(*) AS n
FROM order_cells o FULL JOIN ship_cells s ON o.geo = s.geo AND o.time = s.time GROUP BY ALL""", "order_cells", "ship_cells")
add("distinct_rows", "SELECT DISTINCT geo2, time, status FROM sales", "sales")
add("row_counts", """
SELECT status, count(*) AS n_rows, count(DISTINCT geo3) AS n_regions, count(DISTINCT time) AS n_times
FROM sales GROUP BY status""", "sales")
add("symmetric_limit", f"""
SELECT time, {r('CASE WHEN count(nama_net) = count(*) THEN max(abs(nama_net)) END', 'net_limit')},
  {r('max(abs(coalesce(ship_qty, 0)))', 'qty_limit')} FROM raw GROUP BY time""", "raw")
add("column_choice", f"""
SELECT priority AS priority_2024, status AS status_2024, freq, geo, TIME_PERIOD, {V2} FROM indicator""", "indicator")
add("scalar_functions", f"""
SELECT id, CASE status WHEN 'F' THEN 'Biosphere' WHEN 'O' THEN 'Atmosphere' ELSE 'Socioeconomics' END AS domain,
  'CCA' || priority[1] AS axis, date_trunc('quarter', day)::DATE AS start, year(day)::INTEGER AS year,
  quarter(day)::INTEGER AS quarter, date_diff('day', DATE '1970-01-01', day)::INTEGER AS days,
  (year(day) % 5)::INTEGER AS mod5, length(geo3)::INTEGER AS length,
  nullif(regexp_extract('code ' || upper(priority), '[A-Z]{{2}}[A-Z0-9]*'), '') AS code,
  {r('CASE WHEN id % 2 = 0 THEN 0.001 ELSE price END', 'nonzero', 3)},
  {r('CASE WHEN price > 300000 THEN ln(price - 300000) ELSE 0 END', 'log_above')}, country || '/' || status AS label
FROM sales""", "sales")

# --- three-way factors ------------------------------------------------------------------------------------------------

_years = """
SELECT g.geo, y.time, coalesce(v, 0.0) AS ord_value, coalesce(n, 0.0) AS ord_count
FROM (SELECT DISTINCT geo3 AS geo FROM sales) g CROSS JOIN (SELECT DISTINCT year(day)::VARCHAR AS time FROM sales) y
LEFT JOIN (SELECT geo3 AS geo, year(day)::VARCHAR AS time, sum(price) / 1e5 AS v, count(*)::DOUBLE AS n FROM sales GROUP BY ALL) c
  ON c.geo = g.geo AND c.time = y.time"""
add("threeway_estimate", f"SELECT geo, time, {rs(['ord_value', 'ord_count'])} FROM ({_years})", "sales")
add("threeway_core", f"SELECT {r('sum(ord_value ** 2 + ord_count ** 2)', 'squares', 2)} FROM ({_years})", "sales")
# The leading vector of the years' products by power iteration, and its share of all squares.
_SQL["threeway_reduced"] = with_frames("SELECT 1", "sales").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT 1", "") + f""",
cube AS ({_years}),
gram AS (SELECT a.time, list(s ORDER BY b_time) AS row FROM (
  SELECT a.time, b.time AS b_time, sum(a.ord_value * b.ord_value + a.ord_count * b.ord_count) AS s
  FROM cube a JOIN cube b ON a.geo = b.geo GROUP BY ALL) a GROUP BY a.time),
whole AS (SELECT list(row ORDER BY time) AS g, list(time ORDER BY time) AS times FROM gram),
power(step, v) AS (
  SELECT 0, list_transform(times, lambda t: 1.0::DOUBLE) FROM whole
  UNION ALL SELECT step + 1, list_transform(u, lambda x: x / sqrt(list_inner_product(u, u)))
  FROM (SELECT step, list_transform(g, lambda r: list_inner_product(r, v)) AS u FROM power, whole WHERE step < 300)),
found AS (SELECT v, g, times, list_inner_product(v, list_transform(g, lambda r: list_inner_product(r, v))) AS top FROM power, whole WHERE step = 300)
SELECT label, {r('value')}, {r('top / (SELECT sum(ord_value ** 2 + ord_count ** 2) FROM cube)', 'fit')}
FROM (SELECT unnest(times) AS label, unnest(v) AS value, top FROM found)"""
