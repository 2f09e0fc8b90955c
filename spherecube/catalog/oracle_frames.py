"""The frames of `frames.py` as named SQL tables, each with the tables it is built from."""

from __future__ import annotations

FRAMES: dict[str, str] = {}


def frame(name: str, sql: str) -> None:
    FRAMES[name] = sql.strip()


def quarter(day: str) -> str:
    return f"(year({day}) || '-Q' || quarter({day}))"


def with_frames(select: str, *names: str) -> str:
    """The select with all frames it names before it, in their order of definition."""
    return "WITH " + ",\n".join(f"{n} AS ({FRAMES[n]})" for n in FRAMES if n in needed(names)) + "\n" + select.strip()


def needed(names) -> set[str]:
    found: set[str] = set()
    for n in names:
        found |= {n, *needed(DEPENDS.get(n, ()))}
    return found


DEPENDS = {
    "regions": ["customers"],
    "sales": ["customers"],
    "order_cells": ["sales"],
    "ship_cells": ["customers"],
    "raw": ["order_cells", "ship_cells"],
    "raw_long": ["raw"],
    "logged": ["raw"],
    "scaled": ["logged"],
    "order_logged": ["order_cells"],
    "order_scaled": ["order_logged"],
    "season": ["raw"],
    "detrended": ["season"],
    "levels": ["regions"],
    "tree": ["regions"],
    "monthly": ["sales"],
    "yearly": ["sales"],
    "quarterly": ["sales"],
    "mixed_freq": ["monthly", "yearly", "quarterly"],
    "mixed_level": ["sales"],
    "indicator": ["sales"],
    "indicator_annual": ["sales"],
    "axes_wide": ["sales"],
    "axes": ["axes_wide"],
    "features": ["catalog"],
    "codes": ["customers"],
    "cells": ["customers"],
    "settled": ["customers"],
    "split": ["customers"],
    "events_yearly": ["intervals"],
    "flagged": ["axes", "events_yearly"],
    "domains_wide": ["axes"],
}

FEATURES = ["ord_value", "ord_count", "nama_net", "fin_share", "ship_qty", "ship_disc"]
ORDER_FEATURES = FEATURES[:4]


def zscore(c: str, cast: str = "") -> str:
    """z-score over the whole table; missing or constant -> 0."""
    return f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)"


def logged(features: list[str]) -> str:
    return ", ".join(f"CASE WHEN {c} > 0 THEN ln({c}) END AS {c}" if c.startswith("nama_") else c for c in features)


frame("customers", """
SELECT c_custkey, c_acctbal, c_nationkey, n_name AS country,
  'R' || n_regionkey AS geo0,
  'R' || n_regionkey || chr(65 + n_nationkey) AS geo1,
  'R' || n_regionkey || chr(65 + n_nationkey) || substr(c_mktsegment, 1, 1) AS geo2,
  'R' || n_regionkey || chr(65 + n_nationkey) || substr(c_mktsegment, 1, 1) || c_custkey AS geo3
FROM customer JOIN nation ON c_nationkey = n_nationkey""")

frame("regions", "SELECT geo3, geo2, geo1, geo0 FROM customers")

frame("levels", """
SELECT DISTINCT geo3 AS geo, 3 AS level FROM regions UNION SELECT geo2, 2 FROM regions
UNION SELECT geo1, 1 FROM regions UNION SELECT geo0, 0 FROM regions""")

frame("tree", """
SELECT geo2 AS parent, 2 AS level, geo3 AS leaf FROM regions UNION ALL SELECT geo1, 1, geo3 FROM regions
UNION ALL SELECT geo0, 0, geo3 FROM regions""")

frame("sales", f"""
SELECT o_orderkey AS id, country, geo0, geo1, geo2, geo3, o_orderdate::DATE AS day, {quarter('o_orderdate')} AS time,
  o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority
FROM orders JOIN customers ON o_custkey = c_custkey""")

frame("order_cells", """
SELECT geo3 AS geo, time, sum(price) AS ord_value, count(*)::DOUBLE AS ord_count,
  sum(CASE WHEN status = 'F' THEN price ELSE -price END) AS nama_net,
  avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END) AS fin_share
FROM sales GROUP BY geo3, time""")

frame("ship_cells", f"""
SELECT geo3 AS geo, {quarter('l_shipdate')} AS time, sum(l_quantity) AS ship_qty, avg(l_discount) AS ship_disc
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customers ON o_custkey = c_custkey GROUP BY 1, 2""")

frame("raw", """
SELECT geo, time, ord_value, ord_count, nama_net, fin_share, ship_qty, ship_disc
FROM order_cells FULL JOIN ship_cells USING (geo, time)""")

frame("raw_long", f"""
SELECT geo, time, var_id, value FROM raw UNPIVOT INCLUDE NULLS (value FOR var_id IN ({', '.join(FEATURES)}))""")

frame("logged", f"SELECT geo, time, {logged(FEATURES)} FROM raw")
frame("scaled", f"SELECT geo, time, {', '.join(f'{zscore(c)} AS {c}' for c in FEATURES)} FROM logged")

frame("order_logged", f"SELECT geo, time, {logged(ORDER_FEATURES)} FROM order_cells")
frame("order_scaled", f"SELECT geo, time, {', '.join(f'{zscore(c)} AS {c}' for c in ORDER_FEATURES)} FROM order_logged")

frame("season", "SELECT geo, time, " + ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY geo, substr(time, 6)) AS {c}" for c in FEATURES) + " FROM raw")
frame("detrended", f"SELECT geo, time, {', '.join(f'{zscore(c)} AS {c}' for c in FEATURES)} FROM season")

frame("catalog", """
SELECT * FROM (VALUES
  ('atmo', 'ship_qty', 'Quantity', 'Quantity shipped'), ('atmo', 'ship_disc', 'Discount', 'Mean discount'),
  ('bio', 'ord_value', 'Value', 'Value ordered'), ('bio', 'ord_count', 'Orders', 'Number of orders'),
  ('socio', 'nama_net', 'Net', NULL)) t(sphere, var_id, label, description)""")

frame("features", f"""
SELECT var_id, coalesce(sphere, 'socio') AS sphere, coalesce(label, var_id) AS label,
  coalesce(description, label, var_id) AS description
FROM (SELECT unnest([{', '.join(repr(c) for c in FEATURES)}]) AS var_id) LEFT JOIN catalog USING (var_id)""")

frame("monthly", """
SELECT priority AS var, geo2 AS geo, 'M' AS freq, date_trunc('month', day)::DATE AS TIME_PERIOD,
  sum(CASE WHEN status = 'F' THEN price END) AS "values" FROM sales GROUP BY ALL""")
frame("yearly", """
SELECT 'rev' AS var, geo0 AS geo, 'A' AS freq, date_trunc('year', day)::DATE AS TIME_PERIOD, sum(price) AS "values"
FROM sales GROUP BY ALL""")
frame("quarterly", """
SELECT 'cnt' AS var, geo3 AS geo, 'Q' AS freq, date_trunc('quarter', day)::DATE AS TIME_PERIOD,
  count(*)::DOUBLE AS "values" FROM sales GROUP BY ALL""")
frame("mixed_freq", "SELECT * FROM monthly UNION ALL SELECT * FROM yearly UNION ALL SELECT * FROM quarterly")

frame("mixed_level", " UNION ALL ".join(
    f"""SELECT '{var}' AS var, geo{level} AS geo, time, sum(price) AS "values" FROM sales GROUP BY geo{level}, time"""
    for level, var in ((2, "deep"), (1, "deep"), (0, "top"), (3, "leaf"), (0, "leaf"))))

frame("indicator", """
SELECT 'ord_val' AS code, 'Q' AS freq, 'EUR' AS unit, geo2 AS geo, date_trunc('quarter', day)::DATE AS TIME_PERIOD,
  sum(price) AS "values", priority, status FROM sales GROUP BY ALL""")
frame("indicator_annual", """
SELECT 'ord_avg' AS code, 'A' AS freq, 'EUR' AS unit, geo0 AS geo, date_trunc('year', day)::DATE AS TIME_PERIOD,
  avg(price) AS "values", status FROM sales GROUP BY ALL""")

frame("axes_wide", """
SELECT country, year(day)::DOUBLE AS year, sum(price) AS CCX1, avg(price) AS CCX2, max(price) AS CCX3,
  count(*)::DOUBLE AS CCY1, min(price) AS CCY2, stddev_samp(price) AS CCY3,
  sum(CASE WHEN priority = '1-URGENT' THEN price END) AS CCZ1, avg(CASE WHEN status = 'F' THEN price END) AS CCZ2,
  sum(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS CCZ3
FROM sales GROUP BY ALL""")
frame("axes", """
SELECT country, year,
  CASE name[3] WHEN 'X' THEN 'Biosphere' WHEN 'Y' THEN 'Atmosphere' WHEN 'Z' THEN 'Socioeconomics' END AS domain,
  'CCA' || name[4] AS cca_axis, value
FROM axes_wide
UNPIVOT INCLUDE NULLS (value FOR name IN (CCX1, CCX2, CCX3, CCY1, CCY2, CCY3, CCZ1, CCZ2, CCZ3))""")
frame("domains_wide", """
SELECT country, year, cca_axis, max(CASE WHEN domain = 'Biosphere' THEN value END) AS Biosphere,
  max(CASE WHEN domain = 'Atmosphere' THEN value END) AS Atmosphere,
  max(CASE WHEN domain = 'Socioeconomics' THEN value END) AS Socioeconomics
FROM axes GROUP BY ALL""")

frame("intervals", """
SELECT * FROM (VALUES (1996, 1999, 'growth', 'NATION_1'), (1998, 1998, 'law', 'NATION_1'),
  (2000, 2001, 'crisis', 'NATION_1'), (1997, 1998, 'drought', 'NATION_7')) t(first_year, last_year, event, country)""")
frame("events_yearly", "SELECT country, unnest(range(first_year, last_year + 1))::DOUBLE AS year, event FROM intervals")
frame("flagged", """
SELECT a.*, event, event IS NOT NULL AS during_event FROM axes a LEFT JOIN events_yearly e USING (country, year)""")

frame("codes", """
SELECT 'AA' || c_custkey AS V1, CASE WHEN c_acctbal >= 0 THEN 'AA' || c_custkey END AS V2,
  CASE WHEN c_custkey % 10 = 0 THEN 'AB' ELSE 'AA' END || c_custkey AS V3,
  CASE WHEN c_acctbal < 9000 THEN CASE WHEN c_custkey % 15 = 0 THEN 'AB' ELSE 'AA' END || c_custkey END AS V4
FROM customers""")
frame("settled", """
SELECT geo3, geo2, geo1, geo0 FROM customers
UNION ALL SELECT geo1 || 'Z' || c_custkey, geo1 || 'Z', geo1, geo0 FROM customers WHERE c_custkey % 10 = 0""")
frame("split", """
SELECT CASE WHEN c_custkey % 7 > 0 THEN 'P' || (c_custkey // 4) END AS W1,
  CASE WHEN c_custkey % 11 > 0 THEN 'Q' || (c_custkey // 100) || '-' || (c_custkey % 100 // 3) END AS W2,
  'S' || (c_custkey // 50) AS W3
FROM customers""")
frame("cells", """
SELECT geo2 AS a, 'D' || (c_custkey // 240) AS d, 'B' || (c_custkey // 50) AS b, geo1 AS c, c_custkey // 10 AS cell_x, c_custkey % 10 AS cell_y
FROM customers""")
