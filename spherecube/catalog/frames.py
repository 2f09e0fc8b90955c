"""Frames the queries run on, derived from the given tables. `oracle.py` states the same frames in SQL.

A region is a customer: its code starts with the codes of its market segment, nation and world region, so that parents
are prefixes of 4, 3 and 2 characters. Cubes hold one row per customer and quarter and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quarter_label, quarter_name, quarter_number
from ..operators.normalize import detrended_cube, scaled_cube
from ..operators.reshape import full_join_all
from ..operators.timeaxis import quarter_axis
from ..operators.trajectories import parse_axis_names
from ..runtime import materialise
from ..schema import EVENTS, FEATURES
from ..sources import literal_table

SPHERE_FEATURES = {
    "atmo": ["ship_qty", "ship_disc"],
    "bio": ["ord_value", "ord_count"],
    "socio": ["nama_net", "fin_share"],
}
CUBE_FEATURES = ["ord_value", "ord_count", "nama_net", "fin_share", "ship_qty", "ship_disc"]

# A catalogue with one feature missing and one without description.
CATALOG = [
    ("atmo", "ship_qty", "Quantity", "Quantity shipped"),
    ("atmo", "ship_disc", "Discount", "Mean discount"),
    ("bio", "ord_value", "Value", "Value ordered"),
    ("bio", "ord_count", "Orders", "Number of orders"),
    ("socio", "nama_net", "Net", None),
]

# Overlapping and disjoint intervals.
INTERVALS = [
    (1996, 1999, "growth", "NATION_1"),
    (1998, 1998, "law", "NATION_1"),
    (2000, 2001, "crisis", "NATION_1"),
    (1997, 1998, "drought", "NATION_7"),
]


# Columns read of the given tables; a stated schema spares a look into the files for every query.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
        " o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_quantity double, l_discount double, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey"))
    level0 = "concat('R', n_regionkey)"
    level1 = "concat('R', n_regionkey, char(n_nationkey + 65))"
    level2 = "concat('R', n_regionkey, char(n_nationkey + 65), substring(c_mktsegment, 1, 1))"
    level3 = "concat('R', n_regionkey, char(n_nationkey + 65), substring(c_mktsegment, 1, 1), c_custkey)"
    return joined.selectExpr(
        "c_custkey", "c_acctbal", "c_nationkey", "n_name AS country",
        f"{level0} AS geo0", f"{level1} AS geo1", f"{level2} AS geo2", f"{level3} AS geo3",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("geo3", "geo2", "geo1", "geo0")


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions, and for every tenth customer a region of a segment in which nobody orders."""
    tree = customers(spark, sf_dir)
    empty = tree.where("c_custkey % 10 = 0").withColumns({"geo2": F.expr("geo1 || 'Z'"), "geo3": F.expr("geo1 || 'Z' || c_custkey")})
    return tree.unionByName(empty).select("geo3", "geo2", "geo1", "geo0")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(customers(spark, sf_dir), F.expr("o_custkey = c_custkey"))
    return joined.selectExpr(
        "o_orderkey AS id", "country", "geo0", "geo1", "geo2", "geo3", "date(o_orderdate) AS day", "o_totalprice AS price",
        "o_orderstatus AS status", "o_orderpriority AS priority",
    ).withColumn("time", quarter_label("day"))


# Cells are aggregated by customer and quarter number first; codes and labels join to cells instead of to rows.


def _order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, final = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("c_custkey"), quarter_number(F.col("o_orderdate").cast("date")).alias("quarter")
    ).agg(
        F.sum(price).alias("ord_value"),
        F.count(F.lit(1)).cast("double").alias("ord_count"),
        F.sum(F.when(final, price).otherwise(-price)).alias("nama_net"),
        F.avg(F.when(final, 1.0).otherwise(0.0)).alias("fin_share"),
    )


def _ship_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(
        F.col("o_custkey").alias("c_custkey"), quarter_number(F.col("l_shipdate").cast("date")).alias("quarter")
    ).agg(F.sum("l_quantity").alias("ship_qty"), F.avg("l_discount").alias("ship_disc"))


def _named(spark: SparkSession, sf_dir: str, numbers: DataFrame, cols: list[str]) -> DataFrame:
    names = customers(spark, sf_dir).select("c_custkey", F.col("geo3").alias("geo"))
    return numbers.join(names, "c_custkey").select("geo", quarter_name("quarter").alias("time"), *cols)


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, _order_numbers(spark, sf_dir), CUBE_FEATURES[:4])


def ship_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, _ship_numbers(spark, sf_dir), CUBE_FEATURES[4:])


def raw_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by order quarter and lines by shipping quarter; cells of only one kind have NULLs in the other."""
    numbers = full_join_all([_order_numbers(spark, sf_dir), _ship_numbers(spark, sf_dir)], ["c_custkey", "quarter"])
    return _named(spark, sf_dir, numbers, CUBE_FEATURES)


def stored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw cube as a table, for operators that read it more than once."""
    return materialise(raw_cube(spark, sf_dir))


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled cube of the order features only."""
    return scaled_cube(order_cells(spark, sf_dir))


def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detrended_cube(stored_cube(spark, sf_dir))


def catalog(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CATALOG, FEATURES)


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarter_axis(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date"), table(spark, sf_dir, "orders"))


def dim_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(F.col("time").alias("label"), "ord")


def dim_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region has a place on the axis; its number is the customer's."""
    return customers(spark, sf_dir).select(F.col("geo3").alias("label"), F.col("c_custkey").cast("int").alias("ord"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of final orders by priority, segment and month; NULL in a month without one."""
    return sales(spark, sf_dir).groupBy(
        F.col("priority").alias("var"), F.col("geo2").alias("geo"), F.trunc("day", "month").alias("TIME_PERIOD")
    ).agg(F.sum(F.when(F.col("status") == "F", F.col("price"))).alias("values")).select(
        "var", "geo", F.lit("M").alias("freq"), "TIME_PERIOD", "values"
    )


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy(F.col("geo0").alias("geo"), F.trunc("day", "year").alias("TIME_PERIOD")).agg(
        F.sum("price").alias("values")
    ).select(F.lit("rev").alias("var"), "geo", F.lit("A").alias("freq"), "TIME_PERIOD", "values")


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy(F.col("geo3").alias("geo"), F.trunc("day", "quarter").alias("TIME_PERIOD")).agg(
        F.count(F.lit(1)).cast("double").alias("values")
    ).select(F.lit("cnt").alias("var"), "geo", F.lit("Q").alias("freq"), "TIME_PERIOD", "values")


def mixed_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).unionByName(yearly(spark, sf_dir)).unionByName(quarterly(spark, sf_dir))


def at_level(spark: SparkSession, sf_dir: str, level: int, var: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy(F.col(f"geo{level}").alias("geo"), "time").agg(
        F.sum("price").alias("values")
    ).select(F.lit(var).alias("var"), "geo", "time", "values")


def mixed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets: `deep` has levels 2 and 1, `top` level 0, `leaf` levels 3 and 0; all from one reading."""
    parts = [(2, "deep"), (1, "deep"), (0, "top"), (3, "leaf"), (0, "leaf")]
    places = F.array(*[F.struct(F.lit(var).alias("var"), F.col(f"geo{level}").alias("geo")) for level, var in parts])
    placed = sales(spark, sf_dir).select(F.inline(places), "time", "price")
    return placed.groupBy("var", "geo", "time").agg(F.sum("price").alias("values"))


def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy(
        F.col("geo2").alias("geo"), F.trunc("day", "quarter").alias("TIME_PERIOD"), "priority", "status"
    ).agg(F.sum("price").alias("values")).select(
        F.lit("ord_val").alias("code"), F.lit("Q").alias("freq"), F.lit("EUR").alias("unit"), "geo", "TIME_PERIOD",
        "values", "priority", "status",
    )


def indicator_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy(
        F.col("geo0").alias("geo"), F.trunc("day", "year").alias("TIME_PERIOD"), "status"
    ).agg(F.avg("price").alias("values")).select(
        F.lit("ord_avg").alias("code"), F.lit("A").alias("freq"), F.lit("EUR").alias("unit"), "geo", "TIME_PERIOD",
        "values", "status",
    )


def axes_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine aggregates per country and year, named like the axes of the country study."""
    price = F.col("price")
    urgent, final = F.col("priority") == "1-URGENT", F.col("status") == "F"
    return sales(spark, sf_dir).groupBy(
        F.col("country").alias("Country Code"), F.year("day").cast("double").alias("year")
    ).agg(
        F.sum(price).alias("CCX1"), F.avg(price).alias("CCX2"), F.max(price).alias("CCX3"),
        F.count(F.lit(1)).cast("double").alias("CCY1"), F.min(price).alias("CCY2"),
        F.stddev_samp(price).alias("CCY3"), F.sum(F.when(urgent, price)).alias("CCZ1"),
        F.avg(F.when(final, price)).alias("CCZ2"), F.sum(F.when(final, 1.0).otherwise(0.0)).alias("CCZ3"),
    )


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_axis_names(axes_wide(spark, sf_dir))


def intervals(spark: SparkSession) -> DataFrame:
    return literal_table(spark, INTERVALS, EVENTS)


def code_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three (older, newer) code tables with notes around the codes; some customers lack a code, some change theirs."""
    c = customers(spark, sf_dir)
    key, number = F.col("c_custkey"), F.col("c_custkey").cast("string")
    plain, moved = F.concat(F.lit("AA"), number), F.concat(F.lit("AB"), number)
    v = {
        "V1": F.concat(plain, F.lit(" (old)")),
        "V2": F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("code "), plain)),
        "V3": F.when(key % 10 == 0, moved).otherwise(plain),
        "V4": F.when(F.col("c_acctbal") < 9000, F.concat(F.when(key % 15 == 0, moved).otherwise(plain), F.lit(" new"))),
    }
    return [c.select(v[a].alias(a), v[b].alias(b)) for a, b in (("V1", "V2"), ("V2", "V3"), ("V3", "V4"))]


def split_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two (older, newer) tables of blocks of customers: of four, of three within a hundred, and of fifty; some are unlinked."""
    key = F.col("c_custkey")
    hundred, rest = F.floor(key / 100), key % 100
    v = {
        "W1": F.when(key % 7 > 0, F.concat(F.lit("P"), F.floor(key / 4).cast("string"))),
        "W2": F.when(key % 11 > 0, F.concat(F.lit("Q"), hundred.cast("string"), F.lit("-"), F.floor(rest / 3).cast("string"))),
        "W3": F.concat(F.lit("S"), F.floor(key / 50).cast("string")),
    }
    c = table(spark, sf_dir, "customer")
    return [c.select(v[a].alias(a), v[b].alias(b)).distinct() for a, b in (("W1", "W2"), ("W2", "W3"))]


def cells(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """A customer is a cell of a grid; regions are segments of nations (A), blocks of cells (B, D) or nations (C)."""
    c = customers(spark, sf_dir)
    x, y = F.floor(F.col("c_custkey") / 10).cast("int"), (F.col("c_custkey") % 10).cast("int")
    region = {
        "A": F.col("geo2"),
        "B": F.concat(F.lit("B"), F.floor(F.col("c_custkey") / 50).cast("string")),
        "C": F.col("geo1"),
        "D": F.concat(F.lit("D"), F.floor(F.col("c_custkey") / 240).cast("string")),
    }[version]
    return c.select(region.alias("region"), x.alias("cell_x"), y.alias("cell_y"))
