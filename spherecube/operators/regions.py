"""Region hierarchy: parents, levels, and tables lifted to leaf regions.

Region codes carry their ancestors as prefixes of 4, 3 and 2 characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spherecube.runtime import materialise

from .keys import require

LEAF_LEVEL = 3


def region_parents(levels: DataFrame) -> DataFrame:
    """(geo, level) -> (geo3, geo2, geo1, geo0) of the leaf regions."""
    leaf = F.col("geo")
    return levels.where(F.col("level") == LEAF_LEVEL).select(
        leaf.alias("geo3"),
        F.substring(leaf, 1, 4).alias("geo2"),
        F.substring(leaf, 1, 3).alias("geo1"),
        F.substring(leaf, 1, 2).alias("geo0"),
    )


def region_levels(regions: DataFrame) -> DataFrame:
    """(geo3 .. geo0) -> every code with its level."""
    codes = F.array(*[F.struct(F.col(f"geo{k}").alias("geo"), F.lit(k).alias("level")) for k in (3, 2, 1, 0)])
    return regions.select(F.inline(codes)).distinct()


def ancestors(regions: DataFrame) -> DataFrame:
    """(parent, level, leaf) for the levels above the leaves."""
    codes = F.array(*[F.struct(F.col(f"geo{k}").alias("parent"), F.lit(k).alias("level")) for k in (2, 1, 0)])
    return regions.select(F.inline(codes), F.col("geo3").alias("leaf"))


def attach_level(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows whose code is known, with the level of the code."""
    return df.join(levels, "geo")


def majority_level(df: DataFrame, levels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent level among the distinct codes (per `by`); of equally frequent ones the lowest."""
    counts = attach_level(df.select(*by, "geo").distinct(), levels).groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("level"))


def infer_level(df: DataFrame, levels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Finest level that occurs (per `by`), found over the whole table."""
    return attach_level(df.select(*by, "geo").distinct(), levels).groupBy(*by).agg(F.max("level").alias("level"))


def expand_to_children(df: DataFrame, regions: DataFrame, level: int) -> DataFrame:
    """Every row of that level repeated for each leaf below it; rows of other levels are dropped."""
    parent = f"geo{level}"
    children = regions.select(F.col(parent).alias("_parent"), F.col("geo3").alias("_leaf"))
    lifted = df.withColumnRenamed("geo", "_parent").join(children, "_parent")
    return lifted.withColumnRenamed("_leaf", "geo").select(*df.columns)


def expand_to_children_right(df: DataFrame, regions: DataFrame, level: int) -> DataFrame:
    """The same, and leaves whose parent has no row appear once with NULLs."""
    parent = f"geo{level}"
    present = df.select(F.col("geo").alias(parent)).distinct()
    childless = regions.join(present, parent, "left_anti").select(F.col("geo3").alias("geo"))
    return expand_to_children(df, regions, level).unionByName(childless, allowMissingColumns=True)


#: Rows that a part of a parent makes, and that a task makes of several parts.
_PART_ROWS, _TASK_ROWS = 1 << 18, 1 << 20


def _lift(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Rows with `_level` above the leaves, their code replaced by each leaf below it.

    The leaves of a parent, and its rows where there are more than leaves can divide, are dealt out to parts that make
    about equally many rows, and the parts to as many tasks as the result needs: so neither few parents nor a large one
    keep it to few tasks, however small the two sides are.
    """
    keys = ["_parent", "_level"]
    upper = rows.where(F.col("_level") < LEAF_LEVEL).withColumnRenamed("geo", "_parent")
    tree = tree.withColumnRenamed("parent", "_parent")
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((upper, "_rows"), (tree, "_leaves"))]
    made = F.col("_rows") * F.col("_leaves")
    sized = counts[0].join(counts[1], keys).withColumns({"_made": made, "_shares": F.least("_leaves", F.ceil(made / _PART_ROWS))})
    parts = materialise(sized.withColumn("_cuts", F.ceil(F.col("_made") / _PART_ROWS / F.col("_shares"))))  # of known size, as the levels
    tasks = -(-(parts.agg(F.sum("_made")).first()[0] or 1) // _TASK_ROWS)

    def dealt(df: DataFrame, own: str, by: list[str], other: str) -> DataFrame:
        """Each row in one of its parent's parts `own`, and once in each of the parts of the other side."""
        known = df.join(parts.select(*keys, "_shares", "_cuts"), keys)
        placed = known.withColumns({f"{own}_at": F.pmod(F.xxhash64(*by), own) + 1, f"{other}_at": F.explode(F.sequence(F.lit(1).cast("long"), other))})
        return placed.drop("_shares", "_cuts").repartition(tasks, *keys, "_shares_at", "_cuts_at")

    values = [c for c in rows.columns if c not in ("geo", "_level")]
    leaves = dealt(tree.withColumnRenamed("leaf", "geo"), "_shares", ["geo"], "_cuts")
    return dealt(upper, "_cuts", values, "_shares").join(leaves, [*keys, "_shares_at", "_cuts_at"]).select(*rows.columns)


def resample_space(
    df: DataFrame, regions: DataFrame, levels: DataFrame, level_policy: str = "majority", by: Sequence[str] = ()
) -> DataFrame:
    """Lift a table to leaf regions, each dataset named by `by` from its own level.

    `majority`: the most frequent level decides; a leaf-level dataset is passed on as it is, of others only the rows of
    the deciding level are repeated for their leaves. `finest`: the finest level present decides, only its rows count,
    and leaves without a value appear with NULL. A dataset none of whose codes is known is an error.
    """
    choose = {"majority": majority_level, "finest": infer_level}[level_policy]
    df = materialise(df)  # the levels, the rows of leaves and the rows above them each start from it
    chosen = choose(df, levels, by).withColumnRenamed("level", "_level")
    if by:
        chosen = df.select(*by).distinct().join(chosen, list(by), "left")
    chosen = require(chosen, F.col("_level").between(0, LEAF_LEVEL), "a dataset without known region codes, or a region level not between 0 and 3")
    chosen = materialise(chosen)  # a stored table has a size by which Spark decides whether to send it along
    placed = df.join(chosen, list(by)) if by else df.withColumn("_level", chosen.select("_level").scalar())
    tree = ancestors(regions).withColumnRenamed("level", "_level")

    # Leaf-level rows pass as they are.
    leaf_rows = placed.where(F.col("_level") == LEAF_LEVEL).select(*df.columns)
    lifted = leaf_rows.unionByName(_lift(placed, tree).select(*df.columns))
    if level_policy == "majority":
        return lifted

    # Rows of a leaf-level dataset that are no leaves themselves do not count.
    codes = levels.where(F.col("level") == LEAF_LEVEL)
    lifted = lifted.join(codes, "geo", "left_semi").select(*df.columns)
    # Leaves of each lifted dataset's level whose parent has no row. The right join counts datasets times leaves.
    wanted = chosen.where(F.col("_level") < LEAF_LEVEL).join(tree, "_level")
    present = placed.select(*by, F.col("geo").alias("parent")).distinct()
    childless = wanted.join(present, [*by, "parent"], "left_anti").select(*by, F.col("leaf").alias("geo"))
    return lifted.unionByName(childless, allowMissingColumns=True)
