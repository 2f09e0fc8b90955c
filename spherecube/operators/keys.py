"""Key-wise operators: lookups, first and top rows, identifiers, natural joins, nesting.

None of them sorts a whole key group in one task: "first" and "top" are `min_by` aggregates that combine before the
shuffle, identifiers count per range partition, and nesting cuts a large group into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Pass every row on; fail the query at the first row that is not `ok`."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def lookup_first(df: DataFrame, pred: Column, col: str, order: Sequence) -> Column:
    """Value of `col` in the first matching row, as a scalar for use in another query."""
    return df.where(pred).agg(F.min_by(col, F.struct(*order))).scalar()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row of every key under `order`; the other columns are kept. Equal `order` values must mean equal rows."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def slice_rows(df: DataFrame, positions: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Rows at the given 1-based positions of the ordered table; reads no further than the last position."""
    top = df.orderBy(*order).limit(max(positions))
    ranked = top.withColumn("_row", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("_row").isin(*positions)).drop("_row")


def assign_id(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Consecutive numbers 1..n in `order`, which must identify a row.

    Range partitions hold consecutive stretches of the order; each row's number is its place within its partition plus
    the sizes of the partitions before. Only one row per partition meets in the running total.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(starts, "_part").select(*df.columns, (place + F.col("_start")).alias(name))


def number_within(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """Numbers 1..n within each group `by`, in ascending `order` (missing values first); equal rows in any order.

    Range partitions hold consecutive stretches of the groups in order, so a group of any size is spread over tasks. A row's
    number is its place in its group's stretch, plus the stretches before; only groups at the ends of partitions have
    several, of which one row each is summed up. A missing value in `by` is a group of its own.
    """
    group = F.struct(*by).alias("_group")
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")
    )
    ranged = materialise(ranged)
    ends = ranged.groupBy("_part").agg(F.min_by(group, "_place").alias("a"), F.max_by(group, "_place").alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("_group")).distinct()
    keyed = ranged.withColumn("_group", group)
    stretches = keyed.join(ends, "_group", "left_semi").groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.select("_group", "_part", F.sum("_rows").over(before).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_group", "_part").orderBy("_place"))
    numbered = keyed.withColumn("_row", place).join(starts, ["_group", "_part"], "left")
    return numbered.select(*df.columns, (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def natural_left_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins from the first frame on, a missing key equal to a missing key."""

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
        return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])

    return reduce(step, frames)


def common_observations(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys that occur in every frame, a missing key equal to a missing key; one shuffle for all frames."""
    marked = [f.select(*keys, F.lit(n).alias("_frame")) for n, f in enumerate(frames)]
    in_all = reduce(Column.__and__, [F.bool_or(F.col("_frame") == n) for n in range(len(frames))])
    seen = reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(in_all.alias("_in_all"))
    return seen.where("_in_all").drop("_in_all")


def concat_unique(df: DataFrame, keys: Sequence[str], col: str, sep: str, name: str, size: int = 10_000) -> DataFrame:
    """Distinct texts of a key in one text, in ascending order. Repeats are dropped before anything is collected.

    Range partitions number a key's texts, every `size` of them are joined in a task of their own, and only the joined
    chunks of a key meet.
    """
    once = df.select(*keys, col).where(F.col(col).isNotNull()).distinct()
    numbered = number_within(once, keys, [col], "_n").withColumn("_chunk", F.floor((F.col("_n") - 1) / size))
    chunks = numbered.groupBy(*keys, "_chunk").agg(F.array_join(F.sort_array(F.collect_list(col)), sep).alias("_text"))
    ordered = F.sort_array(F.collect_list(F.struct("_chunk", "_text")))
    return chunks.groupBy(*keys).agg(F.array_join(ordered["_text"], sep).alias(name))


def nest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 1000) -> DataFrame:
    """Rows of a key as arrays of structs in column `rows`, about `size` rows to an array.

    A large group becomes many chunks (column `chunk`), so no row holds more than a small part of a hot key. `order`
    spreads the rows over the chunks and must identify a row within its key.
    """
    rest = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_chunks"))
    chunk = F.pmod(F.xxhash64(*order), F.col("_chunks")).alias("chunk")
    return (
        natural_left_chain([df, counts], keys)
        .select(*keys, chunk, F.struct(*rest).alias("_row"))
        .groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("_row")).alias("rows"))
    )


def unnest(nested: DataFrame, keys: Sequence[str], rows: str = "rows") -> DataFrame:
    return nested.select(*keys, F.inline(rows))


def order_levels_within(df: DataFrame, by: Sequence[str], level: str, order: str, name: str = "ord") -> DataFrame:
    """(by..., level, ord): the levels of each group, numbered by their smallest value of `order`, equal ones by name.

    Smallest values combine before the shuffle; the numbers come from range partitions, so a group may have any number of
    levels and none is in one task. A level without a value comes first, a missing level has a number like others.
    """
    smallest = df.groupBy(*by, level).agg(F.min(order).alias("_low"))
    return number_within(smallest, by, ["_low", level], name).drop("_low")


def reorder_levels(df: DataFrame, category: str, by: str, name: str = "ord") -> DataFrame:
    """(category, ord): categories numbered by their smallest `by`, ties by name."""
    lowest = df.groupBy(category).agg(F.min(by).alias("_low"))
    return assign_id(lowest, ["_low", category], name).select(category, name)


def category_order(c, levels: Sequence[str]) -> Column:
    """Position of a value in a declared list of categories; NULL if it is not declared."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), c)
    return F.nullif(at, F.lit(0)).cast("int")
