"""Country trajectories: axis names, events, changes and states."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import axis_of, domain_of
from ..schema import AXIS_COLUMNS, POINT_STATES
from ..runtime import materialise
from .keys import category_order, concat_unique
from .reshape import to_long


def parse_axis_names(df: DataFrame) -> DataFrame:
    """CCX1 .. CCZ3 columns -> (country, year, domain, cca_axis, value)."""
    named = df.withColumnRenamed("Country Code", "country")
    long = to_long(named, ["country", "year"], AXIS_COLUMNS, "name", "value")
    return long.select("country", "year", domain_of("name").alias("domain"), axis_of("name").alias("cca_axis"), "value")


def events_by_year(events: DataFrame) -> DataFrame:
    """Intervals -> (country, year, event), one row per year they cover."""
    return events.select("country", F.explode(F.sequence("from", "to")).alias("year"), "event")


def with_events(df: DataFrame, events: DataFrame) -> DataFrame:
    """Rows with the events of their country and year; a year with several events appears once for each."""
    yearly = events_by_year(events).withColumn("year", F.col("year").cast(df.schema["year"].dataType))
    return df.join(yearly, ["country", "year"], "left").withColumn("during_event", F.col("event").isNotNull())


def event_text(df: DataFrame, sep: str = ", ") -> DataFrame:
    """(country, year, events): the distinct events of a year in one text."""
    return concat_unique(df, ["country", "year"], "event", sep, "events")


def lag_by(df: DataFrame, part: Sequence[str], order: str, col: str, name: str, span: int = 64) -> DataFrame:
    """Value of the row before, within `part` and by the number `order`, which must identify a row there.

    A group is cut into blocks of `span` order units that different tasks handle; only the last value of every block
    goes on to the next one. The ends of the blocks are carried on in the same way, by blocks of blocks, until a group
    has at most `span` of them: so no task sees more than `span` places of a group, however long it is.
    """
    low, high = df.agg(F.floor(F.min(order) / span), F.floor(F.max(order) / span)).first()
    return _lagged(df, list(part), order, col, name, span, int(low or 0), int(high or 0))


def _lagged(df: DataFrame, part: list[str], order: str, col: str, name: str, span: int, low: int, high: int) -> DataFrame:
    """`low` and `high`: the first and the last block of `span` units that a group can have."""
    block = F.floor(F.col(order) / span)
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*part, "_block").orderBy(order)
    ends = blocked.groupBy(*part, "_block").agg(F.max_by(F.struct(F.col(col).alias("v")), order).alias("_end"))
    wider = max(span, 2)  # blocks of one unit would never get fewer
    if high - low >= wider:
        ends = _lagged(ends.withColumnRenamed("_block", "_place"), part, "_place", "_end", "_before", wider, low // wider, high // wider)
        ends = ends.withColumnRenamed("_place", "_block")
    else:
        ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*part).orderBy("_block")))
    ends = ends.select(*[F.col(c).alias(f"_p{k}") for k, c in enumerate(part)], F.col("_block").alias("_b"), "_before")
    same = reduce(
        Column.__and__, [F.col(c).eqNullSafe(F.col(f"_p{k}")) for k, c in enumerate(part)],
        F.col("_block").eqNullSafe(F.col("_b")),
    )
    first = F.row_number().over(inside) == 1
    return (
        blocked.withColumn("_first", first).withColumn("_lag", F.lag(col).over(inside))
        .join(ends, same, "left")
        .select(*df.columns, F.when(F.col("_first"), F.col("_before.v")).otherwise(F.col("_lag")).alias(name))
    )


def abs_lag_diff(df: DataFrame, part: Sequence[str], order: str, col: str, name: str = "derivative") -> DataFrame:
    """Absolute change since the row before; NULL in the first row of each group."""
    return lag_by(df, part, order, col, "_previous").withColumn(name, F.abs(F.col(col) - F.col("_previous"))).drop("_previous")


def trajectory_state(df: DataFrame, country: str, year) -> DataFrame:
    """Point and path groups, label and size of every point for one chosen country and year."""
    here, now = F.col("country") == country, F.col("year") == year
    point = (
        F.when(now & here, "current_point").when(here, "normal").when(now, "current_year").otherwise("normal")
    )
    return df.withColumns({
        "point_group": point,
        "path_group": F.when(here & (F.col("year") <= year), "current_country"),
        "country_label": F.when(now, F.col("country")),
        "point_size": F.when(now & here, F.lit(2.5)).otherwise(F.lit(1.0)),
        "plot_order": category_order(point, POINT_STATES),
    })


def sort_by_state(df: DataFrame) -> DataFrame:
    return df.orderBy("plot_order", "year", "country")


def _block(place: Column, level: Column | int) -> Column:
    """The block of a level that holds the place; shifts are exact for every whole number, divisions are not beyond 2^53."""
    return F.call_function("shiftright", place, F.lit(level) if isinstance(level, int) else level)


def dyadic_pieces(start: Column, end: Column, levels: int) -> Column:
    """The blocks (level, block) that make up start..end, both ends included; block b of level j holds b * 2^j .. (b + 1) * 2^j - 1.

    At each level at most the first and the last block that the next level cannot take are used: O(levels) in all.
    """

    start, end = start.cast("long"), end.cast("long")

    def within(level: int) -> tuple[Column, Column]:
        return -_block(-start, level), _block(end + 1, level)  # blocks low .. high - 1 lie within

    def piece(level: int, block: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), block.alias("block"))

    ends = []
    for level in range(levels - 1):
        low, high = within(level)
        odd_low, odd_high = low.bitwiseAND(1) == 1, high.bitwiseAND(1) == 1
        ends += [F.when(odd_low & (low < high), piece(level, low)), F.when(odd_high & (low + low.bitwiseAND(1) < high), piece(level, high - 1))]
    low, high = within(levels - 1)  # the last level takes all that is left
    rest = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))
    left = F.transform(rest, lambda block: piece(levels - 1, block))
    return F.array_compact(F.concat(F.array(*ends), left)) if ends else left


#: Blocks that an interval of mean length is cut into at most, and the longest one, at the last level.
_MEAN_PIECES, _MOST_PIECES = 4, 1 << 16

#: Blocks of intervals that a task of the join has, about, and tasks at most.
_TASK_PIECES, _MOST_TASKS = 1 << 14, 1 << 12


def _levels(length: Column, held: DataFrame) -> tuple[int, int, int]:
    """The finest level of blocks, of about the typical length, the number of levels, and the tasks to deal them out to.

    Every level sends all points once more; coarser blocks send fewer rows but leave more pairs to compare. The typical
    length is the geometric mean, which a few long intervals hardly move; these are left to coarser levels.
    """
    n, longest, mean, scale = held.agg(F.count(F.lit(1)), F.max(length), F.avg(length), F.avg(F.log2(length))).first()
    finest = min(int(scale or 0), 62)  # a shift has 6 bits
    coarse = [math.ceil(math.log2(x)) for x in ((mean or 0) / _MEAN_PIECES, (longest or 0) / _MOST_PIECES) if x]
    last = min(max(finest, *coarse, 0), 62)
    pieces = n * (1 + 2 * (last - finest) + (mean or 0) / 2**last)
    return finest, last - finest + 1, max(1, min(math.ceil(pieces / _TASK_PIECES), _MOST_TASKS))


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, how: str = "inner"
) -> DataFrame:
    """Points with the intervals of their keys that hold them: start <= at <= end, in whole numbers or dates.

    An interval is cut into the blocks it touches, of about the typical length; where some intervals are much longer, those
    use blocks of doubling size, at most two a level. A point meets the blocks that hold it, one a level: mostly there is one
    level, and points are sent once. So the join is by equal values, whatever the intervals' lengths, and makes no row per
    unit of time; a point and an interval meet in one block only, where the ends are compared. An interval given backwards
    holds the same points; one without an end, or without a key, and a point without a place hold and are in nothing. With
    `how="left"` points in no interval stay, once, with missing values. Columns of both sides keep their names; those of the
    intervals' keys go.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join {how}")

    def number(df: DataFrame, name: str) -> Column:
        return (F.unix_date(name) if dict(df.dtypes)[name] == "date" else F.col(name)).cast("long")

    rest = {f"_i{k}": c for k, c in enumerate(c for c in intervals.columns if c not in keys)}  # columns of their own: unused ones are not sent
    ends = number(intervals, start), number(intervals, end)
    held = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    low, high = F.least(*ends), F.greatest(*ends)
    finest, levels, tasks = _levels(high.cast("double") - low.cast("double") + 1, held)
    spans = held.select(*keys, *[F.col(c).alias(name) for name, c in rest.items()], low.alias("_low"), high.alias("_high"))
    pieces = dyadic_pieces(_block(F.col("_low"), finest), _block(F.col("_high"), finest), levels)
    cut = spans.select("*", F.inline(pieces).alias("_level", "_block"))
    if how == "left":
        points = materialise(points.withColumn("_point", F.monotonically_increasing_id()))
    every = points.where(F.col(at).isNotNull()).select("*", F.explode(F.array(*map(F.lit, range(levels)))).alias("_level"))
    held_in = every.withColumn("_block", _block(number(points, at), F.col("_level") + finest))
    place = ["_block", "_level", *keys]  # numbers first: most rows are put in order by the block alone
    pairs = held_in.repartition(tasks, *place).join(cut.repartition(tasks, *place), place)  # tasks by what they make: what is sent is small
    met = pairs.where(number(points, at).between(F.col("_low"), F.col("_high")))
    named = [F.col(name).alias(c) for name, c in rest.items()]
    if how == "inner":
        return met.select(*points.columns, *named)
    joined = points.join(met.select("_point", *rest), "_point", "left")
    return joined.select(*[c for c in points.columns if c != "_point"], *named)
