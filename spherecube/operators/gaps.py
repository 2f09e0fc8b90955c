"""Runs of missing cells along the time axis, from summaries of blocks that are merged in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a block, which are the bits of a word, and summaries that are merged into one at a time.
BLOCK, MERGED = 64, 64

FIELDS = ("n", "missing", "lead", "trail", "longest", "gaps")


def _struct(*values: Column) -> Column:
    return F.struct(*[v.cast("long").alias(c) for c, v in zip(FIELDS, values)])


def _all_missing(n: Column) -> Column:
    some = F.when(n > 0, 1).otherwise(0)
    return _struct(n, n, n, n, n, some)


def block_summary(mask: Column, n: Column) -> Column:
    """Of a block of `n` places, whose present ones are the set bits: missing places, those at both ends, longest run, runs."""
    bits = F.substring(F.reverse(F.lpad(F.bin(mask), BLOCK, "0")), 1, BLOCK)
    bits = F.substring(bits, F.lit(1), n.cast("int"))
    runs = F.filter(F.split(bits, "1+"), lambda r: F.length(r) > 0)
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return _struct(
        n, F.length(F.replace(bits, F.lit("1"), F.lit(""))), F.length(F.regexp_extract(bits, "^0*", 0)),
        F.length(F.regexp_extract(bits, "0*$", 0)), longest, F.size(runs),
    )


def merged(a: Column, b: Column) -> Column:
    """The summary of two neighbouring stretches. Merging is associative, so blocks may be merged in any grouping."""
    bridge = a["trail"] + b["lead"]
    return _struct(
        a["n"] + b["n"], a["missing"] + b["missing"],
        F.when(a["lead"] == a["n"], a["n"] + b["lead"]).otherwise(a["lead"]),
        F.when(b["trail"] == b["n"], b["n"] + a["trail"]).otherwise(b["trail"]),
        F.greatest(a["longest"], b["longest"], bridge),
        a["gaps"] + b["gaps"] - F.when((a["trail"] > 0) & (b["lead"] > 0), 1).otherwise(0),
    )


def _merged_level(level: DataFrame, keys: list[str], places: int, span: int) -> DataFrame:
    """Summaries (keys..., _block, _s) of blocks of `span` places, merged MERGED at a time; a block without a row is missing."""
    first = F.col("_block") * MERGED

    def child(k: Column) -> Column:
        here = F.transform(F.filter("_all", lambda x: x["_block"] == first + k), lambda x: x["_s"])
        width = F.greatest(F.lit(0), F.least(F.lit(span), F.lit(places) - (first + k) * span))
        return F.coalesce(F.get(here, F.lit(0)), _all_missing(width))

    parents = level.groupBy(*keys, F.floor(F.col("_block") / MERGED).alias("_parent")).agg(F.collect_list(F.struct("_block", "_s")).alias("_all"))  # at most MERGED
    children = F.transform(F.sequence(F.lit(0), F.lit(MERGED - 1)), child)
    return parents.withColumnRenamed("_parent", "_block").select(*keys, "_block", F.aggregate(children, _all_missing(F.lit(0)), merged).alias("_s"))


def gap_runs(cube: DataFrame, axis: DataFrame, features: Sequence[str], key: str = "geo") -> DataFrame:
    """(geo, feature, n, missing, gaps, longest, lead, trail): runs of missing cells of each region and feature.

    `axis` has the places of the time axis (time, ord), ord from 0 on without holes; rows off the axis do not count, and
    a place without a row is missing. gaps: number of runs; longest: places of the longest; lead and trail: places
    before the first and after the last value.

    Presence is a bit, so rows of one block combine before the shuffle. Blocks are summarised, and neighbouring summaries
    are merged, MERGED at a time, until one is left: no window over a region, and no row or group grows with the axis.
    """
    places = axis.count()
    rows = cube.join(axis.select("time", F.col("ord").cast("long").alias("_ord")), "time")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))).alias("_has")) for c in features])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_ord") % BLOCK).cast("int"))
    level = (
        rows.select(key, "_ord", F.inline(cells)).groupBy(key, "feature", F.floor(F.col("_ord") / BLOCK).alias("_block"))
        .agg(F.bit_or(F.when(F.col("_has"), bit).otherwise(F.lit(0).cast("long"))).alias("_mask"))
        .select(key, "feature", "_block", block_summary(F.col("_mask"), F.least(F.lit(BLOCK), places - F.col("_block") * BLOCK)).alias("_s"))
    )
    span, blocks = BLOCK, -(-places // BLOCK)
    while blocks > 1:
        level = _merged_level(level, [key, "feature"], places, span)
        span, blocks = span * MERGED, -(-blocks // MERGED)
    return level.select(key, "feature", *[F.col("_s")[c].alias(c) for c in ("n", "missing", "gaps", "longest", "lead", "trail")])
