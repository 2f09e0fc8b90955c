"""Regions as covers of square cells of mixed size, and their overlap by joins of codes.

A cell of level l holds 2^l x 2^l unit cells. Its code interleaves the bits of its corner, so the code of the cell around it
is the code without its last two bits, and two cells overlap only if one lies in the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

#: Added to both coordinates, which lie between -2^30 and 2^30 - 1. Levels of cells: up to this one.
ORIGIN, TOP = 1 << 30, 31


def _spread(v: Column) -> Column:
    """The 32 bits of a number in every second place of 64."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
    return v


def cell_code(x: Column, y: Column) -> Column:
    """The code of a unit cell; a place out of range is an error, a missing one has no code."""
    inside = (x >= -ORIGIN) & (x < ORIGIN) & (y >= -ORIGIN) & (y < ORIGIN)
    code = _spread(x.cast("long") + ORIGIN).bitwiseOR(F.shiftleft(_spread(y.cast("long") + ORIGIN), 1))
    return F.when(inside, code).when(~inside, F.raise_error(F.lit("a cell is out of range")).cast("long"))


def quad_cover(cells: DataFrame) -> DataFrame:
    """(region, level, code): the fewest cells that cover the unit cells (region, cell_x, cell_y) of each region exactly.

    Four cells that make up the one around them become it, level by level; each pass works on the cells the last one
    made. Repeated rows count once, rows without a region or place are left out.
    """
    units = cells.where("region is not null and cell_x is not null and cell_y is not null")
    now = materialise(units.select("region", cell_code(F.col("cell_x"), F.col("cell_y")).alias("code")).distinct())
    done = []
    for level in range(TOP):
        around = F.shiftright("code", 2)
        four = now.groupBy("region", around.alias("_around")).agg(F.count(F.lit(1)).alias("_n"), F.collect_list("code").alias("_codes"))  # at most 4
        four = materialise(four)
        done.append(four.where("_n < 4").select("region", F.lit(level).alias("level"), F.explode("_codes").alias("code")))
        now = four.where("_n = 4").select("region", F.col("_around").alias("code"))
        if now.isEmpty():
            break
    else:
        done.append(now.select("region", F.lit(TOP).alias("level"), "code"))
    return reduce(DataFrame.unionByName, done)


def cover_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, area): unit cells that each region of cover `a` shares with each region of cover `b`.

    Of two overlapping cells the larger or equal one has the code of the smaller one's surroundings at its level, so both
    meet by level and code. Each cell asks only at the levels the other cover has; nothing is compared by place.
    """
    levels_a, levels_b = (sorted(r[0] for r in c.select("level").distinct().collect()) for c in (a, b))  # at most TOP + 1

    def met(small: DataFrame, large: DataFrame, levels: list[int], least: int) -> DataFrame:
        """Cells of `small` in those of `large` that are at least `least` levels larger."""
        at = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda l: l >= F.col("level") + least)).alias("_at")
        asked = small.select(F.col("region").alias("_small"), "level", "code", at)
        asked = asked.select("_small", "level", "_at", F.call_function("shiftright", "code", 2 * (F.col("_at") - F.col("level"))).alias("_code"))
        found = asked.join(large.select(F.col("level").alias("_at"), F.col("code").alias("_code"), F.col("region").alias("_large")), ["_at", "_code"])
        return found.select("_small", "_large", F.pow(F.lit(4.0), F.col("level")).alias("area"))

    inside = met(a, b, levels_b, 0).select(F.col("_small").alias("a"), F.col("_large").alias("b"), "area")
    around = met(b, a, levels_a, 1).select(F.col("_large").alias("a"), F.col("_small").alias("b"), "area")
    return inside.unionByName(around).groupBy("a", "b").agg(F.sum("area").alias("area"))


def largest_overlap_of_covers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(region, other, overlap): for every region of cover `a` the region of `b` it shares most with, NULL if none.

    Of equally large overlaps the lower code counts.
    """
    shared = cover_overlap(a, b).groupBy(F.col("a").alias("region")).agg(
        F.min_by("b", F.struct(-F.col("area"), "b")).alias("other"), F.max("area").alias("overlap")
    )
    # A region without an overlap keeps its area, as cells that no region of `b` holds.
    areas = a.groupBy("region").agg(F.sum(F.pow(F.lit(4.0), F.col("level"))).alias("_area"))
    return areas.join(shared, "region", "left").select("region", "other", F.coalesce("overlap", "_area").alias("overlap"))
