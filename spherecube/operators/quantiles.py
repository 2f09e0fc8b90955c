"""Exact quantiles without sorting the data or gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..runtime import materialise

# Bins a search interval is cut into per pass over the data.
BINS = 1000


@dataclass(frozen=True)
class _Search:
    """The value of 0-based rank `k` among the values of `col` from `low` to `high`."""

    col: str
    k: int
    low: float
    high: float

    def bin(self) -> Column:
        """Bin of a value, NULL outside the interval. Its ends never share a bin, so every pass narrows the search."""
        v = clean(self.col)
        width = (self.high - self.low) / BINS
        at = F.least(F.floor((v - F.lit(self.low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        at = F.when(v == self.low, 0).when(v == self.high, BINS).otherwise(at).cast("int")
        return F.when(v.between(self.low, self.high), at)

    def narrow(self, bins: Sequence[tuple[int, int, float, float]]) -> float | _Search:
        """`bins` are (bin, count, smallest, largest) in order of the bins."""
        k = self.k
        for _, count, smallest, largest in bins:
            if k < count:
                return smallest if smallest == largest else _Search(self.col, k, smallest, largest)
            k -= count
        raise ValueError(f"rank {self.k} lies beyond the values of {self.col}")


def order_statistics(df: DataFrame, searches: Sequence[_Search]) -> list[float]:
    """All open searches share a pass: values are counted by bin of each search, and each goes on within one bin."""
    found: list[float | _Search] = list(searches)
    while any(isinstance(s, _Search) for s in found):
        # Searches for different ranks of one interval share its bins.
        intervals = list(dict.fromkeys((s.col, s.low, s.high) for s in found if isinstance(s, _Search)))
        cells = F.array(*[
            F.struct(F.lit(n).alias("interval"), _Search(c, 0, low, high).bin().alias("bin"), clean(c).alias("v"))
            for n, (c, low, high) in enumerate(intervals)
        ])
        counted = (
            df.select(F.inline(cells)).where(F.col("bin").isNotNull())
            .groupBy("interval", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()  # a row per interval and bin
        )
        bins: dict[int, list] = {n: [] for n in range(len(intervals))}
        for row in sorted(counted, key=lambda r: r["bin"]):
            bins[row["interval"]].append((row["bin"], row["n"], row["low"], row["high"]))
        found = [
            s.narrow(bins[intervals.index((s.col, s.low, s.high))]) if isinstance(s, _Search) else s for s in found
        ]
    return found


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float],
    extent: dict[str, tuple[int, float, float]] | None = None,
) -> dict[str, list[float]]:
    """Quantiles of every column, interpolated linearly between neighbouring values; missing values are skipped.

    `extent` holds number, smallest and largest of each column's values, if they are known already.
    """
    if extent is None:
        row = df.agg(*[F.struct(F.count(clean(c)), F.min(clean(c)), F.max(clean(c))) for c in cols]).first()
        extent = {c: tuple(v) for c, v in zip(cols, row)}
    if not all(n for n, _, _ in extent.values()):
        raise ValueError("a column without values has no quantiles")
    places = {}
    for c in cols:
        last = extent[c][0] - 1
        for p in probs:
            low = min(floor(last * p + 1e-9), last)
            places[c, p] = (low, min(low + 1, last), max(last * p - low, 0.0))
    wanted = sorted({(c, k) for (c, _), (low, high, _) in places.items() for k in (low, high)})
    values = dict(zip(wanted, order_statistics(df, [_Search(c, k, *extent[c][1:]) for c, k in wanted])))

    def between(c: str, low: int, high: int, share: float) -> float:
        return values[c, low] * (1 - share) + values[c, high] * share

    return {c: [between(c, *places[c, p]) for p in probs] for c in cols}


# Values of a group's search interval from which on it is narrowed by bins instead of being gathered in a row.
GATHER = 10_000


def _narrowed(values: DataFrame, open_: DataFrame) -> DataFrame:
    """One refinement of all open searches (_g, _rank, _k, _low, _high): each goes on within the bin that holds its rank.

    Values are counted by group, search and bin, partially before the shuffle, so a hot group is spread over all tasks.
    """
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    share = (v - low) / (high - low) * BINS
    share = F.when(F.isnan(share), 0).otherwise(F.least(share, F.lit(BINS - 1.0)))
    place = F.when(v == low, 0).when(v == high, BINS + 1).otherwise(1 + F.floor(share)).cast("int")
    met = values.join(open_, "_g").where(v.between(low, high))
    bins = met.groupBy("_g", "_rank", "_k", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    upto = F.sum("_n").over(Window.partitionBy("_g", "_rank").orderBy("_bin"))  # at most BINS + 2 rows
    here = bins.withColumn("_before", upto - F.col("_n")).where((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_n")))
    return here.select("_g", "_rank", (F.col("_k") - F.col("_before")).alias("_k"), "_low", "_high", "_n")


def grouped_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], name: str = "quantiles") -> DataFrame:
    """(by..., n, missing, quantiles): exact quantiles of every group, interpolated linearly; NULL where a group has no values.

    A group of up to GATHER values is sorted in its row. Larger ones, of any size, are searched all at once: in each pass
    the values still in question are counted by bin, until GATHER of them are left. Missing values are counted in
    `missing` and otherwise skipped; a missing key is a group of its own.
    """
    values = df.select(F.struct(*by).alias("_g"), clean(col).cast("double").alias("_v"))
    sizes = values.groupBy("_g").agg(
        F.count("_v").alias("_n"), F.count_if(F.col("_v").isNull()).alias("_missing"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    sizes = materialise(sizes)
    values = values.where(F.col("_v").isNotNull())
    last = F.col("_n") - 1
    first = [F.least(F.floor(last * F.lit(float(p)) + 1e-9), last) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(k, F.least(k + 1, last)) for k in first])))

    large = sizes.where(F.col("_n") > GATHER)
    found = None
    if large.isEmpty():
        small = values
    else:
        small = values.join(large.select("_g"), "_g", "left_anti")
        searched = values.join(large.select("_g"), "_g", "left_semi")
        found = materialise(_searched(searched, large.select("_g", F.explode(ranks).alias("_rank"), "_low", "_high", "_n")))
    gathered = small.groupBy("_g").agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
    value = lambda k: F.struct(k.cast("long").alias("_rank"), F.get("_sorted", k.cast("int")).alias("_v"))
    ordered = gathered.join(sizes.select("_g", ranks.alias("_ranks")), "_g").select("_g", F.transform("_ranks", value).alias("_at"))
    if found is not None:
        ordered = ordered.unionByName(found.groupBy("_g").agg(F.collect_list(F.struct("_rank", "_v")).alias("_at")))
    by_rank = F.map_from_entries("_at")
    joined = sizes.join(ordered, "_g", "left").withColumn("_by", by_rank)
    between = []
    for p, k in zip(probs, first):
        low, high = F.col("_by")[k], F.col("_by")[F.least(k + 1, last)]
        between.append(low + (high - low) * F.greatest(last * F.lit(float(p)) - k, F.lit(0.0)))
    return joined.select("_g.*", F.col("_n").alias("n"), F.col("_missing").alias("missing"), F.when(F.col("_n") > 0, F.array(*between)).alias(name))


def _searched(values: DataFrame, searches: DataFrame) -> DataFrame:
    """(_g, _rank, _v): the value of each 0-based rank of the large groups."""
    values = materialise(values)
    open_ = materialise(searches.withColumn("_k", F.col("_rank")).select("_g", "_rank", "_k", "_low", "_high", "_n"))
    done, ready = [], (F.col("_low") == F.col("_high")) | (F.col("_n") <= GATHER)
    while not open_.isEmpty():
        done.append(open_.where(ready))
        open_ = materialise(_narrowed(values, open_.where(~ready).drop("_n")))
    spans = reduce(DataFrame.unionByName, done)
    same = spans.where("_low = _high").select("_g", "_rank", F.col("_low").alias("_v"))
    # Searches of one interval share its values, of which there are at most GATHER.
    rest = spans.where("_low < _high").groupBy("_g", "_low", "_high").agg(F.collect_set(F.struct("_rank", "_k")).alias("_asked"))
    held = values.join(rest, "_g").where(F.col("_v").between(F.col("_low"), F.col("_high")))
    lists = held.groupBy("_g", "_low", "_high").agg(F.sort_array(F.collect_list("_v")).alias("_sorted"), F.any_value("_asked").alias("_asked"))
    return same.unionByName(
        lists.select("_g", F.explode("_asked").alias("_a"), "_sorted").select("_g", "_a._rank", F.get("_sorted", F.col("_a._k").cast("int")).alias("_v"))
    )


@dataclass(frozen=True)
class QuantileOf:
    """An aggregate for the resampling operators: the exact quantile of a group's values.

    `strict` makes it missing where any value of the group is missing.
    """

    prob: float
    strict: bool = False

    def over(self, df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
        found = grouped_quantiles(df, keys, col, [self.prob], "_q")
        value = F.get("_q", F.lit(0))
        if self.strict:
            value = F.when(F.col("missing") == 0, value)
        return found.select(*keys, value.alias(col))


MEDIAN = QuantileOf(0.5)
