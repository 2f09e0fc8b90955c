"""Long and wide forms, key packing, grids and cube assembly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import united
from ..runtime import materialise
from ..schema import KEYS
from .keys import first_per_key, natural_left_chain, require

# Bits of a BIGINT that can mark one feature each.
_BITS = 62


def to_long(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None, var: str = "var_id", value: str = "value"
) -> DataFrame:
    """One row per id and column; missing values are kept."""
    return df.unpivot(list(ids), list(cols) if cols is not None else None, var, value)


def _marks(var: str, ids: Sequence[str]) -> list[Column]:
    """Per key, which of `ids` occurred: one bit each."""
    marks = []
    for start in range(0, len(ids), _BITS):
        bit = F.lit(0).cast("bigint")
        for k, v in enumerate(ids[start:start + _BITS]):
            bit = F.when(F.col(var) == v, F.lit(1 << k).cast("bigint")).otherwise(bit)
        marks.append(F.bit_count(F.bit_or(bit)))
    return marks


def to_wide(
    df: DataFrame, keys: Sequence[str], var: str, value: str, ids: Sequence[str], prefix: str = ""
) -> DataFrame:
    """One column per name in `ids`, one shuffle on `keys`. A second row for the same key and name is an error."""
    cells = df.where(F.col(var).isin(*ids)).groupBy(*keys).agg(
        *[F.max(F.when(F.col(var) == v, F.col(value))).alias(f"{prefix}{v}") for v in ids],
        (F.count(F.lit(1)) - reduce(Column.__add__, _marks(var, ids))).alias("_repeats"),
    )
    unique = require(cells, F.col("_repeats") == 0, f"more than one value per ({', '.join(keys)}, {var})")
    return unique.drop("_repeats")


def cube_to_long(cube: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(geo, time, var_id, value)"""
    return to_long(cube, KEYS, features)


def union_named(series: Mapping[str, DataFrame], name: str = "var_id") -> DataFrame:
    """Named frames stacked, the name as a column; columns missing in a frame are NULL."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn(name, F.lit(k)) for k, df in series.items()],
    )


def split_named(df: DataFrame, names: Sequence[str], name: str = "var_id") -> dict[str, DataFrame]:
    """The reverse of `union_named`."""
    return {k: df.where(F.col(name) == k).drop(name) for k in names}


def assemble_cube(series: Sequence[DataFrame], features: Sequence[str]) -> DataFrame:
    """Full outer join of all features on (geo, time), written as one union and one aggregation.

    Keys whose values are all missing stay; a repeated (geo, time, var_id) is an error.
    """
    rows = reduce(DataFrame.unionByName, [s.select(*KEYS, "var_id", "value") for s in series])
    return to_wide(rows, KEYS, "var_id", "value", features)


def full_join_all(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Full outer join of many frames with one row per key and columns of their own.

    The frames are stacked and their rows merged by one aggregation, so there is one shuffle however many frames there
    are; a second row for a key within a frame is an error.
    """
    values = [c for f in frames for c in f.columns if c not in keys]
    if len(set(values)) < len(values):
        raise ValueError("the frames share a column that is not a key")
    rows = union_named({str(n): f for n, f in enumerate(frames)}, "_frame")
    names = [str(n) for n in range(len(frames))]
    merged = rows.groupBy(*keys).agg(
        *[F.max(f"`{c}`").alias(c) for c in values],
        (F.count(F.lit(1)) - reduce(Column.__add__, _marks("_frame", names))).alias("_repeats"),
    )
    return require(merged, F.col("_repeats") == 0, f"more than one row per ({', '.join(keys)})").drop("_repeats")


def bind_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns of both frames side by side."""
    return left.join(right, list(keys), "full")


def unite(df: DataFrame, name: str, cols: Sequence[str], sep: str = "_", remove: bool = True) -> DataFrame:
    packed = df.withColumn(name, united(*cols, sep=sep))
    return packed.drop(*[c for c in cols if c != name]) if remove else packed


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = r"[^A-Za-z0-9]+", remove: bool = True) -> DataFrame:
    """Split a packed text at a pattern; surplus names are NULL."""
    parts = F.split(F.col(col), sep)
    rest = [c for c in df.columns if c not in into and not (remove and c == col)]
    return df.select(*rest, *[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(into)])


def prefix_pivot(df: DataFrame, keys: Sequence[str], var: str, value: str, ids: Sequence[str], prefix: str) -> DataFrame:
    return to_wide(df, keys, var, value, ids, prefix)


def grid(*dims: DataFrame) -> DataFrame:
    """Every combination of the axes; the size of the result is what the operator is for."""
    return reduce(DataFrame.crossJoin, dims)


def expected_cells(*dims: DataFrame) -> Column:
    """Number of cells of the axis product, as a scalar."""
    return reduce(Column.__mul__, [d.agg(F.count(F.lit(1))).scalar() for d in dims])


def complete_grid(df: DataFrame, *dims: DataFrame) -> DataFrame:
    """Add the combinations that do not occur, their other columns NULL; rows off the axes are dropped.

    The last axis has one column and is a short one, such as time. The rows of a combination of the other axes become
    one row, which is shuffled, and the last axis is laid out afterwards: the dense grid itself is never shuffled.
    """
    *others, last = dims
    if len(last.columns) != 1:
        raise ValueError("the last axis has one column")
    name = last.columns[0]
    keys = [c for d in others for c in d.columns]
    rest = [c for c in df.columns if c not in (*keys, name)]
    axis = last.agg(F.collect_list(name)).scalar()  # a short axis
    rows = df.join(last, name, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct(name, *rest)).alias("_rows"))
    empty = F.struct(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest])
    fields = [empty[c].alias(c) for c in rest]
    placed = natural_left_chain([grid(*others), rows], keys) if others else rows
    found = F.coalesce(F.col("_rows"), F.array().cast(rows.schema["_rows"].dataType))
    absent = F.transform(F.array_except("_axis", F.transform(found, lambda r: r[name])), lambda a: F.struct(a.alias(name), *fields))
    return placed.withColumn("_axis", axis).select(*keys, F.inline(F.concat(found, absent))).select(*df.columns)


#: Places of the short axis that one row of `conformed_rows` has, and regions of which a task makes the empty places.
_SLOTS, _TASK_REGIONS = 16, 1 << 13


def conformed_rows(
    series: DataFrame, dim_time: DataFrame, dim_geo: DataFrame, order: Sequence[str] | None = None
) -> tuple[DataFrame, Column]:
    """`conform_to_axes` before its cells become rows, which `laid_out` makes of them, and the time axis as an array.

    A row (var, geo, _stretch, _values) has the values of 16 places of a region, in order and without their labels; places
    beyond the axis have none.
    Cells and the places of the axes meet in one aggregation, which combines before its shuffle: a column for each place
    of a stretch of the time axis, so that neither the dense grid nor the series is shuffled row by row.
    """
    labels = dim_time.agg(F.sort_array(F.collect_set("label")).alias("labels"))  # a short axis
    times = materialise(labels.select(F.posexplode("labels").alias("_place", "time")))  # its size is known: it is sent along
    axis = times.agg(F.sort_array(F.collect_list("time"))).scalar()
    geos, variables = dim_geo.select(F.col("label").alias("geo")), series.select("var").distinct()
    rows = series.dropna(subset=["geo", "time"])
    if order:
        rows = first_per_key(rows, ["var", "geo", "time"], list(order))
    stretch, slot = F.floor(F.col("_place") / _SLOTS).cast("int"), (F.col("_place") % _SLOTS).cast("int")
    value = F.col("values")
    placed = rows.join(times, "time").select("var", "geo", stretch.alias("_stretch"), slot.alias("_slot"), "values", F.lit(0).alias("_wanted"))
    stretches = times.select(stretch.alias("_stretch")).distinct()
    dealt = geos.repartition(-(-geos.count() // _TASK_REGIONS) or 1, "geo")  # a short table would make the whole grid in one task
    wanted = grid(variables, dealt, stretches).select(
        "var", "geo", "_stretch", F.lit(None).cast("int").alias("_slot"), F.lit(None).cast(series.schema["values"].dataType).alias("values"), F.lit(1).alias("_wanted")
    )
    found = placed.unionByName(wanted).groupBy("var", "geo", "_stretch").agg(
        *[F.min(F.when(F.col("_slot") == k, value)).alias(f"_v{k}") for k in range(_SLOTS)],
        F.bit_or(F.when(value.isNull(), F.call_function("shiftleft", F.lit(1), F.col("_slot")))).alias("_empty"),
        F.sum("_wanted").alias("_wanted"),
    ).where(F.col("_wanted") > 0)
    # NaN is the largest value, and a missing one goes before it.
    known = lambda k: F.when(~(F.isnan(f"_v{k}") & (F.coalesce("_empty", F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0)), F.col(f"_v{k}"))
    values = F.array(*[known(k) for k in range(_SLOTS)])
    repeated = F.when(F.col("_wanted") == 1, F.col("_values")).otherwise(F.flatten(F.array_repeat("_values", F.col("_wanted").cast("int"))))
    return found.select("var", "geo", "_stretch", "_wanted", values.alias("_values")).select("var", "geo", "_stretch", repeated.alias("_values")), axis


def laid_out(rows: DataFrame, axis: Column) -> DataFrame:
    """Rows of `conformed_rows`, with any other columns -> a row (time, values) per cell.

    Labels are looked up cell by cell and are never shuffled. No row is without values, so the outer form adds none; of the
    other one Spark derives a filter that repeats the making of the array, in a method too long to be compiled.
    """
    others = [c for c in rows.columns if c not in ("_stretch", "_values")]
    cells = rows.select(*others, "_stretch", F.posexplode_outer("_values").alias("_at", "values"))
    time = F.get(axis, F.col("_stretch") * _SLOTS + F.col("_at") % _SLOTS)
    return cells.select(*others, time.alias("time"), "values").where(F.col("time").isNotNull())


def conform_to_axes(
    series: DataFrame, dim_time: DataFrame, dim_geo: DataFrame, fill: float | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Every variable of (var, geo, time, values) on the full (label, ord) axes.

    Rows off the axes are dropped, of several rows for one cell the first under `order` counts (by default the smallest
    value that is not missing), absent cells are added, and missing values become `fill`.
    """
    full = laid_out(*conformed_rows(series, dim_time, dim_geo, order))
    return full if fill is None else full.withColumn("values", F.coalesce("values", F.lit(fill)))


def version_long(df: DataFrame, keys: Sequence[str], sep: str = "-", version: str = "version") -> DataFrame:
    """Columns named `field-version` -> one row per version. The names are in the schema, so nothing is shuffled."""
    by_version: dict[str, dict[str, str]] = defaultdict(dict)
    for c in df.columns:
        if c not in keys and sep in c:
            field, tag = c.split(sep, 1)
            by_version[tag][field] = c
    fields = list(dict.fromkeys(f for cols in by_version.values() for f in cols))
    rows = [
        F.struct(F.lit(tag).alias(version), *[
            (F.col(f"`{cols[f]}`") if f in cols else F.lit(None)).alias(f) for f in fields
        ])
        for tag, cols in by_version.items()
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def suffix_columns(df: DataFrame, cols: Sequence[str], tag: str, sep: str = "-") -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{sep}{tag}" for c in cols})


def columns_except(df: DataFrame, stable: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in stable]


def move_first(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *columns_except(df, first))
