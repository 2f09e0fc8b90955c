"""Scalar and aggregate expressions built from Spark's own functions; no Python runs per row."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOMAINS

# The patterns codes are recognised by.
COUNTRY_PATTERN = "^[A-z]+"
REGION_CODE_PATTERN = "[A-Z]{2}[A-Z0-9]*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """NaN and NULL are one kind of missing value: NULL."""
    return F.nullif(_col(c), F.lit(float("nan")))


def tidy(c, digits: int = 6) -> Column:
    """Rounded value for display and comparison: no negative zero, and halves go up however they were computed.

    A shift far below the last digit takes values off the exact half, where summation order would decide.
    """
    unit, shift = 10.0 ** digits, 3.7 * 10.0 ** -(digits + 3)
    if isinstance(c, str):
        return F.expr(f"rint((`{c}` + {shift!r}D) * {unit!r}D) / {unit!r}D + 0D")
    return F.rint((c + F.lit(shift)) * F.lit(unit)) / F.lit(unit) + F.lit(0.0)


def ln_positive(c) -> Column:
    """Natural logarithm; NULL where the value is not positive."""
    return F.ln(_col(c))


def replace_zero(c, by: float = 0.001) -> Column:
    c = _col(c)
    return F.when(c == 0, F.lit(by)).otherwise(c)


def strict_mean(c) -> Column:
    """Mean that is NULL as soon as one value is missing."""
    c = clean(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def strict_max_abs(c) -> Column:
    """Largest absolute value; NULL as soon as one value is missing."""
    c = clean(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.max(F.abs(c)))


def quarter_label(c) -> Column:
    """Date -> 'YYYY-Qn'."""
    c = _col(c)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def quarter_number(c) -> Column:
    """Date -> consecutive number of its quarter: a key that is cheap to group and shuffle by."""
    c = _col(c)
    return F.year(c) * 4 + F.quarter(c) - 1


def quarter_name(n) -> Column:
    """Number of a quarter -> 'YYYY-Qn'."""
    n = _col(n)
    return F.concat(F.floor(n / 4).cast("string"), F.lit("-Q"), (F.pmod(n, F.lit(4)) + 1).cast("string"))


def quarter_start(c) -> Column:
    """'YYYY-Qn' -> first day of that quarter; NULL for any other text."""
    c = _col(c)
    year, quarter = F.substring(c, 1, 4).try_cast("int"), F.substring(c, 7, 1).try_cast("int")
    well_formed = (F.length(c) == 7) & (F.substring(c, 5, 2) == "-Q") & quarter.between(1, 4)
    return F.when(well_formed, F.make_date(year, quarter * 3 - 2, F.lit(1)))


def days_since(c, epoch: str = "1970-01-01") -> Column:
    return F.datediff(_col(c), F.lit(epoch).cast("date"))


def country_of(c) -> Column:
    """Leading letters of a region code; NULL if there are none."""
    return F.regexp_substr(_col(c), F.lit(COUNTRY_PATTERN))


def region_code(c) -> Column:
    """First region code within free text; NULL if there is none."""
    return F.regexp_substr(_col(c), F.lit(REGION_CODE_PATTERN))


def recode(c, mapping: dict) -> Column:
    """Replace the values named in `mapping`, keep the others."""
    c = _col(c)
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, c), c)


def domain_of(name) -> Column:
    """'CCY3' -> 'Atmosphere'."""
    return recode(F.regexp_substr(_col(name), F.lit("[XYZ]")), DOMAINS)


def axis_of(name) -> Column:
    """'CCY3' -> 'CCA3'."""
    return F.concat(F.lit("CCA"), F.regexp_substr(_col(name), F.lit("[0-9]")))


def united(*cols, sep: str = "_") -> Column:
    """Columns packed into one text; a missing part reads 'NA'."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def year_label(c, every: int = 5) -> Column:
    """The year itself every `every` years, NULL in between."""
    c = _col(c)
    return F.when(F.pmod(c, F.lit(every)) == 0, c)
