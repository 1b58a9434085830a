"""Numbers, dates and keyword series as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def number_of(name: str) -> Column:
    """The column as a double; null where it is blank or no finite number."""
    x = F.expr(f"try_cast(nullif(trim(cast({name} as string)), '') as double)")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def micros_to_unit(value: Column | str, zeros_to_null: bool = True) -> Column:
    """Money in millionths as units; zero is null unless kept."""
    unit = col(value).cast("double") / F.lit(1e6)
    return F.nullif(unit, F.lit(0.0)) if zeros_to_null else unit


def round1(value: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(value * 10 + 0.5) / 10


def month_start(year: Column | str, month: Column | str) -> Column:
    """The first day of a month, null for an impossible one."""
    y, m = col(year).cast("int"), col(month).cast("int")
    return F.when(m.between(1, 12), F.make_date(y, F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1)))


def parse_year_month(value: Column | str) -> Column:
    """First day of a strict YYYY-MM; raises otherwise."""
    good = col(value).rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(good, F.to_date(F.concat(col(value), F.lit("-01")))).when(col(value).isNotNull(), F.raise_error(F.concat(F.lit("not a YYYY-MM month: "), col(value))).cast("date"))


def trend_pct(values: Column | str, points: int) -> Column:
    """Growth in percent from the n-th last value to the last; a zero start counts as 1; null with fewer points."""
    v = col(values)
    start = F.try_element_at(v, F.lit(-points)).cast("double")
    last = F.try_element_at(v, F.lit(-1)).cast("double")
    return F.when(F.size(v) >= points, (last - start) / F.when(start == 0, 1.0).otherwise(start) * 100)


def linear_trend(values: Column | str) -> Column:
    """Least squares slope over the index, divided by the mean; null under 3 points or at mean 0."""
    v = F.transform(col(values), lambda x: x.cast("double"))
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    middle = (n - 1) / 2
    cross = F.aggregate(F.transform(v, lambda x, i: (i - middle) * x), F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(F.transform(v, lambda x, i: (i - middle) * (i - middle)), F.lit(0.0), lambda a, x: a + x)
    return F.when((n >= 3) & (total != 0), F.try_divide(F.try_divide(cross, spread), total / n))
