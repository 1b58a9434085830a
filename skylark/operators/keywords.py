"""Keyword metrics: cleaned records, monthly series, growth and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import linear_trend, micros_to_unit, trend_pct

# Names of months in the keyword service.
MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()
METRICS = (
    "struct<avgMonthlySearches:string,competition:string,competitionIndex:string,averageCpcMicros:string,lowTopOfPageBidMicros:string,"
    "highTopOfPageBidMicros:string,monthlySearchVolumes:array<struct<year:string,month:string,monthlySearches:string>>>"
)
RESPONSE = (
    f"results array<struct<text:string,keywordIdeaMetrics:{METRICS},keywordMetrics:{METRICS},closeVariants:array<string>,"
    "keywordAnnotations:struct<concepts:array<struct<name:string,conceptGroup:struct<name:string>>>>>>"
)


def _number(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def monthly_series(volumes: Column) -> Column:
    """array<struct<month date, volume double>> in order; points without year, month or volume are dropped."""
    names = F.array(*map(F.lit, MONTHS))
    month = lambda v: F.coalesce(F.nullif(F.array_position(names, F.upper(v["month"])).cast("int"), F.lit(0)), v["month"].try_cast("int"))
    date = lambda v: F.when(month(v).between(1, 12), F.make_date(v["year"].try_cast("int"), F.greatest(F.least(month(v), F.lit(12)), F.lit(1)), F.lit(1)))
    points = F.transform(volumes, lambda v: F.struct(date(v).alias("month"), _number(v["monthlySearches"]).alias("volume")))
    return F.array_sort(F.filter(points, lambda p: p["month"].isNotNull() & p["volume"].isNotNull()))


def with_trends(df: DataFrame, volumes: str = "searchVolume") -> DataFrame:
    """df with growth in percent over 12, 3 and 2 points (yoy, three_months, one_month) and the linear trend."""
    pct = {"yoy": 12, "three_months": 3, "one_month": 2}
    return df.select("*", *[trend_pct(volumes, n).alias(k) for k, n in pct.items()], linear_trend(volumes).alias("trend"))


def keyword_records(responses: DataFrame, payload: str = "payload", zeros_to_null: bool = True) -> DataFrame:
    """One row a keyword of JSON responses, with metrics, monthly series, concepts and trends.

    Results without text are dropped; numbers may come as strings; prices come in millionths, and zero prices
    are null unless kept. A payload that is no JSON gives no rows.
    """
    parsed = responses.select(F.explode(F.from_json(payload, RESPONSE)["results"]).alias("r")).filter("r.text is not null and r.text <> ''")
    m = F.coalesce("r.keywordIdeaMetrics", "r.keywordMetrics")
    price = lambda f: micros_to_unit(_number(m[f]), zeros_to_null)
    series = monthly_series(m["monthlySearchVolumes"])
    named = lambda xs, *skip: F.nullif(F.array_distinct(F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(*skip))), F.array().cast("array<string>"))
    concepts = F.col("r.keywordAnnotations.concepts")
    out = parsed.select(
        F.col("r.text").alias("keyword"),
        _number(m["avgMonthlySearches"]).alias("avgMonthlySearches"),
        F.nullif(m["competition"], F.lit("")).alias("competition"),
        _number(m["competitionIndex"]).alias("competitionIndex"),
        price("averageCpcMicros").alias("averageCpc"),
        price("lowTopOfPageBidMicros").alias("lowTopOfPageBid"),
        price("highTopOfPageBidMicros").alias("highTopOfPageBid"),
        F.transform(series, lambda p: p["volume"]).alias("searchVolume"),
        F.transform(series, lambda p: p["month"]).alias("searchVolumeDate"),
        named(F.transform(concepts, lambda c: c["name"]), "Others", "Non-Brands").alias("concepts"),
        named(F.transform(concepts, lambda c: c["conceptGroup"]["name"]), "Others").alias("conceptGroups"),
        F.nullif(F.col("r.closeVariants"), F.array().cast("array<string>")).alias("closeVariants"),
    )
    return with_trends(out)


def series_trends(points: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Growth and trend of a long series (keys, month, value): one row a key.

    Least squares by aggregation over the month's index; the growth from the values at the end.
    """
    w = Window.partitionBy(*keys).orderBy(month)
    placed = points.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    back = lambda n: F.max(F.when(F.col("_i") == F.col("_n") - n, F.col(value)))
    pct = lambda n: F.when(F.max("_n") >= n, (back(1) - back(n)) / F.when(back(n) == 0, 1.0).otherwise(back(n)) * 100)
    slope = F.regr_slope(F.col(value), F.col("_i").cast("double"))
    return placed.groupBy(*keys).agg(
        F.max("_n").alias("points"), pct(12).alias("yoy"), pct(3).alias("three_months"), pct(2).alias("one_month"),
        F.when((F.max("_n") >= 3) & (F.avg(value) != 0), F.try_divide(slope, F.avg(value))).alias("trend"),
    )
