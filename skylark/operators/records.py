"""Operations on records: order, keep-first and keep-last, samples, batches with usage and cost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order; rows without key are dropped."""
    first = df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return first.filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, at the place (`_at`) of the key's first row; rows without key are dropped.

    An aggregation, so hot keys combine before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(order)).alias("_row"), F.min(order).alias("_at"))
    return kept.select("_row.*", "_at")


def sample_rows(df: DataFrame, n: int, seed: int = 0, ident: str | None = None) -> DataFrame:
    """n rows without replacement (all if there are fewer); with an id column the same ones on every run."""
    key = F.xxhash64(F.lit(seed), F.col(ident)) if ident else F.rand(seed)
    return df.withColumn("_r", key).orderBy("_r", *([ident] if ident else [])).limit(n).drop("_r")


def empty_record(columns: Sequence[Column]) -> Column:
    """True if all of a record's values are null or blank."""
    return reduce(lambda a, c: a & is_blank(c.cast("string")), columns, F.lit(True))


def record_json(df: DataFrame) -> Column:
    """A record as JSON, without null fields."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def attribute_sections(df: DataFrame, order: str) -> DataFrame:
    """(ord, section): a heading for each column and its values in order, without nulls and empty strings.

    Columns are unpivoted and gathered by one aggregation; meant for the records that go into one prompt.
    """
    cols = [c for c in df.columns if c != order]
    title = lambda c: " ".join(w[:1].upper() + w[1:] for w in c.split("_"))
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(title(c)).alias("title"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    rows = df.select(F.col(order).alias("_o"), F.explode(cells).alias("x")).select("_o", "x.*").filter("v is not null and v <> ''")
    values = F.transform(F.array_sort(F.collect_list(F.struct("_o", "v"))), lambda x: x["v"])
    joined = rows.groupBy("ord", "title").agg(F.array_join(values, ", ").alias("values"))
    return joined.select("ord", F.concat(F.lit("## "), "title", F.lit("\n\n"), "values").alias("section"))


def model_key(model: Column) -> Column:
    """A model id without its date."""
    return F.regexp_replace(model, r"-\d{4}-\d{2}-\d{2}$", "")


def with_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """usage (model, inputTokens, outputTokens, totalTokens) with cost in units of the price table.

    Prices are for a million tokens, by exact model id, else by the id without date; cost is null for unknown
    models and where both prices are 0. Cache and reasoning prices don't count.
    """
    price = pricing.groupBy(F.col("model").alias("_m")).agg(F.max("input").alias("_i"), F.max("output").alias("_o"))
    exact = price.select(F.col("_m").alias("_e"), F.struct("_i", "_o").alias("_exact"))
    bare = price.select(F.col("_m").alias("_b"), F.struct("_i", "_o").alias("_bare"))
    joined = usage.join(exact, usage["model"] == F.col("_e"), "left").join(bare, model_key(usage["model"]) == F.col("_b"), "left")
    p = F.coalesce("_exact", "_bare")
    cost = F.col("inputTokens") / F.lit(1e6) * p["_i"] + F.col("outputTokens") / F.lit(1e6) * p["_o"]
    return joined.select(*[usage[c] for c in usage.columns], F.when((p["_i"] != 0) | (p["_o"] != 0), cost).alias("cost"))


def total_usage(usage: DataFrame) -> DataFrame:
    """One row: summed tokens and cost, and n, the rows that have usage."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inputTokens", "outputTokens", "totalTokens")]
    return usage.agg(*sums, F.count("totalTokens").alias("n"), F.sum("cost").alias("cost"))
