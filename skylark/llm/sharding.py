"""Sharding [native]: contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_prefix


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1 for the separator; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(df: DataFrame, order: Sequence[Column | str], size: Column, n_shards: int = 16) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (row number in its shard, gapless from 0).

    Rows in the given order; shard i takes the rows whose middle byte falls in the i-th of n equal stretches
    of all bytes, so each shard is one contiguous range and its bytes differ from the target by less than the
    rows at its two ends. A size is at least 1. Nulls sort first; rows equal in all order columns are
    interchangeable; an empty table gives no rows. Columns of df named shard or slot are replaced.
    """
    base = df.drop("shard", "slot").withColumn("_size", F.greatest(size.cast("long"), F.lit(1)))
    placed = global_prefix(base, order, {"_bytes": F.col("_size"), "_rows": F.lit(1).cast("long")})
    shard = F.expr(f"least(({n_shards}L * (2 * _bytes_before + _size)) div (2 * _bytes_total), {n_shards - 1}L)").cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("_rows_before").alias("_first"))  # n_shards rows
    out = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rows_before") - F.col("_first"))
    return out.drop("_size", "_first", *[f"{k}_{x}" for k in ("_bytes", "_rows") for x in ("before", "total")])
