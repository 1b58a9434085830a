"""Mixing sources to target weights [native]: Efraimidis-Spirakis keys against word budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_prefix, word_count, written
from .quality_rules import SYMBOLS


def quality_weight(text: Column) -> Column:
    """Share of the characters that are no markup symbols times the share of the lines that are no repeats, 0.05 at least.

    Symbols as in quality_rules, runs of line feeds end a line; no language or word length is favoured. 1 for
    an empty text.
    """
    t = F.coalesce(text, F.lit(""))
    clean = F.lit(1.0) - (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("double") / F.length(t)
    fresh = F.transform(F.array(F.split(t, "\n+")), lambda x: F.size(F.array_distinct(x)).cast("double") / F.size(x))
    return F.when(F.length(t) > 0, F.greatest(clean * F.get(fresh, F.lit(0)), F.lit(0.05))).otherwise(F.lit(1.0))


def uniform(ident: Column, text: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) for an id and its text; the same on every run and every layout."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """One row a source: source_size, target. The target level is the water level that caps leave.

    Sources are weighed by their rank in code point order, null last, with `weights` repeating. A source's
    target is weight x level, at most cap x its size; the excess goes to the others by weight, which is the
    level max over sources i, by cap / weight, of (budget - caps before i) / (weights from i on).
    """
    totals = sizes.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"))
    ranked = global_prefix(totals, [F.col("_source").isNull(), F.col("_source")], {"_rank": F.lit(1).cast("long")})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select("_source", "source_size", F.get(cycle, (F.col("_rank_before") % len(weights)).cast("int")).alias("_w"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(cap))
    level = global_prefix(
        weighed,
        [F.col("_cap") / F.col("_w"), F.col("_source").isNull(), F.col("_source")],
        {"_caps": F.col("_cap"), "_ws": F.col("_w"), "_all": F.col("source_size")},
    ).withColumn("_level", (F.col("_all_total") * F.lit(share) - F.col("_caps_before")) / (F.col("_ws_total") - F.col("_ws_before")))
    level = written(level)
    top = level.agg(F.max("_level")).scalar()
    return level.select("_source", "source_size", F.least("_cap", F.col("_w") * top).alias("target"))


def _keyed(df: DataFrame, ident: str, source: str, text: str, seed: int) -> DataFrame:
    """df with _seat, its place within its source: exponential key, id, size."""
    key = -F.log(uniform(F.col(ident), F.col(text), seed)) / quality_weight(F.col(text))
    return df.withColumn("_seat", F.struct(key.alias("key"), F.col(ident).alias("id"), word_count(F.col(text)).alias("size")))


def _ranked(df: DataFrame, ident: str, source: str, text: str, weights: Sequence[int], share: float, cap: float, seed: int) -> DataFrame:
    """_source, _seat, source_size, target, epochs and picked of each row of df."""
    seats = _keyed(df.select(ident, source, text), ident, source, text, seed)
    keyed = written(seats.select(F.col(source).alias("_source"), "_seat", F.col("_seat.size").alias("size")))
    by_source = [F.col("_source").isNull(), F.col("_source")]
    targets = written(source_targets(keyed, "_source", "size", weights, share, cap))
    ahead = global_prefix(targets, by_source, {"_ahead": F.col("source_size")})
    starts = written(ahead.select(F.col("_source").alias("_s"), "source_size", "target", "_ahead_before"))
    placed = global_prefix(keyed, [*by_source, F.col("_seat")], {"_run": F.col("size")})
    joined = placed.join(starts, F.col("_source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    middle = 2 * (F.col("_run_before") - F.col("_ahead_before")) + F.col("size")
    return joined.withColumn("epochs", epochs).withColumn("picked", (F.col("size") > 0) & (middle <= 2 * rest))


def mix_sources(
    df: DataFrame,
    ident: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row a row of df: id, source, size, source_size, target, epochs (whole passes), picked, taken.

    Whole epochs come first; the rest of the target is filled by exponential keys -ln(u) / quality, smallest
    first within the source, as long as the row's middle word falls within the budget. taken = size x
    (epochs + picked). Keys derive from id and text alone, so reruns agree; rows of the same id and text are
    interchangeable. A null text has size 0 and is taken 0 words; a null source is a source, the last one;
    an empty table gives no rows; other columns are ignored.
    """
    return _ranked(df, ident, source, text, weights, share, cap, seed).select(
        F.col("_seat.id").alias(ident),
        F.col("_source").alias(source),
        "size",
        "source_size",
        "target",
        "epochs",
        "picked",
        (F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))).alias("taken"),
    )


def mix_documents(
    df: DataFrame,
    ident: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: each row of df as many times as mix_sources takes it, with all its columns.

    The rows picked in a source come first in the order of its seats, so its last picked seat decides all
    others: one row a source is joined to the documents (Spark broadcasts it when it is measured to be small)
    and no text is shuffled or sorted. Only where rows of equal id and text straddle that seat are these
    numbered, to take as many as the budget does. Rows without words are taken 0 times. Edge cases as in mix_sources.
    """
    ranked = written(_ranked(df, ident, source, text, weights, share, cap, seed).select("_source", "_seat", "epochs", "picked"))
    last = ranked.groupBy("_source").agg(F.max("epochs").alias("_epochs"), F.max(F.when(F.col("picked"), F.col("_seat"))).alias("_last"))
    last = written(last.withColumnRenamed("_source", "_s"))
    at_last = ranked.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_seat") == F.col("_last")))
    ties = at_last.groupBy(F.col("_s").alias("_t")).agg(F.count("*").alias("_all"), F.count_if("picked").alias("_fit"))
    cuts = written(last.join(ties, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t"))
    met = _keyed(df, ident, source, text, seed).join(cuts, F.col(source).eqNullSafe(F.col("_s"))).filter("_seat.size > 0")
    divided = F.coalesce((F.col("_seat") == F.col("_last")) & (F.col("_fit") < F.col("_all")), F.lit(False))
    times = F.col("_epochs") + F.coalesce(F.col("_seat") <= F.col("_last"), F.lit(False)).cast("long")
    whole = met.filter(~divided).withColumn("_times", times)
    if cuts.filter("_fit < _all").limit(1).count():
        tied = global_prefix(met.filter(divided), ["_s"], {"_n": F.lit(1).cast("long")})
        first = tied.groupBy(F.col("_s").alias("_t")).agg(F.min("_n_before").alias("_first"))
        tied = tied.join(first, F.col("_s").eqNullSafe(F.col("_t")))
        tied = tied.withColumn("_times", F.col("_epochs") + (F.col("_n_before") - F.col("_first") < F.col("_fit")).cast("long"))
        whole = whole.unionByName(tied.select(*whole.columns))
    repeated = whole.filter("_times > 0").withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return repeated.select(*df.columns)
