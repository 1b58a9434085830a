"""URL filters [native]: host-suffix and path-prefix expressions, short hash join, full digest check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), folder).cast("binary"), 256)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """df with host, path, rule (`host` + `path` of the winning rule, else null) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins, then the longer host, then block before allow. Each distinct host and path is expanded into
    its host suffixes times its folder prefixes, only of the lengths that occur in the rules; they meet the
    rules in an equi-join on the first `prefix_hex` hex digits of SHA-256, then full digests and the rest of
    the rule's path are compared. Null urls and urls without :// have empty host and path and fit no rule.
    Repeated rows are kept; columns of df named host, path, rule or verdict are replaced. The rule table may
    be of any size: Spark broadcasts it only when it is measured to be small.
    """
    labels, depth = F.size(F.split("host", r"\.")), F.size(F.split("folder", "/"))
    coded = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host is not null and path is not null")
    coded = coded.withColumn("folder", _folder(F.col("path"))).withColumn("digest", _digest(F.col("host"), F.col("folder")))
    coded = written(coded.select("*", labels.alias("labels"), depth.alias("depth"), F.substring("digest", 1, prefix_hex).alias("short")))
    lengths = F.struct(F.collect_set("labels").alias("labels"), F.collect_set("depth").alias("depths"))
    shapes = coded.agg(lengths).scalar()  # small integers

    judged = df.drop("host", "path", "rule", "verdict").select("*", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = judged.select("host", "path").filter("host <> ''").distinct()
    suffix = lambda n: F.when(n <= F.size("_hosts"), F.array_join(F.slice("_hosts", F.greatest(F.size("_hosts") - n + 1, F.lit(1)), n), "."))
    folder = lambda n: F.when(n <= F.size("_folders"), F.concat(F.array_join(F.slice("_folders", 1, n - 1), "/"), F.when(n > 1, "/").otherwise("")))
    parts = keys.select("host", "path", shapes.alias("_shapes"), F.split("host", r"\.").alias("_hosts"), F.split("path", "/").alias("_folders"))
    tried = (
        parts.select("host", "path", "_shapes", "_folders", F.explode("_shapes.labels").alias("n"), "_hosts")
        .select("host", "path", suffix(F.col("n")).alias("suffix"), F.explode("_shapes.depths").alias("n"), "_folders")
        .select("host", "path", "suffix", folder(F.col("n")).alias("folder"))
        .filter("suffix is not null and folder is not null")
        .withColumn("digest", _digest(F.col("suffix"), F.col("folder")))
    )
    fits = tried.withColumn("short", F.substring("digest", 1, prefix_hex)).alias("t").join(coded.alias("r"), "short")
    fits = fits.filter("t.digest = r.digest and startswith(t.path, r.path)")
    rank = F.struct(
        (F.length("r.host") + F.length("r.path")).alias("a"), F.length("r.host").alias("b"), (F.col("r.verdict") == "block").alias("c")
    )
    best = fits.groupBy("t.host", "t.path").agg(
        F.max_by(F.struct(F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict")), rank).alias("_won")
    )
    out = judged.join(best, ["host", "path"], "left")
    order = [c for c in judged.columns if c not in ("host", "path")]
    return out.select(*order, "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(default)).alias("verdict"))
