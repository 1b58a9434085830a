"""Quality rules [native]: base rules of each text, and host verdicts from shrunk failure rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long, 0 for null or empty text).

    Lines are split at \\n alone and compared as they are; a line counts if it has a word and equals an
    earlier line of the text. Columns of df with these names are replaced. Every text is measured whole.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    t = F.coalesce(F.col(text), F.lit(""))
    words = df.drop(*names).select(
        "*",
        t.alias("_t"),
        F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_h"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("_lines"),
    )
    places = F.sequence(F.lit(0), F.size("_h") - WINDOW)
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    windows = words.withColumn("_w", F.when(F.size("_h") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    ranked = F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    sorted_ = windows.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), ranked))
    same = lambda x, i, k: F.coalesce(F.get("_s", i + k)["w"] == x["w"], F.lit(False))
    hits = F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))
    marked = sorted_.withColumn("_p", hits)
    gap = lambda x, i: F.least(F.coalesce(F.get("_p", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
    covered = F.coalesce(F.aggregate(F.transform("_p", gap), F.lit(0), lambda a, x: a + x), F.lit(0))
    return marked.select(
        *[c for c in df.columns if c not in names],
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = 10, max_repeat_percent: int = 20):
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str, failed: str, max_rate: float = 0.5) -> DataFrame:
    """One row a host: n_docs, n_failed, shrunk_rate, host_ok.

    The failure rates of all hosts give an empirical beta prior by the method of moments, weighed by documents:
    mean m, variance v (at least the binomial noise of one document in 10,000), strength m(1-m)/v - 1 held in
    [1, 1000]. The shrunk rate is (n_failed + m x strength) / (n_docs + strength); a host is rejected above
    max_rate, so a host with few documents needs more than a few failures.
    """
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    hosts = written(hosts.withColumn("_rate", F.col("n_failed") / F.col("n_docs")))
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("_m"),
        (F.sum(F.col("n_docs") * F.col("_rate") * F.col("_rate")) / F.sum("n_docs")).alias("_sq"),
    )
    prior = prior.withColumn("_v", F.greatest(F.col("_sq") - F.col("_m") * F.col("_m"), F.lit(1e-4)))
    strength = F.least(F.greatest(F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1, F.lit(1.0)), F.lit(1000.0))
    prior = prior.select(F.struct(F.col("_m").alias("m"), strength.alias("k"))).scalar()
    shrunk = (F.col("n_failed") + F.col("_prior.m") * F.col("_prior.k")) / (F.col("n_docs") + F.col("_prior.k"))
    rated = hosts.withColumn("_prior", prior).withColumn("shrunk_rate", shrunk)
    return written(rated.select("_host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") <= max_rate).alias("host_ok")))


def judge_measured(measured: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """measured (see text_measures) with base_failed, shrunk_rate (its host's) and kept.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most max_rate.
    A null text has no words and fails; documents without host form one host; an empty table gives no rows;
    repeated rows are judged each; columns with the names of results are replaced. Texts are measured
    once: the rows are written with their measures to the shared folder, and hosts are summed from there.
    """
    judged = written(measured.drop("base_failed", "shrunk_rate", "kept").withColumn("base_failed", base_failed()))
    hosts = host_verdicts(judged, host, "base_failed", max_rate).select("_host", "shrunk_rate", "host_ok")
    out = judged.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left")
    return out.select(*judged.columns, "shrunk_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))
