"""Taxonomies and labels: distinct subtopics, labels that belong to a taxonomy, funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = "topic string, subtopics array<string>"


def topics_from_map(spark: SparkSession, taxonomy: Mapping[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(t, list(s)) for t, s in taxonomy.items()], TOPICS)


def subtopic_errors(topics: DataFrame, least: int = 2) -> DataFrame:
    """(topic, subtopic, other, error): subtopics too near to their topic, to each other, or a permutation.

    Distances are Levenshtein on lower case, between subtopics without spaces. The pairs of a topic are
    formed inside its row by a generator.
    """
    low = topics.select("topic", F.transform("subtopics", F.lower).alias("s"))
    parent = low.select("topic", F.explode("s").alias("subtopic")).filter(F.levenshtein("subtopic", F.lower("topic")) < least)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.greatest(F.size("s"), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = low.filter(F.size("s") > 1).select("topic", F.explode(pairs).alias("p")).select("topic", "p.a", "p.b")
    squeezed = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    near = each.filter(F.levenshtein(squeezed("a"), squeezed("b")) < least).select("topic", F.col("a").alias("subtopic"), F.col("b").alias("other"), F.lit("too similar to another subtopic").alias("error"))
    same = each.filter(words("a") == words("b")).select("topic", F.col("a").alias("subtopic"), F.col("b").alias("other"), F.lit("permutation of another subtopic").alias("error"))
    up = parent.select("topic", "subtopic", F.col("topic").alias("other"), F.lit("too similar to its topic").alias("error"))
    return up.union(near).union(same)


def label_pairs(topics: DataFrame) -> DataFrame:
    return topics.select("topic", F.explode("subtopics").alias("subtopic")).distinct()


def invalid_labels(labels: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows whose (topic, subtopic) is not in the taxonomy; rows without label are valid."""
    return labels.filter("topic is not null").join(label_pairs(topics), ["topic", "subtopic"], "left_anti")


def valid_labels(labels: DataFrame, topics: DataFrame) -> DataFrame:
    return labels.join(label_pairs(topics), ["topic", "subtopic"], "left_semi")


def in_range(value: Column, low: float, high: float, whole: bool = False) -> Column:
    """A score that counts: in the range, and whole where asked."""
    good = value.between(low, high)
    return good & (value == F.floor(value)) if whole else good


def labels_allowed(labels: Column, allowed: Sequence[str]) -> Column:
    return F.size(F.array_except(labels, F.array(*map(F.lit, allowed)))) == 0


def size_between(items: Column, low: int, high: int) -> Column:
    return F.size(items).between(low, high)


def funnel_categories(funnels: DataFrame, stages: str = "stages") -> DataFrame:
    """One row a category of nested funnels: stage_ord, stage, goal, category_ord and the category's fields."""
    s = funnels.select(*[c for c in funnels.columns if c != stages], F.posexplode(stages).alias("stage_ord", "_s"))
    keep = [c for c in s.columns if c != "_s"]
    c = s.select(*keep, F.col("_s.stage").alias("stage"), F.col("_s.goal").alias("goal"), F.posexplode("_s.categories").alias("category_ord", "_c"))
    return c.select(*[x for x in c.columns if x != "_c"], "_c.*")


def funnel_topics(funnels: DataFrame, stages: str = "stages") -> DataFrame:
    """Stages as topics, their categories' names as subtopics, in order."""
    s = funnels.select(F.explode(stages).alias("s"))
    return s.select(F.col("s.stage").alias("topic"), F.transform("s.categories", lambda c: c["name"]).alias("subtopics"))
