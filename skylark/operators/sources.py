"""Sources enriched with brands: mentions, links, first-appearance ranking, URL sets, categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import brand_match_key
from ..functions.urls import extract_domain

_NAMES = "array<struct<key:string,name:string>>"


def _first_of_key(named: Column) -> Column:
    """Names of (key, name) structs, only the first of each key, none without key."""
    good = F.filter(named, lambda x: x["key"] != "")
    keys = F.transform(good, lambda x: x["key"])
    return F.transform(F.filter(good, lambda x, i: F.array_position(keys, x["key"]) == i + 1), lambda x: x["name"])


def enrich_sources(df: DataFrame, brands: Sequence[Mapping[str, Any]], sources: str = "sources", entities: str | None = None) -> DataFrame:
    """df whose sources also have mentionedBrands, mentionedCompetitors, linkedBrand and linkedCompetitor.

    A brand is mentioned if its short name stands literally, without regard to case, in title or URL, and
    linked if the domains are equal (of several the last). A brand entity counts as a competitor under the
    display name of the brand with its key, unless that brand is our own. Null sources become empty.
    """
    own = [b for b in brands if not b.get("isCompetitor")]
    rivals = [b for b in brands if b.get("isCompetitor")]
    empty = F.array().cast(_NAMES)

    def mentioned(s: Column, group: list[Mapping[str, Any]]) -> Column:
        found = [
            F.when(F.contains(F.lower(s["title"]), F.lit(b["shortName"].lower())) | F.contains(F.lower(s["url"]), F.lit(b["shortName"].lower())),
                   F.struct(brand_match_key(F.lit(b["shortName"])).alias("key"), F.lit(b["shortName"]).alias("name")))
            for b in group
        ]
        return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else empty

    def linked(s: Column, group: list[Mapping[str, Any]]) -> Column:
        return F.coalesce(*[F.when(s["domain"] == b["domain"], F.lit(b["shortName"])) for b in reversed(group) if b.get("domain")], F.lit(None).cast("string"))

    def rivals_named(s: Column) -> Column:
        if entities is None:
            return empty
        key = lambda e: brand_match_key(e["name"])
        display = lambda e: F.coalesce(*[F.when(key(e) == brand_match_key(F.lit(b["shortName"])), F.lit(b["shortName"])) for b in brands], e["name"])
        ours = [brand_match_key(F.lit(b["shortName"])) for b in own]
        hit = lambda e: (F.lower(e["type"]) == "brand") & (F.contains(F.lower(s["title"]), F.lower(e["name"])) | F.contains(F.lower(s["url"]), F.lower(e["name"])))
        kept = F.filter(F.coalesce(F.col(entities), F.array().cast("array<struct<name:string,type:string>>")), lambda e: hit(e) & (~key(e).isin(*ours) if ours else F.lit(True)))
        return F.transform(kept, lambda e: F.struct(key(e).alias("key"), display(e).alias("name")))

    def enrich(s: Column) -> Column:
        return (
            s.withField("mentionedBrands", _first_of_key(mentioned(s, own)))
            .withField("mentionedCompetitors", _first_of_key(F.concat(mentioned(s, rivals), rivals_named(s))))
            .withField("linkedBrand", linked(s, own))
            .withField("linkedCompetitor", linked(s, rivals))
        )

    base = df.withColumn(sources, F.coalesce(F.col(sources), F.array().cast(df.schema[sources].dataType)))
    return base.withColumn(sources, F.transform(sources, enrich))


def rank_in_sources(df: DataFrame, sources: str = "sources") -> DataFrame:
    """df with ranked_mentions and ranked_links: brands by first appearance over the sources.

    Inside a source own brands come before competitors; of equal keys the first spelling stays.
    """
    named = lambda c: F.transform(c, lambda n: F.struct(brand_match_key(n).alias("key"), n.alias("name")))
    mentions = F.flatten(F.transform(sources, lambda s: named(F.concat(s["mentionedBrands"], s["mentionedCompetitors"]))))
    links = F.flatten(F.transform(sources, lambda s: named(F.filter(F.array(s["linkedBrand"], s["linkedCompetitor"]), lambda n: n.isNotNull()))))
    return df.withColumn("ranked_mentions", _first_of_key(mentions)).withColumn("ranked_links", _first_of_key(links))


def collect_urls(df: DataFrame, sources: str = "sources", domains: bool = False, longest: int = 400) -> DataFrame:
    """The distinct URLs (or domains) of all sources, without those that are too long."""
    field = "domain" if domains else "url"
    return df.select(F.explode(F.col(sources)[field]).alias(field)).filter(F.length(field) <= longest).distinct()


def categorize_sources(df: DataFrame, mapper: DataFrame, sources: str = "sources", domains: bool = False) -> DataFrame:
    """df whose sources also have category and subcategory from mapper (key, topic, subtopic); null if unknown.

    Sources are exploded with the other columns of their row, joined on their key and gathered again per row;
    order stays. A row without sources has null.
    """
    field, others = "domain" if domains else "url", [c for c in df.columns if c != sources]
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(F.lit(0).alias("_"), *others).alias("_rest"), sources)
    each = rows.select("_row", "_rest", F.posexplode_outer(sources).alias("_ord", "_s"))
    labels = mapper.groupBy("key").agg(F.max_by(F.struct("topic", "subtopic"), F.struct("topic", "subtopic")).alias("_label"))
    joined = each.join(labels, F.col("_s")[field] == F.col("key"), "left")
    labelled = F.col("_s").withField("category", F.col("_label.topic")).withField("subcategory", F.col("_label.subtopic"))
    gathered = F.array_sort(F.collect_list(F.when(F.col("_ord").isNotNull(), F.struct("_ord", labelled.alias("s")))))
    again = joined.groupBy("_row").agg(F.first("_rest").alias("_rest"), F.transform(gathered, lambda x: x["s"]).alias("_new"))
    return again.select(*[F.when(F.size("_new") > 0, F.col("_new")).alias(c) if c == sources else F.col("_rest")[c].alias(c) for c in df.columns])


def normalize_sources(df: DataFrame, sources: str = "sources") -> DataFrame:
    """df whose sources have the domain of their URL (their own where there is no URL)."""
    return df.withColumn(sources, F.transform(sources, lambda s: s.withField("domain", F.when(F.coalesce(s["url"], F.lit("")) != "", extract_domain(s["url"])).otherwise(extract_domain(s["domain"])))))
