"""Brand visibility in search results, cited URLs by engine, cited domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_name
from ..functions.urls import extract_domain, normalize_url

SOURCE = "title string, url string, domain string, cited boolean, snippet string, positions array<int>"
SEARCH_RESULT = f"result_id long, answer string, sources array<struct<{SOURCE.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array<int>', ':array<int>')}>>"


def result_sources(results: DataFrame) -> DataFrame:
    """One row a source: result_id, ord, the source's fields, its lower-case domain and normalized url."""
    out = results.select("result_id", F.posexplode("sources").alias("ord", "s")).select("result_id", "ord", "s.*")
    domain = F.lower(F.coalesce(F.nullif(F.col("domain"), F.lit("")), extract_domain("url")))
    return out.withColumn("source_domain", domain).withColumn("norm_url", normalize_url("url"))


def _by_domain(brands: Sequence[Mapping[str, Any]]) -> dict[str, str]:
    """Lower-case domain to short name; of brands that share a domain the last."""
    return {b["domain"].lower(): b["shortName"] for b in brands if b.get("domain")}


def annotate_visibility(results: DataFrame, brands: Sequence[Mapping[str, Any]]) -> DataFrame:
    """(result_id, brand, in_content, mentions, in_sources, citations, refs): one row a result and brand.

    citations and refs are the normalized URLs of cited and uncited sources on the brand's domain, in order.
    Everything stays in the row, so nothing is shuffled.
    """
    src = F.transform("sources", lambda s: F.struct(
        F.lower(F.coalesce(F.nullif(s["domain"], F.lit("")), extract_domain(s["url"]))).alias("domain"),
        normalize_url(s["url"]).alias("url"),
        F.coalesce(s["cited"], F.lit(False)).alias("cited"),
    ))
    base = results.select("result_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(src, F.array().cast("array<struct<domain:string,url:string,cited:boolean>>")).alias("src"))
    domains = {}
    for d, name in _by_domain(brands).items():
        domains.setdefault(name, []).append(d)

    def presence(name: str):
        own = domains.get(name, [])
        hit = F.filter("src", lambda s: s["domain"].isin(own) if own else F.lit(False))
        of = lambda cited: F.transform(F.filter(hit, lambda s: s["cited"] == F.lit(cited)), lambda s: s["url"])
        return F.struct(F.lit(name).alias("brand"), count_name("answer", name).alias("mentions"), of(True).alias("citations"), of(False).alias("refs"))

    rows = [presence(b["shortName"]) for b in brands]
    out = base.select("result_id", F.explode(F.array(*rows)).alias("v")).select("result_id", "v.*")
    return out.select(
        "result_id", "brand", (F.col("mentions") > 0).alias("in_content"), "mentions",
        (F.size("citations") + F.size("refs") > 0).alias("in_sources"), "citations", "refs",
    )


def aggregate_visibility(annotated: DataFrame) -> DataFrame:
    """(brand, answer, citations, unique_citations, refs, unique_refs), most answers first.

    Citations count as references too; unique counts go by lower-case URL. Distinct URLs are found by a
    two-step aggregation, so no brand's URLs meet in one task.
    """
    totals = annotated.groupBy("brand").agg(
        F.sum(F.col("in_content").cast("long")).alias("answer"),
        F.sum(F.size("citations")).alias("citations"),
        F.sum(F.size("citations") + F.size("refs")).alias("refs"),
    )
    pair = lambda c, cited: F.transform(c, lambda u: F.struct(F.lower(u).alias("u"), F.lit(cited).alias("cited")))
    urls = annotated.select("brand", F.explode(F.concat(pair("citations", 1), pair("refs", 0))).alias("x")).select("brand", "x.*")
    once = urls.groupBy("brand", "u").agg(F.max("cited").alias("cited"))
    unique = once.groupBy("brand").agg(F.sum("cited").alias("unique_citations"), F.count("*").alias("unique_refs"))
    out = totals.join(unique, "brand", "left").fillna(0, ["unique_citations", "unique_refs"])
    return out.select("brand", "answer", "citations", F.col("unique_citations").cast("long"), "refs", "unique_refs").orderBy(F.desc("answer"), "brand")


def cited_urls(engines: Mapping[str, DataFrame], include_uncited: bool = True, exclude_domains: Sequence[str] = ()) -> DataFrame:
    """(url, total, <engine>...): how often each normalized URL is a source, in all and by engine (0 if never).

    One aggregation over the union of the engines' sources; the engines are given, so the pivot needs no scan.
    """
    parts = [result_sources(df).select("norm_url", "source_domain", "cited").withColumn("engine", F.lit(name)) for name, df in engines.items()]
    rows = reduce(DataFrame.union, parts)
    if not include_uncited:
        rows = rows.filter("cited")
    if exclude_domains:
        rows = rows.filter(~F.col("source_domain").isin([d.lower() for d in exclude_domains]))
    by = [F.count_if(F.col("engine") == name).alias(name) for name in engines]
    return rows.groupBy(F.lower("norm_url").alias("url")).agg(F.count("*").alias("total"), *by)


def cited_domains(urls: DataFrame, engines: Sequence[str]) -> DataFrame:
    """(domain, total, <engine>..., n_urls): cited_urls summed by registrable domain."""
    named = urls.withColumn("domain", extract_domain("url")).filter("domain <> ''")
    return named.groupBy("domain").agg(F.sum("total").alias("total"), *[F.sum(e).alias(e) for e in engines], F.count("*").alias("n_urls"))


def domain_urls(urls: DataFrame) -> DataFrame:
    """(domain, urls): the set of URLs of each domain."""
    return urls.groupBy(extract_domain("url").alias("domain")).agg(F.array_sort(F.collect_set("url")).alias("urls"))


def filter_by_engine(pages: DataFrame, urls: DataFrame, engine: str, url: str = "url") -> DataFrame:
    """The pages whose URL the engine cited. URLs compare in lower case on both sides."""
    wanted = urls.filter(F.col(engine) > 0).select(F.col("url").alias("_cited"))
    return pages.join(wanted, F.lower(normalize_url(F.col(url))) == F.col("_cited"), "left_semi")


def organic_results(serps: DataFrame) -> DataFrame:
    """Search results of organic entries (result_id, organic array<struct<title, link, url>>); all are cited."""
    link = lambda e: F.coalesce(e["link"], e["url"], F.lit(""))
    source = lambda e: F.struct(
        F.coalesce(e["title"], F.lit("")).alias("title"), normalize_url(link(e)).alias("url"), extract_domain(link(e)).alias("domain"), F.lit(True).alias("cited"),
        F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("array<int>").alias("positions"),
    )
    return serps.select("result_id", F.lit("").alias("answer"), F.transform(F.coalesce("organic", F.array().cast(serps.schema["organic"].dataType)), source).alias("sources"))


def overview_results(serps: DataFrame) -> DataFrame:
    """Search results of AI overviews (result_id, overview struct<answer, sources>); empty where there is none."""
    none = F.array().cast(serps.schema["overview"].dataType["sources"].dataType)
    cited = F.transform("overview.sources", lambda s: s.withField("url", normalize_url(s["url"])).withField("cited", F.lit(True)))
    return serps.select("result_id", F.coalesce("overview.answer", F.lit("")).alias("answer"), F.coalesce(cited, none).alias("sources"))
