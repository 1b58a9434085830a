"""Registered queries of the engine's own operators, each with the SQL that restates it for DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..operators import brands as B
from ..operators import citations, keywords, overlaps, records, sources, topics, visibility
from ..operators import pages as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stand-in brands: the domains of the pages, under names that occur in the texts.
BRANDS = [
    {"shortName": "Thation", "aliases": ["The-Ation"], "domain": "example.com", "isCompetitor": False},
    {"shortName": "Onre", "aliases": None, "domain": "example.net", "isCompetitor": True},
    {"shortName": "there", "aliases": ["the re"], "domain": "example.org", "isCompetitor": True},
]


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages a result as its sources (every third uncited), a document as its answer."""
    grouped = _page_groups(spark, sf_dir)
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("result_id"), F.col("text").alias("answer"))
    return grouped.join(answers, "result_id", "left").select("result_id", "answer", "sources")


def answered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like search_results, but every document is an answer: those without pages have no sources."""
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("result_id"), F.col("text").alias("answer"))
    joined = _page_groups(spark, sf_dir).join(answers, "result_id", "full")
    none = F.array().cast(joined.schema["sources"].dataType)
    return joined.select("result_id", "answer", F.coalesce("sources", none).alias("sources"))


def _page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 10).alias("result_id"),
        F.struct(
            F.col("page_id").alias("ord"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "url",
            F.lit(None).cast("string").alias("domain"), (F.col("page_id") % 3 != 0).alias("cited"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("array<int>").alias("positions"),
        ).alias("s"),
    )
    return pages.groupBy("result_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.dropFields("ord")).alias("sources"))


_DOMAIN = "regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '([^.]+\\.[^.]+)$', 1)"
_NORM = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
_SOURCES = f"src as (select page_id, page_id // 10 result_id, url, page_id % 3 <> 0 cited, {_DOMAIN} dom, {_NORM} norm from pages)"


_ANSWERED = "r as (select coalesce(d.doc_id, g.result_id) result_id, d.text from documents d full join (select distinct result_id from src) g on g.result_id = d.doc_id)"


@query(f"""
with {_SOURCES}, {_ANSWERED},
b(brand, domain) as (values ('Thation', 'example.com'), ('Onre', 'example.net'), ('there', 'example.org')),
s as (select b.brand, src.* from b join src on src.dom = b.domain join r on r.result_id = src.result_id),
a as (select b.brand, count(*) answer from b, r where regexp_matches(r.text, '(?i)(^|[^A-Za-z0-9_])' || b.brand || '([^A-Za-z0-9_]|$)') group by b.brand)
select b.brand, coalesce(max(a.answer), 0)::bigint answer, count(*) filter (s.cited) citations,
  count(distinct lower(s.norm)) filter (s.cited) unique_citations, count(s.norm) refs, count(distinct lower(s.norm)) unique_refs
from b left join s on s.brand = b.brand left join a on a.brand = b.brand group by b.brand""")
def answered_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: visibility of brands in the sources of search results and in their answers, which are all documents."""
    return visibility.aggregate_visibility(visibility.annotate_visibility(answered_results(spark, sf_dir), BRANDS))


@query(f"""
with {_SOURCES}, {_ANSWERED},
b(brand, domain) as (values ('Thation', 'example.com'), ('Onre', 'example.net'), ('there', 'example.org')),
s as (select b.brand, src.result_id, count(*) filter (cited) n_citations, count(*) filter (not cited) n_refs from b join src on src.dom = b.domain group by all)
select r.result_id, b.brand, coalesce(s.n_citations, 0)::bigint n_citations, coalesce(s.n_refs, 0)::bigint n_refs, s.result_id is not null in_sources,
  coalesce(regexp_matches(r.text, '(?i)(^|[^A-Za-z0-9_])' || b.brand || '([^A-Za-z0-9_]|$)'), false) in_content
from r cross join b left join s on s.brand = b.brand and s.result_id = r.result_id""")
def answered_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's citations and mentions in each search result; every document is an answer."""
    a = visibility.annotate_visibility(answered_results(spark, sf_dir), BRANDS)
    return a.select("result_id", "brand", F.size("citations").cast("long").alias("n_citations"), F.size("refs").cast("long").alias("n_refs"), "in_sources", "in_content")


def _engines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each result belongs to one of two search engines, told by the parity of its id."""
    results = search_results(spark, sf_dir).withColumn("engine", F.when(F.col("result_id") % 2 == 0, "alpha").otherwise("beta"))
    return {e: results.filter(F.col("engine") == e).drop("engine") for e in ("alpha", "beta")}


@query(f"""
with {_SOURCES}
select lower(norm) url, count(*) total, count(*) filter (result_id % 2 = 0) alpha, count(*) filter (result_id % 2 = 1) beta
from src where dom <> 'example.org' and cited group by 1""")
def cited_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.cited_urls(_engines(spark, sf_dir), include_uncited=False, exclude_domains=["example.org"])


@query(f"""
with {_SOURCES},
u as (select lower(norm) url, dom, count(*) filter (result_id % 2 = 0) alpha, count(*) filter (result_id % 2 = 1) beta
      from src group by all)
select dom as domain, sum(alpha + beta)::bigint total, sum(alpha)::bigint alpha, sum(beta)::bigint beta, count(*) n_urls from u group by dom""")
def cited_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.cited_domains(visibility.cited_urls(_engines(spark, sf_dir)), ["alpha", "beta"])


@query(f"""
with {_SOURCES}
select page_id from src where lower(norm) in (select lower(norm) from src where result_id % 2 = 1)""")
def pages_of_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = visibility.cited_urls(_engines(spark, sf_dir))
    return visibility.filter_by_engine(table(spark, sf_dir, "pages"), stats, "beta").select("page_id")


@query(f"select page_id, {_DOMAIN} as domain, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') as full_host, {_NORM} as norm from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", urls.extract_domain("url").alias("domain"), urls.extract_domain("url", with_subdomain=True).alias("full_host"), urls.normalize_url("url").alias("norm"))


@query(f"with {_SOURCES} select dom as domain, count(*) n from src group by 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(urls.extract_domain("url").alias("domain")).agg(F.count("*").alias("n"))


_STEPS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '''', '', 'g'), '\\.', '', 'g'), '&', ' and ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')"
_NAME = (
    "regexp_replace(strip_accents(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(" + _STEPS + ")), '-', ' ', 'g'), "
    "'([a-z])and([a-z])', '\\1 and \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')), '\\s+', ' ', 'g')"
)


@query(f"select p_partkey, {_NAME % 'p_name'} as name, regexp_replace({_NAME % 'p_brand'}, '[^a-z0-9]', '', 'g') as brand_key from part")
def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_brand_name("p_name").alias("name"), text.brand_match_key("p_brand").alias("brand_key"))


@query("select doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g') as compact, trim(regexp_replace(lower(text), '[^a-z0-9_áéíóúñü]+', ' ', 'g')) as words from documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.compact("text").alias("compact"), text.normalize_words("text").alias("words"))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(%s), '[^a-z0-9_áéíóúñü]+', ' ', 'g')), ' '), lambda w: length(w) > 2))"


@query(f"""
with d as (select row_number() over () r, doc_id, {_WORDS % 'text'} ws from documents), b as (select row_number() over () s, item_id, {_WORDS % 'text'} ws from benchmark),
dw as (select r, doc_id, len(ws) n, unnest(ws) w from d), bw as (select s, item_id, len(ws) m, unnest(ws) w from b)
select doc_id, item_id, count(*)::double / (n + m - count(*)) as overlap from dw join bw using (w) group by r, s, doc_id, item_id, n, m""")
def benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item that it shares a word with."""
    return overlaps.word_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""
with d as (select row_number() over () r, doc_id, {_WORDS % 'text'} ws from documents), b as (select row_number() over () s, {_WORDS % 'text'} ws from benchmark),
dw as (select r, len(ws) n, unnest(ws) w from d), bw as (select s, len(ws) m, unnest(ws) w from b),
o as (select r, count(*)::double / (n + m - count(*)) as x from dw join bw using (w) group by r, s, n, m)
select d.doc_id, coalesce(max(o.x), 0.0::double) as overlap from d left join o using (r) group by d.r, d.doc_id""")
def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's greatest word overlap with any item; 0 where no word is shared."""
    docs = table(spark, sf_dir, "documents").withColumn("_row", F.monotonically_increasing_id())
    best = overlaps.word_overlaps(docs.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.max("overlap").alias("overlap"))
    return docs.select("doc_id", "_row").join(best.withColumnRenamed("doc_id", "_row"), "_row", "left").select("doc_id", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


@query("""
select doc_id, list_aggregate(list_transform(list_sort(list_distinct([doc_id % 5 + 1, doc_id % 3 + 1])), lambda x: x::varchar), 'string_agg', ',') as numbers from documents""")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.col("text"), F.lit(" ["), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("] and \\["), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("\\]."))
    found = text.inline_citations(marked)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("numbers"))


@query("""
with m as (select doc_id, len(regexp_extract_all(' ' || regexp_replace(text, '([^A-Za-z0-9_])', '\\1\\1', 'g') || ' ', '(?i)[^A-Za-z0-9_]the[^A-Za-z0-9_]')) n from documents)
select doc_id, n::bigint as mentions from m""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.count_name("text", "the").cast("long").alias("mentions"))


_OPENED = "strip_accents(text)"
for _pattern, _put, _flags in (
    ("''", "", "g"), (r"\.", "", "g"), ("([a-z])([A-Z])", r"\1 \2", "g"), ("-", " ", "g"), ("([0-9])([a-zA-Z])", r"\1 \2", "g"),
    ("([a-zA-Z])([0-9])", r"\1 \2", "g"), ("([a-z])and([a-z])", r"\1 and \2", "gi"), ("&", " and ", "g"), (r"\s+", " ", "g"),
):
    _OPENED = f"regexp_replace({_OPENED}, '{_pattern}', '{_put}', '{_flags}')"
_THERE = r"(?:^|[^a-z0-9])th[eéèëê](?:[\s\-''&]|and)*r[eéèëê](?:$|[^a-z0-9])"
_WHISE = r"(?:^|[^a-z0-9])wh[iíìïî]s[eéèëê](?:$|[^a-z0-9])"


def _at(pattern: str) -> str:
    at = lambda t: f"case when regexp_matches({t}, '(?is){pattern}') then length(regexp_extract({t}, '(?is)^(.*?){pattern}', 1)) end"
    return f"coalesce({at('text')}, {at('opened')})"


@query(f"""
with t as (select doc_id, text, {_OPENED} as opened from documents),
f as (select doc_id, {_at(_THERE)} b, {_at(_WHISE)} c from t)
select doc_id, case when b is not null and c is not null then case when b <= c then 'the re,whise' else 'whise,the re' end
  when b is not null then 'the re' when c is not null then 'whise' else '' end as brands from f""")
def brands_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = B.rank_brands(docs, "text", [{"shortName": "the re"}, {"shortName": "whise"}])
    return ranked.select("doc_id", F.array_join("brands", ",").alias("brands"))


@query(f"""
with {_SOURCES},
f as (select *, row_number() over (partition by result_id, dom order by page_id) n, min(page_id) over (partition by result_id, dom) first from src)
select result_id, string_agg(case dom when 'example.com' then 'Thation' when 'example.net' then 'Onre' else 'there' end, ',' order by page_id) as links from f where n = 1 group by result_id""")
def linked_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = sources.normalize_sources(search_results(spark, sf_dir))
    ranked = sources.rank_in_sources(sources.enrich_sources(results, BRANDS))
    return ranked.select("result_id", F.array_join("ranked_links", ",").alias("links"))


@query("select distinct url from pages where length(url) <= 400")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.collect_urls(search_results(spark, sf_dir))


@query(f"""
with {_SOURCES}
select dom as domain, n_pages, rank from (select dom, count(*) n_pages, row_number() over (order by count(*) desc, dom) rank from src group by dom)""")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("all").alias("topic"), F.struct(urls.extract_domain("url").alias("url")).alias("source"))
    return citations.top_sources(pages, most=None).select(F.col("url").alias("domain"), F.col("frequency").alias("n_pages"), F.col("rank"))


@query("""
with c as (select c_custkey, c_name, list_filter(string_split_regex(lower(c_name), '\\s+'), lambda w: length(w) > 2) ws from customer)
select c_custkey, array_to_string(list_concat([regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')],
  list_filter(list_transform(ws, lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda v: length(v) >= 3 and v <> regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'))), ',') as variations from c""")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.company_variations("c_name"), ",").alias("variations"))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id) n from events) where n = 1")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.keep_first(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""
select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type, min(event_id) as first_id from events group by user_id""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return kept.select("user_id", "event_id", "event_type", F.col("_at").alias("first_id"))


@query("""
select 0 as ord, '## N Nationkey' || chr(10) || chr(10) || string_agg(n_nationkey::varchar, ', ' order by n_nationkey) as section from nation
union all select 1, '## N Name' || chr(10) || chr(10) || string_agg(n_name, ', ' order by n_nationkey) from nation""")
def attribute_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_ord"), "n_nationkey", "n_name")
    return records.attribute_sections(nations, "_ord")


@query("""
with u as (select case conv_id % 3 when 0 then 'small-2025-01-31' when 1 then 'large' else 'odd' end model, length(text)::bigint i, (turn * 7)::bigint o from conversations),
p(model, pi, po) as (values ('small', 0.25, 2.0), ('large', 1.25, 10.0), ('free', 0.0, 0.0))
select u.model, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, count(*) as calls, sum(round(i / 1e6 * pi + o / 1e6 * po, 9)) as cost
from u left join p on p.model = regexp_replace(u.model, '-\\d{4}-\\d{2}-\\d{2}$', '') group by u.model""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("conv_id") % 3 == 0, "small-2025-01-31").when(F.col("conv_id") % 3 == 1, "large").otherwise("odd")
    turns = table(spark, sf_dir, "conversations")
    usage = turns.select(model.alias("model"), F.length("text").cast("long").alias("inputTokens"), (F.col("turn") * 7).alias("outputTokens"))
    usage = usage.withColumn("totalTokens", F.col("inputTokens") + F.col("outputTokens"))
    prices = spark.createDataFrame([("small", 0.25, 2.0), ("large", 1.25, 10.0), ("free", 0.0, 0.0)], "model string, input double, output double")
    costed = records.with_cost(usage, prices)
    return costed.groupBy("model").agg(
        F.sum("inputTokens").alias("input_tokens"), F.sum("outputTokens").alias("output_tokens"), F.count("*").alias("calls"), F.sum(F.round("cost", 9)).alias("cost")
    )


@query("""
with m as (select o_orderpriority p, date_trunc('month', o_orderdate)::date d, count(*)::double v from orders group by all),
i as (select *, row_number() over (partition by p order by d) - 1 i, count(*) over (partition by p) n from m)
select p as priority, max(n) as points,
  round((max(v) filter (i = n - 1) - max(v) filter (i = n - 12)) / max(v) filter (i = n - 12) * 100, 6) as yoy,
  round((max(v) filter (i = n - 1) - max(v) filter (i = n - 3)) / max(v) filter (i = n - 3) * 100, 6) as three_months,
  round((max(v) filter (i = n - 1) - max(v) filter (i = n - 2)) / max(v) filter (i = n - 2) * 100, 6) as one_month,
  round(regr_slope(v, i::double) / avg(v), 9) as trend
from i group by p""")
def order_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    series = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), month.alias("month")).agg(F.count("*").cast("double").alias("v"))
    t = keywords.series_trends(series, ["priority"], "month", "v")
    return t.select("priority", "points", *[F.round(c, 6).alias(c) for c in ("yoy", "three_months", "one_month")], F.round("trend", 9).alias("trend"))


@query("""
with m as (select o_orderstatus s, date_trunc('month', o_orderdate)::date d, count(*)::double v from orders group by all),
i as (select *, row_number() over (partition by s order by d) - 1 i from m)
select s as status, count(*) as points, round(regr_slope(v, i::double) / avg(v), 9) as trend from i group by s""")
def array_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    series = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), month.alias("month")).agg(F.count("*").cast("double").alias("v"))
    arrays = series.groupBy("status").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "v"))), lambda x: x["v"]).alias("vs"))
    return arrays.select("status", F.size("vs").cast("long").alias("points"), F.round(numbers.linear_trend("vs"), 9).alias("trend"))


@query("""
select o_orderkey, nullif(round(o_totalprice * 1000)::double / 1e6, 0) as unit, make_date(year(o_orderdate), month(o_orderdate), 1)::varchar as month, floor(o_totalprice * 10 + 0.5) / 10 as rounded from orders""")
def money_and_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        numbers.micros_to_unit(F.round(F.col("o_totalprice") * 1000)).alias("unit"),
        numbers.month_start(F.year("o_orderdate"), F.month("o_orderdate")).cast("string").alias("month"),
        numbers.round1(F.col("o_totalprice")).alias("rounded"),
    )


@query("""
with n as (select r_name topic, lower(n_name) s, n_nationkey k from nation join region on n_regionkey = r_regionkey)
select a.topic, a.s as subtopic, b.s as other, 'too similar to another subtopic' as error from n a join n b on a.topic = b.topic and a.k < b.k
where levenshtein(replace(a.s, ' ', ''), replace(b.s, ' ', '')) < 6
union all
select a.topic, a.s, b.s, 'permutation of another subtopic' from n a join n b on a.topic = b.topic and a.k < b.k
where list_sort(list_distinct(string_split(a.s, ' '))) = list_sort(list_distinct(string_split(b.s, ' ')))
union all
select topic, s, topic, 'too similar to its topic' from n where levenshtein(s, lower(topic)) < 6""")
def taxonomy_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return topics.subtopic_errors(nations.groupBy(F.col("r_name").alias("topic")).agg(named.alias("subtopics")), least=6)


@query("""
select s_suppkey, r_name as topic, n_name as subtopic from supplier join nation on s_nationkey = n_nationkey join region on r_regionkey = s_suppkey % 5
where n_regionkey <> r_regionkey""")
def labels_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    taxonomy = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("topic")).agg(F.collect_set("n_name").alias("subtopics"))
    named = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("s_suppkey") % 5 == F.col("r_regionkey"))
    labels = named.select("s_suppkey", F.col("r_name").alias("topic"), F.col("n_name").alias("subtopic"))
    return topics.invalid_labels(labels, taxonomy).select("s_suppkey", "topic", "subtopic")


@query("select c_custkey, levenshtein(c_name, c_mktsegment) as distance, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_]+', '_', 'g'), '^_|_$', '', 'g') as column_name from customer")
def name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.levenshtein("c_name", "c_mktsegment").alias("distance"), text.clean_column_name("c_name").alias("column_name"))


@query()
def sampled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of exactly 100 rows; sampling is the feature."""
    return records.sample_rows(table(spark, sf_dir, "events").select("event_id", "user_id"), 100, seed=3, ident="event_id")


@query("""
with e as (select page_id, html, regexp_replace(html, '(?is)<(script|style|nav|header|footer|noscript)[^>]*>.*?</\\1>', '', 'g') h from pages)
select page_id, len(regexp_extract_all(regexp_replace(html, '(?is)<(nav|footer|header|script|style)\\b.*?</(nav|footer|header|script|style)>', '', 'g'), '(?i)<h1[ >]'))::int as n_h1,
  len(regexp_extract_all(regexp_replace(html, '(?is)<(nav|footer|header|script|style)\\b.*?</(nav|footer|header|script|style)>', '', 'g'), '(?i)<[uo]l[ >]'))::int as n_lists
from pages""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = P.page_content(table(spark, sf_dir, "pages"))
    return content.select("page_id", F.size(F.filter("headings", lambda h: h["tag"] == "h1")).alias("n_h1"), F.size("lists").alias("n_lists"))


@query()
def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of pages by domain."""
    pages = table(spark, sf_dir, "pages").withColumn("domain", urls.extract_domain("url"))
    stats = P.page_stats(P.page_content(pages, resolve_relative=True), ["page_id", "domain"])
    return P.aggregate_pages(stats, ["domain"])


# The names of the first round for the same results over whole tables.
for _name, _whole in (("brand_visibility", "answered_visibility"), ("brand_annotation", "answered_annotation")):
    QUERIES[_name], ORACLE[_name] = QUERIES[_whole], ORACLE[_whole]
