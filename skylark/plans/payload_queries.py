"""Queries of the operators that read service payloads or link sources; payloads are built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations, keywords, payloads, sources, topics
from ..sources import google
from ..streaming.enrich import windowed_counts
from ..tools import presets
from .queries import _SOURCES, answered_results, query, search_results, table


@query("""
select o_orderpriority as query, o_orderstatus as page, count(*)::double as clicks, sum(o_custkey)::double as impressions, 0.0::double as ctr from orders group by 1, 2""")
def console_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a search console, one a priority and status, opened to rows."""
    keys = F.array("o_orderpriority", "o_orderstatus").alias("keys")
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("clicks"), F.sum("o_custkey").alias("impressions"))
    answers = rows.select(F.to_json(F.struct(F.array(F.struct(keys, "clicks", "impressions")).alias("rows"))).alias("payload"))
    return google.console_rows(answers, ["query", "page"]).select("query", "page", "clicks", "impressions", "ctr")


@query("""
with m as (select o_orderpriority p, date_trunc('month', o_orderdate)::date d, count(*)::double v from orders group by all),
i as (select *, row_number() over (partition by p order by d) - 1 i, count(*) over (partition by p) n from m)
select p as keyword, round(avg(v), 6) as volume, max(n)::int as points, max(d)::varchar as last_month, 0.25::double as cpc,
  round((max(v) filter (i = n - 1) - max(v) filter (i = n - 12)) / max(v) filter (i = n - 12) * 100, 6) as yoy,
  round(regr_slope(v, i::double) / avg(v), 9) as trend
from i group by p""")
def keyword_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as keywords whose monthly volumes come in a planner's JSON."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", month.alias("m")).agg(F.count("*").alias("v"))
    volume = F.struct(F.year("m").cast("string").alias("year"), F.upper(F.date_format("m", "MMMM")).alias("month"), F.col("v").cast("string").alias("monthlySearches"))
    metrics = F.struct(F.avg("v").cast("string").alias("avgMonthlySearches"), F.lit("250000").alias("averageCpcMicros"), F.collect_list(volume).alias("monthlySearchVolumes"))
    results = counts.groupBy("o_orderpriority").agg(metrics.alias("keywordMetrics")).select(F.col("o_orderpriority").alias("text"), "keywordMetrics")
    got = keywords.keyword_records(results.select(F.to_json(F.struct(F.array(F.struct("text", "keywordMetrics")).alias("results"))).alias("payload")))
    return got.select(
        "keyword", F.round("avgMonthlySearches", 6).alias("volume"), F.size("searchVolume").alias("points"), F.array_max("searchVolumeDate").cast("string").alias("last_month"),
        F.col("averageCpc").alias("cpc"), F.round("yoy", 6).alias("yoy"), F.round("trend", 9).alias("trend"),
    )


@query(f"""
with {_SOURCES},
r as (select result_id, list(url order by page_id) us from src group by 1),
p as (select result_id, us, list_sort(list_distinct([result_id % 5 + 1, result_id % 3 + 1])) ns from r)
select result_id, array_to_string(list_transform(ns, lambda n: n::bigint::varchar), ',') as numbers,
  case when len(ns) = 2 and us[ns[1]::int] is not distinct from us[ns[2]::int] then 1 else len(list_filter(ns, lambda n: n <= len(us))) end::int as n_sources,
  us[ns[1]::int] as first_url from p""")
def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with inline marks, linked to the sources that they number."""
    marks = F.concat(F.lit(" ["), (F.col("result_id") % 5 + 1).cast("string"), F.lit("] \\["), (F.col("result_id") % 3 + 1).cast("string"), F.lit("\\]"))
    results = search_results(spark, sf_dir).withColumn("text", F.concat(F.lit("Answer"), marks))
    got = citations.link_citations(results)
    linked = F.col("sources_from_citations")
    return got.select("result_id", F.array_join(F.transform("citation_numbers", lambda n: n.cast("string")), ",").alias("numbers"), F.size(linked).alias("n_sources"), F.get(linked, F.lit(0))["url"].alias("first_url"))


@query(f"""
with {_SOURCES}
select result_id, count(distinct regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*', 0))::int as n_sources,
  count(distinct regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*', 0)) filter (cited)::int as n_cited from src group by result_id""")
def chat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped chats whose attached links and citations merge by origin and path."""
    results = search_results(spark, sf_dir)
    link = lambda s, i: F.struct(s["url"].alias("url"), s["title"].alias("text"), (i + 1).alias("position"))
    cite = lambda s: F.struct(s["url"].alias("url"), s["title"].alias("title"), s["title"].alias("description"), s["cited"].alias("cited"))
    chat = F.struct(
        F.lit("q").alias("prompt"), F.lit("a").alias("answer_text"), F.lit("a").alias("answer_text_markdown"),
        F.transform(F.filter("sources", lambda s: s["cited"]), link).alias("links_attached"), F.transform("sources", cite).alias("citations"),
    )
    got = payloads.parse_chat(results.select("result_id", F.to_json(chat).alias("payload")))
    return got.select("result_id", F.size("sources").alias("n_sources"), F.size(F.filter("sources", lambda s: s["cited"])).alias("n_cited"))


@query(f"""
with {_SOURCES},
f as (select *, row_number() over (partition by result_id, url order by page_id) k from src where contains(regexp_replace(url || dom, '[^a-z0-9]', '', 'g'), 'example')),
r as (select *, row_number() over (partition by result_id order by not cited, page_id) n from f where k = 1)
select result_id, string_agg(url, ' ' order by n) as urls from r where n <= 3 group by result_id""")
def company_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sources of a company in each result."""
    got = citations.sources_for_company(search_results(spark, sf_dir).withColumn("company", F.lit("Example School")))
    return got.select("result_id", F.array_join(F.transform("company_sources", lambda s: s["url"]), " ").alias("urls"))


@query(f"""
with {_SOURCES}
select result_id, count(*) filter (dom = 'example.com')::int as shops, count(*) filter (dom = 'example.net')::int as news, count(*) filter (dom = 'example.org')::int as unknown from src group by 1""")
def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources labelled by their domain; one domain has no label."""
    mapper = spark.createDataFrame([("example.com", "web", "shops"), ("example.net", "web", "news")], "key string, topic string, subtopic string")
    got = sources.categorize_sources(sources.normalize_sources(search_results(spark, sf_dir)), mapper, domains=True)
    n = lambda name: F.size(F.filter("sources", lambda s: s["subcategory"].eqNullSafe(F.lit(name))))
    return got.select("result_id", n("shops").alias("shops"), n("news").alias("news"), n(None).alias("unknown"))


@query("""
select r_name as topic, string_agg(n_name, ',' order by n_nationkey) as subtopics from nation join region on n_regionkey = r_regionkey group by r_name""")
def funnel_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as the stages of a funnel, nations as their categories."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    stages = joined.groupBy("r_name").agg(F.transform(ordered, lambda x: F.struct(x["n_name"].alias("name"))).alias("categories"))
    funnels = stages.select(F.array(F.struct(F.col("r_name").alias("stage"), "categories")).alias("stages"))
    return topics.funnel_topics(funnels).select("topic", F.array_join("subtopics", ",").alias("subtopics"))


@query("select date_trunc('day', ts)::date::varchar as day, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by tumbling day, as the stream operator makes them, over the whole table."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events, "ts", ["event_type"]).select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")


@query()
def turn_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's intent by a row tool on the offline backend."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return presets.speech_intent().batch(turns, ["text"]).select("conv_id", "turn", F.col("result").alias("intent"))


@query()
def supported_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the sources that support them by company, title and snippet."""
    got = citations.link_statements(answered_results(spark, sf_dir).withColumn("company", F.lit("Example")), text="answer")
    return got.select("result_id", F.size("supporting").alias("n_supporting"), F.round(F.get("supporting", F.lit(0))["score"], 6).alias("best"))


#: Levels that the lists of the built overviews nest.
_LEVELS = 12


@query(f"""
with o as (select o_custkey c, o_orderkey k, o_orderstatus s, row_number() over (partition by o_custkey order by o_orderkey) n from orders),
i as (select c, k, n, l, case when l = 0 then 'Order ' || k else 'level ' || l || ' ' || s end as said from o, range({_LEVELS}) t(l)),
t as (select c, string_agg(said, chr(10) order by n, l) as plain, string_agg('- ' || said, chr(10) order by n, l) as md, max(k) as last, count(distinct k) as ks from i group by c)
select c as custkey, left(plain || chr(10) || chr(10) || 'Customer ' || c || ' [1]', 16000) as answer, left(md || chr(10) || chr(10) || 'Customer ' || c || ' [1]', 16000) as markdown,
  'http://orders.example/' || last as first_url, ks::int as n_sources from t""")
def nested_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews of each customer's orders, an item an order, whose lists nest twelve deep; the latest order is cited."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    item = F.struct(F.lit("level " + str(_LEVELS - 1)).alias("title"), F.col("o_orderstatus").alias("snippet"))
    for level in range(_LEVELS - 2, -1, -1):
        title, snippet = (F.lit(f"level {level}"), F.col("o_orderstatus")) if level else (F.lit("Order"), F.col("o_orderkey").cast("string"))
        item = F.struct(title.alias("title"), snippet.alias("snippet"), F.array(item).alias("list"))
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.to_json(item).alias("item")))).alias("xs"))
    names = F.transform("xs", lambda x: x["item"])
    refs = F.transform("xs", lambda x: F.concat(F.lit('{"index":'), x["o_orderkey"].cast("string"), F.lit(',"title":"t","link":"http://orders.example/'), x["o_orderkey"].cast("string"), F.lit('"}')))
    last = F.element_at("xs", -1)["o_orderkey"].cast("string")
    payload = F.concat(
        F.lit('{"textBlocks":[{"type":"list","list":['), F.array_join(names, ","), F.lit(']},{"type":"paragraph","snippet":"Customer '), F.col("o_custkey").cast("string"),
        F.lit('","referenceIndexes":['), last, F.lit(']}],"references":['), F.array_join(F.reverse(refs), ","), F.lit("]}"),
    )
    got = payloads.parse_overview(listed.select(F.col("o_custkey").alias("custkey"), payload.alias("payload")))
    return got.select("custkey", "answer", F.col("answerMarkdown").alias("markdown"), F.get("sources", F.lit(0))["url"].alias("first_url"), F.size("sources").alias("n_sources"))
