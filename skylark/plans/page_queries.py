"""Queries over pages that are written from the order tables, so that SQL can say what is on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as P
from .queries import query, table


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey, segment, url, html): a page for each customer with orders, which has a section, list item, row, field and link for each."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, status, priority = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    glue = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    level = F.when(F.col("o_orderkey") % 3 == 0, "h4").otherwise("h3")
    one = F.struct(
        "o_orderkey",
        glue("<", level, ">Order ", key, "</", level, "><p>Order ", key, " has the priority ", priority, ".").alias("section"),
        glue("<li>", key, "<ul><li>", status, "<li>", priority, "</ul>").alias("item"),
        glue("<tr><td>", key, "<td>", status).alias("row"),
        glue('<label for="k', key, '">Order ', key, '</label><input id="k', key, '" name="n">').alias("field"),
        glue('<a href="http://', F.when(F.col("o_orderkey") % 2 == 0, "shop").otherwise("else"), '.example/', key, F.when(F.col("o_orderkey") % 5 == 0, ".pdf").otherwise(""), '">', status, "</a>").alias("link"),
    )
    made = orders.groupBy(F.col("o_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment")).agg(F.array_sort(F.collect_list(one)).alias("os"))
    each = lambda part: F.array_join(F.transform("os", lambda o: o[part]), "")
    page: Column = glue(
        "<html><head><title>Customer ", F.col("custkey").cast("string"), "</title></head><body><nav><ul><li>menu</ul></nav><h1>Orders</h1><h2>All</h2>", each("section"), "<div><ul>", each("item"),
        "</ul></div><table><tr><th>key<th>status</tr>", each("row"), '</table><form id="f">', each("field"), "</form>", each("link"), "<footer><p>A footer paragraph that does not count</p></footer></body></html>",
    )
    return made.select("custkey", "segment", F.lit("http://www.shop.example/").alias("url"), page.alias("html"))


_ORDERS = """o as (select o_custkey c, c_mktsegment g, o_orderkey k, o_orderstatus s, o_orderpriority p, row_number() over (partition by o_custkey order by o_orderkey) n
  from orders join customer on o_custkey = c_custkey)"""


@query(f"""
with {_ORDERS}, cust as (select c, count(*) m from o group by c),
heads as (select c, 'heading' kind, 0::bigint a, 0::bigint b, 'h1 Orders 1' said from cust union all select c, 'heading', 1, 0, 'h2 All 2 of 0' from cust
  union all select c, 'heading', n + 1, 0, case when k % 3 = 0 then 'h4 Order ' || k || case when coalesce(seen, 0) > 0 then ' 4 of ' || (seen + 1) else ' 3 of 1' end else 'h3 Order ' || k || ' 3 of 1' end
  from (select *, max(case when k % 3 <> 0 then n end) over (partition by c order by n) seen from o)),
items as (select c, 'item' kind, 0::bigint a, (n - 1) * 3 b, k || s || p said from o union all select c, 'item', 0, (n - 1) * 3 + 1, s from o union all select c, 'item', 0, (n - 1) * 3 + 2, p from o
  union all select c, 'item', n, 0, s from o union all select c, 'item', n, 1, p from o),
cells as (select c, 'cell' kind, 0::bigint a, 0::bigint b, 'key' said from cust union all select c, 'cell', 0, 1, 'status' from cust
  union all select c, 'cell', n, 0, k::varchar from o union all select c, 'cell', n, 1, s from o),
fields as (select c, 'field' kind, 0::bigint a, n - 1 b, 'text k' || k || ' n Order ' || k said from o),
links as (select c, 'link' kind, 0::bigint a, n - 1 b, s || ' ' || (k % 2 = 1)::varchar || ' ' || (k % 5 = 0)::varchar said from o),
paras as (select c, 'paragraph' kind, 0::bigint a, n - 1 b, 'Order ' || k || ' has the priority ' || p || '.' said from o)
select c as custkey, kind, a, b, said from (select * from heads union all select * from items union all select * from cells union all select * from fields union all select * from links union all select * from paras)""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, list items, table cells, form fields, links and paragraphs of pages as flat rows, each with its place."""
    pages = P.page_content(order_pages(spark, sf_dir)).select("custkey", "headings", "lists", "tables", "forms", "links", "paragraphs")
    text = lambda c: c.cast("string")
    flat = lambda c: F.array(F.transform(c, lambda x: x))
    up = lambda h: F.concat(F.lit(" of "), text(h["parent"]))
    parts = {
        "heading": F.transform("headings", lambda h: F.array(F.concat_ws(" ", h["tag"], h["text"], F.concat(text(h["depth"]), F.coalesce(up(h), F.lit("")))))),
        "item": F.transform("lists", lambda x: x["items"]),
        "cell": F.flatten(F.transform("tables", lambda t: t["rows"])),
        "field": F.transform("forms", lambda f: F.transform(f["fields"], lambda x: F.concat_ws(" ", x["type"], x["id"], x["name"], x["label"]))),
        "link": flat(F.transform("links", lambda x: F.concat_ws(" ", x["text"], text(x["isExternal"]), text(x["isPdf"])))),
        "paragraph": flat(F.col("paragraphs")),
    }
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), x.alias("xs")) for kind, x in parts.items()])
    outer = pages.select("custkey", F.explode(kinds).alias("k")).select("custkey", "k.kind", F.posexplode("k.xs").alias("a", "ys"))
    return outer.select("custkey", "kind", F.col("a").cast("long").alias("a"), F.posexplode("ys").alias("b", "said")).withColumn("b", F.col("b").cast("long"))


@query(f"""
with {_ORDERS},
h as (select *, max(case when k % 3 <> 0 then n end) over (partition by c order by n) seen from o),
t as (select g, c, count(*) m, count(*) filter (k % 2 = 1) ext, max(case when k % 3 = 0 and seen > 0 then 4 else 3 end) deep, count(*) filter (k % 3 = 0 and seen is null) skipped,
  floor(avg(length('Order ' || k || ' has the priority ' || p || '.')) + 0.5) len, floor((3 * count(*) + 2 * count(*)) / (count(*) + 1)::double + 0.5) items from h group by g, c)
select g as segment, count(*) as pages, floor(avg(m + 2) * 10 + 0.5) / 10 as headings, floor(avg(m + 1) * 10 + 0.5) / 10 as lists, floor(avg(ext) * 10 + 0.5) / 10 as external,
  floor(avg(deep) * 10 + 0.5) / 10 as depth, floor(avg(skipped) * 10 + 0.5) / 10 as skipped, floor(sum(len * m) / sum(m) * 10 + 0.5) / 10 as paragraph_length,
  floor(sum(items * (m + 1)) / sum(m + 1) * 10 + 0.5) / 10 as list_length, 100.0::double as one_h1, 1.0::double as forms, 1.0::double as tables from t group by g""")
def page_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of page statistics by market segment."""
    stats = P.page_stats(P.page_content(order_pages(spark, sf_dir)), ["custkey", "segment"])
    got = P.aggregate_pages(stats, ["segment"])
    named = {"headings": "avgHeadings", "lists": "avgLists", "external": "avgExternalLinks", "depth": "avgMaxDepth", "skipped": "avgSkippedLevels", "paragraph_length": "avgParagraphLength",
             "list_length": "avgListLength", "one_h1": "pctOneH1", "forms": "avgForms", "tables": "avgTables"}
    return got.select("segment", F.col("count").alias("pages"), *[F.col(c).alias(n) for n, c in named.items()])
