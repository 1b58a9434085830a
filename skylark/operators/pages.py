"""Structure and statistics of web pages, from their flat elements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round1
from ..functions.text import col, questions
from ..functions.urls import extract_domain
from .html_elements import elements

HEADINGS = [f"h{i}" for i in range(1, 7)]
FIELDS = ["input", "select", "textarea", "button"]
# Structured data types and fields that are looked for; metadata names.
SCHEMA_TYPES = (
    "Article BlogPosting BreadcrumbList Event FAQPage HowTo JobPosting LocalBusiness Organization Person Product Recipe Review Service "
    "SoftwareApplication VideoObject WebSite"
).split()
ORGANIZATION_FIELDS = "name url logo sameAs brand contactPoint address".split()
AUTHOR_FIELDS = "name url sameAs address contactPoint email".split()
META_NAMES = "description keywords author language abstract topic summary subject category date".split()


def _of(el: Column, *tags: str) -> Column:
    return F.filter(el, lambda e: e["tag"].isin(*tags) & e["kept"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, not once for each element of a function inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _span(parts: Column, e: Column) -> Column:
    return F.slice(parts, e["begin"] + 1, e["until"] - e["begin"])


def heading_forest(el: Column) -> Column:
    """array<struct<ord, tag, level, text, parent, depth>>: parent is the ord of the nearest heading before with a lower level."""
    return F.transform(_of(el, *HEADINGS), lambda e, i: F.struct(
        i.alias("ord"), e["tag"].alias("tag"), F.substring(e["tag"], 2, 1).cast("int").alias("level"), e["text"].alias("text"), e["parent"].alias("parent"), e["depth"].alias("depth")
    ))


def heading_stats(forest: Column | str) -> Column:
    """Totals of a heading forest; a first heading below h1 counts as skipped, as does a child two levels down."""
    f = col(forest)
    level_of = lambda ord_: F.get(f, ord_)["level"]  # noqa: E731  ord is the place in the forest
    skipped = F.filter(f, lambda h: h["level"] > F.coalesce(level_of(h["parent"]), F.lit(0)) + 1)
    texts = F.filter(F.transform(f, lambda h: F.lower(F.trim(h["text"]))), lambda t: t != "")
    parents = F.filter(F.transform(f, lambda h: h["parent"]), lambda p: p.isNotNull())
    count = lambda tag: F.size(F.filter(f, lambda h: h["tag"] == tag))
    return F.struct(
        F.size(f).alias("totalHeadings"),
        (count("h1") == 1).alias("oneH1"),
        F.coalesce(F.array_max(F.transform(f, lambda h: h["depth"])), F.lit(0)).alias("maxDepth"),
        F.coalesce(F.try_divide(F.size(parents), F.size(F.array_distinct(parents))), F.lit(0.0)).alias("avgSubheadings"),
        F.size(skipped).alias("skippedLevels"),
        (F.size(f) - F.size(texts)).alias("emptyHeadings"),
        (F.size(texts) - F.size(F.array_distinct(texts))).alias("duplicateHeadings"),
        *[count(h).alias(h) for h in HEADINGS],
    )


def paragraphs(el: Column, most: int = 500, least: int = 20) -> Column:
    return F.transform(F.filter(_of(el, "p"), lambda p: F.length(p["text"]) > least), lambda p: F.substring(p["text"], 1, most))


def lists(el: Column) -> Column:
    """Lists with all items inside them (nested ones count in each), the heading and the text before."""
    near = lambda e: F.when(e["near"] != F.coalesce(e["heading"], F.lit("")), F.nullif(e["near"], F.lit("")))
    one = lambda e, items: F.struct((e["tag"] == "ol").alias("ordered"), _span(items, e).alias("items"), F.nullif(e["heading"], F.lit("")).alias("contextHeading"), near(e).alias("closestText"))
    return _let(F.transform(_of(el, "li"), lambda i: i["text"]), lambda items: F.transform(_of(el, "ul", "ol"), lambda e: one(e, items)))


def tables(el: Column) -> Column:
    cells = F.transform(_of(el, "th", "td"), lambda c: c["text"])
    rows = _let(cells, lambda texts: F.transform(_of(el, "tr"), lambda r: _span(texts, r)))
    return _let(rows, lambda all_: F.transform(_of(el, "table"), lambda t: F.struct(F.filter(_span(all_, t), lambda r: F.size(r) > 0).alias("rows"), t["heading"].alias("contextHeading"))))


def forms(el: Column) -> Column:
    """Form elements, boxes whose class or id says form, and the nearest of 5 ancestors that hold two fields or more."""
    fields = F.filter(_of(el, *FIELDS), lambda f: (f["tag"] != "button") | (f["attrs"]["type"] == "submit"))
    attr = lambda e, name: F.nullif(e["attrs"][name], F.lit(""))
    label = lambda f: F.coalesce(f["label"], attr(f, "placeholder"), attr(f, "aria-label"))
    kind = lambda f: F.when(f["tag"] == "input", F.coalesce(attr(f, "type"), F.lit("text"))).otherwise(f["tag"])
    shown = lambda f: F.struct(kind(f).alias("type"), attr(f, "id").alias("id"), attr(f, "name").alias("name"), label(f).alias("label"))
    return _let(F.transform(fields, shown), lambda every: F.transform(F.filter(el, lambda e: e["tag"] == "fields"), lambda b: F.struct(
        b["attrs"]["id"].alias("id"), b["attrs"]["class"].alias("class"), F.transform(b["fields"], lambda i: F.get(every, i)).alias("fields"),
        F.nullif(F.regexp_replace(b["heading"], r"\s+", " "), F.lit("")).alias("contextHeading"), F.nullif(b["near"], F.lit("")).alias("closestText"),
    )))


def links(el: Column, url: Column, unique: bool = False, resolve_relative: bool = False) -> Column:
    """Links with an absolute URL (relative ones too if resolved against the page), whether external, whether PDF."""
    href = lambda a: a["attrs"]["href"]
    root = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)?", 0)
    full = lambda h: F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
    if resolve_relative:
        full = lambda h: F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(folder, h))
    found = F.filter(_of(el, "a"), lambda a: F.coalesce(href(a), F.lit("")) != "")
    made = F.transform(found, lambda a: F.struct(full(href(a)).alias("href"), a["text"].alias("text")))
    good = F.filter(made, lambda m: m["href"].isNotNull())
    if unique:
        hrefs = F.transform(good, lambda m: m["href"])
        good = F.filter(good, lambda m, i: F.array_position(hrefs, m["href"]) == i + 1)
    shown = lambda m, page: F.struct(m["href"].alias("href"), m["text"].alias("text"), (extract_domain(m["href"]) != page).alias("isExternal"), F.lower(m["href"]).endswith(".pdf").alias("isPdf"))
    return _let(extract_domain(url), lambda page: F.transform(good, lambda m: shown(m, page)))


def structured_data(el: Column) -> Column:
    """JSON-LD blocks as JSON strings; broken ones are left out."""
    blocks = F.transform(F.filter(el, lambda e: e["tag"] == "json"), lambda e: F.when(e["text"] == "", "{}").otherwise(e["text"]))
    return F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())


def structured_types(blocks: Column | str) -> Column:
    """map<string, boolean>: each type, Author, and the fields of organizations and authors (as Type.field)."""
    b = col(blocks)
    kind = lambda x: F.get_json_object(x, "$['@type']")
    some = lambda name: F.exists(b, lambda x: F.coalesce(kind(x) == name, F.lit(False)))
    person = lambda x: F.when(kind(x) == "Person", x).when(F.get_json_object(x, "$.author['@type']") == "Person", F.get_json_object(x, "$.author"))
    author = F.get(F.filter(F.transform(b, person), lambda x: x.isNotNull()), F.lit(0))
    has = lambda x, field: F.coalesce(F.get_json_object(x, f"$.{field}").isNotNull(), F.lit(False))
    org = lambda field: F.exists(b, lambda x: F.coalesce(kind(x) == "Organization", F.lit(False)) & has(x, field))
    pairs = {t: some(t) for t in SCHEMA_TYPES} | {"Author": author.isNotNull()}
    pairs |= {f"Organization.{f}": org(f) for f in ORGANIZATION_FIELDS} | {f"Author.{f}": has(author, f) for f in AUTHOR_FIELDS}
    return F.create_map(*[x for k in sorted(pairs) for x in (F.lit(k), pairs[k])])


def metadata(el: Column) -> Column:
    """map<string, string> of title and the known meta names that the head has."""
    title = F.get(F.filter(el, lambda e: e["tag"] == "head title"), F.lit(0))["text"]
    named = lambda key, n: F.filter(el, lambda e: (e["tag"] == "head meta") & (e["attrs"][key] == n) & (F.coalesce(e["attrs"]["content"], F.lit("")) != ""))
    content = lambda n: F.get(F.concat(named("name", n), named("property", n)), F.lit(0))["attrs"]["content"]
    full = F.create_map(F.lit("title"), F.nullif(title, F.lit("")), *[x for n in META_NAMES for x in (F.lit(n), content(n))])
    return F.map_filter(full, lambda k, v: v.isNotNull())


def body_text(el: Column) -> Column:
    return F.trim(F.regexp_replace(F.get(_of(el, "body"), F.lit(0))["text"], r"(?U)\s+", " "))


def page_content(df: DataFrame, url: str = "url", html: str = "html", text: str | None = None, resolve_relative: bool = False) -> DataFrame:
    """df with schemas, meta, headings, paragraphs, lists, tables, links, forms and questions (of the text column, or the page's text)."""
    parsed = df.withColumn("_el", elements(html))
    el = F.col("_el")
    said = F.coalesce(F.col(text), F.lit("")) if text else F.coalesce(body_text(el), F.lit(""))
    return parsed.select(
        *df.columns, structured_data(el).alias("schemas"), metadata(el).alias("meta"), heading_forest(el).alias("headings"), paragraphs(el).alias("paragraphs"), lists(el).alias("lists"),
        tables(el).alias("tables"), links(el, F.col(url), resolve_relative=resolve_relative).alias("links"), forms(el).alias("forms"), questions(said).alias("questions"), said.alias("said"),
    )


def page_stats(content: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Counts, rounded mean lengths, words and characters of each page; a page without paragraphs has mean length 0."""
    mean = lambda c, size: F.floor(F.coalesce(F.try_divide(F.aggregate(F.transform(c, size), F.lit(0), lambda a, x: a + x), F.size(c)), F.lit(0.0)) + 0.5)
    outside = F.filter("links", lambda x: x["isExternal"])
    return content.select(
        *keep, F.size("schemas").alias("numSchemas"), structured_types("schemas").alias("schemaStats"), heading_stats("headings").alias("headingStats"),
        F.size("paragraphs").alias("numParagraphs"), mean("paragraphs", F.length).alias("avgParagraphLength"), F.size("lists").alias("numLists"),
        mean("lists", lambda x: F.size(x["items"])).alias("avgListLength"), F.size("tables").alias("numTables"), F.size("links").alias("numLinks"),
        (F.size("links") - F.size(outside)).alias("numInternalLinks"), F.size(outside).alias("numExternalLinks"), F.size("questions").alias("numQuestions"),
        F.size("forms").alias("numForms"), F.size(F.split(F.trim("said"), r"(?U)\s+")).alias("numWords"), F.length("said").alias("numChars"),
    )


_PLAIN = {"Schemas": "numSchemas", "Paragraphs": "numParagraphs", "Lists": "numLists", "Tables": "numTables", "Links": "numLinks", "InternalLinks": "numInternalLinks",
          "ExternalLinks": "numExternalLinks", "Questions": "numQuestions", "Forms": "numForms", "Words": "numWords", "Chars": "numChars"}
_HEADS = {"Headings": "totalHeadings", "MaxDepth": "maxDepth", "Subheadings": "avgSubheadings", "SkippedLevels": "skippedLevels", "EmptyHeadings": "emptyHeadings", "DuplicateHeadings": "duplicateHeadings"}


def aggregate_pages(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means (one decimal) over pages, by group or in all: one partial and one final aggregation.

    Lengths are weighed by paragraphs and lists; pages without any add nothing. An empty table gives no group.
    """
    mean = lambda c: round1(F.avg(c))
    weighed = lambda length, n: F.coalesce(round1(F.try_divide(F.sum(F.col(length) * F.col(n)), F.sum(n))), F.lit(0.0))
    types = [F.count_if(F.col("schemaStats")[t]).alias(t) for t in [*SCHEMA_TYPES, "Author"]]
    return stats.groupBy(*by).agg(
        F.count("*").alias("count"), *[mean(c).alias(f"avg{k}") for k, c in _PLAIN.items()], *[mean(f"headingStats.{c}").alias(f"avg{k}") for k, c in _HEADS.items()],
        *[mean(f"headingStats.{h}").alias(f"avg_{h}") for h in HEADINGS], round1(F.avg(F.col("headingStats.oneH1").cast("double")) * 100).alias("pctOneH1"),
        weighed("avgParagraphLength", "numParagraphs").alias("avgParagraphLength"), weighed("avgListLength", "numLists").alias("avgListLength"), *types,
    ).filter("count > 0")


def brand_pages(brand_urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each brand (brand, url joined with url, html); URLs without page are left out."""
    return brand_urls.join(pages, "url")


def page_context(content: DataFrame, keep: Sequence[str], chars: int = 4000, most: int = 20) -> DataFrame:
    """A page as JSON for a prompt: metadata and the first elements of each kind, cut to so many characters."""
    first = lambda c: F.slice(c, 1, most)
    parts = F.struct("meta", F.transform(first("headings"), lambda h: h["text"]).alias("headings"), first("paragraphs").alias("paragraphs"), first("lists").alias("lists"), F.size("links").alias("links"), F.size("forms").alias("forms"))
    return content.select(*keep, F.substring(F.to_json(parts), 1, chars).alias("context"))


def page_results(content: DataFrame, ident: str) -> DataFrame:
    """Pages as search results: the text is the answer, the distinct links are cited sources."""
    urls = F.array_distinct(F.transform("links", lambda x: F.struct(x["text"].alias("title"), x["href"].alias("url"), extract_domain(x["href"]).alias("domain"), F.lit(True).alias("cited"))))
    return content.select(F.col(ident).alias("result_id"), F.col("said").alias("answer"), urls.alias("sources"))
