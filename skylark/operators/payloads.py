"""JSON payloads of search and chat services as search results; parsing is from_json and array functions, but for lists that nest to any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_blank_lines, without_adjacent_repeats, without_css
from ..functions.urls import extract_domain

#: A block's list stays JSON here: its items nest to any depth, see nested_items().
_BLOCK = "struct<type:string,snippet:string,referenceIndexes:array<int>,list:string,rows:array<array<string>>,language:string>"
_REF = "struct<index:int,title:string,link:string,url:string,snippet:string,source:string>"
OVERVIEW = f"textBlocks array<{_BLOCK}>, references array<{_REF}>, aiOverview struct<textBlocks:array<{_BLOCK}>,references:array<{_REF}>>"
LONGEST = 16_000
#: What a text has if clean_text changes it: braces, white space other than single spaces, spaces at its ends.
_UNCLEAN = r"(?U)[{}\x{FEFF}]|[^\S ]|  |^ | \z"


def clean_text(c: Column) -> Column:
    """Without style rules that leaked into it and runs of spaces, lines trimmed, blank lines collapsed."""
    full = lambda t: collapse_blank_lines(F.regexp_replace(without_css(t), r"[ \t\x{A0}]+", " "))
    return F.get(F.transform(F.array(c), lambda t: F.when(t.rlike(_UNCLEAN), full(t)).otherwise(t)), F.lit(0))


def clean_answer(c: Column) -> Column:
    """A chat answer without Markdown images and without lines that only say that there is one."""
    lines = F.split(F.regexp_replace(c, r"!\[[^\[\]]*\]\([^()\s]*(?:\s[^()]*)?\)", ""), "\n")
    said = F.filter(lines, lambda x: F.trim(x) != "Image")
    return F.trim(F.regexp_replace(F.array_join(said, "\n"), "\n\n\n+", "\n\n"))


_LISTS = pa.list_(pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("snippet", pa.string())])))
#: Items that a task holds before it hands them to Spark; a longer row is held alone.
HELD = 50_000


def _items(listed: str | None) -> list[dict]:
    """The items of a nested list in reading order, each with its level; what is no item is left out."""
    said = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    try:
        out, ahead = [], [(0, json.loads(listed or "[]"))]
    except ValueError:  # the list is given as text
        return []
    while ahead:
        level, x = ahead.pop()
        if isinstance(x, list):
            ahead += [(level, item) for item in reversed(x)]
        elif isinstance(x, dict):
            out.append({"level": level, "title": said(x.get("title")), "snippet": said(x.get("snippet"))})
            ahead.append((level + 1, x.get("list")))
    return out


def _lots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The items of each row's lists, in lots of about HELD items, so that a task's memory does not follow the rows of a batch."""
    for rows in batches:
        held, n = [], 0
        for row in rows:
            held.append([_items(x) for x in row.as_py() or []])
            n += 1 + sum(map(len, held[-1]))
            if n >= HELD:
                yield pa.array(held, _LISTS)
                held, n = [], 0
        if held:
            yield pa.array(held, _LISTS)


def nested_items(blocks: Column) -> Column:
    """The items (level, title, snippet) of each of a row's lists, given as JSON; null has none."""

    @F.arrow_udf("array<array<struct<level:int,title:string,snippet:string>>>")
    def flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _lots(batches)

    return flat(blocks)


def _said(items: Column) -> Column:
    """The items of a nested list with their text, in order; items without text are left out."""
    text = lambda i: clean_text(F.trim(F.concat_ws(" ", F.nullif(i["title"], F.lit("")), F.nullif(i["snippet"], F.lit("")))))
    return F.filter(F.transform(items, lambda i: F.struct(i["level"].alias("level"), text(i).alias("text"))), lambda i: i["text"] != "")


def _lines(said: Column, markdown: bool) -> Column:
    return F.transform(said, lambda i: F.concat(F.repeat(F.lit("  "), i["level"]), F.lit("- "), i["text"]) if markdown else i["text"])


def _rendered(b: Column, items: Column, markdown: bool) -> Column:
    kind = F.coalesce(b["type"], F.when(b["snippet"] != "", "paragraph"))
    plain = clean_text(F.coalesce(b["snippet"], F.lit("")))
    rows = F.transform(b["rows"], lambda r: F.array_join(r, " | ", ""))
    if markdown:
        ruled = F.transform(rows, lambda r: F.concat(F.lit("| "), r, F.lit(" |")))
        rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(b["rows"], F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
        table = F.array_join(F.concat(F.slice(ruled, 1, 1), F.array(rule), F.slice(ruled, 2, 1_000_000)), "\n")
        mark = F.concat(F.lit("[Code"), F.when(b["language"] != "", F.concat(F.lit(": "), b["language"])).otherwise(""), F.lit("]\n"))
        code = F.when(b["snippet"] != "", F.concat(mark, F.trim(b["snippet"])))
    else:
        table, code = F.array_join(rows, "\n"), plain
    shown = (
        F.when(kind == "list", F.array_join(_lines(items, markdown), "\n"))
        .when(kind == "table", F.when(F.size(b["rows"]) > 0, table))
        .when(kind == "code", code)
        .when(kind.isNotNull() & (kind != "carousel"), plain)
    )
    return F.coalesce(shown, F.lit(""))


def parse_overview(df: DataFrame, payload: str = "payload", nested: bool = True) -> DataFrame:
    """df with answer, answerMarkdown (16,000 characters at most) and sources of an AI overview or AI mode payload.

    References become sources, one of each URL; a block's reference indexes become [n] marks, n being the
    source's place, and its positions. Lists keep their items at every depth (JSON may nest 1,000 deep; a payload beyond
    that, like any broken one, gives an empty answer). nested also reads an overview inside the payload.
    """
    p = F.from_json(payload, OVERVIEW)
    base = df.withColumn("_p", p)
    blocks, refs = F.col("_p.textBlocks"), F.col("_p.references")
    if nested:
        blocks, refs = F.coalesce(blocks, F.col("_p.aiOverview.textBlocks")), F.coalesce(refs, F.col("_p.aiOverview.references"))
    link = lambda r: F.coalesce(F.nullif(r["link"], F.lit("")), F.nullif(r["url"], F.lit("")))
    base = base.withColumn("_b", F.coalesce(blocks, F.array().cast(f"array<{_BLOCK}>")))
    known = F.filter(F.coalesce(refs, F.array().cast(f"array<{_REF}>")), lambda r: link(r).isNotNull() & r["index"].isNotNull())
    base = base.withColumn("_r", known).withColumn("_urls", F.array_distinct(F.transform("_r", link)))
    seat = lambda i: F.array_position("_urls", link(F.get(F.filter("_r", lambda r: r["index"] == i), F.lit(0)))).cast("int")

    listed = nested_items(F.transform("_b", lambda b: F.when(b["type"] == "list", b["list"])))
    base = base.withColumn("_i", listed).withColumn("_i", F.transform("_i", _said))

    def piece(b: Column, i: Column, markdown: bool) -> Column:
        marks = F.array_distinct(F.filter(F.transform(F.coalesce(b["referenceIndexes"], F.array().cast("array<int>")), seat), lambda n: n > 0))
        shown = _rendered(b, F.get(F.col("_i"), i), markdown)
        cited = F.when(F.size(marks) > 0, F.concat(F.lit(" "), F.array_join(F.transform(marks, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))).otherwise("")
        return F.struct(shown.alias("text"), cited.alias("cited"), marks.alias("marks"))

    base = base.withColumn("_plain", F.transform("_b", lambda b, i: piece(b, i, False))).withColumn("_md", F.transform("_b", lambda b, i: piece(b, i, True)))
    either = lambda i: (F.get(F.col("_plain"), i)["text"] != "") | (F.get(F.col("_md"), i)["text"] != "")
    joined = lambda c: F.substring(clean_text(F.array_join(without_adjacent_repeats(F.transform(F.filter(c, lambda x, i: either(i)), lambda x: F.concat(x["text"], x["cited"]))), "\n\n")), 1, LONGEST)
    base = base.withColumn("_cited", F.flatten(F.transform(F.filter("_plain", lambda x, i: either(i)), lambda x: x["marks"])))

    def source(u: Column, i: Column) -> Column:
        own = F.filter("_r", lambda r: link(r) == u)
        pick = lambda f: F.get(F.filter(F.transform(own, f), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
        cited = F.array_contains("_cited", (i + 1).cast("int"))
        return F.struct(
            F.coalesce(pick(lambda r: r["title"]), F.lit("")).alias("title"), u.alias("url"), extract_domain(u).alias("domain"), F.when(cited, F.lit(True)).alias("cited"),
            pick(lambda r: clean_text(F.coalesce(r["snippet"], F.lit("")))).alias("snippet"), F.when(cited, F.array((i + 1).cast("int"))).alias("positions"),
        )

    out = base.select("*", joined("_plain").alias("answer"), joined("_md").alias("answerMarkdown"), F.transform("_urls", source).alias("sources"))
    return out.drop("_p", "_b", "_i", "_r", "_urls", "_plain", "_md", "_cited")


def _merge_key(u: Column) -> Column:
    """Origin and path of a URL; the URL itself if it is none."""
    return F.coalesce(F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+[^?#]*", 0), F.lit("")), u)


def merge_links(df: DataFrame, citations: str = "citations", links: str = "links") -> DataFrame:
    """df with sources: attached links (by position) and citations merged by origin and path.

    Links are cited and carry positions; a citation's title and snippet win. Of the URLs of a source the first that adds a query or
    fragment to what came before stays. Merged inside the row, so nothing is shuffled.
    """
    position = lambda x: F.coalesce(x["position"], F.lit(2**31 - 1))
    ordered = F.array_sort(F.transform(F.filter(F.coalesce(F.col(links), F.array().cast(df.schema[links].dataType)), lambda x: x["url"] != ""), lambda x, i: F.struct(position(x).alias("p"), i.alias("i"), x["url"].alias("url"))))
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    a = F.transform(ordered, lambda x: F.struct(x["url"].alias("url"), text.alias("title"), text.alias("snippet"), F.lit(True).alias("cited"), F.when(x["p"] < 2**31 - 1, x["p"]).otherwise(none).alias("position")))
    given = F.filter(F.coalesce(F.col(citations), F.array().cast(df.schema[citations].dataType)), lambda x: x["url"] != "")
    b = F.transform(given, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["description"].alias("snippet"), x["cited"].alias("cited"), none.alias("position")))
    base = df.withColumn("_all", F.concat(a, b)).withColumn("_keys", F.array_distinct(F.transform("_all", lambda x: _merge_key(x["url"]))))
    has = lambda u, mark: F.contains(u, F.lit(mark))
    better = lambda now, new: (has(new, "#") & ~has(now, "#")) | (has(new, "?") & ~has(now, "?"))

    def source(k: Column) -> Column:
        own = F.filter("_all", lambda x: _merge_key(x["url"]) == k)
        last = lambda f: F.try_element_at(F.filter(F.transform(own, lambda x: x[f]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(-1))
        url = F.aggregate(own, F.get(own, F.lit(0))["url"], lambda now, x: F.when(better(now, x["url"]), x["url"]).otherwise(now))
        places = F.array_sort(F.array_distinct(F.filter(F.transform(own, lambda x: x["position"]), lambda p: p.isNotNull())))
        cited = F.array_max(F.transform(own, lambda x: x["cited"]))
        return F.struct(F.coalesce(last("title"), F.lit("")).alias("title"), url.alias("url"), extract_domain(url).alias("domain"), cited.alias("cited"), last("snippet").alias("snippet"), F.when(F.size(places) > 0, places).alias("positions"))

    return base.withColumn("sources", F.transform("_keys", source)).drop("_all", "_keys")


CHAT_A = (
    "prompt string, answer_text string, answer_text_markdown string, links_attached array<struct<url:string,text:string,position:int>>, "
    "citations array<struct<url:string,title:string,description:string,cited:boolean>>, web_search_query array<string>"
)
CHAT_B = "results array<struct<content:struct<prompt:string,response_text:string,markdown_text:string,citations:array<struct<url:string,title:string,description:string,section:string>>>>>"


def parse_chat(df: DataFrame, payload: str = "payload", provider: str = "a") -> DataFrame:
    """df with prompt, answer, answerMarkdown, sources and searchQueries of a scraped chat (provider a or b).

    A payload without content gives empty strings and no sources, never a missing row.
    """
    if provider == "a":
        base = df.withColumn("_x", F.from_json(payload, CHAT_A)).select("*", F.col("_x.citations").alias("citations"), F.col("_x.links_attached").alias("links"))
        fields = ("prompt", "answer_text", "answer_text_markdown")
    else:
        first = F.get(F.from_json(payload, CHAT_B)["results"], F.lit(0))["content"]
        cited = F.transform("_x.citations", lambda c: F.struct(c["url"].alias("url"), c["title"].alias("title"), c["description"].alias("description"), (c["section"] == "citations").alias("cited")))
        base = df.withColumn("_x", first).select("*", cited.alias("citations"), F.lit(None).cast("array<struct<url:string,text:string,position:int>>").alias("links"))
        fields = ("prompt", "response_text", "markdown_text")
    merged = merge_links(base)
    named = [F.coalesce(f, F.lit("")) for f in (F.col(f"_x.{fields[0]}"), clean_answer(F.col(f"_x.{fields[1]}")), clean_answer(F.col(f"_x.{fields[2]}")))]
    queries = F.col("_x.web_search_query") if provider == "a" else F.lit(None).cast("array<string>")
    return merged.select(*df.columns, named[0].alias("prompt"), named[1].alias("answer"), named[2].alias("answerMarkdown"), "sources", queries.alias("searchQueries"))
