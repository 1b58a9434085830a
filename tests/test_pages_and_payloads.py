import json

from pyspark.sql import functions as F

from skylark.operators import keywords, pages, payloads, records

HTML = """<html><head><title> Shop </title><meta name="description" content="Cups"><script type="application/ld+json">
{"@type": "Product", "author": {"@type": "Person", "name": "Ann"}}</script><script type="application/ld+json">{broken</script></head><body>
<nav><h1>Menu</h1><a href="http://nav.example/">n</a></nav>
<h2>First</h2><p>Short</p><p>A paragraph that is long enough to count<p>Another paragraph that is never closed properly
<h1>Top</h1><h3>Deep</h3><h3></h3><h2>first</h2>
<ul><li>one<ul><li>inner</li></ul><li>two</ul>
<table><tr><th>a<th>b<tr><td>1</table>
<form id="f" class="c"><label for="q">Query</label><input id="q" name="q"><select name="s"></select><button type="submit">Go</button></form>
<div><input placeholder="Mail"><input type="checkbox" aria-label="OK"></div>
<a href="http://www.shop.example/a">in</a><a href="/rel">rel</a><a href="http://other.example/x.PDF">pdf</a><a href="http://other.example/x.PDF">again</a>
<footer><p>This footer paragraph is long but does not count</p></footer></body></html>"""


def content(spark, **options):
    df = spark.createDataFrame([(1, "http://shop.example/", HTML), (2, "http://b.example/", None), (3, "http://c.example/", "")], "id int, url string, html string")
    return pages.page_content(df, **options)


def test_structure(spark):
    row = content(spark).filter("id = 1").first()
    assert [(h.tag, h.text, h.depth) for h in row.headings] == [("h2", "First", 1), ("h1", "Top", 1), ("h3", "Deep", 2), ("h3", "", 2), ("h2", "first", 2)]
    assert [p[:9] for p in row.paragraphs] == ["A paragra", "Another p"]
    assert [list(x["items"]) for x in row.lists] == [["oneinner", "inner", "two"], ["inner"]]
    assert row.lists[0].contextHeading == "first"
    assert [list(map(list, t.rows)) for t in row.tables] == [[["a", "b"], ["1"]]]
    assert [(x.href, x.isExternal, x.isPdf) for x in row.links] == [("http://www.shop.example/a", False, False)] + [("http://other.example/x.PDF", True, True)] * 2
    assert row.meta == {"title": "Shop", "description": "Cups"} and len(row.schemas) == 1
    first, second = row.forms
    assert (first.id, [(f.type, f.name, f.label) for f in first.fields]) == ("f", [("text", "q", "Query"), ("select", "s", None), ("submit", None, None)][:2] + [("button", None, None)])
    assert [(f.type, f.label) for f in second.fields] == [("text", "Mail"), ("checkbox", "OK")]
    assert "http://shop.example/rel" in [x.href for x in content(spark, resolve_relative=True).filter("id = 1").first().links]


def test_statistics(spark):
    stats = pages.page_stats(content(spark), ["id"])
    one = stats.filter("id = 1").first()
    h = one.headingStats
    assert (h.totalHeadings, h.oneH1, h.maxDepth, h.avgSubheadings, h.skippedLevels, h.emptyHeadings, h.duplicateHeadings, h.h3) == (5, True, 2, 3.0, 3, 1, 1, 2)
    assert one.schemaStats["Product"] and one.schemaStats["Author"] and one.schemaStats["Author.name"] and not one.schemaStats["Recipe"]
    assert (one.numParagraphs, one.numLists, one.avgListLength, one.numTables, one.numForms, one.numExternalLinks) == (2, 2, 2, 1, 2, 2)
    total = pages.aggregate_pages(stats).first()
    assert (total["count"], total.avgParagraphs, total.pctOneH1, total.Product, total.avgListLength) == (3, 0.7, 33.3, 1, 2.0)
    assert pages.aggregate_pages(stats.limit(0)).count() == 0
    assert json.loads(pages.page_context(content(spark), ["id"], chars=100_000).filter("id = 1").first().context)["headings"][0] == "First"


OVERVIEW = {
    "textBlocks": [
        {"type": "paragraph", "snippet": "Hello  there.", "referenceIndexes": [7, 8]},
        {"snippet": "Hello  there.", "referenceIndexes": [7, 8]},
        {"type": "list", "list": [{"title": "A:", "snippet": "first"}, {"snippet": "second", "list": [{"title": "inner"}]}]},
        {"type": "table", "rows": [["k", "v"], ["1", "2"]]},
        {"type": "code", "language": "sql", "snippet": "select 1"},
        {"type": "carousel", "snippet": "no"},
    ],
    "references": [
        {"index": 7, "title": "T", "link": "http://a.example/x", "snippet": "s"},
        {"index": 8, "link": "http://a.example/x"},
        {"index": 9, "title": "U", "url": "http://b.example/"},
        {"title": "no index", "link": "http://c.example"},
    ],
}


def test_overviews(spark):
    rows = [(1, json.dumps(OVERVIEW)), (2, json.dumps({"aiOverview": OVERVIEW})), (3, "{}"), (4, None), (5, "broken")]
    got = {r.id: r for r in payloads.parse_overview(spark.createDataFrame(rows, "id int, payload string")).collect()}
    assert got[1].answer == "Hello there. [1]\n\nA: first\nsecond\ninner\n\nk | v\n1 | 2\n\nselect 1"
    assert got[1].answerMarkdown.startswith("Hello there. [1]\n\n- A: first\n- second") and "| --- | --- |" in got[1].answerMarkdown and "[Code: sql]" in got[1].answerMarkdown
    assert [(s.title, s.url, s.domain, s.cited, s.positions) for s in got[1].sources] == [("T", "http://a.example/x", "a.example", True, [1]), ("U", "http://b.example/", "b.example", None, None)]
    assert got[2].answer == got[1].answer
    assert [(got[i].answer, got[i].sources) for i in (3, 4, 5)] == [("", [])] * 3


def test_chats(spark):
    a = {
        "prompt": "p", "answer_text": "see\n\n\n\n![x](y) it ", "links_attached": [{"url": "http://a.example/1#top", "position": 2}, {"url": "http://b.example/", "position": 1}, {"url": "http://a.example/1", "position": 3}],
        "citations": [{"url": "http://a.example/1?q=1", "title": "A", "description": "d", "cited": False}, {"url": "http://c.example/", "title": "C", "cited": False}], "web_search_query": ["w"],
    }
    got = payloads.parse_chat(spark.createDataFrame([(json.dumps(a),), (None,)], "payload string")).collect()
    assert [(s.url, s.title, s.cited, s.positions) for s in got[0].sources] == [("http://b.example/", "", True, [1]), ("http://a.example/1?q=1", "A", True, [2, 3]), ("http://c.example/", "C", False, None)]
    assert (got[0].prompt, got[0].answer, got[0].searchQueries) == ("p", "see\n\n it", ["w"])
    assert (got[1].prompt, got[1].sources) == ("", [])
    b = {"results": [{"content": {"prompt": "q", "response_text": "r", "citations": [{"url": "http://a.example/", "title": "A", "section": "citations"}, {"url": "http://b.example/", "section": "more"}]}}]}
    row = payloads.parse_chat(spark.createDataFrame([(json.dumps(b),)], "payload string"), provider="b").first()
    assert [(s.url, s.cited) for s in row.sources] == [("http://a.example/", True), ("http://b.example/", False)]


def test_keyword_records(spark):
    months = [{"year": "2024", "month": m, "monthlySearches": str(v)} for m, v in (("MARCH", 30), ("JANUARY", 0), ("FEBRUARY", 20), ("NEVER", 1))]
    payload = {"results": [
        {"text": "cups", "keywordIdeaMetrics": {"avgMonthlySearches": "50", "competition": "LOW", "averageCpcMicros": "0", "lowTopOfPageBidMicros": "1500000", "monthlySearchVolumes": months},
         "keywordAnnotations": {"concepts": [{"name": " Cup ", "conceptGroup": {"name": "Others"}}, {"name": "Others"}]}, "closeVariants": ["cup"]},
        {"text": ""}, {"text": "plain", "keywordMetrics": {"competitionIndex": "7"}},
    ]}
    got = keywords.keyword_records(spark.createDataFrame([(json.dumps(payload),), (None,)], "payload string")).collect()
    assert [r.keyword for r in got] == ["cups", "plain"]
    r = got[0]
    assert (r.avgMonthlySearches, r.averageCpc, r.lowTopOfPageBid, r.searchVolume, r.concepts, r.conceptGroups) == (50.0, None, 1.5, [0.0, 20.0, 30.0], ["Cup"], None)
    assert (r.yoy, r.three_months, r.one_month, round(r.trend, 4)) == (None, 3000.0, 50.0, 0.9)
    assert (got[1].competitionIndex, got[1].trend) == (7.0, None)


def test_records(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", "z"), (4, "a", "w")], "_ord int, k string, v string")
    assert sorted(r.v for r in records.keep_first(df, "k", "_ord").collect()) == ["x", "z"]
    assert sorted((r.v, r["_at"]) for r in records.keep_last(df, "k", "_ord").collect()) == [("w", 1), ("z", 3)]
    assert records.sample_rows(df, 2, seed=1, ident="_ord").count() == 2 and records.sample_rows(df, 9).count() == 4
    assert [r.section for r in records.attribute_sections(df, "_ord").orderBy("ord").collect()] == ["## K\n\na, b, a", "## V\n\nx, y, z, w"]
    usage = spark.createDataFrame([("m-2024-01-01", 1_000_000, 0, 1_000_000), ("free", 5, 5, 10), ("x", 1, 1, 2), ("m", None, None, None)], "model string, inputTokens long, outputTokens long, totalTokens long")
    prices = spark.createDataFrame([("m", 2.0, 4.0), ("free", 0.0, 0.0)], "model string, input double, output double")
    costed = records.with_cost(usage, prices)
    assert {r.model: r.cost for r in costed.collect()} == {"m-2024-01-01": 2.0, "free": None, "x": None, "m": None}
    assert tuple(records.total_usage(costed).first()) == (1_000_006, 6, 1_000_012, 3, 2.0)
    assert df.select(records.empty_record([F.col("k")])).collect()[1][0]


def test_lists_nest_to_any_depth(spark):
    item = {"title": "level 299"}
    for level in range(298, -1, -1):
        item = {"title": f"level {level}", "snippet": None if level % 2 else 7, "list": [item, "no item", None, {"snippet": f"after {level}"}]}
    rows = [(1, json.dumps({"textBlocks": [{"type": "list", "list": [item]}, {"type": "list"}, {"type": "list", "list": "none"}]}))]
    got = payloads.parse_overview(spark.createDataFrame(rows, "id int, payload string")).first()
    said = got.answer.split("\n")
    assert said[:3] == ["level 0 7", "level 1", "level 2 7"] and said[298:302] == ["level 298 7", "level 299", "after 298", "after 297"] and said[-1] == "after 0" and len(said) == 599
    assert got.answerMarkdown.split("\n")[12] == "- level 12 7"


def test_large_and_deep_pages(spark):
    """20,000 items, headings and fields, and 20,000 open boxes, in one pass."""
    n = 20_000
    many = "<ul>" + "<li>x" * n + "</ul>" + "<h2>a<b>c</b></h2><h3>d</h3>" * n + "<form>" + "<label for=i>L</label><input id=i>" * n + "</form>"
    rows = [(1, "http://a.example/", many), (2, "http://a.example/", "<div>" * n + "<p>A text of more than twenty letters<ul><li>deep" + "</div>" * n), (3, "http://a.example/", "why " * 200_000)]
    got = {r.id: r for r in pages.page_content(spark.createDataFrame(rows, "id int, url string, html string")).drop("html").collect()}
    assert [len(x["items"]) for x in got[1].lists] == [n] and len(got[1].headings) == 2 * n and got[1].headings[-1].parent == 2 * n - 2
    assert [(len(f.fields), f.fields[-1].label) for f in got[1].forms] == [(n, "L")]
    assert got[2].paragraphs == ["A text of more than twenty letters"] and [list(x["items"]) for x in got[2].lists] == [["deep"]]
    assert got[3].questions == []


def test_elements_leave_in_bounded_lots():
    import pyarrow as pa

    from skylark.operators import html_elements

    pages_ = pa.array(["<ul>" + "<li>x" * 99 + "</ul>"] * 1000 + [None])
    lots = list(html_elements._lots(iter([pages_, pages_[:0], pages_[:3]])))
    assert [len(x) for x in lots] == [200] * 5 + [1, 3]
    assert sum(len(e) for lot in lots for e in lot.to_pylist()) == 100 * 1003


def test_items_leave_in_bounded_lots():
    import pyarrow as pa

    rows = pa.array([[json.dumps([{"title": "t", "list": [{"title": "u"}]}] * 499), None]] * 250 + [None])
    assert [len(x) for x in payloads._lots(iter([rows, rows[:0], rows[:2]]))] == [51, 51, 51, 51, 47, 2]


def test_clean_text_of_any_white_space(spark):
    pairs = [("plain text", "plain text"), (" a", "a"), ("a ", "a"), ("a  b", "a b"), ("a\u2003", "a"), ("\ufeffa", "a"), ("a \r\n\u2003\n \n\t b", "a\n\nb"), ("a\u00a0b", "a b"), ("a\u2003b", "a\u2003b"), ("a\n", "a"),
             ("x .a{b:c} y", "x y"), ("\u2003" * 20000 + "z", "z"), ("", ""), (None, None)]
    df = spark.createDataFrame(pairs, "t string, want string")
    assert [r.got for r in df.select(payloads.clean_text(F.col("t")).alias("got")).collect()] == [w for _, w in pairs]


def test_plain_pages_are_cut_by_one_pattern_as_by_the_library():
    """Pages of text and plain tags don't go through HTMLParser, one call a tag; their elements are the same."""
    import random

    from skylark.operators import html_elements

    def by_library(page):
        parser = html_elements._Elements()
        parser.feed(page)
        return parser.finish()

    rng = random.Random(5)
    tags = "p ul ol li table tr th td form label a body head nav footer div section h1 h2 h3 input select button option br".split()
    attrs = ["", "", ' id="a"', ' class="form x"', ' type="submit"', ' href="http://x/y.pdf" id="b"', ' for="a"', ' href=""', ' id="a" id="b"']
    part = lambda: rng.choice([f"<{rng.choice(tags)}{rng.choice(attrs)}>", f"</{rng.choice(tags)}>", "x", " y z ", "\n", 'a>b "q"', "ü", "<title>t</title>"])
    plain = ["".join(part() for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    odd = [p + x for p, x in zip(plain, ["&amp;", "<", "<!-- c --><p>x", "<P>x", "<br/>", "</ p>", "<a b=c>", "<a  id='x'>", "<title>t", "</p x>", "<script><p></script>x", "<title>a<b></title>", '<a id="a"name="b">', "<textarea><p>"])]
    assert all(html_elements._PLAIN.fullmatch(p) for p in plain) and not any(html_elements._PLAIN.fullmatch(p) for p in odd)
    assert all(html_elements._Elements().read(p) == by_library(p) for p in plain + odd)


def test_order_pages_are_plain(spark):
    """The pages of page_parts take the short way, whole."""
    from skylark.operators import html_elements
    from skylark.plans.page_queries import order_pages

    pages_ = [r.html for r in order_pages(spark, "/root/testdata/sf0.001").collect()]
    assert pages_ and all(html_elements._PLAIN.fullmatch(p) for p in pages_)
