import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skylark.functions import companies, numbers, text, urls
from skylark.plans import queries


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def one(spark, value, f):
    return values(spark, [(value,)], "v string", f("v").alias("r"))[0][0]


@pytest.mark.parametrize(
    "name, normal, key",
    [
        ("Dora's", "doras", "doras"),
        ("St. Marlo", "st marlo", "stmarlo"),
        ("Fenn&Oak", "fenn and oak", "fennandoak"),
        ("BrightLine", "bright line", "brightline"),
        ("Kilo-Watt", "kilo watt", "kilowatt"),
        ("9lives", "9 lives", "9lives"),
        ("Citroën", "citroen", "citroen"),
        ("  Two   Words ", "two words", "twowords"),
    ],
)
def test_brand_names(spark, name, normal, key):
    assert (one(spark, name, text.normalize_brand_name), one(spark, name, text.brand_match_key)) == (normal, key)


def test_blank_and_trim(spark):
    rows = [(None,), ("",), (" \t\n ",), (" x ",)]
    assert values(spark, rows, "v string", text.is_blank("v")) == [(True,), (True,), (True,), (False,)]
    assert one(spark, " a b ", text.trim_all) == "a b"


def test_word_functions(spark):
    assert one(spark, "Hello, Señor_X! 2", text.normalize_words) == "hello señor_x 2"
    got = values(spark, [("red green blue", "green blue yellow"), ("a b", "green"), (None, "x")], "a string, b string", text.word_overlap("a", "b"))
    assert got[0] == (0.5,) and got[1] == (0.0,)
    assert one(spark, "Academia Delta of Soria", text.company_variations) == ["academiadeltaofsoria", "delta", "soria"]
    assert one(spark, r"A [2] and \[1\] and [2].", text.inline_citations) == [1, 2]
    assert one(spark, "  Total Sales (EUR) ", text.clean_column_name) == "total_sales_eur"
    assert one(spark, "See http://x.y/?a=1 now. Is it? Yes! Is it? Why", text.questions) == ["Is it?"]
    assert one(spark, "a\n \n\n b \n", text.collapse_blank_lines) == "a\n\nb"
    assert values(spark, [(["a", "a", "b", "a"],)], "v array<string>", text.without_adjacent_repeats("v")) == [(["a", "b", "a"],)]
    assert one(spark, "Ana, ana banana ANA", lambda c: text.count_name(c, "ana")) == 3


@pytest.mark.parametrize(
    "url, domain, full",
    [
        ("https://www.shop.example.co.uk/a?b#c", "example.co.uk", "shop.example.co.uk"),
        ("example.com/path", "example.com", "example.com"),
        ("HTTP://User@Blog.Example.ORG:8080", "example.org", "blog.example.org"),
        ("https://translate.google.com/translate?hl=en&u=https%3A%2F%2Fnews.example.net%2Fx", "example.net", "news.example.net"),
        ("http://127.0.0.1/x", "http://127.0.0.1/x", "127.0.0.1"),
        ("localhost", "localhost", "localhost"),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_domains(spark, url, domain, full):
    assert one(spark, url, urls.extract_domain) == domain
    assert one(spark, url, lambda c: urls.extract_domain(c, with_subdomain=True)) == full


def test_normal_urls(spark):
    assert one(spark, "HTTPS://Ex.COM:443/A?b=1#c", urls.normalize_url) == "https://ex.com/A"
    assert one(spark, "http://ex.com", urls.normalize_url) == "http://ex.com/"
    assert one(spark, "http://ex.com/a?b=1#c", lambda c: urls.normalize_url(c, False)) == "http://ex.com/a?b=1"
    assert one(spark, "no url", urls.normalize_url) == "no url"


def test_numbers(spark):
    assert values(spark, [("1.5",), (" ",), ("x",), ("NaN",), (None,)], "v string", numbers.number_of("v")) == [(1.5,), (None,), (None,), (None,), (None,)]
    assert values(spark, [(2500000,), (0,), (None,)], "v long", numbers.micros_to_unit("v"), numbers.micros_to_unit("v", False)) == [(2.5, 2.5), (None, 0.0), (None, None)]
    got = values(spark, [([1.0, 2.0, 3.0],), ([0.0, 5.0],), ([2.0, 2.0, 2.0],), ([-1.0, 0.0, 1.0],), ([],)], "v array<double>", numbers.trend_pct("v", 2), numbers.linear_trend("v"))
    assert got == [(50.0, 0.5), (500.0, None), (0.0, 0.0), (100.0, None), (None, None)]
    assert str(one(spark, "2024-02", numbers.parse_year_month)) == "2024-02-01"
    with pytest.raises(Exception, match="not a YYYY-MM"):
        one(spark, "2024-2", numbers.parse_year_month)
    assert values(spark, [(2024, 13), (2024, 2)], "y int, m int", numbers.month_start("y", "m").cast("string")) == [(None,), ("2024-02-01",)]
    assert math.isclose(values(spark, [(0.25,)], "v double", numbers.round1(F.col("v")))[0][0], 0.3)


def test_companies(spark):
    rows = [("Escuela Sol (Lugo)", "Lugo, Galicia"), ("Marea Lugo - Galicia", "Lugo, Galicia"), ("Academia Lugo", "Lugo"), (None, "Lugo"), ("Marea", None)]
    hints = companies.location_hints("p")
    got = values(spark, rows, "n string, p string", companies.normalize_company("n", hints))
    assert got == [("Escuela Sol",), ("Marea",), ("Academia Lugo",), (None,), ("Marea",)]
    assert one(spark, "A / B - C", companies.location_hints) == ["A / B - C", "A", "B - C", "A / B", "C", "B"]
    assert values(spark, [("Marea Norte Lugo", ["Lugo"])], "n string, h array<string>", companies.normalize_company("n", "h", {"Marea": ["mareanor"]})) == [("Marea",)]


def test_benchmark_overlaps_read_every_item(spark, tmp_path):
    """Items with id 40 and more count, as do documents without id and repeated rows."""
    docs = [(1, "red green blue"), (None, "Blue sea"), (3, "nothing here"), (1, "red green blue"), (4, None), (5, "a b")]
    items = [(41, "green blue yellow"), (199, "the sea"), (0, "unlike"), (None, "red"), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.benchmark_overlaps(spark, str(tmp_path)).collect()
    want = [(1, 41, 0.5), (1, 41, 0.5), (1, None, 1 / 3), (1, None, 1 / 3), (None, 41, 0.25), (None, 199, 1 / 3)]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_patterns_on_very_long_texts(spark):
    long = [("a." * 100_000 + "com",), ("x@" + "a." * 100_000,), (".a{" + "b:c;" * 100_000 + "}",), ("the" + " " * 100_000 + "re",), ("@media x {" + ".a{b:c}" * 50_000 + "}",), ("{" * 100_000,)]
    df = spark.createDataFrame(long, "t string")
    got = df.select(urls.is_domain("t").alias("d"), urls.extract_domain("t").alias("e"), F.length(text.without_css("t")).alias("n")).collect()
    assert [r.d for r in got] == [True, False, False, False, False, False] and got[0].e == "a.com"
    assert got[2].n == 0 and got[4].n == 0 and got[3].n == 100_005


def test_css_goes_and_prose_stays(spark):
    cases = {
        "use {name: value} here": "use {name: value} here",
        "a .x{color:red} b": "a  b",
        ":root{--a:1;--b:2}text": "text",
        "@supports (x:y){.a{b:c}.d{e:f}}after": "after",
        'see {"k": 1} and .net 5': 'see {"k": 1} and .net 5',
        ".a{} stays": ".a{} stays",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", text.without_css("t").alias("o")).collect()} == cases


def test_public_suffix_rules(spark):
    rules = spark.createDataFrame([(r,) for r in ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", ""]], "rule string")
    want = {
        "a.b.example.com": "example.com", "example.co.uk": "example.co.uk", "x.example.co.uk": "example.co.uk", "co.uk": None, "www.ck": "www.ck", "a.www.ck": "www.ck",
        "foo.bar.ck": "foo.bar.ck", "b.foo.bar.ck": "foo.bar.ck", "bar.ck": None, "x.city.kawasaki.jp": "city.kawasaki.jp", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp",
        "new.tld": "new.tld", "q.new.tld": "new.tld", "single": None, "10.0.0.1": None, "": None, "A.Example.COM": "example.com", "a." * 3000 + "com": "a.com",
    }
    df = spark.createDataFrame([*[(h, 1) for h in want], (None, 1), ("q.new.tld", 1)], "h string, domain int")
    got = urls.suffix_domains(df, "h", rules).collect()
    assert len(got) == len(want) + 2 and {r.h: r.domain for r in got} == want | {None: None}
    assert urls.suffix_domains(df.limit(0), "h", rules).count() == 0


def test_dedent(spark):
    cases = {
        "\n    You are\n    a judge.\n\n    - one\n      - two\n\n    1. a\n    2. b\n  ": "You are a judge.\n\n- one\n  - two\n\n1. a\n2. b",
        "a\n  b": "a   b", "\t\tx\n\t\ty\n\n\n\t\tz": "x y\n\n z", "": "", " \n \n": "", "  b. x\n  c. y": "b. x\nc. y", "-x\ny": "-x y", "  w\n" * 20_000: "w " * 19_999 + "w", None: None,
    }
    assert dict(values(spark, [(t,) for t in cases], "t string", "t", text.dedent("t"))) == cases
