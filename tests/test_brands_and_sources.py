import itertools

import pytest
from pyspark.sql import functions as F

from skylark.operators import brands, citations, payloads, sources, topics, visibility
from skylark.plans import payload_queries, queries

SOURCES = "array<struct<title:string,url:string,domain:string,cited:boolean,snippet:string,positions:array<int>>>"


def ranked(spark, text, brand_list, entities=None):
    df = spark.createDataFrame([(text, entities)], "t string, e array<struct<name:string,type:string>>")
    return brands.rank_brands(df, "t", brand_list, "e" if entities is not None else None).first()["brands"]


SPELLINGS = ["Fenn&Oak", "Fenn & Oak", "Fenn and Oak", "FennAndOak", "Fenn-and-Oak", "fennandoak", "Fenn  &\tOak", "FENN & OAK"]


@pytest.mark.parametrize("name", ["Fenn&Oak", "Fenn and Oak", "FennAndOak"])
def test_spellings_of_a_brand(spark, name):
    df = spark.createDataFrame([(f"I like {s} a lot.",) for s in SPELLINGS], "t string")
    assert {tuple(r["brands"]) for r in brands.rank_brands(df, "t", [{"shortName": name}]).collect()} == {(name,)}


@pytest.mark.parametrize("text, name, hit", [("a 7-Mares day", "7mares", True), ("CITROËN", "Citroen", True), ("inside hpx", "HP", False), ("an HP.", "HP", True), ("Dora’s", "Nora", False), ("the Doras", "Dora's", True)])
def test_boundaries_and_accents(spark, text, name, hit):
    assert bool(ranked(spark, text, [{"shortName": name}])) == hit


def test_ranking_by_place(spark):
    known = [{"shortName": "Alto"}, {"shortName": "Brix", "aliases": ["Brixton Co"]}, {"shortName": "Cent", "domain": "cent.example"}]
    assert ranked(spark, "See cent.example, Brixton Co and Alto", known) == ["Cent", "Brix", "Alto"]
    assert ranked(spark, None, known) == []
    assert ranked(spark, "Dolo beats brixtonco", known, [("Dolo", "Brand"), ("brixtonco", "brand"), ("x", "place")]) == ["Dolo", "Brix"]


def test_brand_tables(spark):
    own = spark.createDataFrame([("A", None)], "shortName string, aliases array<string>")
    rivals = spark.createDataFrame([("B", ["b"]), ("b", None)], "shortName string, aliases array<string>")
    both = brands.concat_brands(own, rivals)
    assert sorted((r.shortName, r.aliases, r.isCompetitor) for r in both.collect()) == [("A", [], False), ("B", ["b"], True), ("b", [], True)]
    assert [r.error for r in brands.brand_list_errors(both).collect()] == ["short name repeats: b"]


def source(title, url, domain, cited=None, snippet=None, positions=None):
    return (title, url, domain, cited, snippet, positions)


def test_enriched_sources(spark):
    known = [{"shortName": "Alto", "domain": "alto.example", "isCompetitor": False}, {"shortName": "Fenn&Oak", "domain": "fenn.example", "isCompetitor": True}]
    rows = [([source("Alto news", "http://x.example/fenn&oak", "alto.example"), source("Fenn and Oak", "http://y.example", "fenn.example"), source("Dolo", "u", "d")], [("Dolo", "brand"), ("Alto", "brand")]), (None, None)]
    df = spark.createDataFrame(rows, f"sources {SOURCES}, e array<struct<name:string,type:string>>")
    out = sources.rank_in_sources(sources.enrich_sources(df, known, entities="e")).collect()
    a, b, c = out[0]["sources"]
    assert (a.mentionedBrands, a.mentionedCompetitors, a.linkedBrand, a.linkedCompetitor) == (["Alto"], ["Fenn&Oak"], "Alto", None)
    assert (b.mentionedBrands, b.mentionedCompetitors, b.linkedCompetitor) == ([], [], "Fenn&Oak")
    assert c.mentionedCompetitors == ["Dolo"]
    assert (out[0]["ranked_mentions"], out[0]["ranked_links"]) == (["Alto", "Fenn&Oak", "Dolo"], ["Alto", "Fenn&Oak"])
    assert out[1]["sources"] == [] and out[1]["ranked_mentions"] == []
    mapper = spark.createDataFrame([("u", "media", "news")], "key string, topic string, subtopic string")
    labelled = sources.categorize_sources(df.filter("sources is not null"), mapper).first()["sources"]
    assert [s.category for s in labelled] == [None, None, "media"]


def test_visibility(spark):
    known = [{"shortName": "Alto", "domain": "alto.example"}, {"shortName": "Brix", "domain": "brix.example"}]
    rows = [
        (1, "Alto and alto, not Altonia", [source("", "http://a.alto.example/x?u=1", None, True), source("", "http://a.alto.example/X#f", None, False)]),
        (2, None, [source("", "http://a.alto.example/x", "alto.example", True), source("", "http://other.example", None, None)]),
        (3, "nothing", None),
    ]
    df = spark.createDataFrame(rows, f"result_id long, answer string, sources {SOURCES}")
    noted = visibility.annotate_visibility(df, known)
    assert noted.count() == 6
    got = {r.brand: (r.answer, r.citations, r.unique_citations, r.refs, r.unique_refs) for r in visibility.aggregate_visibility(noted).collect()}
    assert got == {"Alto": (1, 2, 1, 3, 1), "Brix": (0, 0, 0, 0, 0)}
    stats = visibility.cited_urls({"a": df.filter("result_id = 1"), "b": df.filter("result_id <> 1")})
    assert {r.url: (r.total, r.a, r.b) for r in stats.collect()} == {"http://a.alto.example/x": (3, 2, 1), "http://other.example/": (1, 0, 1)}


def test_citations(spark):
    s = [source("One", "u1", "d", positions=[3]), source("Two", "u2", "d"), source("One again", "u1", "d")]
    df = spark.createDataFrame([("see [3] and [2] and [9]", None, s), ("nothing", "Delta", [source("Delta school", "u3", "delta.com", True), source("x", "u4", "y.com")])], f"text string, company string, sources {SOURCES}")
    linked = citations.link_statements(df).collect()
    assert [x.source.url for x in linked[0].supporting] == ["u2", "u1"]
    assert [(x.source.url, round(x.score, 3)) for x in linked[1].supporting] == [("u3", 0.5)]
    found = citations.sources_for_company(df).collect()
    assert [x.url for x in found[1].company_sources] == ["u3"]


def test_taxonomies(spark):
    df = topics.topics_from_map(spark, {"Fruit": ["fruits", "red apple", "apple red", "pears", "peers"], "Empty": [], "Far": ["abc", "abcde"]})
    got = {(r.topic, r.subtopic, r.other) for r in topics.subtopic_errors(df).collect()}
    assert got == {("Fruit", "fruits", "Fruit"), ("Fruit", "red apple", "apple red"), ("Fruit", "pears", "peers")}
    labels = spark.createDataFrame([("Far", "abc"), ("Far", "fruits"), (None, None)], "topic string, subtopic string")
    assert [tuple(r) for r in topics.invalid_labels(labels, df).collect()] == [("Far", "fruits")]


def test_every_spelling_pair_of_two_words(spark):
    names = [a + s + b for (a, b), s in itertools.product([("blue", "moon")], [" ", "-", "", " & ", "'"])]
    df = spark.createDataFrame([(f"so {n}, yes",) for n in names], "t string")
    assert all(r["brands"] == ["Blue Moon"] for r in brands.rank_brands(df, "t", [{"shortName": "Blue Moon"}]).collect())


def test_funnels(spark):
    df = spark.createDataFrame([([("know", "see", [("a", "x"), ("b", "y")])],)], "stages array<struct<stage:string,goal:string,categories:array<struct<name:string,description:string>>>>")
    assert [(r.stage_ord, r.category_ord, r.name) for r in topics.funnel_categories(df).collect()] == [(0, 0, "a"), (0, 1, "b")]
    assert [tuple(r) for r in topics.funnel_topics(df).collect()] == [("know", ["a", "b"])]
    assert df.select(F.size("stages")).first()[0] == 1


def test_every_document_is_an_answer(spark, tmp_path):
    """Documents without pages are answers too, and pages without a document stay."""
    docs = [(0, "there it is"), (7, "Onre and there"), (900, "Thation."), (None, "Onre")]
    pages = [(i, f"http://www.example.com/{i}", "") for i in (0, 1, 50)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.brand: (r.answer, r.citations, r.refs) for r in queries.answered_visibility(spark, str(tmp_path)).collect()}
    assert got == {"there": (2, 0, 0), "Onre": (2, 0, 0), "Thation": (1, 2, 3)}
    rows = queries.answered_annotation(spark, str(tmp_path)).collect()
    assert {r.result_id for r in rows} == {0, 5, 7, 900, None} and len(rows) == 15
    found = {r.result_id: r.n_supporting for r in payload_queries.supported_statements(spark, str(tmp_path)).collect()}
    assert set(found) == {0, 5, 7, 900, None} and found[900] == 0


def test_top_domains_has_no_cap(spark, tmp_path):
    pages = spark.range(1200).selectExpr("id page_id", "concat('http://site', id, '.com/') url", "'' html")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.top_domains(spark, str(tmp_path)).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1201))


def test_names_of_domains(spark):
    cases = {"www.acme-corp.com": ["acme-corp", "acme corp"], "AcmeCorp.co.uk": ["acmecorp", "acme corp"], "shop.acme.de": ["shop.acme"], "localhost": ["localhost"], "m.acme.org": ["acme"]}
    df = spark.createDataFrame([(d,) for d in cases], "d string")
    assert [r.n for r in df.select(citations.domain_names(F.col("d")).alias("n")).collect()] == list(cases.values())


def test_style_rules_and_images_go(spark):
    texts = [
        ("a :root{--x: 1px;}.b{color:red}.c{margin:0;padding:0}. end", "a end"),
        ("see @supports (display:grid){.x{display:grid}} this  {not css} ", "see this {not css}"),
        ("one\r\n\n\n\n two", "one\n\ntwo"),
    ]
    df = spark.createDataFrame(texts, "t string, want string")
    assert [r.got for r in df.select(payloads.clean_text(F.col("t")).alias("got")).collect()] == [w for _, w in texts]
    answer = spark.createDataFrame([("Hi ![pic](http://x/y.png) there\n Image \n\n\n\nend",)], "t string").select(payloads.clean_answer(F.col("t"))).first()[0]
    assert answer == "Hi  there\n\nend"


def test_brands_of_a_table(spark):
    texts = [t for t in SPELLINGS] + ["thea ndre", "the and re", "a 7-Mares day", "CITROËN", "inside hpx", "an HP. HP", "loveHP", "the Doras", "Brix/Alto", None, "", "the" + " " * 3000 + "re", "x " * 20000 + "Alto", "品牌很好", "Fenn, Oak", "fennand oak"]
    names = ["Fenn&Oak", "the re", "7mares", "Citroen", "HP", "Dora's", "Alto", "Brix", "品牌", "A B C D E F G"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    one = {r.i: r.brands for r in brands.rank_brands(df, "t", [{"shortName": n} for n in names]).collect()}
    many = spark.createDataFrame([(n, None) for n in names] + [(f"Zq{i}x", [f"Other {i} Name"]) for i in range(2000)] + [(" ", None), ("Nord", [" ", "nørd & süd"])], "shortName string, aliases array<string>")
    joined = {r.i: r.brands for r in brands.rank_brands(df, "t", many).collect()}
    assert {i: sorted(b) for i, b in one.items()} == {i: sorted(b) for i, b in joined.items()}
    by_text = {texts[i]: b for i, b in one.items()}
    assert all(by_text[s] == ["Fenn&Oak"] for s in SPELLINGS) and by_text["thea ndre"] == [] and by_text["the and re"] == ["the re"]
    assert by_text["Brix/Alto"] == ["Brix", "Alto"] and by_text["Fenn, Oak"] == [] and by_text["fennand oak"] == []
    assert [by_text[t] for t in ("inside hpx", "an HP. HP", "loveHP", "the Doras", "品牌很好")] == [[], ["HP"], ["HP"], ["Dora's"], ["品牌"]]
    assert by_text["the" + " " * 3000 + "re"] == ["the re"] and by_text["x " * 20000 + "Alto"] == ["Alto"]


def test_words_of_a_name_are_not_broken(spark):
    texts = ["i can't here", "ther e and er", "ther eander", "Th ere", "the re", "There", "the-re", "theandre", "A-BC"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    names = ["the re", "a b c"]
    one = {texts[r.i]: r.brands for r in brands.rank_brands(df, "t", [{"shortName": n} for n in names]).collect()}
    joined = {texts[r.i]: r.brands for r in brands.rank_brands(df, "t", spark.createDataFrame([(n, None) for n in names], "shortName string, aliases array<string>")).collect()}
    assert one == joined == dict.fromkeys(texts[:4], []) | dict.fromkeys(texts[4:8], ["the re"]) | {"A-BC": ["a b c"]}


def test_brands_in_texts_is_its_sql_on_odd_texts(spark, tmp_path):
    """Letters outside ASCII beside a name, "and" glued to one word, other accents and marks, white space, long gaps, places in characters."""
    import random

    import duckdb

    texts = ["on the Reçeau", "thereé", "çthere", "theand re", "the andre", "thё re", "thểre", "the️re", "whiſe", "thereſ", "whiseK", "whıse", "whİse", "the\x0bre", "the re",
             "the re", "there\n", "t.he r'e", "😀😀😀 7there whise", "😀 whise2 a there", "the" + "and " * 20_000 + "re", "whise théRe", "éthe-re", "Ther eander", "", None]
    rng = random.Random(3)
    bits = ["é", "e", "E", "and", "And", " ", "-", "'", "&", ".", "\n", "\t", "\x0b", "ç", "ñ", "́", "ſ", "K", "7", "x", "X", "ü", "😀", "", "", "", ""]
    some = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 2)))
    texts += [some() + "".join(x + some() for x in rng.choices(["the", "re", "there", "The", "Whise", "wh", "ise"], k=3)) for _ in range(1500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(queries.ORACLE["brands_in_texts"]).fetchall())
    got = {r.doc_id: r.brands for r in queries.brands_in_texts(spark, str(tmp_path)).collect()}
    assert {repr(texts[i][:40]): (got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == len(texts)
    assert sum("the re" in b for b in want.values()) > 40 and sum("whise" in b for b in want.values()) > 40


@pytest.mark.parametrize("text, name, hit", [("Blue" + " and" * 20_000 + " Andes", "Blue Andes", True), ("blueandandes", "Blue Andes", True), ("C++ (x)!", "c++", True), ("a Rise, b", "Rise and", True), ("and", "and", False), ("é品牌很好", "品牌", True)])
def test_patterns_of_names(spark, text, name, hit):
    assert bool(ranked(spark, text, [{"shortName": name}])) == bool(ranked(spark, text, [], [(name, "brand")])) == hit
