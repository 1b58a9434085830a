import base64
import json

import pytest
from pyspark.sql import functions as F

from skylark.sources import google, jobs, lookups, transport
from skylark.streaming import enrich
from skylark.tools import backend, generators, presets, rows


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord int, text string")


def test_classifiers_keep_rows_and_labels(spark):
    df = texts(spark, "pure joy today", None, "", "  ", "anger, only anger")
    got = presets.plutchik_emotion().batch(df, ["text"]).orderBy("ord").collect()
    assert [r.result for r in got] == ["joy", None, None, None, "anger"]
    assert [r.usage is None for r in got] == [False, True, True, True, False]
    many = presets.labeler({"a": "x", "b": "y"}).batch(df, ["text"]).orderBy("ord").collect()
    assert all(set(r.result) <= {"a", "b"} for r in many if r.result is not None)
    assert 1 <= presets.scorer("fun", "how funny", 1, 5).batch(df, ["text"]).orderBy("ord").first().result <= 5
    pair = presets.topic_assigner({"food": ["bread", "soup"]}).batch(texts(spark, "a soup"), ["text"]).first().result
    assert (pair.topic, pair.subtopic in ("bread", "soup")) == ("food", True)
    assert isinstance(presets.summarizer().batch(df, ["text"]).orderBy("ord").first().result, str)
    assert presets.keyword_to_prompt().batch(df, ["text"]).orderBy("ord").first().result


@pytest.mark.parametrize("padding", [0, 3000])
def test_stub_finds_labels_early_in_long_messages(padding):
    """A label wins wherever it stands; six labels, so that no hash pick finds all."""
    labels = ["red", "green", "blue", "black", "white", "grey"]
    for name in labels:
        reply = backend.StubBackend().complete("m", [{"role": "user", "content": f"{name} " + "." * padding}], {"enum": labels}, {})
        assert json.loads(reply.text) == name


class Failing:
    def __init__(self):
        self.seen = []

    def complete(self, model, messages, schema, params):
        self.seen.append(messages)
        return backend.Reply('{"label": "zzz"}' if len(self.seen) < 3 else '{"label": "a"}', {"inputTokens": 1, "outputTokens": 1, "totalTokens": 2})


def test_errors_are_fed_back_and_usage_adds_up():
    schema = presets.classifier({"a": "x"}).schema
    failing = Failing()
    assert rows.ask("stub", [{"role": "user", "content": "q"}], schema, {}, 3, failing) == ('{"label": "a"}', {"inputTokens": 3, "outputTokens": 3, "totalTokens": 6}, None)
    assert failing.seen[1][-1]["role"] == "system" and "zzz" in failing.seen[1][-1]["content"]
    text, _, error = rows.ask("stub", [{"role": "user", "content": "q"}], schema, {}, 1, Failing())
    assert text is None and "zzz" in error


def test_templates_are_filled_once(spark):
    df = spark.createDataFrame([("{b} $1",)], "a string")
    assert df.select(rows.fill("{a}-{b}", a=F.col("a"), b="x")).first()[0] == "{b} $1-x"


def test_schemas(spark):
    closed = backend.strict_schema({"type": "object", "propertyNames": {}, "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {}}}}})
    assert closed == {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {}, "additionalProperties": False, "required": []}}}, "additionalProperties": False, "required": ["a"]}
    assert backend.provider_of("gemini-x") == "google" and backend.provider_of("other") == "openai"
    got = generators.auto(texts(spark, "hello world", None), "Say it", {"type": "object", "properties": {"n": {"type": "integer"}}}, ["text"]).orderBy("ord").collect()
    assert isinstance(got[0].result.n, int) and got[1].result is None
    assert generators.spark_type({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}}, "m": {"type": "object"}}}) == "struct<`a`:array<double>,`m`:map<string,string>>"


def test_quotes_have_to_be_literal(spark):
    reply = {"aspects": [{"aspect": "a", "sentiment": "positive", "reason": "r", "quote": q, "context": ""} for q in ("good cup", "bad cup")]}

    class Fixed:
        def complete(self, *a):
            return backend.Reply(json.dumps(reply))

    got = presets.sentiment_extractor().batch(texts(spark, "a good cup"), ["text"], backend=Fixed()).first().result
    assert [a.quote for a in got] == ["good cup"]


def test_generators(spark):
    with pytest.raises(ValueError):
        generators.generate_prompts("x", 5, 2)
    with pytest.raises(ValueError):
        generators.generate_keywords()
    assert len(generators.generate_prompts("cups", 2, 3)) == 2
    assert generators.generate_persona()["keywordSeeds"]
    assert generators.extract_labels(texts(spark, "a", "b"), "ord")
    funnel = generators.generate_funnel(spark, "cups")
    assert funnel.count() == len(generators.FUNNEL) and funnel.filter("size(keywordSeeds) between 3 and 10").count() == funnel.count()
    brands = spark.createDataFrame([(["tea"], [("Cup", "ware")]), (None, None)], "sectors array<string>, portfolio array<struct<name:string,category:string>>")
    assert [len(r.portfolio) for r in generators.portfolio_keywords(brands).collect()] == [1, 0]


def test_secrets_stay_out_of_errors():
    message = transport.error_message("s", 401, "Bearer abc.def key1 " + "x" * 600, ["key1"])
    assert "abc" not in message and "key1" not in message and message.endswith("...")
    calls = []

    def answer(request):
        calls.append(request.key)
        return (500, "boom") if len(calls) < 3 else {"ok": 1}

    assert transport.send_json(transport.RecordedTransport(answer), transport.Request("GET", "u"), "s", wait=lambda s: None) == {"ok": 1} and len(calls) == 3
    with pytest.raises(transport.ServiceError):
        transport.send_json(transport.RecordedTransport({}), transport.Request("GET", "u"), "s")


def test_serp_parameters():
    assert lookups.serp_params("q", type="local", offset=47, results_per_page=500, country="ES", device="TV", filters=[" a ", ""], safe_search=False) == {"q": "q", "gl": "es", "tbs": "a", "safe": "off", "start": 40, "num": 100, "tbm": "lcl"}
    assert lookups.scrape_body("u", formats=["text"], wait=None) == {"url": "u", "outputFormat": ["text", "json"]}


def answers(request):
    if request.params.get("pageToken"):
        return {"textBlocks": [{"snippet": "deferred"}]}
    if request.params.get("q") == "a":
        return {"aiOverview": {"pageToken": "t"}} if "client" not in request.params else ["a", ["b", "c"]]
    if request.params.get("q") == "b":
        return ["b", ["A", "d"]]
    return None


def test_lookups_keep_rows(spark):
    df = spark.createDataFrame([("a",), ("zzz",)], "query string")
    got = {r.query: r for r in lookups.fetch_overviews(df, transport.RecordedTransport(answers), "http://s", "k").collect()}
    assert (got["a"].answer, got["zzz"].answer, got["zzz"].sources) == ("deferred", "", [])
    edges = lookups.expand_suggestions(df.limit(1), transport.RecordedTransport(answers), depth=3).collect()
    assert sorted((e.query, e.suggestion, e.depth) for e in edges) == [("a", "b", 0), ("a", "c", 0), ("b", "A", 1), ("b", "d", 1)]


def test_web_search(spark):
    item = {"type": "message", "content": [{"type": "output_text", "text": "t", "annotations": [{"type": "url_citation", "title": "A", "url": "http://a.example/"}, {"type": "file"}]}]}
    df = spark.createDataFrame([(json.dumps({"output": [{"type": "web_search_call"}, item]}),), (json.dumps({"output": [item]}),)], "payload string")
    got = lookups.parse_web_search(df).collect()
    assert [(r.answer, len(r.sources)) for r in got] == [("t", 1), ("t", 0)]


def batch(request):
    if request.method == "POST":
        return {"jobId": "-".join(sorted(r["url"] for r in request.body["requests"]))}
    if request.url.endswith("/results"):
        urls = request.url.split("/")[-2].split("-")
        return {"results": [{"url": u, "text": f"text of {u}"} for u in urls if u != "bad"][: 100 if request.params["page"] == 0 else 0]}
    return {"status": "finished"}


def test_jobs(spark):
    df = spark.createDataFrame([("a",), ("b",), ("bad",), ("a",)], "url string")
    got = jobs.batch_scrape(df, transport.RecordedTransport(batch), "http://s", "k", wait=lambda s: None).collect()
    assert sorted((r.url, r.page.text if r.page else None) for r in got) == [("a", "text of a"), ("a", "text of a"), ("b", "text of b"), ("bad", None)]
    with pytest.raises(TimeoutError):
        jobs.wait_for(lambda: "running", 5, 10, lambda s: None)
    chat = lambda r: {"snapshot_id": r.body["prompt"]} if r.method == "POST" else ({"prompt": "x", "answer_text": "yes"} if r.params["id"] == "p" else None)
    out = jobs.chat_batch(spark.createDataFrame([("p",), ("q",)], "prompt string"), transport.RecordedTransport(chat), "http://s", "k", wait=lambda s: None).collect()
    assert sorted((r.prompt, r.answer) for r in out) == [("p", "yes"), ("q", "")]


def test_search_console(spark):
    body = google.analytics_request("2024-01-01", "2024-01-31", ["page", "query"])
    key = transport.Request("POST", f"{google.SITES}/sc-domain%3Ax/searchAnalytics/query", body=body).key
    recorded = {key: {"rows": [{"keys": ["http://a", "cups"], "clicks": 2, "position": 1.5}, {"keys": ["http://b"]}]}}
    got = google.search_console_queries(spark, "tok", "sc-domain:x", "2024-01-01", "2024-01-31", ["page", "query"], recorded=recorded).orderBy("page").collect()
    assert [(r.page, r.query, r.clicks, r.position, r.country) for r in got] == [("http://a", "cups", 2.0, 1.5, None), ("http://b", "", 0.0, 0.0, None)]
    sites = google.search_console_sites(spark, "tok", {transport.Request("GET", google.SITES).key: {"siteEntry": [{"siteUrl": "s", "permissionLevel": "owner"}]}})
    assert [tuple(r) for r in sites.collect()] == [("s", "owner")]
    with pytest.raises(ValueError):
        google.search_console_sites(spark, " ")
    df = spark.createDataFrame([("cups",), (None,)], "query string")
    assert df.filter(google.local_filter("query", "notContains", "cup")).count() == 1
    claims = base64.urlsafe_b64encode(json.dumps({"email": "a@b.example", "email_verified": True}).encode()).decode().rstrip("=")
    assert google.token_email(f"x.{claims}.y") == "a@b.example" and google.token_email("x") is None


def test_keyword_requests():
    cfg = google.keyword_config(keywords=[" a ", ""], url="x.example", country="es")
    assert (cfg["keywords"], cfg["ideas"], cfg["language"], cfg["country"]) == (["a"], False, "en", "ES")
    assert google.keyword_config(url="x.example")["ideas"]
    assert len(google.keyword_config(keywords=[str(i) for i in range(30)], ideas=True)["keywords"]) == 20
    for bad in ({"metrics_start": "2024-01"}, {"metrics_start": "2024-02", "metrics_end": "2024-01"}, {"metrics_start": "x", "metrics_end": "y"}):
        with pytest.raises(ValueError):
            google.keyword_config(**bad)
    method, body = google.keyword_request(google.keyword_config(url="x.example", whole_site=True), {"en": "l/1"}, {})
    assert method == "generateKeywordIdeas" and body["siteSeed"] == {"site": "x.example"} and body["language"] == "l/1"
    with pytest.raises(ValueError):
        google.resource_of("zz", {})
    assert google.resource_of("a/b", {}) == "a/b"


def test_stream_enrichment(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    texts(spark, "joy", "fear").write.parquet(str(source))
    stream = spark.readStream.schema("ord int, text string").parquet(str(source))
    query = enrich.enrich_stream(stream, lambda d: d.withColumn("n", F.length("text")), str(out), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.read.parquet(str(out)).collect()) == [3, 4]


def test_redaction_by_name_and_shape():
    said = transport.redact('{"access_token": "s3cr3t", "note": "ya29.abc-d"} ?key=AbC12&x=1 eyJhbGci.eyJzdWIi.sig ok', ["ok-value"])
    assert not [x for x in ("s3cr3t", "ya29", "AbC12", "eyJ") if x in said] and said.endswith("ok") and "x=1" in said


def test_network_errors_are_tried_again():
    class Shaky:
        calls = 0

        def send(self, request):
            self.calls += 1
            if self.calls < 3:
                raise TimeoutError("slow")
            return 200, "{}"

    shaky = Shaky()
    assert transport.send_json(shaky, transport.Request("GET", "http://x"), "s", wait=lambda _: None) == {} and shaky.calls == 3
    with pytest.raises(OSError):
        transport.send_json(Shaky(), transport.Request("GET", "http://x"), "s", retries=1, wait=lambda _: None)
