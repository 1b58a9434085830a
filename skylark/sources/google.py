"""Search Console and keyword planner as Spark data sources over a transport."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.keywords import keyword_records
from .transport import HttpTransport, RecordedTransport, Request, Transport, send_json

SITES = "https://www.googleapis.com/webmasters/v3/sites"
TOKENS = "https://oauth2.googleapis.com/token"
DIMENSIONS = ["country", "date", "device", "hour", "page", "query", "searchAppearance"]
OPERATORS = ["equals", "notEquals", "contains", "notContains", "includingRegex", "excludingRegex"]
CONSOLE_ROW = ", ".join(f"{d} string" for d in DIMENSIONS) + ", clicks double, impressions double, ctr double, position double"


def token_of(value: str) -> str:
    if not value.strip():
        raise ValueError("an access token is needed")
    return value.strip()


def analytics_request(start: str, end: str, dimensions: Sequence[str] = ("query", "page"), row_limit: int = 250, start_row: int | None = None, filters: Sequence[Mapping[str, Any]] = (), **more: Any) -> dict[str, Any]:
    """The body of a query; filters are {dimension, operator, expression}."""
    for f in filters:
        if f["operator"] not in OPERATORS or f["dimension"] not in DIMENSIONS:
            raise ValueError(f"unknown filter {f}")
    body: dict[str, Any] = {"startDate": start, "endDate": end, "dimensions": list(dimensions), "rowLimit": row_limit}
    if start_row is not None:
        body["startRow"] = start_row
    if filters:
        body["dimensionFilterGroups"] = [{"filters": [dict(f) for f in filters]}]
    return body | {k: v for k, v in more.items() if v}


def local_filter(dimension: str, operator: str, expression: str) -> Column:
    """A service filter as a predicate on rows that are here already."""
    c = F.coalesce(F.col(dimension), F.lit(""))
    plain = {"equals": c == expression, "contains": F.contains(c, F.lit(expression)), "includingRegex": c.rlike(expression)}
    opposite = {"notEquals": "equals", "notContains": "contains", "excludingRegex": "includingRegex"}
    return ~plain[opposite[operator]] if operator in opposite else plain[operator]


def console_rows(df: DataFrame, dimensions: Sequence[str], payload: str = "payload") -> DataFrame:
    """Rows of query answers: keys by position become dimensions, missing numbers 0, missing keys ''."""
    rows = F.from_json(payload, "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>")["rows"]
    each = df.select(F.explode(rows).alias("r"))
    key = lambda d: F.coalesce(F.get("r.keys", F.lit(dimensions.index(d))), F.lit("")) if d in dimensions else F.lit(None).cast("string")
    return each.select(*[key(d).alias(d) for d in DIMENSIONS], *[F.coalesce(f"r.{m}", F.lit(0.0)).alias(m) for m in ("clicks", "impressions", "ctr", "position")])


def token_email(id_token: str) -> str | None:
    """The e-mail address of an id token, only if it is verified."""
    part = id_token.split(".")[1] if id_token.count(".") >= 2 else ""
    try:
        claims = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return None
    return claims.get("email") if claims.get("email_verified") else None


def exchange_token(transport: Transport, client_id: str, client_secret: str, code: str | None = None, redirect: str = "", refresh: str | None = None) -> Any:
    """Tokens for an authorization code, or new ones for a refresh token."""
    grant = {"grant_type": "authorization_code", "code": code, "redirect_uri": redirect} if code else {"grant_type": "refresh_token", "refresh_token": refresh}
    body = {"client_id": client_id, "client_secret": client_secret} | grant
    return send_json(transport, Request("POST", TOKENS, body=body), "token", [client_secret, code, refresh])


def is_domain(value: str) -> bool:
    return bool(re.fullmatch(r"(?!-)[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", value))


def keyword_config(keywords: Sequence[str] = (), url: str = "", whole_site: bool = False, ideas: bool = False, max_ideas: int = 100, language: str = "EN", country: str = "",
                   metrics_start: str = "", metrics_end: str = "") -> dict[str, Any]:
    """Checked options: blank keywords go, a URL alone means ideas, ideas take 20 seeds, both ends of a range or none."""
    words = [k.strip() for k in keywords if k.strip()]
    url = url.strip()
    site = bool(url and whole_site and is_domain(url))
    ideas = ideas or bool(url and not words)
    if bool(metrics_start) != bool(metrics_end):
        raise ValueError("a metrics range needs both ends")
    for month in filter(None, (metrics_start, metrics_end)):
        if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", month):
            raise ValueError(f"{month} is no YYYY-MM month")
    if metrics_start > metrics_end:
        raise ValueError("a metrics range ends before it starts")
    code = lambda v, case: v if "/" in v else getattr(v.strip(), case)()
    return {
        "keywords": words[:20] if ideas and not site else words, "url": url, "wholeSite": site, "ideas": ideas, "maxIdeas": max_ideas,
        "language": code(language or "EN", "lower"), "country": code(country, "upper"), "range": (metrics_start, metrics_end) if metrics_start else None,
    }


def resource_of(code: str | None, codes: Mapping[str, str]) -> str | None:
    """The resource of a language or country code in any case; one with a slash is a resource itself."""
    if not code or "/" in code:
        return code or None
    for c in (code, code.lower(), code.upper()):
        if c in codes:
            return codes[c]
    raise ValueError(f"unknown code {code}")


def keyword_request(cfg: Mapping[str, Any], languages: Mapping[str, str], countries: Mapping[str, str]) -> tuple[str, dict[str, Any]]:
    """(method, body) of a keyword request: ideas from site, URL, URL and keywords, or keywords; else metrics."""
    history: dict[str, Any] = {"include_average_cpc": True}
    if cfg["range"]:
        ends = [{"year": int(m[:4]), "month": int(m[5:])} for m in cfg["range"]]
        history["year_month_range"] = {"start": ends[0], "end": ends[1]}
    body: dict[str, Any] = {"includeAdultKeywords": True, "keywordPlanNetwork": "GOOGLE_SEARCH", "historicalMetricsOptions": history}
    language, country = resource_of(cfg["language"], languages), resource_of(cfg["country"], countries)
    body |= {k: v for k, v in (("language", language), ("geoTargetConstants", [country] if country else None)) if v}
    words, url = cfg["keywords"], cfg["url"]
    if not cfg["ideas"]:
        if not words:
            raise ValueError("keywords are needed for metrics")
        return "generateKeywordHistoricalMetrics", body | {"keywords": words}
    seed = (
        {"siteSeed": {"site": url}} if url and cfg["wholeSite"] else {"keywordAndUrlSeed": {"url": url, "keywords": words}} if url and words
        else {"urlSeed": {"url": url}} if url else {"keywordSeed": {"keywords": words}} if words else None
    )
    if seed is None:
        raise ValueError("ideas need keywords or a URL")
    return "generateKeywordIdeas", body | seed | {"pageSize": cfg["maxIdeas"], "keywordAnnotation": ["KEYWORD_CONCEPT"]}


class _Page(InputPartition):
    def __init__(self, request: Request) -> None:
        super().__init__(request.key)
        self.request = request


class _Reader(DataSourceReader):
    def __init__(self, requests: list[Request], transport: Transport, secrets: list[str]) -> None:
        self.requests, self.transport, self.secrets = requests, transport, secrets

    def partitions(self) -> list[InputPartition]:
        return [_Page(r) for r in self.requests]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        yield (json.dumps(send_json(self.transport, partition.request, "service", self.secrets)),)


class JsonService(DataSource):
    """format("json_service"): one row (payload) a request, each request a partition.

    Options: requests (a JSON list of {method, url, params, body}), token, recorded (a JSON map of request
    keys to answers, instead of the network).
    """

    @classmethod
    def name(cls) -> str:
        return "json_service"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema: Any) -> DataSourceReader:
        token = self.options.get("token", "")
        headers = {"Authorization": f"Bearer {token}"} if token else {}
        requests = [Request(r.get("method", "GET"), r["url"], r.get("params", {}), headers, r.get("body")) for r in json.loads(self.options["requests"])]
        recorded = self.options.get("recorded")
        return _Reader(requests, RecordedTransport(json.loads(recorded)) if recorded else HttpTransport(), [token])


def read_service(spark: SparkSession, requests: Sequence[Mapping[str, Any]], token: str = "", recorded: Mapping[str, Any] | None = None) -> DataFrame:
    spark.dataSource.register(JsonService)
    reader = spark.read.format("json_service").option("requests", json.dumps(list(requests))).option("token", token)
    return (reader.option("recorded", json.dumps(recorded)) if recorded is not None else reader).load()


def search_console_sites(spark: SparkSession, token: str, recorded: Mapping[str, Any] | None = None) -> DataFrame:
    got = read_service(spark, [{"url": SITES}], token_of(token), recorded)
    return got.select(F.explode(F.from_json("payload", "siteEntry array<struct<siteUrl:string,permissionLevel:string>>")["siteEntry"]).alias("s")).select("s.*")


def search_console_queries(spark: SparkSession, token: str, site: str, start: str, end: str, dimensions: Sequence[str] = ("query", "page"), pages: int = 1, row_limit: int = 250,
                           recorded: Mapping[str, Any] | None = None, **more: Any) -> DataFrame:
    """Query rows of a site; the service filters and pages, each page a partition."""
    from urllib.parse import quote

    bodies = [analytics_request(start, end, dimensions, row_limit, i * row_limit if pages > 1 else None, **more) for i in range(pages)]
    requests = [{"method": "POST", "url": f"{SITES}/{quote(site, safe='')}/searchAnalytics/query", "body": b} for b in bodies]
    return console_rows(read_service(spark, requests, token_of(token), recorded), list(dimensions))


def keywords(spark: SparkSession, endpoint: str, token: str, languages: Mapping[str, str], countries: Mapping[str, str], recorded: Mapping[str, Any] | None = None, **config: Any) -> DataFrame:
    """Keyword records of a request to the planner."""
    method, body = keyword_request(keyword_config(**config), languages, countries)
    return keyword_records(read_service(spark, [{"method": "POST", "url": f"{endpoint}:{method}", "body": body}], token, recorded))


def expand_keywords(spark: SparkSession, endpoint: str, token: str, languages: Mapping[str, str], countries: Mapping[str, str], seeds: Sequence[str], url: str = "", most_ideas: int = 10_000,
                    recorded: Mapping[str, Any] | None = None, **config: Any) -> DataFrame:
    """Ideas of each seed and of the URL, with the seed (or URL) as _src; one partition a request, no fixed order."""
    plans = [(s, keyword_config([s], ideas=True, **config)) for s in seeds]
    plans += [(url, keyword_config(url=url, whole_site=True, max_ideas=most_ideas, **config))] if url else []
    parts = []
    for src, cfg in plans:
        method, body = keyword_request(cfg, languages, countries)
        parts.append(keyword_records(read_service(spark, [{"method": "POST", "url": f"{endpoint}:{method}", "body": body}], token, recorded)).withColumn("_src", F.lit(src)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
