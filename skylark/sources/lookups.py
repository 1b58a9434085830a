"""One request a row, in bounded parallelism: search pages, scraped pages, chats, suggestions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.payloads import parse_overview
from ..functions.urls import extract_domain
from .transport import Request, ServiceError, Transport, send_json

# Search types of the results service.
SEARCH_TYPES = {"images": "isch", "videos": "vid", "news": "nws", "shopping": "shop", "local": "lcl"}


def lookup(df: DataFrame, request: Callable[[Mapping[str, Any]], Sequence[Request] | Request], transport: Transport, service: str, concurrency: int = 29,
           follow: Callable[[Any], Request | None] | None = None, secrets: Sequence[str | None] = ()) -> DataFrame:
    """df with payload (the answer as JSON) and error; every row stays, a failed one has a null payload.

    follow may name a further request whose answer is merged into the first.
    """
    cols = [f for f in df.schema.fields if f.name not in ("payload", "error")]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cols] + ["payload string", "error string"])

    def one(row: Mapping[str, Any]) -> tuple[str | None, str | None]:
        try:
            got = send_json(transport, request(row), service, secrets)
            more = follow(got) if follow else None
            if more:
                got = {**got, **(send_json(transport, more, service, secrets) or {})}
            return json.dumps(got), None
        except (ServiceError, ValueError, OSError) as e:
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                got = list(pool.map(one, frame.to_dict("records")))
                yield frame.assign(payload=[g[0] for g in got], error=[g[1] for g in got])

    return df.select(*[f.name for f in cols]).mapInPandas(run, out)


def serp_params(query: str, **o: Any) -> dict[str, Any]:
    """Parameters of a search page: locales in lower case, local offsets on 20s, 10 to 100 results a page."""
    kind = o.get("type")
    tbm = None if kind in (None, "all") else SEARCH_TYPES.get(kind.lower(), kind)
    tbs = o.get("filters")
    device = (o.get("device") or "").lower()
    flag = lambda name: None if o.get(name) is None else ("1" if o[name] else "0")
    safe = o.get("safe_search")
    start = math.floor(o["offset"]) if o.get("offset") is not None and o["offset"] >= 0 else None
    out = {
        "q": query, "location": o.get("location"), "gl": (o.get("country") or "").lower() or None, "hl": (o.get("language") or "").lower() or None, "lr": o.get("content_language"),
        "domain": o.get("domain"), "uule": o.get("encoded_location"), "tbs": ",".join(x.strip() for x in tbs if x.strip()) if isinstance(tbs, (list, tuple)) else tbs,
        "safe": {True: "active", False: "off"}.get(safe, safe) if safe is not None else None, "filter": flag("filter_results"), "nfpr": flag("prevent_auto_correct"),
        "start": start // 20 * 20 if start is not None and tbm == "lcl" else start, "num": min(max(math.floor(o["results_per_page"]), 10), 100) if o.get("results_per_page") else None,
        "tbm": tbm, "deviceType": device if device in ("desktop", "mobile", "tablet") else None, "ludocid": o.get("place_id"), "lsig": o.get("lsig"), "kgmid": o.get("entity_id"), "si": o.get("search_id"),
    }
    return {k: v for k, v in out.items() if v not in (None, "")}


def fetch_serps(df: DataFrame, transport: Transport, endpoint: str, api_key: str, query: str = "query", **options: Any) -> DataFrame:
    """Search pages of the queries; a deferred overview is followed by its page token."""
    headers = {"x-api-key": api_key}

    def follow(got: Any) -> Request | None:
        token = ((got or {}).get("aiOverview") or {}).get("pageToken")
        return Request("GET", f"{endpoint}/ai-overview", {"pageToken": token}, headers) if token else None

    return lookup(df, lambda r: Request("GET", endpoint, serp_params(r[query], **options), headers), transport, "search", follow=follow, secrets=[api_key])


def fetch_overviews(df: DataFrame, transport: Transport, endpoint: str, api_key: str, query: str = "query", mode: bool = False, **options: Any) -> DataFrame:
    """Answers and sources of AI overviews, or of AI mode pages; a failed query has an empty answer."""
    pages = fetch_serps(df, transport, endpoint, api_key, query, **options)
    parsed = parse_overview(pages, "payload", nested=not mode)
    empty = F.array().cast(parsed.schema["sources"].dataType)
    return parsed.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("sources", F.coalesce("sources", empty))


PAGE = "url string, markdown string, text string, html string, links array<string>"


def scrape_body(url: str, **o: Any) -> dict[str, Any]:
    """A scrape request: JSON is always among the formats, options that are not set stay out."""
    formats = list(dict.fromkeys([*o.pop("formats", ["html", "text"]), "json"]))
    return {"url": url, "outputFormat": formats} | {k: v for k, v in o.items() if v is not None}


def scrape_pages(df: DataFrame, transport: Transport, endpoint: str, api_key: str, url: str = "url", concurrency: int = 29, **options: Any) -> DataFrame:
    """df with `page` (markdown, text, html, links); a failed one is null inside."""
    headers = {"x-api-key": api_key}
    got = lookup(df, lambda r: Request("POST", endpoint, headers=headers, body=scrape_body(r[url], **options)), transport, "scrape", concurrency, secrets=[api_key])
    return got.withColumn("page", F.from_json("payload", PAGE)).drop("payload")


SUGGEST = "https://suggestqueries.google.com/complete/search"


def suggestions(df: DataFrame, transport: Transport, query: str = "query", language: str = "", country: str = "") -> DataFrame:
    """(query, ord, suggestion) of each query; failed queries give no rows."""
    extra = {k: v for k, v in (("hl", language), ("gl", country)) if v}
    got = lookup(df, lambda r: Request("GET", SUGGEST, {"client": "chrome", "q": r[query].strip()} | extra), transport, "suggestions", concurrency=1)
    texts = F.from_json(F.get_json_object("payload", "$[1]"), "array<string>")
    return got.select(F.col(query), F.posexplode(texts).alias("ord", "suggestion"))


def expand_suggestions(df: DataFrame, transport: Transport, query: str = "query", depth: int = 1, **options: Any) -> DataFrame:
    """(query, suggestion, depth): suggestions of suggestions, level by level, each text asked once.

    Breadth first, so a text that is reached twice has its least depth. A level is one job; what has been asked
    is kept out by an anti join.
    """
    from functools import reduce

    norm = lambda c: F.lower(F.trim(c))
    frontier, seen, found = df.select(F.col(query).alias("query")).dropDuplicates(["query"]), None, []
    for level in range(depth):
        fresh = frontier.withColumn("_key", norm(F.col("query"))).dropDuplicates(["_key"])
        if seen is not None:
            fresh = fresh.join(seen, "_key", "left_anti")
        fresh = fresh.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else fresh.persist()
        got = suggestions(fresh.select("query"), transport, "query", **options)
        got = got.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else got.persist()
        found.append(got.select("query", "suggestion", F.lit(level).alias("depth")))
        keys = fresh.select("_key")
        seen = keys if seen is None else seen.union(keys)
        frontier = got.select(F.col("suggestion").alias("query"))
    return reduce(DataFrame.union, found)


_OUTPUT = "array<struct<type:string,content:array<struct<type:string,text:string,annotations:array<struct<type:string,title:string,url:string>>>>>>"


def parse_web_search(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with answer and sources of a web search by a language model; sources only if it did search."""
    items = F.from_json(F.get_json_object(payload, "$.output"), _OUTPUT)
    content = F.get(F.get(F.filter(items, lambda i: i["type"] == "message"), F.lit(0))["content"], F.lit(0))
    searched = F.exists(items, lambda i: i["type"] == "web_search_call")
    cited = F.transform(F.filter(content["annotations"], lambda a: a["type"] == "url_citation"), lambda a: F.struct(a["title"].alias("title"), a["url"].alias("url"), extract_domain(a["url"]).alias("domain")))
    none = F.array().cast("array<struct<title:string,url:string,domain:string>>")
    return df.withColumn("answer", F.when(content["type"] == "output_text", content["text"])).withColumn("sources", F.coalesce(F.when(searched, cited), none))
