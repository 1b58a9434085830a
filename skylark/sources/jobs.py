"""Jobs that are submitted, polled and fetched: batch scrapes and scraped chats."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.payloads import parse_chat
from .lookups import PAGE, lookup, scrape_body
from .transport import Request, Transport, send_json

ENDED = {"done", "stopped", "finished", "failed", "ready"}


def wait_for(status: Callable[[], str], poll: float = 5, most: float = 300, wait: Callable[[float], None] = time.sleep) -> str:
    """The end state of a job; raises after `most` seconds of polling."""
    spent = 0.0
    while (state := status()) not in ENDED:
        if spent >= most:
            raise TimeoutError(f"job still {state} after {most:g} s")
        wait(poll)
        spent += poll
    return state


def batch_scrape(urls: DataFrame, transport: Transport, endpoint: str, api_key: str, per_job: int = 1000, page_size: int = 100, poll: float = 5, most: float = 300,
                 wait: Callable[[float], None] = time.sleep, **options: Any) -> DataFrame:
    """(url, page) for each distinct url: jobs of per_job urls, results fetched page by page in parallel, joined on url.

    Urls are dealt into jobs by hash, each job is submitted and awaited by the task that holds it; failed
    items have a null page.
    """
    headers = {"x-api-key": api_key}
    distinct = urls.select("url").filter("url is not null").distinct()
    jobs = max(1, -(-distinct.count() // per_job))
    dealt = distinct.groupBy(F.pmod(F.xxhash64("url"), F.lit(jobs)).alias("job")).agg(F.collect_list("url").alias("urls"))

    def fetch(row: Any) -> list[tuple]:
        body = {"requests": [scrape_body(u, **options) for u in row["urls"]]}
        job = send_json(transport, Request("POST", endpoint, headers=headers, body=body), "batch scrape", [api_key])["jobId"]
        wait_for(lambda: send_json(transport, Request("GET", f"{endpoint}/{job}", headers=headers), "batch scrape", [api_key])["status"], poll, most, wait)
        out, page = [], 0
        while True:
            got = send_json(transport, Request("GET", f"{endpoint}/{job}/results", {"page": page, "limit": page_size}, headers), "batch scrape", [api_key])
            out += [(r.get("url"), r.get("markdown"), r.get("text"), r.get("html"), r.get("links")) for r in got.get("results", [])]
            page += 1
            if len(got.get("results", [])) < page_size:
                return out

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [r for record in frame.to_dict("records") for r in fetch(record)]
            yield pd.DataFrame(rows, columns=["url", "markdown", "text", "html", "links"])

    pages = dealt.mapInPandas(run, PAGE).select("url", F.struct("url", "markdown", "text", "html", "links").alias("page"))
    once = pages.groupBy("url").agg(F.first("page", ignorenulls=True).alias("page"))
    return urls.join(once, "url", "left")


def chat_batch(prompts: DataFrame, transport: Transport, endpoint: str, api_key: str, provider: str = "a", per_job: int = 50, concurrency: int = 10,
               poll: float = 5, most: float = 600, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts (with prompt) with answer, answerMarkdown, sources and searchQueries; a failed prompt has empty ones.

    Two phases: every prompt is triggered (a table of job ids), then jobs are awaited and downloaded; provider
    b answers 204 while a job is pending.
    """
    headers = {"Authorization": f"Bearer {api_key}"}
    triggered = lookup(prompts, lambda r: Request("POST", f"{endpoint}/trigger", headers=headers, body={"prompt": r["prompt"]}), transport, "chat", concurrency, secrets=[api_key])
    jobs = triggered.withColumn("job", F.coalesce(F.get_json_object("payload", "$.snapshot_id"), F.get_json_object("payload", "$.id"))).drop("payload", "error")

    class Waiting:
        def send(self, request: Request) -> tuple[int, str]:
            spent = 0.0
            while True:
                status, body = transport.send(request)
                if status not in (202, 204) or spent >= most:
                    return (status, body) if status not in (202, 204) else (408, "still pending")
                wait(poll)
                spent += poll

    got = lookup(jobs, lambda r: Request("GET", f"{endpoint}/download", {"id": r["job"] or ""}, headers), Waiting(), "chat", concurrency, secrets=[api_key])
    return parse_chat(got.withColumnRenamed("prompt", "_asked"), "payload", provider).drop("prompt", "payload").withColumnRenamed("_asked", "prompt")


def split_prompts(prompts: Sequence[str], most: int) -> list[Sequence[str]]:
    """Prompts in groups that one request may hold."""
    return [prompts[i : i + most] for i in range(0, len(prompts), most)]
