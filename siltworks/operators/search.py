"""Search result bodies to hits: native JSON paths per provider, a tree scan for result pages in HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dom import parse, select
from ..functions.urls import unwrapped

# Where each provider keeps its hits, and its names of title, url and snippet.
PROVIDERS = {
    "brave": ("$.web.results", "title", "url", "description"),
    "serper": ("$.organic", "title", "link", "snippet"),
    "serpapi": ("$.organic_results", "title", "link", "snippet"),
    "searxng": ("$.results", "title", "url", "content"),
    "exa": ("$.results", "title", "url", "text"),
}
HTML_PROVIDER, HTML_HOST = "duckduckgo", "duckduckgo.com"
_ITEM = "array<struct<title:string,url:string,link:string,description:string,snippet:string,content:string,text:string>>"


def json_hits(bodies: DataFrame) -> DataFrame:
    """(query_id, provider, position, title, url, snippet) of JSON bodies (query_id, provider, body); unreadable bodies give none."""
    bare = F.regexp_replace("body", r"^\s*//[^\n]*\n", "")
    out = None
    for name, (path, title, url, snippet) in PROVIDERS.items():
        items = F.from_json(F.get_json_object(bare, path), _ITEM)
        part = bodies.where(F.col("provider") == name).select("query_id", "provider", F.posexplode(items).alias("_p", "_i"))
        part = part.select("query_id", "provider", "_p", F.coalesce(F.col(f"_i.{title}"), F.lit("")).alias("title"), F.coalesce(F.col(f"_i.{url}"), F.lit("")).alias("url"), F.coalesce(F.col(f"_i.{snippet}"), F.lit("")).alias("snippet"))
        out = part if out is None else out.unionByName(part)
    return out


def html_hits(bodies: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = 0
                for box in select(parse(body or ""), "div.result"):
                    for a in select(box, "a.result__a")[:1]:
                        snippet = select(box, ".result__snippet")
                        rows.append((q, p, a.content().strip(), a.attrs.get("href", ""), snippet[0].content().strip() if snippet else ""))
                        p += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["query_id", "_p", "title", "url", "snippet"])

    own = bodies.where(F.col("provider") == HTML_PROVIDER).select(F.col("query_id").cast("bigint").alias("query_id"), "body")
    found = own.mapInArrow(run, "query_id bigint, _p int, title string, url string, snippet string")
    return found.select("query_id", F.lit(HTML_PROVIDER).alias("provider"), "_p", "title", unwrapped("url", HTML_HOST).alias("url"), "snippet")


def hits(bodies: DataFrame, limit: int = 10) -> DataFrame:
    """Hits with positions from 1 in provider order, hits without URL left out, at most ``limit`` a query (the feature)."""
    from pyspark.sql import Window

    both = json_hits(bodies).unionByName(html_hits(bodies)).where("url <> ''")
    w = Window.partitionBy("query_id", "provider").orderBy("_p")
    return both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("_p")


def with_pages(found: DataFrame, pages: DataFrame, top: int) -> DataFrame:
    """Hits with the page (url, title, markdown) of the first ``top`` positions."""
    page = pages.select("url", F.struct(*(c for c in pages.columns if c != "url")).alias("page"))
    joined = found.where(F.col("position") <= top).join(page, "url", "left")
    return joined.unionByName(found.where(F.col("position") > top).withColumn("page", F.lit(None).cast(joined.schema["page"].dataType)))


# The public endpoints of the providers; {base} is the caller's own instance.
ENDPOINTS = {
    "brave": ("GET", "https://api.search.brave.com/res/v1/web/search?q={q}&count={n}", "X-Subscription-Token"),
    "serper": ("POST", "https://google.serper.dev/search", "X-API-KEY"),
    "serpapi": ("GET", "https://serpapi.com/search.json?engine=google&q={q}&num={n}&api_key={key}", ""),
    "searxng": ("GET", "{base}/search?q={q}&format=json", ""),
    "exa": ("POST", "https://api.exa.ai/search", "x-api-key"),
    "duckduckgo": ("GET", "https://html.duckduckgo.com/html/?q={q}", ""),
}


class SearchError(RuntimeError):
    """A search that can't be asked."""


def request(provider: str, query: str, limit: int = 10, key: str = "", base: str = "") -> dict:
    """method, url, headers and body of a search; unknown providers, and absent keys or instances, are errors."""
    import json
    from urllib.parse import quote_plus

    if provider not in ENDPOINTS:
        raise SearchError(f"unknown provider {provider!r}")
    method, url, name = ENDPOINTS[provider]
    if (name or "{key}" in url) and not key:
        raise SearchError(f"{provider} needs a key")
    if "{base}" in url and not base:
        raise SearchError(f"{provider} needs an instance")
    body = {"serper": {"q": query, "num": limit}, "exa": {"query": query, "numResults": limit, "contents": {"text": True}}}.get(provider)
    return {"method": method, "url": url.format(q=quote_plus(query), n=limit, key=quote_plus(key), base=base.rstrip("/")), "headers": {name: key} if name else {}, "body": json.dumps(body) if body else None}


def searched(queries: DataFrame, transport, keys: dict[str, str] | None = None, base: str = "", limit: int = 10) -> DataFrame:
    """Hits of queries (query_id, provider, query) asked over transport(request) -> body; a failed search has a row with its error and no hit."""
    keys = keys or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, provider, query in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append((i, provider, transport(request(provider, query or "", limit, keys.get(provider, ""), base)), None))
                except Exception as e:  # a failed search is data on the row
                    rows.append((i, provider, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["query_id", "provider", "body", "error"])

    from ..session import checkpointed

    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "provider", "query").mapInArrow(run, "query_id bigint, provider string, body string, error string")
    asked = checkpointed(asked)  # a search is asked once
    failed = asked.where("error is not null").select("query_id", "provider", F.lit(None).cast("int").alias("position"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit("").alias("snippet"), "error")
    return hits(asked.where("error is null"), limit).select("query_id", "provider", "position", "title", "url", "snippet", F.lit(None).cast("string").alias("error")).unionByName(failed)
