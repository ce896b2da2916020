"""Queries of fetching, record stores, cache-first extraction, modules and streams, over the tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import extraction as X
from ..operators import schema as S
from ..operators import search as H
from ..operators.registry import Registry, json_transform, register_table_functions
from ..session import checkpoint_dir, table
from ..sources import sinks as K
from ..sources.fetching import Policy, VirtualClock, fetch_urls
from ..sources.pages import FetchError
from ..streaming import watch as W


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _site(url: str, attempt: int, proxy: str | None, headers: dict) -> dict:
    """A transport without a network: what a URL answers follows from its length and the try."""
    k = len(url) % 5
    if k == 4:
        raise FetchError("connection reset")
    if k == 1 and attempt < 3:
        return {"status": 500, "body": b""}
    if k == 3 and attempt < 2:
        return {"status": 429, "body": b"", "headers": {"Retry-After": "2"}}
    return {"status": 404 if k == 2 else 200, "body": url.encode(), "headers": {"X": headers.get("A", "")}}


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page URLs fetched with retries, Retry-After, pacing and proxies, on a virtual clock."""
    urls = table(spark, sf_dir, "raw_page").select("url").distinct()
    policy = Policy(proxies=["http://p1:1", "http://p2:1"], profiles={"one": {"A": "1"}}, warm_up=False, clock=VirtualClock)
    got = fetch_urls(urls, _site, policy, lanes=2)
    return got.select("url", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce(F.md5("html"), F.lit("")).alias("html_md5"), "attempts", "waited", F.coalesce("error", F.lit("")).alias("error"))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for every part over an injected transport; those without a key or of an unknown provider are errors."""

    def answer(req: dict) -> str:
        if req["method"] == "POST":
            return json.dumps({"organic": [{"title": json.loads(req["body"])["q"], "link": "https://a.test/"}]})
        return json.dumps({"results": [{"title": req["url"].split("q=")[1].split("&")[0], "url": "https://b.test/", "content": "c"}]})

    provider = F.element_at(F.array(*map(F.lit, ("serper", "searxng", "exa", "none"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    queries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), provider.alias("provider"), F.col("p_name").alias("query"))
    return H.searched(queries, answer, {"serper": "k"}, "https://s.test/").select("query_id", "title", "url", F.coalesce("error", F.lit("")).alias("error"))


def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed record table after two deliveries, the second of them twice."""
    at = _folder(spark, "records")
    t = table(spark, sf_dir, "batch_item").where("url is not null").select("run_id", "url", "title", "item_id", F.col("ingested_at").alias("updated_at"))
    one, two = t.where("item_id % 2 = 0"), t.where("item_id % 2 = 1")
    for part in (one, two, two):
        K.write_records(part, at, ["run_id", "url"])
    K.drop_versions(spark, at)
    return K.read_records(spark, at).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("item_id") % 2 == 1).alias("odd"))


def cache_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from the cache where it lacks nothing, else filled in by a model."""
    schema = S.load(json.dumps({"type": "object", "required": ["n"], "properties": {"n": {"type": "string"}, "s": {"type": "string"}}}))
    t = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    pages = t.select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("sidecar"), F.col("p_name").alias("markdown"))
    known = F.when(k == 0, F.to_json(F.struct(F.col("p_name").alias("n"), F.lit("c").alias("s")))).when(k == 1, F.to_json(F.struct(F.concat("p_name", F.lit("!")).alias("n"))))
    cached = t.select(F.col("p_partkey").alias("id"), known.alias("record"), F.when(k == 1, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    got = X.cache_first(pages, cached, schema, lambda system, user: json.dumps({"n": user.split("\n")[1], "s": "m"}))
    g = lambda f: F.get_json_object("record", f"$.{f}")
    return got.select(F.col("id").alias("p_partkey"), g("n").alias("n"), g("s").alias("s"), "from_cache", "error")


def module_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through two registered modules: a frame transform, and a change of JSON texts that fails on some."""

    def change(text: str) -> str:
        k = json.loads(text)["k"]
        if k % 10 == 0:
            raise ValueError("tens")
        return json.dumps({"k": k + 1})

    r = Registry()
    r.register("transform", "clicks", "1.2.0", lambda df: df.where("event_type = 'click'"))
    r.register("transform", "plus", "v1.0.1", lambda df: json_transform(df, "props", change))
    return r.apply("plus", r.apply("clicks", table(spark, sf_dir, "events").select("event_id", "event_type", "props"))).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce("props_error", F.lit("")).alias("error"))


def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by the SQL table function."""
    register_table_functions(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", F.format_string('<a href="/n/%s">x</a><a href="https://b.test/">y</a>', "n_name").alias("html")).createOrReplaceTempView("silt_nation_pages")
    return spark.sql("SELECT n_nationkey, url FROM silt_nation_pages, LATERAL page_links(html, 'https://a.test/q/')")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table as a stream of its files."""
    table(spark, sf_dir, "batch_item")
    schema = spark.read.parquet(f"{sf_dir}/batch_item.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/batch_item*.parquet")


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its source is used up."""
    at = _folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every item URL, as a stream."""
    s = _items(spark, sf_dir).where("ok and url is not null").select("url", F.sha2("markdown", 256).alias("content_hash"), "markdown", F.col("item_id").alias("seq"))
    return _drained(spark, W.watch(s), "watch").select("url", "seq", "changed", F.coalesce("old_hash", F.lit("")).alias("old_hash"), "new_hash")


def watch_hash_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the host's front line of titles, as a stream that keeps hashes only, and the diffs of what changed."""
    items = lambda t: t.where("ok and title is not null").select(F.col("host").alias("url"), F.sha2("title", 256).alias("content_hash"), F.col("title").alias("markdown"), F.col("item_id").alias("seq"))
    changes = _drained(spark, W.watch_hashes(items(_items(spark, sf_dir))), "hashes")
    return W.with_diffs(changes, items(table(spark, sf_dir, "batch_item"))).select("url", "seq", "old_seq", (F.col("diff") != "").alias("differs"))


def heal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items at which a host's share of missing titles passes the threshold, as a stream."""
    s = _items(spark, sf_dir).select(F.col("host").alias("domain"), F.lit("title").alias("field"), F.col("item_id").alias("seq"), F.col("title").isNull().alias("is_null"))
    return _drained(spark, W.heal_stream(s, threshold=0.1), "heal").select("domain", "seq")


def throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay of every host after each of its responses, as a stream: every fourth item is a refusal."""
    s = _items(spark, sf_dir).select("host", F.col("item_id").alias("seq"), F.when(F.col("item_id") % 4 == 0, 429).otherwise(200).alias("status"), F.lit(None).cast("double").alias("retry_after"))
    return _drained(spark, W.throttle_stream(s), "throttle").select("host", "seq", F.round("delay_s", 6).alias("delay_s"))


def seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a run whose canonical URL was not seen before in it, as a stream."""
    s = W.url_key(_items(spark, sf_dir).where("url is not null").select("run_id", "url"))
    return _drained(spark, W.seen_once(s), "seen").groupBy("run_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (fetched_pages, searched, record_store, cache_first, module_transforms, table_functions, watch_stream, watch_hash_stream, heal_stream, throttle_stream, seen_stream)}

from .ledger_queries import SQL as _LEDGER  # noqa: E402
from .web_queries import _canon  # noqa: E402

SQL = {
    "fetched_pages": "SELECT url, CASE k WHEN 4 THEN 0 WHEN 2 THEN 404 ELSE 200 END AS status, CASE WHEN k = 4 THEN '' ELSE md5(url) END AS html_md5, CASE k WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 1 END AS attempts, CASE k WHEN 1 THEN 1.5 WHEN 3 THEN 2.0 WHEN 4 THEN 3.5 ELSE 0.0 END::DOUBLE AS waited, CASE WHEN k = 4 THEN 'connection reset' ELSE '' END AS error FROM (SELECT DISTINCT url, length(url) % 5 AS k FROM raw_page WHERE url IS NOT NULL)",
    "searched": "SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '+') ELSE '' END AS title, CASE p_partkey % 4 WHEN 0 THEN 'https://a.test/' WHEN 1 THEN 'https://b.test/' ELSE '' END AS url, CASE p_partkey % 4 WHEN 2 THEN 'exa needs a key' WHEN 3 THEN 'unknown provider ''none''' ELSE '' END AS error FROM part",
    "record_store": "SELECT run_id, count(*) AS n, count(*) FILTER (o = 1) AS odd FROM (SELECT run_id, url, max(item_id % 2) AS o FROM batch_item WHERE url IS NOT NULL GROUP BY ALL) GROUP BY run_id",
    "cache_first": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_name || '!' ELSE p_name END AS n, CASE WHEN p_partkey % 3 = 0 THEN 'c' ELSE 'm' END AS s, p_partkey % 3 = 0 AS from_cache, '' AS error FROM part",
    "module_transforms": "SELECT event_id, CASE WHEN k % 10 = 0 THEN k ELSE k + 1 END AS k, CASE WHEN k % 10 = 0 THEN 'tens' ELSE '' END AS error FROM (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE event_type = 'click')",
    "table_functions": "SELECT n_nationkey, unnest(['https://a.test/n/' || n_name, 'https://b.test/']) AS url FROM nation",
    "watch_stream": "SELECT url, item_id AS seq, coalesce(lag(h) OVER w <> h, false) AS changed, coalesce(lag(h) OVER w, '') AS old_hash, h AS new_hash FROM (SELECT *, sha256(markdown) AS h FROM batch_item WHERE ok AND url IS NOT NULL) WINDOW w AS (PARTITION BY url ORDER BY item_id)",
    "watch_hash_stream": "SELECT host AS url, item_id AS seq, o AS old_seq, true AS differs FROM (SELECT host, item_id, title, lag(title) OVER w AS t, lag(item_id) OVER w AS o FROM batch_item WHERE ok AND title IS NOT NULL WINDOW w AS (PARTITION BY host ORDER BY item_id)) WHERE t <> title",
    "heal_stream": _LEDGER["healer_triggers"].replace("SELECT host, item_id FROM f WHERE fire", "SELECT host AS domain, item_id AS seq FROM f WHERE fire"),
    "throttle_stream": """WITH RECURSIVE o AS (SELECT host, item_id, row_number() OVER (PARTITION BY host ORDER BY item_id) AS n FROM batch_item),
        f(host, n, item_id, d) AS (SELECT host, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS DOUBLE) FROM o WHERE n = 1
            UNION ALL SELECT o.host, o.n, o.item_id, CASE WHEN o.item_id % 4 = 0 THEN least(2 * greatest(f.d, 1.0), 60.0) ELSE greatest(0.75 * greatest(f.d, 1.0), 1.0) END FROM f JOIN o ON o.host = f.host AND o.n = f.n + 1)
        SELECT host, item_id AS seq, round(d, 6) AS delay_s FROM f WHERE n > 0""",
    "seen_stream": _canon("(SELECT * FROM batch_item WHERE url IS NOT NULL)") + "SELECT run_id, count(DISTINCT canonical) AS n FROM canon GROUP BY run_id",
}
