"""Queries over the link graph, robots rules and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import facts as P
from ..operators import frontier as G
from ..session import table

def page_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl over the links of the fetched pages from every page's host root, two levels deep."""
    t = table(spark, sf_dir, "raw_page")
    f = P.page_facts(t, carry=["url"])
    links = f.select(U.homepage("url").alias("home"), F.explode("hrefs").alias("url")).select(U.url_hash(U.canonical_url("home")).alias("src_hash"), "url")
    seeds = t.select(U.homepage("url").alias("url")).where("url <> ''").distinct()
    return G.crawl(seeds, links, 2).select("url", "depth")


def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier URLs of the largest depth that no smaller depth has reported, by anti-join."""
    t = table(spark, sf_dir, "frontier").select("url_hash", "depth")
    deep = t.agg(F.max("depth").alias("m"))
    new = t.join(F.broadcast(deep), t.depth == deep.m).select("url_hash")
    return G.enqueued(new, t.join(F.broadcast(deep), t.depth < deep.m).select("url_hash"))


QUERIES = {f.__name__: f for f in (page_crawl, new_links)}

from .web_queries import _HOSTPORT, _PAGELINKS, _canon, _part  # noqa: E402

_home = lambda u: f"regexp_replace(lower({_part(u, 1)}) || '://' || {_HOSTPORT(u)} || '/', '^(https://[^/]*):443/|^(http://[^/]*):80/', '\\1\\2/')"
_ASSETS = "|".join(U.ASSET_EXTENSIONS)
SQL = {
    "new_links": "SELECT DISTINCT url_hash FROM frontier WHERE depth = (SELECT max(depth) FROM frontier) AND url_hash NOT IN (SELECT url_hash FROM frontier WHERE depth < (SELECT max(depth) FROM frontier))",
    "page_crawl": "WITH RECURSIVE " + _canon(_PAGELINKS).strip().removeprefix("WITH ") + f""", l AS (SELECT DISTINCT {_home('u')} AS s, canonical AS t FROM canon WHERE canonical IS NOT NULL AND NOT regexp_matches(lower({_part('canonical', 3)}), '\\\\.(' || '{_ASSETS}' || ')$')),
        w AS (SELECT DISTINCT {_home('url')} AS url, 0 AS depth FROM raw_page WHERE {_part('url', 1)} <> '' AND {_HOSTPORT('url')} <> '' UNION SELECT l.t, w.depth + 1 FROM w JOIN l ON l.s = w.url WHERE w.depth < 2)
        SELECT url, min(depth) AS depth FROM w GROUP BY url""",
}
