"""Breadth-first crawl over tables: links joined with pages level by level, exact dedup by anti-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, has_asset_extension, is_fetchable, url_hash
from ..session import checkpointed


def discovered(links: DataFrame, url_col: str, scope: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, url_hash) of the links that may be enqueued: fetchable, canonical, no assets, in scope; each once.

    scope is a predicate over the column ``url`` of canonical URLs. The columns of keep stay in front;
    each URL is then there once for each of their values.
    """
    out = links.where(is_fetchable(url_col)).select(*keep, canonical_url(url_col).alias("url")).where("url is not null")
    out = out.where(~has_asset_extension("url"))
    if scope is not None:
        out = out.where(scope)
    return out.distinct().select(*keep, "url", url_hash("url").alias("url_hash"))


def enqueued(new: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows of new that were never seen, each hash once."""
    return new.dropDuplicates(["url_hash"]).join(visited.select("url_hash"), "url_hash", "left_anti")


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int | None = None, scope: Column | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(url, url_hash, depth): least depth of every page reached from the seeds.

    links: (src_hash, url) with canonical source hashes. Depth -1 is seeds only. The loop ends
    when a level brings nothing new; each level is cut off by a checkpoint, so that its lineage
    does not grow, and the hashes seen so far are met by a hash anti-join.
    lists: for pages that link to whole lists of URLs, (keys, url, url_hash) as discovered keeps
    them; links is then (src_hash, keys). Pages and URLs meet by the keys of their lists, and no
    row is made for each pair of them.
    """
    level = checkpointed(discovered(seeds, "url", scope).withColumn("depth", F.lit(0)))
    levels, taken, depth = [level], 0, 0
    if max_pages is not None:
        level = level.orderBy("url").limit(max_pages)
        levels, taken = [level], level.count()
    edges = links.select("src_hash", "url") if lists is None else links
    keys = [c for c in edges.columns if c != "src_hash"]
    while depth < max_depth and (max_pages is None or taken < max_pages):
        found = edges.join(level.select(F.col("url_hash").alias("src_hash")), "src_hash", "left_semi").select(keys)
        if lists is None:
            found = discovered(found, "url", scope)
        else:
            found = lists.join(found.distinct(), keys, "left_semi")
            found = found.where(scope) if scope is not None else found
        seen = reduce(DataFrame.unionByName, levels)
        nxt = enqueued(found, seen).select("url", "url_hash").withColumn("depth", F.lit(depth + 1))
        if max_pages is not None:
            nxt = nxt.orderBy("url").limit(max_pages - taken)
        nxt = checkpointed(nxt)
        n = nxt.count()
        if not n:
            break
        levels.append(nxt)
        level, taken, depth = nxt, taken + n, depth + 1
    return reduce(DataFrame.unionByName, levels)


def seeded(seed: DataFrame, listed: DataFrame, scope: Column | None = None, max_pages: int | None = 100, sitemap_only: bool = False, cap_first: bool = True) -> DataFrame:
    """(url) to start from: the seed and the listed sitemap URLs in scope.

    The listing is cut to max_pages before the scope filter, or after it with cap_first False
    (then no page in scope is lost to pages out of it). The seed always stays, except in
    sitemap-only runs, where an empty listing is an error.
    """
    urls = listed.select(canonical_url("url").alias("url")).where("url is not null").distinct()
    cut = lambda df: df.orderBy("url").limit(max_pages) if max_pages is not None else df
    urls = cut(urls) if cap_first else urls
    urls = urls.where(scope) if scope is not None else urls
    urls = urls if cap_first else cut(urls)
    if sitemap_only:
        if urls.limit(1).isEmpty():
            raise ValueError("the sitemaps list nothing in scope")
        return urls
    return seed.select(canonical_url("url").alias("url")).where("url is not null").union(urls).distinct()
