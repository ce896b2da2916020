"""robots.txt: rules per host, longest match decides; sitemap documents and their listing."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, checkpointed

# Bounds of a sitemap listing.
MAX_CHILDREN, MAX_URLS, MAX_DEPTH = 100, 10_000, 5
MAX_ROBOTS = 1 << 20
#: Bytes of robots files that may be sent to every task.
BROADCAST_BYTES = 64 << 20


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[bool, str]] = field(default_factory=list)
    delay: float = 0.0


def parse_robots(body: str) -> list[Group]:
    groups: list[Group] = []
    open_agents = False
    for raw in body[:MAX_ROBOTS].splitlines():
        line = raw.split("#", 1)[0].strip()
        key, sep, value = line.partition(":")
        if not sep:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_agents or not groups:
                groups.append(Group())
            groups[-1].agents.append(value.lower())
            open_agents = True
            continue
        open_agents = False
        if not groups:
            continue
        if key in ("allow", "disallow"):
            groups[-1].rules.append((key == "allow", value))
        elif key == "crawl-delay":
            try:
                groups[-1].delay = max(groups[-1].delay, float(value))
            except ValueError:
                pass
    return groups


def groups_for(groups: list[Group], agent: str) -> list[Group]:
    own = [g for g in groups if any(a != "*" and a and a in agent.lower() for a in g.agents)]
    return own or [g for g in groups if "*" in g.agents]


class Rules:
    """What a robots body says to one agent, read once."""

    def __init__(self, body: str | None, agent: str):
        own = groups_for(parse_robots(body or ""), agent)
        # the longest pattern decides, a permission before a ban of its length
        rules = [(len(p), ok, re.compile(_pattern(p), re.S)) for g in own for ok, p in g.rules if p]
        self.rules = sorted(rules, key=lambda r: (-r[0], not r[1]))
        self.delay = max((g.delay for g in own), default=0.0)

    def allowed(self, path: str) -> bool:
        return next((ok for _, ok, p in self.rules if p.match(path or "/")), True)


def _pattern(rule: str) -> str:
    return "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + (r"\Z" if rule.endswith("$") else "")


def permits(status: int | None) -> bool | None:
    """What the status of a robots file says by itself: a client error permits everything, any other failure nothing; None where its rules decide."""
    if status is not None and 200 <= status < 300:
        return None
    return status is not None and 400 <= status < 500


def allowed(body: str | None, status: int | None, agent: str, path: str) -> bool:
    """Whether robots permit the path."""
    verdict = permits(status)
    return Rules(body, agent).allowed(path) if verdict is None else verdict


def crawl_delay(body: str | None, agent: str) -> float:
    return Rules(body, agent).delay


def robots_verdicts(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """(id, allowed, delay) for pages (id, host, path) and robots (host, status, body); hosts without robots deny nothing.

    Up to BROADCAST_ROWS robots files, counted, of together BROADCAST_BYTES, measured, are sent to
    the tasks and pages stay where they are; more are joined by host. Either way each body is read
    once per task.
    """
    files = robots.select("host", "status", F.substring("body", 1, MAX_ROBOTS).alias("body")).dropDuplicates(["host"])
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("bytes")).first()
    schema = "id bigint, allowed boolean, delay double"

    def verdict(known: dict, host: str | None, status: int | None, body: str | None, path: str | None) -> tuple[bool, float]:
        if status is None and body is None:
            return True, 0.0
        rules = known.get(host)
        if rules is None:
            if len(known) > 10_000:
                known.clear()
            rules = known[host] = Rules(body, agent)
        ok = permits(status)
        return rules.allowed(path) if ok is None else ok, rules.delay

    def emit(ids: pa.Array, got: list[tuple[bool, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([x for x, _ in got], pa.bool_()), pa.array([d for _, d in got], pa.float64())], names=["id", "allowed", "delay"])

    if size.n <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: (r.status, r.body) for r in files.toLocalIterator()})

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                yield emit(batch.column(0), [verdict(known, h, *sent.value.get(h, (None, None)), p) for h, p in rows])

        return pages.select("id", "host", "path").mapInArrow(look_up, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            hosts, ids, paths, status, body = batch.columns
            yield emit(ids, [verdict(known, *x) for x in zip(hosts.to_pylist(), status.to_pylist(), body.to_pylist(), paths.to_pylist())])

    return pages.select("id", "host", "path").join(files, "host", "left").select("host", "id", "path", "status", "body").mapInArrow(joined, schema)


def sitemap_seeds(robots: DataFrame) -> DataFrame:
    """(host, url) of the Sitemap lines of robots bodies, tolerant of case, spaces and comments; else the usual place."""
    lines = robots.select("host", F.explode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("line"))
    bare = F.trim(F.regexp_replace("line", r"#.*$", ""))
    found = lines.select("host", F.trim(F.regexp_extract(bare, r"(?i)^sitemap\s*:(.*)$", 1)).alias("url")).where("url <> ''").distinct()
    rest = robots.select("host").distinct().join(found, "host", "left_anti").select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"))
    return found.union(rest)


def sitemap_entries(body: bytes | None) -> tuple[str, list[str]]:
    """('urlset' or 'index' or '', locations in order, each once); gzip is told by its first bytes."""
    if not body:
        return "", []
    try:
        if body[:2] == b"\x1f\x8b":
            body = zlib.decompressobj(31).decompress(body, 64 << 20)
        root = ElementTree.fromstring(re.sub(rb"^\s+", b"", body))
    except (ElementTree.ParseError, OSError, zlib.error, EOFError, gzip.BadGzipFile, ValueError):
        return "", []
    kind = {"urlset": "urlset", "sitemapindex": "index"}.get(root.tag.rsplit("}", 1)[-1], "")
    out: dict[str, None] = {}
    for item in root:
        if item.tag.rsplit("}", 1)[-1] in ("url", "sitemap"):
            for x in item:
                if x.tag.rsplit("}", 1)[-1] == "loc" and (x.text or "").strip():
                    out.setdefault(x.text.strip())
    return kind, list(out)


def sitemap_listing(seeds: DataFrame, docs: DataFrame, max_children: int = MAX_CHILDREN, max_urls: int = MAX_URLS, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(urls, flags): locations listed from the seed documents, and per host whether the listing is truncated.

    seeds: (host, url); docs: (url, body). Index documents are followed level by level up to the
    depth; a document that is missing or can't be read truncates. The bounds are the feature
    and hold per host.
    """
    from pyspark.sql import Window

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sitemap_entries(bytes(b) if b is not None else None) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["url", "kind", "locs"])

    parsed = checkpointed(docs.select("url", F.col("body").cast("binary").alias("body")).dropDuplicates(["url"]).mapInArrow(parse, "url string, kind string, locs array<string>"))
    level = checkpointed(seeds.select("host", "url").distinct())
    visited, listed, cut = level, None, None
    for depth in range(max_depth + 1):
        got = checkpointed(level.join(parsed, "url", "left"))
        bad = got.where("kind is null or kind = ''").select("host")
        urls = got.where("kind = 'urlset'").select("host", F.explode("locs").alias("url"))
        listed = urls if listed is None else listed.union(urls)
        cut = bad if cut is None else cut.union(bad)
        nxt = got.where("kind = 'index'").select("host", F.explode("locs").alias("url")).distinct().join(visited, ["host", "url"], "left_anti")
        w = Window.partitionBy("host").orderBy("url")
        ranked = nxt.withColumn("n", F.row_number().over(w))
        cut = cut.union(ranked.where(F.col("n") > max_children).select("host"))
        level = checkpointed(ranked.where(F.col("n") <= max_children).select("host", "url"))
        if level.isEmpty():
            break
        if depth == max_depth:
            cut = cut.union(level.select("host"))
        visited = visited.union(level)
    ranked = listed.distinct().withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("url")))
    flags = seeds.select("host").distinct().join(cut.union(ranked.where(F.col("n") > max_urls).select("host")).distinct().withColumn("t", F.lit(True)), "host", "left").select("host", F.coalesce("t", F.lit(False)).alias("truncated"))
    return ranked.where(F.col("n") <= max_urls).select("host", "url"), flags
