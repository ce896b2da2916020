"""Typed records of known sites from bodies that were already fetched.

Dispatch is an ordered CASE over the URL; records are native JSON paths, one struct each.
Error statuses give an error, never a record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import _col, hostname, path, scheme, segments, video_id


@dataclass(frozen=True)
class Site:
    """hosts: exact host names ('' any); pattern: what the path must match; opt_in: only by name, never by dispatch."""

    name: str
    hosts: tuple[str, ...]
    pattern: str
    opt_in: bool = False


# Hosts and paths of the known sites, in the order in which they are tried.
SITES = (
    Site("arxiv", ("arxiv.org", "www.arxiv.org", "export.arxiv.org"), r"^/(abs|pdf)/[^/]+/?$"),
    Site("shopify_product", ("",), r"/products/", True),
    Site("ecommerce_product", ("",), r"", True),
    Site("github_repo", ("github.com", "www.github.com"), r"^/[^/]+/[^/]+(/?|/(issues|pull|releases)(/.*)?)$"),
    Site("og", ("",), r"", True),
    Site("pypi", ("pypi.org", "www.pypi.org"), r"^/.*[^/]"),
    Site("npm", ("www.npmjs.com", "npmjs.com"), r"^/.*[^/]"),
    Site("crates_io", ("crates.io", "www.crates.io"), r"^/.*[^/]"),
    Site("dockerhub", ("hub.docker.com",), r"^/r/[^/]+/[^/]+"),
    Site("huggingface", ("huggingface.co",), r"^/(datasets/[^/]+/[^/]+|(?!datasets/)[^/]+/[^/]+)/?$"),
    Site("reddit", ("reddit.com", "www.reddit.com", "old.reddit.com", "new.reddit.com"), r"^/r/[^/]+"),
    Site("hackernews", ("news.ycombinator.com",), r"^/item/?$"),
    Site("stackoverflow", ("stackoverflow.com", "www.stackoverflow.com"), r"^/questions/[^/]+"),
    Site("trustpilot", ("trustpilot.com", "www.trustpilot.com"), r"^/review/[^/]+"),
    Site("youtube", ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be"), r""),
)


def matches(url: Column | str, site: Site) -> Column:
    ok = scheme(url).isin("http", "https")
    if site.hosts != ("",):
        ok = ok & hostname(url).isin(*site.hosts)
    if site.pattern:
        ok = ok & path(url).rlike(site.pattern)
    if site.name == "hackernews":
        ok = ok & _col(url).rlike(r"[?&]id=[^&#]")
    if site.name == "youtube":
        ok = ok & video_id(url).isNotNull()
    return ok


def dispatch(url: Column | str, sites: tuple[Site, ...] = SITES) -> Column:
    """Name of the first site that takes the URL, null if none does; opt-in sites never do."""
    out = None
    for s in sites:
        if not s.opt_in:
            out = F.when(matches(url, s), s.name) if out is None else out.when(matches(url, s), s.name)
    return out


def mismatch(url: Column | str, name: Column, sites: tuple[Site, ...] = SITES) -> Column:
    """'mismatch' where an explicitly named site does not take the URL, 'unknown' for unknown names, else null."""
    out = F.when(~name.isin(*(s.name for s in sites)), "unknown")
    for s in sites:
        out = out.when((name == s.name) & ~matches(url, s), "mismatch")
    return out


def listing(spark) -> DataFrame:
    return spark.createDataFrame([(k, s.name, s.opt_in) for k, s in enumerate(SITES, 1)], "position int, name string, opt_in boolean")


def json_body(body: Column | str) -> Column:
    """A body without byte-order mark, outer space and one layer of JSON quoting."""
    bare = F.regexp_replace(_col(body), "^[\\s\\x{FEFF}]+|\\s+\\z", "")
    inner = F.get_json_object(F.concat(F.lit("["), bare, F.lit("]")), "$[0]")
    return F.when(bare.startswith('"'), F.regexp_replace(inner, "^[\\s\\x{FEFF}]+|\\s+\\z", "")).otherwise(bare)


def text_at(body: Column, *paths: str) -> Column:
    """First non-empty string at the paths, '' if none."""
    return F.coalesce(*(F.nullif(F.get_json_object(body, p), F.lit("")) for p in paths), F.lit(""))


def number_at(body: Column, *paths: str) -> Column:
    return F.coalesce(*(F.get_json_object(body, p).try_cast("double") for p in paths), F.lit(0.0))


def _last(url: Column) -> Column:
    return F.coalesce(F.element_at(segments(url), -1), F.lit(""))


def record(name: str, url: Column | str, body: Column | str) -> Column:
    """The site's record as a struct from a bare body (json_body); fields that are absent are '' or 0."""
    u, b = _col(url), _col(body)
    t, n = lambda *p: text_at(b, *p), lambda *p: number_at(b, *p)
    if name == "github_repo":
        issue = F.get_json_object(b, "$.number").isNotNull()
        release = F.get_json_object(b, "$.tag_name").isNotNull()
        kind = F.when(release, "release").when(issue, F.when(path(u).contains("/pull/"), "pr").otherwise("issue")).otherwise("repo")
        return F.struct(
            kind.alias("kind"), t("$.full_name").alias("full_name"), t("$.description").alias("description"), n("$.stargazers_count").alias("stars"), n("$.forks_count").alias("forks"), t("$.language").alias("language"), F.lower(t("$.license.name")).alias("license"), n("$.open_issues_count").alias("open_issues"),
            F.when(release, t("$.name", "$.tag_name")).otherwise(t("$.title")).alias("title"), t("$.user.login").alias("author"), t("$.state").alias("state"), n("$.comments").alias("comments"), t("$.body").alias("body"), t("$.tag_name").alias("tag"), u.alias("url"),
        )
    if name == "hackernews":
        kids = F.from_json(F.get_json_object(b, "$.children"), "array<string>")
        parent = F.get_json_object(b, "$.parent_id")
        return F.struct(F.when(parent.isNotNull(), "comment").otherwise("story").alias("kind"), t("$.title").alias("title"), F.coalesce(F.nullif(t("$.url"), F.lit("")), u).alias("url"), n("$.points").alias("points"), t("$.author").alias("author"), F.greatest(F.coalesce(F.size(kids), F.lit(0)), F.lit(0)).cast("double").alias("comments"), t("$.text").alias("text"), parent.try_cast("bigint").alias("parent_id"))
    if name == "stackoverflow":
        answers = F.from_json(F.get_json_object(b, "$.items"), "array<struct<answer_id:bigint,score:double,body:string,is_accepted:boolean>>")
        own = F.filter(answers, lambda a: a.answer_id.isNotNull())
        return F.struct(F.lit("question").alias("kind"), t("$.items[0].title").alias("title"), n("$.items[0].score").alias("score"), F.from_json(F.get_json_object(b, "$.items[0].tags"), "array<string>").alias("tags"), F.when(F.get_json_object(b, "$.items[0].answer_id").isNull(), t("$.items[0].body")).otherwise("").alias("body"), t("$.items[0].owner.display_name").alias("owner"), F.transform(own, lambda a: F.struct(F.coalesce(a.score, F.lit(0.0)).alias("score"), F.coalesce(a.body, F.lit("")).alias("body"), F.coalesce(a.is_accepted, F.lit(False)).alias("is_accepted"))).alias("answers"))
    if name == "reddit":
        p = "$[0].data.children[0].data"
        return F.struct(F.lit("post").alias("kind"), t(f"{p}.title").alias("title"), t(f"{p}.author").alias("author"), n(f"{p}.score").alias("score"), t(f"{p}.selftext").alias("selftext"), u.alias("url"))
    if name == "pypi":
        return F.struct(*(t(f"$.info.{f}", f"$.{f}").alias(f) for f in ("name", "version", "summary", "author", "requires_python")), F.concat(F.lit("https://pypi.org/project/"), F.regexp_extract(path(u), r"(?:^|/)project/([^/]+)", 1), F.lit("/")).alias("url"))
    if name == "npm":
        latest = t("$.dist-tags.latest")
        versions = F.from_json(F.get_json_object(b, "$.versions"), "map<string,struct<version:string,description:string>>")
        at = F.try_element_at(versions, latest)
        return F.struct(t("$.name").alias("name"), F.coalesce(F.nullif(at.version, F.lit("")), latest).alias("version"), F.coalesce(F.nullif(at.description, F.lit("")), t("$.description")).alias("description"), latest.alias("latest"), u.alias("url"))
    if name == "crates_io":
        return F.struct(*(t(f"$.crate.{f}", f"$.{f}").alias(f) for f in ("name", "newest_version", "description")), n("$.crate.downloads", "$.downloads").alias("downloads"), F.concat(F.lit("https://crates.io/crates/"), _last(u)).alias("url"))
    if name == "dockerhub":
        return F.struct(t("$.name").alias("name"), t("$.description").alias("description"), n("$.star_count").alias("star_count"), n("$.pull_count").alias("pull_count"), t("$.last_updated").alias("last_updated"))
    if name == "huggingface":
        return F.struct(F.when(path(u).startswith("/datasets/"), "dataset").otherwise("model").alias("kind"), t("$.id").alias("id"), n("$.likes").alias("likes"), n("$.downloads").alias("downloads"), F.from_json(F.get_json_object(b, "$.tags"), "array<string>").alias("tags"), F.nullif(t("$.pipeline_tag"), F.lit("")).alias("pipeline_tag"))
    if name == "shopify_product":
        images = F.from_json(F.get_json_object(b, "$.images"), "array<struct<src:string>>")
        return F.struct(t("$.title").alias("title"), t("$.vendor").alias("vendor"), (n("$.price") / 100).alias("price"), t("$.type", "$.product_type").alias("type"), F.coalesce(F.filter(F.transform(images, lambda i: i.src), lambda s: F.coalesce(s, F.lit("")) != ""), F.array().cast("array<string>")).alias("images"), u.alias("url"))
    if name == "ecommerce_product":
        return F.struct(t("$.name", "$.title").alias("name"), F.when(F.get_json_object(b, "$.brand").startswith("{"), t("$.brand.name")).otherwise(t("$.brand")).alias("brand"), F.coalesce(F.get_json_object(b, "$.offers.price"), F.get_json_object(b, "$.offers[0].price")).alias("price"), t("$.offers.priceCurrency", "$.offers[0].priceCurrency").alias("currency"), t("$.offers.availability", "$.offers[0].availability").alias("availability"), F.coalesce(F.nullif(t("$.url"), F.lit("")), u).alias("url"))
    if name == "youtube":
        return F.struct(t("$.videoDetails.title", "$.title").alias("title"), t("$.videoDetails.author", "$.author_name").alias("author"), t("$.videoDetails.shortDescription").alias("description"), n("$.videoDetails.viewCount").alias("views"), n("$.videoDetails.lengthSeconds").alias("duration_s"), F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(u)).alias("url"))
    if name == "trustpilot":
        return F.struct(t("$.name").alias("name"), n("$.aggregateRating.ratingValue").alias("rating_value"), n("$.aggregateRating.reviewCount").alias("review_count"))
    if name == "arxiv":
        x = lambda e: F.trim(F.xpath_string(F.regexp_replace(_col(body), r'\sxmlns="[^"]*"', ""), F.lit(e)))
        return F.struct(x("/feed/entry[1]/title").alias("title"), F.transform(F.xpath(F.regexp_replace(_col(body), r'\sxmlns="[^"]*"', ""), F.lit("/feed/entry[1]/author/name/text()")), lambda a: F.trim(a)).alias("authors"), x("/feed/entry[1]/summary").alias("summary"), x("/feed/entry[1]/published").alias("published"), F.concat(F.lit("https://arxiv.org/abs/"), F.regexp_replace(_last(u), r"\.pdf$", "")).alias("url"))
    raise KeyError(name)


def records(bodies: DataFrame, name: str, url: str = "url", status: str = "status", body: str = "body") -> DataFrame:
    """bodies with the columns record and error; error 'status N' for other than 2xx, 'malformed' for bodies that are no JSON."""
    # the bare body is a column of its own, so that every field reads it instead of making it again
    bare = bodies.withColumn("_bare", F.col(body) if name == "arxiv" else json_body(body))
    ok = F.col(status).between(200, 299)
    good = F.lit(True) if name == "arxiv" else F.get_json_object("_bare", "$").isNotNull()
    error = F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("status "), F.coalesce(F.col(status).cast("string"), F.lit("none")))).when(~F.coalesce(good, F.lit(False)), "malformed")
    return bare.withColumn("error", error).withColumn("record", F.when(F.col("error").isNull(), record(name, url, "_bare"))).drop("_bare")
