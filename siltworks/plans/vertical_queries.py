"""Queries of the known sites: dispatch of URLs and typed records, over bodies built from the star tables.

A body has the layout of its site's API and the values of a table row, so that the SQL can read
the same values straight from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verticals as V
from ..operators.page_records import page_records
from ..session import table

#: URL pattern (``{k}``: the row's key, ``{w}``: a word of its name) and the site that takes it, '' if none does.
FORMS = (
    ("https://arxiv.org/abs/2401.{k}v2", "arxiv"), ("https://github.com/{w}/r{k}", "github_repo"), ("https://github.com/{w}/r{k}/issues/3", "github_repo"), ("https://github.com/{w}{k}", ""), ("https://pypi.org/project/{w}{k}/", "pypi"), ("https://www.npmjs.com/package/{w}{k}", "npm"), ("https://crates.io/crates/{w}{k}", "crates_io"),
    ("https://hub.docker.com/r/{w}/{k}", "dockerhub"), ("https://hub.docker.com/u/{w}{k}", ""), ("https://huggingface.co/{w}/m{k}", "huggingface"), ("https://huggingface.co/datasets/{w}{k}", ""), ("https://old.reddit.com/r/{w}/comments/{k}/t", "reddit"), ("https://news.ycombinator.com/item?id={k}", "hackernews"), ("https://news.ycombinator.com/item", ""),
    ("https://stackoverflow.com/questions/{k}/{w}", "stackoverflow"), ("https://www.trustpilot.com/review/{w}{k}.test", "trustpilot"), ("https://shop.test/products/{w}{k}", ""), ("ftp://github.com/{w}/r{k}", ""),
)


def _word(name: str) -> Column:
    return F.regexp_extract(name, r"^(\w+)", 1)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k.replace("__", "-")) for k, c in fields.items())))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumns({"k": F.col("p_partkey").cast("string"), "w": _word("p_name")})


def vertical_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site that takes each URL, and whether the site named for repositories would refuse it."""
    forms = F.array(*(F.lit(u) for u, _ in FORMS))
    url = F.replace(F.replace(F.element_at(forms, (F.col("p_partkey") % len(FORMS) + 1).cast("int")), F.lit("{k}"), F.col("k")), F.lit("{w}"), F.col("w"))
    t = _parts(spark, sf_dir).select("p_partkey", url.alias("url"))
    return t.select("p_partkey", F.coalesce(V.dispatch("url"), F.lit("")).alias("site"), F.coalesce(V.mismatch("url", F.lit("github_repo")), F.lit("")).alias("as_github"))


def vertical_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry in the order in which sites are tried."""
    return V.listing(spark)


def _records(t: DataFrame, name: str, url: Column, body: Column, status: Column | None = None) -> DataFrame:
    bodies = t.select("p_partkey", "p_name", url.alias("url"), body.alias("body"), (F.lit(200) if status is None else status).alias("status"))
    return V.records(bodies, name)


def pypi_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package records; every seventh body is an error page."""
    info = F.struct(F.col("w").alias("name"), F.concat(F.lit("1."), F.col("p_size")).alias("version"), F.col("p_name").alias("summary"), F.col("p_brand").alias("author"), F.when(F.col("p_size") > 20, F.lit(">=3.9")).alias("requires_python"))
    r = _records(_parts(spark, sf_dir), "pypi", F.concat(F.lit("https://pypi.org/project/"), "w", "k", F.lit("/")), _json(info=info), F.when(F.col("p_partkey") % 7 == 0, 404).otherwise(200))
    return r.select("p_partkey", "record.name", "record.version", "record.summary", "record.author", "record.requires_python", "record.url", "error")


def npm_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package records: the latest tag picks the version's description, else the package's."""
    latest = F.concat(F.lit("2."), F.col("p_size"))
    versions = F.create_map(latest, F.struct(latest.alias("version"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description")))
    r = _records(_parts(spark, sf_dir), "npm", F.concat(F.lit("https://www.npmjs.com/package/"), "k"), _json(name=F.col("p_name"), description=F.col("p_brand"), dist__tags=F.struct(latest.alias("latest")), versions=versions))
    return r.select("p_partkey", "record.name", "record.version", "record.description", "record.latest")


def crates_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package records under ``crate`` or at the top."""
    crate = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("0."), F.col("p_size")).alias("newest_version"), F.col("p_type").alias("description"), (F.col("p_size") * 100).alias("downloads"))
    body = F.when(F.col("p_partkey") % 2 == 0, _json(crate=crate)).otherwise(F.to_json(crate))
    r = _records(_parts(spark, sf_dir), "crates_io", F.concat(F.lit("https://crates.io/crates/"), "w", "k"), body)
    return r.select("p_partkey", "record.name", "record.newest_version", "record.description", "record.downloads", "record.url")


def docker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(_parts(spark, sf_dir), "dockerhub", F.concat(F.lit("https://hub.docker.com/r/"), "w", F.lit("/"), "k"), _json(name=F.col("p_name"), description=F.nullif("p_type", F.lit("ECONOMY")), star_count=F.col("p_size"), pull_count=F.col("p_size") * 1000, last_updated=F.lit("2026-01-02")))
    return r.select("p_partkey", "record.name", "record.description", "record.star_count", "record.pull_count", "record.last_updated")


def hub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and dataset records, told by the URL."""
    kind = F.when(F.col("p_partkey") % 3 == 0, F.lit("datasets/")).otherwise(F.lit(""))
    r = _records(_parts(spark, sf_dir), "huggingface", F.concat(F.lit("https://huggingface.co/"), kind, "w", F.lit("/"), "k"), _json(id=F.concat("w", F.lit("/"), "k"), likes=F.col("p_size"), downloads=F.col("p_size") * 10, tags=F.array("p_type", "p_brand"), pipeline_tag=F.when(F.col("p_size") > 25, F.lit("fill-mask"))))
    return r.select("p_partkey", "record.kind", "record.id", "record.likes", "record.downloads", F.concat_ws(",", "record.tags").alias("tags"), "record.pipeline_tag")


def shop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product records of shop bodies; prices are in cents."""
    images = F.array(F.struct(F.concat(F.lit("https://cdn.test/"), "k", F.lit(".png")).alias("src")), F.struct(F.lit("").alias("src")))
    r = _records(_parts(spark, sf_dir), "shopify_product", F.concat(F.lit("https://shop.test/products/"), "k"), _json(title=F.col("p_name"), vendor=F.col("p_brand"), price=F.round(F.col("p_retailprice") * 100).cast("bigint"), type=F.nullif("p_type", F.lit("ECONOMY")), product_type=F.lit("cheap"), images=images))
    return r.select("p_partkey", "record.title", "record.vendor", F.round("record.price", 2).alias("price"), "record.type", F.concat_ws(",", "record.images").alias("images"))


def arxiv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper records of feeds."""
    entry = F.format_string('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title><entry><title> %s </title><author><name>A %s</name></author><author><name>%s</name></author><summary>On %s</summary><published>2024-01-0%d</published></entry></feed>', "p_name", "k", "p_brand", "p_type", (F.col("p_partkey") % 9 + 1).cast("int"))
    r = _records(_parts(spark, sf_dir), "arxiv", F.concat(F.lit("https://arxiv.org/pdf/2401."), "k", F.lit(".pdf")), entry)
    return r.select("p_partkey", "record.title", F.concat_ws(";", "record.authors").alias("authors"), "record.summary", "record.published", "record.url")


def video_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video records from player data or from the embed service's answer, ids of all four URL shapes."""
    vid = F.lpad("k", 11, "x")
    shapes = F.array(F.lit("https://youtu.be/"), F.lit("https://www.youtube.com/watch?v="), F.lit("https://m.youtube.com/shorts/"), F.lit("https://youtube.com/embed/"))
    url = F.concat(F.element_at(shapes, (F.col("p_partkey") % 4 + 1).cast("int")), vid)
    details = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("shortDescription"), (F.col("p_size") * 7).cast("string").alias("viewCount"), F.col("p_size").cast("string").alias("lengthSeconds"))
    body = F.when(F.col("p_partkey") % 2 == 0, _json(videoDetails=details)).otherwise(_json(title=F.col("p_name"), author_name=F.col("p_brand")))
    r = _records(_parts(spark, sf_dir), "youtube", url, body)
    return r.select("p_partkey", "record.title", "record.author", "record.description", "record.views", "record.duration_s", "record.url")


def _linked_pages(spark: SparkSession, sf_dir: str, data: Column) -> DataFrame:
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), data, F.lit("</script></head><body><p>x</p></body></html>"))
    t = _parts(spark, sf_dir)
    return t.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.test/p/"), "k").alias("url"), F.when(F.col("p_partkey") % 5 == 0, F.lit("<p>none</p>")).otherwise(page).alias("html"))


def product_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in the linked data of pages; every fifth page has none."""
    offer = F.struct(F.col("p_size").alias("price"), F.lit("EUR").alias("priceCurrency"), F.lit("InStock").alias("availability"))
    pages = _linked_pages(spark, sf_dir, F.when(F.col("p_partkey") % 2 == 0, _json(name=F.col("p_name"), brand=F.struct(F.col("p_brand").alias("name")), offers=offer).substr(F.lit(1), F.lit(100_000))).otherwise(_json(name=F.col("p_name"), brand=F.col("p_brand"), offers=F.array(offer))))
    pages = pages.withColumn("html", F.replace("html", F.lit('{"name"'), F.lit('{"@type":"Product","name"')))
    r = page_records(pages.withColumn("html", F.replace("html", F.lit('"brand":{"@type":"Product",'), F.lit('"brand":{'))), "ecommerce_product")
    g = lambda f: F.get_json_object("record", f"$.{f}")
    return r.select(F.col("id").alias("page_id"), g("name").alias("name"), g("brand").alias("brand"), g("price").cast("int").alias("price"), g("currency").alias("currency"), g("availability").alias("availability"), g("url").alias("url"), "error")


def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation, rating and reviews in the linked data of pages."""
    data = F.format_string('[{"@type":"Organization","name":"%s","aggregateRating":{"ratingValue":"%d.5","reviewCount":%d}},{"@type":"Review","author":{"name":"%s"},"reviewRating":{"ratingValue":%d},"datePublished":"2026-01-01","reviewBody":"%s"}]', "p_name", F.col("p_size") % 5, "p_size", "w", F.col("p_size") % 5, "p_type")
    r = page_records(_linked_pages(spark, sf_dir, data), "trustpilot")
    g = lambda f: F.get_json_object("record", f"$.{f}")
    return r.select(F.col("id").alias("page_id"), g("name").alias("name"), g("rating_value").cast("double").alias("rating"), g("review_count").cast("int").alias("reviews"), g("reviews[0].author").alias("author"), g("reviews[0].rating").cast("int").alias("stars"), g("reviews[0].body").alias("body"), "error")


QUERIES = {f.__name__: f for f in (vertical_dispatch, vertical_list, pypi_records, npm_records, crates_records, docker_records, hub_records, shop_records, arxiv_records, video_records, product_records, review_records)}

_P = "WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k, regexp_extract(p_name, '^(\\w+)', 1) AS w FROM part) "
_SITE = "CASE p_partkey % 18 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s) in enumerate(FORMS)) + " END"
SQL = {
    "vertical_dispatch": f"SELECT p_partkey, site, CASE WHEN site = 'github_repo' THEN '' ELSE 'mismatch' END AS as_github FROM (SELECT p_partkey, {_SITE} AS site FROM part)",
    "vertical_list": "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s.name}', {str(s.opt_in).lower()})" for k, s in enumerate(V.SITES, 1)) + ") t(position, name, opt_in)",
    "pypi_records": _P + "SELECT p_partkey, CASE WHEN e THEN NULL ELSE w END AS name, CASE WHEN e THEN NULL ELSE '1.' || p_size END AS version, CASE WHEN e THEN NULL ELSE p_name END AS summary, CASE WHEN e THEN NULL ELSE p_brand END AS author, CASE WHEN e THEN NULL WHEN p_size > 20 THEN '>=3.9' ELSE '' END AS requires_python, CASE WHEN e THEN NULL ELSE 'https://pypi.org/project/' || w || k || '/' END AS url, CASE WHEN e THEN 'status 404' END AS error FROM (SELECT *, p_partkey % 7 = 0 AS e FROM p)",
    "npm_records": "SELECT p_partkey, p_name AS name, '2.' || p_size AS version, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS description, '2.' || p_size AS latest FROM part",
    "crates_records": _P + "SELECT p_partkey, p_name AS name, '0.' || p_size AS newest_version, p_type AS description, p_size * 100.0::DOUBLE AS downloads, 'https://crates.io/crates/' || w || k AS url FROM p",
    "docker_records": "SELECT p_partkey, p_name AS name, CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_type END AS description, p_size::DOUBLE AS star_count, p_size * 1000.0::DOUBLE AS pull_count, '2026-01-02' AS last_updated FROM part",
    "hub_records": _P + "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'dataset' ELSE 'model' END AS kind, w || '/' || k AS id, p_size::DOUBLE AS likes, p_size * 10.0::DOUBLE AS downloads, p_type || ',' || p_brand AS tags, CASE WHEN p_size > 25 THEN 'fill-mask' END AS pipeline_tag FROM p",
    "shop_records": _P + "SELECT p_partkey, p_name AS title, p_brand AS vendor, round(p_retailprice, 2) AS price, CASE WHEN p_type = 'ECONOMY' THEN 'cheap' ELSE p_type END AS type, 'https://cdn.test/' || k || '.png' AS images FROM p",
    "arxiv_records": _P + "SELECT p_partkey, trim(p_name) AS title, 'A ' || k || ';' || p_brand AS authors, 'On ' || p_type AS summary, '2024-01-0' || (p_partkey % 9 + 1) AS published, 'https://arxiv.org/abs/2401.' || k AS url FROM p",
    "video_records": _P + "SELECT p_partkey, p_name AS title, p_brand AS author, CASE WHEN e THEN p_type ELSE '' END AS description, CASE WHEN e THEN p_size * 7.0::DOUBLE ELSE 0.0 END AS views, CASE WHEN e THEN p_size::DOUBLE ELSE 0.0 END AS duration_s, 'https://www.youtube.com/watch?v=' || lpad(k, 11, 'x') AS url FROM (SELECT *, p_partkey % 2 = 0 AS e FROM p)",
    "product_records": _P + "SELECT p_partkey AS page_id, CASE WHEN e THEN NULL ELSE p_name END AS name, CASE WHEN e THEN NULL ELSE p_brand END AS brand, CASE WHEN e THEN NULL ELSE p_size END AS price, CASE WHEN e THEN NULL ELSE 'EUR' END AS currency, CASE WHEN e THEN NULL ELSE 'InStock' END AS availability, CASE WHEN e THEN NULL ELSE 'https://shop.test/p/' || k END AS url, CASE WHEN e THEN 'no product data' END AS error FROM (SELECT *, p_partkey % 5 = 0 AS e FROM p)",
    "review_records": _P + "SELECT p_partkey AS page_id, CASE WHEN e THEN NULL ELSE p_name END AS name, CASE WHEN e THEN NULL ELSE p_size % 5 + 0.5::DOUBLE END AS rating, CASE WHEN e THEN NULL ELSE p_size END AS reviews, CASE WHEN e THEN NULL ELSE w END AS author, CASE WHEN e THEN NULL ELSE p_size % 5 END AS stars, CASE WHEN e THEN NULL ELSE p_type END AS body, CASE WHEN e THEN 'no linked data' END AS error FROM (SELECT *, p_partkey % 5 = 0 AS e FROM p)",
}
