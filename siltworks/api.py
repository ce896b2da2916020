"""One object with a method per verb; every method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import urls as U
from .operators import clean, diff, extraction, facts, frontier, robots, search, selectors, verticals
from .operators.schema import RecordSchema
from .session import importable

#: Pages of a batch.
BATCH = 100
FORMATS = ("markdown", "llm", "text", "json", "html", "raw")


class OptionError(ValueError):
    """Options that don't fit together; raised before any work."""


class Engine:
    """Pages are frames with page_id, url, final_url, status, headers, html."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        importable(spark)

    def scrape(self, pages: DataFrame, fmt: str = "markdown", max_tokens: int = 8000, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """(page_id, url, title, content, word_count, error): each page rendered; quality issues are the row's error."""
        if fmt not in FORMATS:
            raise OptionError(f"unknown format {fmt!r}")
        if max_tokens <= 0:
            raise OptionError("max_tokens must be positive")
        p = pages if "content_type" in pages.columns else pages.withColumn("content_type", F.lit(None).cast("string"))
        c = clean.clean_pages(p, include, exclude, max_tokens)
        raw = p.select("page_id", F.col("html").alias("raw"))
        head = X.llm_header(F.col("title"), F.col("url"), F.col("description"), F.col("author"), F.col("date"))
        foot = F.transform(X.footer_links("markdown"), lambda x: F.concat(F.lit("- ["), x.text, F.lit("]("), x.url, F.lit(")")))
        llm = F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.nullif(X.llm_body("markdown"), F.lit("")), F.when(F.size(foot) > 0, F.concat(F.lit("## Links\n\n"), F.concat_ws("\n", foot))))
        envelope = F.to_json(F.struct("url", F.col("url").alias("final_url"), "title", "markdown", F.col("sidecar").alias("structured_data"), F.lit("json").alias("page_format"), F.col("markdown").alias("content"), F.struct("description", "author", "date", "lang", "site_name", "image", "favicon").alias("metadata"), F.transform(X.links("markdown"), lambda x: x.url).alias("links"), F.transform(X.images("markdown"), lambda x: x.url).alias("images"), "word_count"))
        content = {"markdown": F.col("markdown"), "llm": llm, "text": X.to_text("markdown"), "json": envelope, "html": F.col("html"), "raw": F.col("raw")}[fmt]
        out = c.join(raw, "page_id") if fmt == "raw" else c
        return out.select("page_id", "url", "title", content.alias("content"), "word_count", F.nullif("quality", F.lit("")).alias("error"))

    def batch(self, pages: DataFrame, order: str = "pos", limit: int | None = BATCH) -> DataFrame:
        """(url, ok, title, markdown, error) in input order; failures are data on the row; more than ``limit`` pages are an error before any work."""
        if limit is not None and pages.select(order).limit(limit + 1).count() > limit:
            raise OptionError(f"a batch holds at most {limit} pages")
        s = self.scrape(pages).withColumnRenamed("content", "markdown")
        j = pages.select("page_id", F.col("url").alias("asked"), order).join(s.drop("url"), "page_id", "left")
        error = F.coalesce("error", F.when(F.col("markdown").isNull(), "no body"))
        return j.select(F.col("asked").alias("url"), error.isNull().alias("ok"), "title", F.when(error.isNull(), F.col("markdown")).alias("markdown"), error.alias("error"), order).orderBy(order)

    def crawl(self, pages: DataFrame, seed: str, max_depth: int = 3, max_pages: int | None = 100, scope: Column | None = None) -> DataFrame:
        """Pages reached from the seed over the links of the given pages, with depth."""
        f = facts.page_facts(pages, carry=["url"]).select(F.col("url").alias("src"), F.explode("hrefs").alias("url"))
        links = f.select(U.url_hash(U.canonical_url("src")).alias("src_hash"), "url")
        seeds = self.spark.createDataFrame([(seed,)], "url string")
        return frontier.crawl(seeds, links, max_depth, max_pages, U.in_scope("url", seed) if scope is None else scope)

    def map(self, robots_bodies: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        return robots.sitemap_listing(robots.sitemap_seeds(robots_bodies), docs)

    def extract(self, pages: DataFrame, schema: RecordSchema, complete: extraction.Complete) -> DataFrame:
        m = facts.page_markdowns(pages).select("id", "markdown")
        return extraction.extract(facts.page_facts(pages).select("id", "sidecar").join(m, "id"), schema, complete)

    def summarize(self, pages: DataFrame, complete: extraction.Complete, sentences: int = 3) -> DataFrame:
        return extraction.summaries(facts.page_markdowns(pages).select("id", "markdown"), complete, sentences)

    def diff(self, pairs: DataFrame, id_col: str, prev: str, cur: str) -> DataFrame:
        return diff.word_diffs(pairs, id_col, prev, cur)

    def brand(self, pages: DataFrame) -> DataFrame:
        return facts.page_facts(pages).select("id", "colors", "fonts", "logo", "favicon")

    def vertical(self, bodies: DataFrame, name: str) -> DataFrame:
        return verticals.records(bodies, name)

    def extractors(self) -> DataFrame:
        return verticals.listing(self.spark)

    def search(self, bodies: DataFrame, limit: int = 10) -> DataFrame:
        return search.hits(bodies, limit)

    def cached_selectors(self, cache: DataFrame, domain: str | None = None, schema_hash: str | None = None) -> DataFrame:
        out = cache
        if domain:
            out = out.where(F.col("domain") == domain)
        if schema_hash:
            out = out.where(F.col("schema_hash") == schema_hash)
        return out.orderBy("domain", "schema_hash")

    def apply_selectors(self, pages: DataFrame, cache: DataFrame) -> DataFrame:
        return selectors.apply_selectors(pages, cache)
