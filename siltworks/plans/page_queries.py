"""Queries of page facts, rendering and classification, over pages built from the star tables.

Every page has one known layout, so the SQL can say what each operator has to find in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..functions import quality as Q
from ..functions import text as X
from ..operators import clean as CL
from ..operators import diff as D
from ..operators import facts as P
from ..operators.page_records import page_records
from ..session import table
from .web_queries import _wc

_PAGE = (
    '<html lang="en"><head><title> {n} </title><meta name="description" content="On {t}"><meta name="author" content="{b}"><meta property="article:published_time" content="2026-01-0{d}"><meta property="og:site_name" content="Shop &amp; Co"><meta property="og:title" content="{n}!"><meta name="twitter:card" content="summary">'
    '<link rel="shortcut icon" href="/f.ico"><link rel="canonical" href="https://shop.test/p/{k}"><style>h1 {{ color: #0A{s}; font-family: "Body {b}", Serif }}</style><script src="/a.js">var a = {s};</script><script type="application/ld+json">{{"@type": "Thing", "n": {s}}}</script></head><body><nav><a href="/x{s}">To {b}</a><a href="#top">Top</a></nav>'
    '<article><h1>{n}</h1><p>On <b>{t}</b> &lt;{k}&gt;.</p><p style="display: none">secret {s}</p><div class="share">Share {b}</div><ul><li>one {s}</li><li><a href="https://b.test/{k}">two</a></li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>{s}</td><td>{k}</td></tr></table></article></body></html>'
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    page: Column = F.lit(_PAGE.replace("{{", "{").replace("}}", "}"))
    parts = {"n": F.col("p_name"), "t": F.col("p_type"), "b": F.replace("p_brand", F.lit("#"), F.lit("")), "d": (F.col("p_partkey") % 9 + 1).cast("string"), "k": F.col("p_partkey").cast("string"), "s": (F.col("p_size") + 1000).cast("string")}
    for name, value in parts.items():
        page = F.replace(page, F.lit("{" + name + "}"), value)
    return t.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.test/p/"), parts["k"], F.lit("?x=1")).alias("url"), page.alias("html"), "p_size")


def built_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language, metadata, embedded data and links of every page."""
    f = P.page_facts(_pages(spark, sf_dir))
    return f.select(F.col("id").alias("page_id"), "title", "lang", "description", "author", "date", "site_name", "favicon", "canonical", "h1", "sidecar", F.concat_ws(" ", "hrefs").alias("hrefs"), F.concat_ws(",", "colors").alias("colors"), F.concat_ws(",", "fonts").alias("fonts"))


def built_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible characters, script bytes, links and hidden elements of every page."""
    f = P.page_facts(_pages(spark, sf_dir))
    return f.select(F.col("id").alias("page_id"), "visible_chars", "script_bytes", "link_count", "hidden")


def built_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link-preview metadata of every page."""
    g = lambda f: F.get_json_object("record", f"$.{f}")
    return page_records(_pages(spark, sf_dir), "og").select(F.col("id").alias("page_id"), g("og_title").alias("og_title"), g("twitter_card").alias("twitter_card"), g("title").alias("title"), g("description").alias("description"), g("canonical").alias("canonical"), g("h1").alias("h1"), "error")


def built_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, items and links in document order, then tables."""
    from ..functions.dom import parse
    from ..functions.markdown import fallback

    @F.pandas_udf("string")
    def render(pages):
        return pages.map(lambda p: fallback(parse(p)))

    return _pages(spark, sf_dir).select("page_id", render("html").alias("fallback"))


def built_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their hidden elements, serialised anew."""
    return P.hidden_stripped(_pages(spark, sf_dir)).select(F.col("id").alias("page_id"), "removed", F.expr("html like '%secret%'").alias("secret"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("h1"))


def built_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut to headings and lists, without shares."""
    s = P.dom_scoped(_pages(spark, sf_dir), ["article h1", "ul > li:nth-of-type(1)"], [".share"])
    return s.select(F.col("id").alias("page_id"), F.regexp_replace(X.strip_tags("html"), r"\s+", " ").alias("text"))


def built_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main content as Markdown: the heading and the table are there, the menu is not."""
    m = P.page_markdowns(_pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<ul><li>"), F.concat(F.lit("<p>"), F.repeat(F.lit("The thing is described in words, with care, for those who read. "), 12), F.lit("</p><ul><li>")))))
    return m.select(F.col("id").alias("page_id"), F.regexp_extract("markdown", r"(?m)^# (.*)$", 1).alias("h1"), F.col("markdown").contains("](/x").alias("menu"), F.regexp_extract("markdown", r"(?m)^\|\s*(\d+)\s*\|\s*\d+\s*\|$", 1).alias("cell"), "fell_back")


def built_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the cleaning composite: title, metadata, word counts and quality by status."""
    p = _pages(spark, sf_dir).withColumns({"final_url": F.lit(None).cast("string"), "status": F.when(F.col("p_size") % 3 == 0, 500).otherwise(200), "content_type": F.lit("text/html")})
    c = CL.clean_pages(p)
    return c.select("page_id", "title", "description", "author", "quality", F.col("markdown").contains("secret").alias("secret"))


def built_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in input order: failed pages are rows with an error."""
    p = _pages(spark, sf_dir).withColumns({"final_url": F.lit(None).cast("string"), "status": F.when(F.col("p_size") % 3 == 0, 503).otherwise(200), "pos": F.col("page_id")})
    b = Engine(spark).batch(p, limit=None)
    return b.where("not ok or markdown is not null").select("url", "pos", F.when(F.col("error") == "unavailable", "unavailable").otherwise("").alias("error"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of every page: what its fields hold."""
    p = _pages(spark, sf_dir).withColumns({"final_url": F.lit(None).cast("string"), "status": F.lit(200)})
    j = Engine(spark).scrape(p, "json")
    g = lambda f: F.get_json_object("content", f"$.{f}")
    return j.select("page_id", g("title").alias("title"), g("page_format").alias("page_format"), g("metadata.author").alias("author"), g("metadata.lang").alias("lang"), g("structured_data").alias("structured_data"))


def quality_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules over items as if fetched with a status of their number."""
    t = table(spark, sf_dir, "batch_item").where("markdown is not null")
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 429, 500, 407, 200))), (F.col("item_id") % 8 + 1).cast("int"))
    body = F.concat(F.lit("<p>"), F.when(F.col("item_id") % 5 == 0, F.repeat(F.lit("more words "), 300)).otherwise(F.lit("")), "markdown", F.when(F.col("item_id") % 3 == 0, F.lit(" Sign in, captcha")).otherwise(F.lit("")), F.lit("</p>"))
    c = Q.with_issue(t.withColumns({"s": status, "b": body}), "issue", "words", "s", "b", "markdown", "title")
    return c.select("item_id", "words", "issue")


def word_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word diffs of two wordings of a sentence."""
    t = table(spark, sf_dir, "part")
    pairs = t.select("p_partkey", F.concat(F.lit("the old "), "p_brand", F.lit(" is here")).alias("a"), F.concat(F.lit("the new "), "p_brand", F.lit(" is here"), F.when(F.col("p_size") % 2 == 0, F.lit(" today")).otherwise(F.lit(""))).alias("b"))
    return D.word_diffs(pairs, "p_partkey", "a", "b").select(F.col("id").alias("p_partkey"), "diff", "error")


_MARKDOWN = "\n".join(
    (
        "# {n}", "", "![](/logo.png)", "![pic](/a.png) of [the {n}](/p/{k}) is **bold** and `code`.", "> said {b}.", "", "", "", "Alpha {k}", "Beta Corp", "", "12.99", "Total parts", "", "| a  |  {s} |", "|---|:-:|", ".btn .btn-primary", "{ color: red; margin: 0 auto; padding: 1px }", "Next at /page/2",
        "A long sentence about the {n}, which stands here twice.", "", "A long sentence about the {n}, which stands here twice.", "- item one", "- item one",
    )
)


def built_llm_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown slimmed for a model: marks, logo runs, styles, pagination and repeated paragraphs go, a number joins its label."""
    t = table(spark, sf_dir, "part")
    md: Column = F.lit(_MARKDOWN)
    for name, value in {"n": F.col("p_name"), "k": F.col("p_partkey").cast("string"), "b": F.col("p_type"), "s": F.col("p_size").cast("string")}.items():
        md = F.replace(md, F.lit("{" + name + "}"), value)
    return t.select("p_partkey", X.llm_body(md).alias("body"))


def built_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly pages seem to need scripts: bare mounts, heavy scripts, notices and embedded data."""
    t = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, F.concat(F.lit('<div id="root"></div><script>'), F.repeat(F.lit("x"), 100), F.lit("</script>"))).when(k == 1, F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 150), F.lit('</p><a href="/a">a</a><a href="/b">b</a><a href="/c">c</a>'))).when(k == 2, F.lit("<p>Please enable JavaScript</p>")).otherwise(F.lit('<script id="__NEXT_DATA__" type="application/json">{}</script>'))
    pages = t.select(F.col("p_partkey").alias("page_id"), F.lit("https://a.test/").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
    f = P.page_facts(pages, carry=["html"])
    s = Q.js_score("html", F.col("visible_chars"), F.col("script_bytes"), F.col("link_count"))
    return f.select(F.col("id").alias("page_id"), s.alias("score"), Q.needs_browser(s, Q.has_embedded_data("html")).alias("browser"))


def capped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to a hundred tokens by the text function that cleaning uses."""
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else CL.capped(t, 100)), "string")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cut("text")).alias("text_md5"))


def proposal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of pages that hold a value, as they are shown to whoever proposes selectors."""

    @F.pandas_udf("string")
    def part(pages, needles):
        return pages.combine(needles, lambda p, n: CL.trimmed_for_proposals(p, [n]))

    out = part("html", F.concat(F.lit("one "), (F.col("p_size") + 1000).cast("string")))
    return _pages(spark, sf_dir).select("page_id", out.contains("one 1").alias("found"), out.contains("<script").alias("scripts"))


QUERIES = {f.__name__: f for f in (built_facts, built_counts, built_social, built_fallback, built_hidden, built_scope, built_main, built_clean, built_batch, built_llm_body, built_scores, capped_texts, proposal_parts, formats, quality_items, word_diffs)}
_B = "WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k, replace(p_brand, '#', '') AS b, CAST(p_size + 1000 AS VARCHAR) AS s, p_name AS n, p_type AS t FROM part) "
_TAGS = "'(?s)<script.*?</script>|<style.*?</style>|<[^>]+>'"
_MARKERS = " OR ".join(f"contains(low, '{m}')" for m in X.CHALLENGE_MARKERS)
SQL = {
    "built_facts": _B + """SELECT p_partkey AS page_id, n AS title, 'en' AS lang, 'On ' || t AS description, b AS author, '2026-01-0' || (p_partkey % 9 + 1) AS date, 'Shop & Co' AS site_name, 'https://shop.test/f.ico' AS favicon, 'https://shop.test/p/' || k AS canonical, n AS h1, '{"@type": "Thing", "n": ' || s || '}' AS sidecar,
        'https://shop.test/x' || s || ' https://shop.test/p/' || k || '?x=1#top https://b.test/' || k AS hrefs, '#0a' || s AS colors, 'Body ' || b || ',Serif' AS fonts FROM p""",
    "built_counts": _B + """SELECT p_partkey AS page_id, CAST(2 * (length(n) + length(b) + length(k)) + length(t) + 45 AS INTEGER) AS visible_chars, CAST(strlen('/a.js' || 'var a = ' || s || ';' || '{"@type": "Thing", "n": ' || s || '}') AS INTEGER) AS script_bytes, 2 AS link_count, 1 AS hidden FROM p""",
    "built_social": _B + "SELECT p_partkey AS page_id, n || '!' AS og_title, 'summary' AS twitter_card, n AS title, 'On ' || t AS description, 'https://shop.test/p/' || k AS canonical, n AS h1, CAST(NULL AS VARCHAR) AS error FROM p",
    "built_fallback": _B + "SELECT p_partkey AS page_id, replace('To ' || b || '~~Top~~# ' || n || '~~On ' || t || ' <' || k || '>.~~secret ' || s || '~~- one ' || s || '~- two~two~~| a | b |~| ' || s || ' | ' || k || ' |', '~', chr(10)) AS fallback FROM p",
    "built_hidden": "SELECT p_partkey AS page_id, 1 AS removed, false AS secret, p_name AS h1 FROM part",
    "built_scope": _B + "SELECT p_partkey AS page_id, ' ' || n || ' one ' || s || ' ' AS text FROM p",
    "built_main": _B + "SELECT p_partkey AS page_id, n AS h1, false AS menu, s AS cell, false AS fell_back FROM p",
    "built_clean": _B + "SELECT p_partkey AS page_id, n AS title, 'On ' || t AS description, b AS author, CASE WHEN p_size % 3 = 0 THEN 'unavailable' ELSE 'empty' END AS quality, false AS secret FROM p",
    "built_batch": _B + "SELECT 'https://shop.test/p/' || k || '?x=1' AS url, p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN 'unavailable' ELSE '' END AS error FROM p",
    "formats": _B + """SELECT p_partkey AS page_id, n AS title, 'json' AS page_format, b AS author, 'en' AS lang, '{"@type": "Thing", "n": ' || s || '}' AS structured_data FROM p""",
    "quality_items": f"""WITH i AS (SELECT item_id, markdown, coalesce(title, '') AS title, [200, 401, 403, 404, 429, 500, 407, 200][item_id % 8 + 1] AS status, '<p>' || CASE WHEN item_id % 5 = 0 THEN repeat('more words ', 300) ELSE '' END || markdown || CASE WHEN item_id % 3 = 0 THEN ' Sign in, captcha' ELSE '' END || '</p>' AS body FROM batch_item WHERE markdown IS NOT NULL),
        w AS (SELECT item_id, status, {_wc('markdown')} AS words, {_wc("regexp_replace(body, " + _TAGS + ", ' ', 'g')")} AS bw, lower(body || chr(10) || markdown || chr(10) || title) AS low FROM i), r AS (SELECT *, words < 200 AS thin, ({_MARKERS}) AS marker FROM w)
        SELECT item_id, words, CASE WHEN status IN (401, 407) AND (contains(low, 'sign in') OR contains(low, 'log in') OR contains(low, 'login required')) THEN 'login-required' WHEN status = 401 AND thin AND (contains(low, 'unauthorized') OR contains(low, 'login')) THEN 'login-required'
        WHEN status = 403 AND thin AND (marker OR contains(low, 'blocked')) THEN 'access-denied' WHEN status = 429 OR status BETWEEN 500 AND 599 THEN 'unavailable' WHEN thin AND (bw - words > 50 OR (words < 20 AND bw > 2 * words)) THEN 'empty'
        WHEN thin AND marker AND (contains(low, '<title>just a moment') OR contains(low, 'checking your browser') OR contains(low, 'enable javascript and cookies')) THEN 'access-denied' WHEN thin AND marker AND words < 30 THEN 'empty' WHEN status = 404 AND thin THEN 'empty' ELSE '' END AS issue FROM r""",
    "word_diffs": "SELECT p_partkey, '- old' || chr(10) || '+ new' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '+ today' || chr(10) ELSE '' END AS diff, '' AS error FROM part",
    "built_llm_body": "SELECT p_partkey, replace('# ' || p_name || '~~pic of the ' || p_name || ' is bold and code.~said ' || p_type || '.~~Total parts: 12.99~~| a | ' || p_size || ' |~A long sentence about the ' || p_name || ', which stands here twice.~~- item one~- item one', '~', chr(10)) AS body FROM part",
    "built_scores": "SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 3 END AS score, p_partkey % 4 IN (0, 2) AS browser FROM part",
    "capped_texts": "WITH d AS (SELECT doc_id, text, CASE WHEN strlen(text) // 4 > 100 THEN text[1:list_max(list_filter(range(1, 401), lambda i: strlen(text[1:i]) <= 400))] END AS head FROM documents) SELECT doc_id, md5(CASE WHEN head IS NULL THEN text WHEN strlen(regexp_extract(head, '(?s)^(.*)\\n', 1)) > 200 THEN regexp_extract(head, '(?s)^(.*)\\n', 1) ELSE head END) AS text_md5 FROM d",
    "proposal_parts": "SELECT p_partkey AS page_id, true AS found, false AS scripts FROM part",
}
