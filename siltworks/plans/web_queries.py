"""Queries over pages, items and documents: URLs, text, classification, facts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as X
from ..functions import urls as U
from ..operators import facts as P
from ..operators.clean import clean_pages
from ..session import spread, table
from ..sources.pages import ssrf_verdicts

_SP = r"\s\x{0B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(u: str, g: int) -> str:
    return f"regexp_extract(trim({u}), '{_URI}', {g})"


_HOSTPORT = lambda u: f"lower(regexp_replace({_part(u, 2)}, '^.*@', ''))"
_HOST = lambda u: f"regexp_replace(regexp_replace({_HOSTPORT(u)}, ':\\d*$', ''), '\\.$', '')"
_CANON = f"""
WITH s AS (SELECT *, lower({_part('url', 1)}) AS sc, {_HOSTPORT('url')} AS hp, {_part('url', 3)} AS pa, {_part('url', 4)} AS qu FROM {{source}}),
p AS (SELECT *, list_filter(list_transform(list_filter(string_split(regexp_replace(qu, '^\\?', ''), '&'), lambda x: x <> '' AND NOT contains(x, ';')), lambda x: {{{{'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=?(.*)$', 1), '+', ' '))}}}}), lambda x: NOT (starts_with(lower(x.k), 'utm_') OR lower(x.k) IN ('gclid', 'fbclid', 'msclkid'))) AS kv FROM s),
c AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(kv, lambda x, i: {{{{'k': x.k, 'i': i, 'v': x.v}}}})), lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS q2 FROM p),
canon AS (SELECT *, CASE WHEN sc <> '' AND sc <> 'file' AND hp <> '' THEN sc || '://' || CASE sc WHEN 'http' THEN regexp_replace(hp, ':80$', '') WHEN 'https' THEN regexp_replace(hp, ':443$', '') ELSE hp END || CASE WHEN pa = '' THEN '/' ELSE pa END || CASE WHEN qu = '' THEN '' WHEN qu = '?' THEN '?' WHEN q2 <> '' THEN '?' || q2 ELSE '' END END AS canonical FROM c)
"""


def _canon(source: str) -> str:
    return _CANON.format(source=source).replace("{{", "{").replace("}}", "}")


def _wc(md: str) -> str:
    bare = f"regexp_replace(regexp_replace({md}, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', '', 'g'), '\\[([^\\]]*)\\]\\(([^)\\s]+)(?:\\s+\"[^\"]*\")?\\)', '\\1', 'g')"
    trim = f"regexp_replace(x, '^[{_SP}]+|[{_SP}]+$', '', 'g')"
    return f"CAST(coalesce(list_sum(list_transform(list_filter(list_transform(string_split({bare}, chr(10)), lambda x: {trim}), lambda x: NOT starts_with(x, '```')), lambda x: len(list_filter(string_split_regex(regexp_replace(x, '[#*_`>~\\-|\\[\\]()!]+', ' ', 'g'), '[{_SP}]+'), lambda w: w <> '')))), 0) AS INTEGER)"


def _unescaped(text: str) -> str:
    """SQL for a text with its numeric and Latin entities read."""
    known = "map {" + ", ".join(f"'{n}': {c}" for n, c in name2codepoint.items() if c < 256 or 0x2010 <= c < 0x2040) + "}"
    whole = "regexp_matches(x, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+[0-9]*);')"
    name, rest = "regexp_extract(x, '^([^;]*);', 1)", "regexp_replace(x, '^[^;]*;', '')"
    code = f"CASE WHEN starts_with(lower({name}), '#x') THEN CAST('0x' || substr({name}, 3) AS INTEGER) WHEN starts_with({name}, '#') THEN CAST(substr({name}, 2) AS INTEGER) ELSE {known}[{name}] END"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda x, i: CASE WHEN i = 1 THEN x WHEN {whole} AND {code} IS NOT NULL THEN chr({code}) || {rest} ELSE '&' || x END), '')"


def _plain(md: str) -> str:
    """The thirteen replacements of plain text as nested calls."""
    t = md
    for pattern, to in ((X.IMAGE, ""), (X.LINK, "\\1"), (X.HEADING, ""), (X.BOLD, "\\1"), (X.ITALIC, "\\1\\2\\3"), (X.CODE, "\\1"), (r"(?m)^\s*>\s?", ""), (X.FENCE, ""), ("`", ""), (r"\*", ""), (r"[ \t]+", " "), (r"(?m)^[ \t]+", ""), (r"\n{3,}", "\n\n")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({t}, '^[{_SP}]+|[{_SP}]+\\z', '', 'g')"


def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form and hash of every frontier URL."""
    c = U.canonical_url("url")
    return table(spark, sf_dir, "frontier").select("seq", c.alias("canonical"), U.url_hash(c).alias("hash"), (U.url_hash(c) == F.col("url_hash")).alias("same"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "batch_item")
    return t.select("item_id", U.hostname("url").alias("hostname"), U.domain_key("url").alias("domain"), F.size(U.segments("url")).alias("n_segments"), U.last_segment("url").alias("last_segment"), U.homepage("url").alias("homepage"))


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct canonical URLs and reports per run."""
    t = table(spark, sf_dir, "frontier").select("run_id", U.canonical_url("url").alias("u"))
    return t.groupBy("run_id", "u").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("urls"), F.sum("n").alias("reports"))


def crawl_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier URLs in the scope of one seed, by include and exclude globs."""
    t = table(spark, sf_dir, "frontier").select("seq", U.canonical_url("url").alias("url"))
    ok = U.in_scope("url", "https://paperlantern.example/", include=("/blog/**", "/guide/*", "/news/*"), exclude=("/**/*zel*",))
    return t.where(ok & ~U.has_asset_extension("url") & U.is_fetchable("url")).select("seq", "url")


def homepage_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct homepages of refused pages, the targets of a warm-up request."""
    t = table(spark, sf_dir, "raw_page").where(F.col("status").isin(401, 403, 429, 503))
    return t.select(U.homepage("url").alias("homepage")).where("homepage <> ''").groupBy("homepage").agg(F.count("*").alias("pages"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_facts(table(spark, sf_dir, "raw_page")).select(F.col("id").alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("lang", F.lit("")).alias("lang"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing link targets of every page, each once."""
    f = P.page_facts(table(spark, sf_dir, "raw_page")).select(F.col("id").alias("page_id"), F.explode("hrefs").alias("href"))
    return f.select("page_id", U.canonical_url("href").alias("url")).where("url is not null").distinct()


def link_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.page_facts(table(spark, sf_dir, "raw_page")).select(F.explode("hrefs").alias("href"))
    return f.select(U.hostname(U.canonical_url("href")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("links"))


def page_script_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that the script score needs, and the score."""
    f = P.page_facts(table(spark, sf_dir, "raw_page"), carry=["html"])
    s = Q.js_score("html", F.col("visible_chars"), F.col("script_bytes"), F.col("link_count"))
    return f.select(F.col("id").alias("page_id"), "visible_chars", "script_bytes", "link_count", "hidden", s.alias("score"), Q.needs_browser(s, Q.has_embedded_data("html")).alias("browser"))


def brand_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.page_facts(table(spark, sf_dir, "raw_page"))
    return f.select(F.col("id").alias("page_id"), F.coalesce(F.concat_ws(",", "colors"), F.lit("")).alias("colors"), F.coalesce(F.concat_ws(",", "fonts"), F.lit("")).alias("fonts"))


def fallback_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.page_markdowns(table(spark, sf_dir, "raw_page"))
    return m.select(F.col("id").alias("page_id"), "fallback", F.length("fallback").alias("n_chars"))


def main_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.page_markdowns(table(spark, sf_dir, "raw_page"))
    return m.select(F.col("id").alias("page_id"), "markdown", "fell_back", X.word_count("markdown").alias("words"))


def hidden_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.hidden_stripped(table(spark, sf_dir, "raw_page"))
    return s.select(F.col("id").alias("page_id"), "removed", F.md5("html").alias("html_md5"))


def dom_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.dom_scoped(table(spark, sf_dir, "raw_page"), ["h1", "article p"], [".share"])
    return s.select(F.col("id").alias("page_id"), F.length("html").alias("n_chars"))


def strip_tags_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "raw_page").where("html is not null")
    return t.select("page_id", F.size(X.fields(X.strip_tags("html"))).alias("words"))


def word_count_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "batch_item").select("item_id", "markdown").where("markdown is not null"))
    return t.select("item_id", X.word_count("markdown").alias("words"), X.token_estimate("markdown").alias("tokens"))


def plain_text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "batch_item").select("item_id", "markdown").where("markdown is not null"))
    return t.select("item_id", F.md5(X.to_text("markdown")).alias("text_md5"), F.length(X.to_text("markdown")).alias("n_chars"))


def llm_body_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "batch_item").select("item_id", "markdown").where("markdown is not null"))
    return t.select("item_id", X.llm_body("markdown").alias("body"))


def llm_header_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "batch_item")
    none = F.lit(None).cast("string")
    return t.select("item_id", X.llm_header(F.col("title"), F.col("url"), none, none, F.date_format("fetched_at", "yyyy-MM-dd")).alias("header"))


def cap_tokens_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(X.cap_tokens("text", 100)).alias("bytes"), F.md5(X.cap_tokens("text", 100)).alias("text_md5"))


def cap_words_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.cap_words("text", 40).alias("head"))


def truncate_sentences_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_sentences("text", 2).alias("head"))


def content_hash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash("text").alias("hash"))


def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of items, each URL once per item, with their position."""
    t = spread(table(spark, sf_dir, "batch_item").select("item_id", "markdown").where("markdown is not null"))
    return t.select("item_id", F.posexplode(X.links("markdown")).alias("pos", "l")).select("item_id", "pos", "l.text", "l.url")


def challenge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "raw_page").where("html is not null")
    return t.select("page_id", X.has_challenge_marker("html").alias("marker"), F.coalesce(Q.challenge_vendor("html", "headers"), F.lit("")).alias("vendor"), F.coalesce(Q.is_challenge_page("status", "html"), F.lit(False)).alias("challenge"))


def quality_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality issue of every page by its status, body, main content and title."""
    c = P.page_content(table(spark, sf_dir, "raw_page"), ["status", "html"])
    return Q.with_issue(c, "issue", "words", "status", "html", "markdown", "title").select(F.col("id").alias("page_id"), "issue")


def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "raw_page").where("status is not null")
    return t.select("page_id", Q.retry_outcome("status", Q.header("headers", "Retry-After")).alias("outcome"), F.coalesce(Q.header("headers", "content-type"), F.lit("")).alias("content_type"))


def clean_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the whole cleaning composite."""
    c = clean_pages(table(spark, sf_dir, "raw_page"))
    return c.select("page_id", "title", "word_count", "quality", F.md5("markdown").alias("markdown_md5"))


def ssrf_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Egress verdicts of all page URLs and of known traps."""
    traps = ("http://127.0.0.1/", "http://10.0.0.8/x", "http://169.254.169.254/meta", "http://[::1]/", "http://localhost:8080/", "ftp://ex.test/", "file:///etc/hosts", "http://8.8.8.8/", "https://a.localhost/", "javascript:alert(1)")
    urls = table(spark, sf_dir, "raw_page").select("url").distinct().union(spark.createDataFrame([(t,) for t in traps], "url string"))
    return ssrf_verdicts(urls)


def footer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of items that belong below a rendered page: no pagination, no comment targets."""
    t = spread(table(spark, sf_dir, "batch_item").select("item_id", "markdown").where("markdown is not null"))
    return t.select("item_id", F.size(X.footer_links("markdown")).alias("links"), F.size(X.images("markdown")).alias("images"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every page as a corpus row with canonical URL, title, main content and quality; one scan, one parse, no shuffle."""
    c = P.page_content(table(spark, sf_dir, "raw_page").withColumn("u", F.coalesce("final_url", "url")), ["status", "html", "u"])
    c = Q.with_issue(c, "quality", "word_count", "status", "html", "markdown", "title")
    return c.select(F.col("id").alias("page_id"), U.canonical_url("u").alias("url"), "title", F.lit(0).alias("depth"), "markdown", "word_count", "quality")


QUERIES = {f.__name__: f for f in (url_canonicalize, url_parts, url_dedup, crawl_scope_filter, homepage_warmup, page_title, page_links, link_host_counts, page_script_facts, brand_surface, fallback_markdown, main_markdown, hidden_stripped, dom_scope, strip_tags_words, word_count_items, plain_text_items, llm_body_items, llm_header_items, cap_tokens_docs, cap_words_docs, truncate_sentences_docs, content_hash_docs, markdown_links, challenge_pages, quality_classify, retry_outcome, clean_composite, ssrf_url_check, footer_links, corpus)}

_LINKRE = '\\[([^\\]]*)\\]\\(([^)\\s]+)(?:\\s+"[^"]*")?\\)'
_PAGELINKS = "(SELECT page_id, u, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE " + f"lower({_part('u', 1)}) || '://' || {_HOSTPORT('u')}" + " || href END AS url FROM (SELECT page_id, u, trim(h) AS href FROM (SELECT page_id, url AS u, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>', '', 'g'), '<a [^>]*?href=\"([^\"]*)\"', 1)) AS h FROM raw_page WHERE html IS NOT NULL)))"

SQL = {
    "url_canonicalize": _canon("frontier") + "SELECT seq, canonical, sha256(canonical) AS hash, sha256(canonical) = url_hash AS same FROM canon",
    "url_parts": f"""SELECT item_id, {_HOST('url')} AS hostname, CASE WHEN url IS NULL THEN 'invalid' WHEN {_HOSTPORT('url')} = '' THEN 'file' ELSE {_HOSTPORT('url')} END AS domain,
        CAST(len(list_filter(string_split({_part('url', 3)}, '/'), lambda x: x <> '')) AS INTEGER) AS n_segments, coalesce(list_filter(string_split({_part('url', 3)}, '/'), lambda x: x <> '')[-1], '') AS last_segment,
        CASE WHEN {_part('url', 1)} <> '' AND {_HOSTPORT('url')} <> '' THEN lower({_part('url', 1)}) || '://' || {_HOSTPORT('url')} || '/' ELSE '' END AS homepage FROM batch_item""",
    "url_dedup": _canon("frontier") + "SELECT run_id, count(DISTINCT canonical) AS urls, count(*) AS reports FROM canon GROUP BY run_id",
    "crawl_scope_filter": _canon("frontier") + f"""SELECT seq, canonical AS url FROM canon WHERE {_HOST('canonical')} = 'paperlantern.example' AND regexp_matches({_part('canonical', 3)}, '^/blog/.*$|^/guide/[^/]*$|^/news/[^/]*$') AND NOT regexp_matches({_part('canonical', 3)}, '^/.*/[^/]*zel[^/]*$')""",
    "homepage_warmup": f"SELECT homepage, count(*) AS pages FROM (SELECT lower({_part('url', 1)}) || '://' || {_HOSTPORT('url')} || '/' AS homepage FROM raw_page WHERE status IN (401, 403, 429, 503)) GROUP BY homepage",
    "page_links": _canon(_PAGELINKS) + "SELECT DISTINCT page_id, canonical AS url FROM canon WHERE canonical IS NOT NULL",
    "link_host_counts": _canon(_PAGELINKS) + f"SELECT {_HOST('canonical')} AS host, count(*) AS links FROM canon WHERE canonical IS NOT NULL GROUP BY 1",
    "markdown_links": r"""WITH m AS (SELECT item_id, regexp_extract_all(markdown, '(!?\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\))', 1) AS l FROM batch_item WHERE markdown IS NOT NULL),
        e AS (SELECT item_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM m), p AS (SELECT item_id, i, regexp_extract(x, '\[([^\]]*)\]', 1) AS t, regexp_extract(x, '\]\(([^)\s]+)', 1) AS u FROM e WHERE NOT starts_with(x, '!')),
        f AS (SELECT item_id, u, min(i) AS i, arg_min(t, i) AS t FROM p WHERE u <> '' AND NOT starts_with(u, '#') GROUP BY item_id, u)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS pos, CASE WHEN trim(t) = '' THEN u ELSE t END AS text, u AS url FROM f""",
    "strip_tags_words": f"SELECT page_id, CAST(len(list_filter(string_split_regex(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]+>', ' ', 'g'), '[{_SP}]+'), lambda w: w <> '')) AS INTEGER) AS words FROM raw_page WHERE html IS NOT NULL",
    "word_count_items": f"SELECT item_id, {_wc('markdown')} AS words, CAST(strlen(markdown) // 4 AS BIGINT) AS tokens FROM batch_item WHERE markdown IS NOT NULL",
    "llm_header_items": """WITH t AS (SELECT item_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS t, trim(coalesce(url, '')) AS u, coalesce(strftime(fetched_at, '%Y-%m-%d'), '') AS d FROM batch_item)
        SELECT item_id, CASE WHEN t || u || d = '' THEN '' ELSE concat_ws(chr(10), '# ' || CASE WHEN t = '' THEN 'Untitled' ELSE t END, CASE WHEN u <> '' THEN '> Source: ' || u END, CASE WHEN d <> '' THEN '> ' || d END) END AS header FROM t""",
    "cap_words_docs": f"SELECT doc_id, CASE WHEN len(w) <= 40 THEN text ELSE array_to_string(w[1:40], ' ') END AS head FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '[{_SP}]+'), lambda x: x <> '') AS w FROM documents)",
    "truncate_sentences_docs": f"SELECT doc_id, regexp_replace(CASE WHEN regexp_extract(text, '^((?:[^.!?]*[.!?]){{2}})', 1) <> '' THEN regexp_extract(text, '^((?:[^.!?]*[.!?]){{2}})', 1) ELSE text END, '^[{_SP}]+|[{_SP}]+$', '', 'g') AS head FROM documents",
    "ssrf_url_check": "SELECT url, true AS allowed FROM (SELECT DISTINCT url FROM raw_page) UNION ALL SELECT url, url = 'http://8.8.8.8/' FROM (VALUES ('http://127.0.0.1/'), ('http://10.0.0.8/x'), ('http://169.254.169.254/meta'), ('http://[::1]/'), ('http://localhost:8080/'), ('ftp://ex.test/'), ('file:///etc/hosts'), ('http://8.8.8.8/'), ('https://a.localhost/'), ('javascript:alert(1)')) t(url)",
    "content_hash_docs": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "retry_outcome": """SELECT page_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (400, 401, 403, 404, 410) THEN 'permanent'
        WHEN status IN (429, 503) AND coalesce(regexp_full_match(list_filter(map_entries(headers), lambda e: lower(e.key) = 'retry-after')[1].value[1], '\\d+'), false) THEN 'retry-after' ELSE 'retry' END AS outcome,
        coalesce(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value[1], '') AS content_type FROM raw_page WHERE status IS NOT NULL""",
    "brand_surface": """WITH c AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1), lambda x: x), chr(10)) AS css FROM raw_page WHERE html IS NOT NULL AND html <> '')
        SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(css, '#[0-9a-fA-F]{3,8}\\b'), lambda x: lower(x)))), ','), '') AS colors,
        coalesce(array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(css, '(?i)font-family\\s*:\\s*([^;{}]+)', 1), lambda x: string_split(x, ','))), lambda y: trim(trim(y), '"''')))), ','), '') AS fonts FROM c""",
    "cap_tokens_docs": "WITH d AS (SELECT doc_id, text, CASE WHEN strlen(text) // 4 > 100 THEN text[1:list_max(list_filter(range(1, 401), lambda i: strlen(text[1:i]) <= 400))] END AS head FROM documents), h AS (SELECT doc_id, CASE WHEN head IS NULL THEN text WHEN strlen(regexp_extract(head, '(?s)^(.*)\n', 1)) > 200 THEN regexp_extract(head, '(?s)^(.*)\n', 1) ELSE head END AS t FROM d) SELECT doc_id, strlen(t) AS bytes, md5(t) AS text_md5 FROM h",
    "plain_text_items": "SELECT item_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT item_id, " + _plain("markdown") + " AS t FROM batch_item WHERE markdown IS NOT NULL)",
    "footer_links": r"""WITH m AS (SELECT item_id, regexp_extract_all(markdown, '(!?\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\))', 1) AS l FROM batch_item WHERE markdown IS NOT NULL),
        e AS (SELECT item_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM m), p AS (SELECT item_id, i, starts_with(x, '!') AS image, regexp_extract(x, '\[([^\]]*)\]', 1) AS t, regexp_extract(x, '\]\(([^)\s]+)', 1) AS u FROM e),
        f AS (SELECT item_id, image, u, arg_min(t, i) AS t FROM p WHERE image OR NOT starts_with(u, '#') GROUP BY ALL), c AS (SELECT item_id, count(*) FILTER (NOT image AND NOT regexp_matches(u, '(?i)(/page/\d+|#comments|#reply|reply-to|comment-\d+)') AND NOT contains(lower(CASE WHEN trim(t) = '' THEN u ELSE t END), 'reply')) AS links, count(*) FILTER (image) AS images FROM f GROUP BY item_id)
        SELECT item_id, CAST(coalesce(links, 0) AS INTEGER) AS links, CAST(coalesce(images, 0) AS INTEGER) AS images FROM m LEFT JOIN c USING (item_id)""",
    "challenge_pages": f"""WITH r AS (SELECT page_id, html, lower(html) AS low, coalesce(status, 0) AS status, headers, strlen(html) < 15360 AS small, {_wc('html')} < 200 AS thin FROM raw_page WHERE html IS NOT NULL), m AS (SELECT *, ({" OR ".join(f"contains(low, '{m}')" for m in X.CHALLENGE_MARKERS)}) AS marker FROM r)
        SELECT page_id, marker, CASE WHEN len(list_filter(map_entries(headers), lambda e: lower(e.key) = 'cf-mitigated')) > 0 THEN 'cloudflare' WHEN html = '' OR NOT small OR NOT thin THEN '' {" ".join("WHEN " + " AND ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{v}'" for ws, v in Q.SIGNATURES)} ELSE '' END AS vendor, thin AND small AND (status IN (401, 403, 429, 503) OR marker) AS challenge FROM m""",
    "page_title": f"SELECT page_id, {_unescaped("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g')")} AS title, coalesce(regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1), '') AS lang FROM raw_page WHERE html <> ''",
}
