"""Ordered rule classification of pages as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import has_challenge_marker, strip_tags, trimmed, word_count
from .urls import _col

# Thresholds and markers of the rules.
THIN_WORDS = 200
CHALLENGE_BYTES = 15 * 1024
SIGNATURES = (
    (("_cf_chl_opt",), "cloudflare"),
    (("challenge-platform/h/b/orchestrate/",), "cloudflare"),
    (("/h/g/orchestrate/",), "cloudflare"),
    (("challenges.cloudflare.com/turnstile",), "turnstile"),
    (("datadome", "captcha"), "datadome"),
    (("datadome", "geo"), "datadome"),
    (("awswaf",), "awswaf"),
    (("h-captcha", "verify"), "hcaptcha"),
    (("h-captcha", "blocked"), "hcaptcha"),
)
MOUNTS = ('id="root"', 'id="app"', "data-reactroot", "__react_devtools_global_hook__", "data-v-", "__vue__", "<app-root", "ng-version", 'id="__next"', 'id="__nuxt"', 'id="svelte"', "__sveltekit_")


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def body_is_richer(body_words: Column, md_words: Column) -> Column:
    return (md_words < THIN_WORDS) & ((body_words - md_words > 50) | ((md_words < 20) & (body_words > 2 * md_words)))


def _rules(status: Column, pdf: Column, words: Column, body_words: Column, low: Column) -> Column:
    thin, marker = words < THIN_WORDS, has_challenge_marker(low)
    hard = _any(low, ("<title>just a moment", "checking your browser", "enable javascript and cookies"))
    return (
        F.when(status.isin(401, 407) & _any(low, ("sign in", "log in", "login required", "log in to continue")), "login-required")
        .when((status == 401) & thin & _any(low, ("unauthorized", "login", "sign in")), "login-required")
        .when((status == 403) & thin & (marker | low.contains("blocked")), "access-denied")
        .when((status == 429) | status.between(500, 599), "unavailable")
        .when(pdf & (words == 0), "empty")
        .when(thin & body_is_richer(body_words, words), "empty")
        .when(thin & marker & hard, "access-denied")
        .when(thin & marker & (words < 30), "empty")
        .when((status == 404) & thin, "empty")
        .otherwise("")
    )


def _inputs(status: Column | str, body: Column | str, md: Column | str, title: Column | str, pdf: Column) -> tuple[Column, Column, Column, Column]:
    md, title = F.coalesce(_col(md), F.lit("")), F.coalesce(_col(title), F.lit(""))
    body = F.when(pdf, "").otherwise(F.coalesce(_col(body), F.lit("")))
    return F.coalesce(_col(status), F.lit(0)), word_count(md), word_count(strip_tags(body)), F.lower(F.concat_ws("\n", body, md, title))


def classify(status: Column | str, body: Column | str, md: Column | str, title: Column | str, is_pdf: Column | None = None) -> Column:
    """'login-required', 'access-denied', 'unavailable', 'empty' or ''; the first rule that holds decides.

    One expression; over whole tables use with_issue, which makes the counts once.
    """
    pdf = F.lit(False) if is_pdf is None else is_pdf
    status, words, body_words, low = _inputs(status, body, md, title, pdf)
    return _rules(status, pdf, words, body_words, low)


def with_issue(df: DataFrame, out: str, words_out: str, status: Column | str, body: Column | str, md: Column | str, title: Column | str, is_pdf: Column | None = None) -> DataFrame:
    """df with the issue and the word count; counts and the lower-case text are columns of their own, so that the rules share them."""
    pdf = F.lit(False) if is_pdf is None else is_pdf
    status, words, body_words, low = _inputs(status, body, md, title, pdf)
    staged = df.withColumns({words_out: words, "_body_words": body_words, "_low": low})
    return staged.withColumn(out, _rules(status, pdf, F.col(words_out), F.col("_body_words"), F.col("_low"))).drop("_body_words", "_low")


def header(headers: Column | str, name: str) -> Column:
    """First value of a header, names compared without case; null if absent."""
    h = _col(headers)
    found = F.filter(F.map_entries(h), lambda e: F.lower(e.key) == name.lower())
    return F.when(F.size(found) > 0, F.get(found[0].value, F.lit(0)))


def challenge_vendor(html: Column | str, headers: Column | str | None = None) -> Column:
    """Vendor of a bot challenge, null if the page is none."""
    body = F.coalesce(_col(html), F.lit(""))
    low = F.lower(body)
    small = (body != "") & (F.octet_length(body) < CHALLENGE_BYTES) & (word_count(body) < THIN_WORDS)
    out = F.when(header(headers, "cf-mitigated").isNotNull(), "cloudflare") if headers is not None else F.when(F.lit(False), "")
    for words, vendor in SIGNATURES:
        ok = small
        for w in words:
            ok = ok & low.contains(w)
        out = out.when(ok, vendor)
    return out


def is_challenge_page(status: Column | str, html: Column | str) -> Column:
    body = F.coalesce(_col(html), F.lit(""))
    small = F.octet_length(body) < CHALLENGE_BYTES
    return (word_count(body) < THIN_WORDS) & ((_col(status).isin(401, 403, 429, 503) & small) | (small & has_challenge_marker(body)))


def has_embedded_data(html: Column | str) -> Column:
    return _any(_col(html), ('id="__NEXT_DATA__"', "window.__NUXT__", 'id="__NUXT__"'))


def js_score(html: Column | str, visible: Column, script_bytes: Column, links: Column) -> Column:
    """How strongly a page seems to need scripts: the sum of seven rules over its facts."""
    body = _col(html)
    low = F.lower(body)
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    scripts = (F.length(low) - F.length(F.replace(low, F.lit("<script"), F.lit("")))) / len("<script")
    return (
        one(visible < 200, 2)
        + one(script_bytes / F.greatest(visible, F.lit(1)) > 3.0)
        + one(_any(low, MOUNTS) & (visible < 500), 2)
        + one(_any(low, ("enable javascript", "requires javascript")))
        + one(links < 3)
        + one((F.octet_length(body) < 5 * 1024) & (scripts >= 10))
        + one(low.contains('name="fragment"'))
    )


def needs_browser(score: Column, embedded: Column) -> Column:
    return (score >= 2) & ~embedded


def is_pdf(head: Column | str, content_type: Column | str) -> Column:
    return F.coalesce(_col(head).startswith("%PDF-"), F.lit(False)) | F.coalesce(F.lower(trimmed(content_type)).startswith("application/pdf"), F.lit(False))


def retry_outcome(status: Column | str, retry_after: Column | str | None = None) -> Column:
    """'ok', 'permanent', 'retry' or 'retry-after'."""
    s = _col(status)
    wait = F.lit(False) if retry_after is None else F.coalesce(_col(retry_after).rlike(r"^\d+\z"), F.lit(False))
    return F.when(s.between(200, 299), "ok").when(s.isin(400, 401, 403, 404, 410), "permanent").when(s.isin(429, 503) & wait, "retry-after").otherwise("retry")


def exit_code(error: Column | str) -> Column:
    """Status code of a typed error name."""
    names = {"": 0, "runtime": 1, "usage": 2, "all-failed": 3, "partial": 4, "robots-blocked": 5, "cost": 6, "credentials": 7, "quality": 8}
    out = F.lit(1)
    for k, v in names.items():
        out = F.when(_col(error) == k, v).otherwise(out)
    return out
