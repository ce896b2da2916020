"""The cleaning composite: scope, hidden text, embedded data, title, main content, cap, rescue of thin pages, quality.

The tree part is one pass in Arrow batches; metadata, word counts and the quality rules are
columns on top of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonops
from ..functions import quality as Q
from ..functions import text as X
from ..functions.dom import parse, select
from ..functions.markdown import page_markdown
from ..functions.urls import pdf_title
from .facts import _per_page, is_hidden, page_facts, scoped, sidecar

#: Tokens (of four bytes) of a page's Markdown, words of a thin page, bytes of rescued text, words below which a fallback is empty.
MAX_TOKENS, THIN, ISLAND, FALLBACK_WORDS = 8000, 200, 4000, 50
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")
_NOISE = re.compile(r"[#*_`>~\-|\[\]()!]+")


def count_words(md: str) -> int:
    """X.word_count of one text."""
    bare = X._RE["link"].sub(r"\1", X._RE["image"].sub("", md))
    return sum(len(_NOISE.sub(" ", x).split()) for line in bare.split("\n") if not (x := line.strip()).startswith("```"))


def capped(md: str, tokens: int) -> str:
    """X.cap_tokens of one text."""
    raw = md.encode()
    if len(raw) // 4 <= tokens:
        return md
    head = raw[: 4 * tokens]
    at = head.rfind(b"\n")
    return head[:at].decode("utf-8", "ignore") if at > 2 * tokens else head.decode("utf-8", "ignore")


def player_details(page: str) -> dict | None:
    """Title, author and description of an embedded video player's data."""
    at = page.find("ytInitialPlayerResponse")
    if at < 0:
        return None
    for obj in jsonops.balanced_objects(page[at:]):
        try:
            d = jsonops.strict(obj).get("videoDetails")
        except (ValueError, AttributeError):
            return None
        if isinstance(d, dict) and str(d.get("title") or "").strip():
            return {"title": d["title"], "author": d.get("author") or "", "description": d.get("shortDescription") or ""}
        return None
    return None


def cleaned_page(page: str, include: list[str], exclude: list[str], max_tokens: int, video: bool) -> tuple[str, str, str | None, bool]:
    """(html as cleaned, markdown, embedded data, whether the fallback served)."""
    body = scoped(page, include, exclude) if include or exclude else page
    root = parse(body)
    gone = [n for n in root.walk() if n.tag == "#comment" or not n.tag.startswith("#") and is_hidden(n)]
    for n in gone:
        n.remove()
    if gone:
        body = root.outer()
    side = sidecar(parse(page), page)
    md, fell = page_markdown(root)
    md = capped(md, max_tokens)
    if not include and not exclude and count_words(md) < THIN:
        extra = jsonops.leaf_texts(jsonops.strict(side), cap=ISLAND) if side else ""
        if extra and count_words(md + "\n" + extra) > count_words(md):
            md = (md + "\n\n" + extra).strip()
        d = player_details(page) if video else None
        if d:
            md = f"# {d['title']}\n{d['author']}\n\n{d['description']}\n\n{md}".strip()
    return body, md, side, fell


def pdf_markdown(pages: list[str]) -> str:
    """Markdown of the page texts that a PDF parser gave: a heading for every page with text."""
    return "\n\n".join(f"## Page {k}\n\n{t.strip()}" for k, t in enumerate(pages, 1) if t.strip())


def clean_pages(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_tokens: int = MAX_TOKENS, pdf_text: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(page_id, url, title, markdown, sidecar, html, description, author, date, lang, site_name, image, favicon, word_count, quality).

    pages: page_id, url, final_url, status, content_type, html. PDFs are told by their first
    bytes or content type and never parsed as HTML; their text comes from ``pdf_text``.
    """
    inc, exc = include or [], exclude or []
    p = pages.where("html is not null").withColumn("u", F.coalesce("final_url", "url"))
    pdf = Q.is_pdf("html", "content_type")
    web, docs = p.where(~pdf), p.where(pdf)

    def row(i: int, u: str, page: str) -> tuple:
        host = re.sub(r"^[a-z]+://([^/:]*).*$", r"\1", u.lower())
        return (i, *cleaned_page(page, inc, exc, max_tokens, host in VIDEO_HOSTS))

    c = _per_page(web, "page_id", "u", "html", {"id": pa.int64(), "clean_html": pa.string(), "markdown": pa.string(), "sidecar": pa.string(), "fell_back": pa.bool_()}, row)
    f = page_facts(web, "page_id", "u").select("id", "title", "description", "author", "date", "lang", "site_name", "image", "favicon")
    j = web.select(F.col("page_id").alias("id"), "u", "status").join(c, "id").join(f, "id")
    j = Q.with_issue(j, "issue", "word_count", "status", "clean_html", "markdown", "title")
    issue = F.when((F.col("issue") == "") & F.col("fell_back") & (F.col("word_count") < FALLBACK_WORDS), "empty").otherwise(F.col("issue"))
    meta = ("description", "author", "date", "lang", "site_name", "image", "favicon")
    out = j.select(F.col("id").alias("page_id"), F.col("u").alias("url"), F.coalesce("title", F.lit("")).alias("title"), "markdown", "sidecar", F.col("clean_html").alias("html"), *meta, "word_count", issue.alias("quality"))

    def read(i: int, u: str, page: str) -> tuple:
        return i, capped(pdf_markdown(pdf_text(page)), max_tokens) if pdf_text else ""

    d = _per_page(docs, "page_id", "u", "html", {"id": pa.int64(), "markdown": pa.string()}, read)
    k = docs.select(F.col("page_id").alias("id"), "u", "status").join(d, "id")
    title = pdf_title("u")
    return out.unionByName(k.select(F.col("id").alias("page_id"), F.col("u").alias("url"), title.alias("title"), "markdown", F.lit(None).cast("string").alias("sidecar"), F.lit("").alias("html"), *(F.lit(None).cast("string").alias(m) for m in meta), X.word_count("markdown").alias("word_count"), Q.classify("status", F.lit(""), "markdown", title, F.lit(True)).alias("quality")))


def trimmed_for_proposals(page: str, needles: list[str], cap: int = 32_000) -> str:
    """The parts of a page that hold the needles, with up to four ancestors, without scripts; at most ``cap`` bytes."""
    root = parse(page)
    for n in select(root, "script, style, noscript"):
        n.remove()
    kept, seen = [], set()
    for n in root.elements():
        if n.children and all(c.tag.startswith("#") for c in n.children) and any(x and x in n.content() for x in needles):
            for _ in range(4):
                if n.parent is None or n.parent.tag.startswith("#"):
                    break
                n = n.parent
            if id(n) not in seen:
                seen.add(id(n))
                kept.append(n.outer())
    return "\n".join(kept).encode()[:cap].decode("utf-8", "ignore")


