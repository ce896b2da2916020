"""Text transforms of Markdown as Column expressions.

White space follows Unicode, lengths count bytes, and '$' never matches before a final line
break (``\\z`` is used), as the rules of the formats ask.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _col

#: Unicode white space as a regular expression class body.
SPACE = r"\s\x{0B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# The patterns of the Markdown subset that the transforms know.
LINK = r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
BOLD = r"\*\*([^*]+)\*\*"
ITALIC = r"(^|[\s(])\*([^*\n]+)\*([\s).,;:!?]|\z)"
CODE = r"`([^`\n]+)`"
CSS_CLASS_LINE = r"^\s*(\.[a-zA-Z][\w-]*)(\s+\.[a-zA-Z][\w-]*)+\s*\z"
CSS_BLOB_LINE = r"^\s*\{[^}]{20,}\}\s*\z"
PAGINATION = r"(?i)(/page/\d+|#comments|#reply|reply-to|comment-\d+)"
QUOTE_LINE = r"^\s*>\s?"
TABLE_RULE = r"^\s*\|(?:[\s:\-]*\|)+\s*\z"
STAT_NUMBER = r"^\s*[\d.,]+%?\s*\z"
STAT_LABEL = r"^\s*[A-Za-z][\w\s&/-]{1,40}\s*\z"
HEADING = r"(?m)^#{1,6}\s+"
FENCE = r"`{3}[^`]*`{3}"
NOISE = r"[#*_`>~\-|\[\]()!]+"
TAGS = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]+>"
CHALLENGE_MARKERS = ("just a moment", "attention required", "verify you are human", "_abck", "akamai", "cf-chl", "__cf_chl", "datadome", "perimeterx", "captcha", "access denied", "access-denied")


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def fields(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def word_count(md: Column | str) -> Column:
    """Words of Markdown: images and marks don't count, link texts do, fence lines don't."""
    bare = F.regexp_replace(F.regexp_replace(_col(md), IMAGE, ""), LINK, "$1")
    lines = F.filter(F.transform(F.split(bare, "\n"), trimmed), lambda x: ~x.startswith("```"))
    return F.aggregate(lines, F.lit(0), lambda n, line: n + F.size(fields(F.regexp_replace(line, NOISE, " "))))


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.octet_length(_col(c)) / 4)


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), TAGS, " ")


def one_line(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(_col(c), f"[{SPACE}]+", " "))


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def cap_tokens(c: Column | str, tokens: int) -> Column:
    """At most 4 bytes a token, cut at a whole character, and at the last line break if that lies beyond half."""
    t, cut = _col(c), 4 * tokens
    raw = F.substring(t.cast("binary"), 1, cut)
    head = F.decode(_whole_characters(raw), "UTF-8")
    at = F.octet_length(F.regexp_extract(head, r"(?s)^(.*)\n", 1))
    short = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    return F.when(F.floor(F.octet_length(t) / 4) <= tokens, t).when(at > cut / 2, short).otherwise(head)


def _whole_characters(raw: Column) -> Column:
    """Bytes without an incomplete UTF-8 character at their end."""
    h = F.hex(raw)
    tail = F.length(F.regexp_extract(h, r"((?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F]){0,1}|[CD][0-9A-F]))\z", 1)) / 2
    return F.substring(raw, F.lit(1), (F.length(raw) - tail).cast("int"))


def cap_words(c: Column | str, n: int) -> Column:
    w = fields(_col(c))
    return F.when(F.size(w) <= n, _col(c)).otherwise(F.concat_ws(" ", F.slice(w, 1, n)))


def truncate_sentences(c: Column | str, n: int) -> Column:
    """The first n sentences (1 to 20, 3 if n is not positive); all if there are fewer."""
    n = 3 if n <= 0 else min(n, 20)
    head = F.regexp_extract(_col(c), rf"^((?:[^.!?]*[.!?]){{{n}}})", 1)
    return trimmed(F.when(head != "", head).otherwise(_col(c)))


def parse_count(c: Column | str) -> Column:
    """'42 comments' is 42, '12.3k' is 12300; 0 where there is no number."""
    number = F.regexp_extract(_col(c), r"([0-9]+(?:[.,][0-9]+)*)\s*([kKmM]?)", 1)
    unit = F.lower(F.regexp_extract(_col(c), r"([0-9]+(?:[.,][0-9]+)*)\s*([kKmM]?)", 2))
    scaled = F.replace(number, F.lit(","), F.lit("")).try_cast("double") * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)
    return F.coalesce(F.round(scaled).cast("bigint"), F.lit(0))


def css_escape(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9_-]", "")


def has_challenge_marker(c: Column | str) -> Column:
    low = F.lower(_col(c))
    ok = F.lit(False)
    for m in CHALLENGE_MARKERS:
        ok = ok | low.contains(m)
    return ok


def to_text(md: Column | str) -> Column:
    """Markdown to plain text: marks go, link texts stay."""
    c = _col(md)
    for pattern, to in ((IMAGE, ""), (LINK, "$1"), (HEADING, ""), (BOLD, "$1"), (ITALIC, "$1$2$3"), (CODE, "$1"), (r"(?m)^\s*>\s?", ""), (FENCE, ""), ("`", ""), (r"\*", ""), (r"[ \t]+", " "), (r"(?m)^[ \t]+", ""), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return trimmed(c)


def links(md: Column | str) -> Column:
    """Anchors of Markdown in order, each URL once: array of (text, url). Blank texts take the URL; images and fragments are left out."""
    found = F.regexp_extract_all(_col(md), F.lit(r"(!?" + LINK + ")"), 1)
    parts = F.transform(found, lambda x: F.struct(F.regexp_extract(x, LINK, 1).alias("text"), F.regexp_extract(x, LINK, 2).alias("url"), x.startswith("!").alias("image")))
    return _first_by_url(F.filter(parts, lambda x: ~x.image & (x.url != "") & ~x.url.startswith("#")))


def images(md: Column | str) -> Column:
    found = F.regexp_extract_all(_col(md), F.lit(r"(!" + LINK + ")"), 1)
    return _first_by_url(F.transform(found, lambda x: F.struct(F.regexp_extract(x, LINK, 1).alias("text"), F.regexp_extract(x, LINK, 2).alias("url"), F.lit(True).alias("image"))))


def _first_by_url(items: Column) -> Column:
    first = F.filter(items, lambda x, i: F.array_position(F.transform(items, lambda y: y.url), x.url) == i + 1)
    return F.transform(first, lambda x: F.struct(F.when(trimmed(x.text) == "", x.url).otherwise(x.text).alias("text"), x.url.alias("url")))


def footer_links(md: Column | str) -> Column:
    """Links without pagination and comment targets and without reply texts."""
    return F.filter(links(md), lambda x: ~x.url.rlike(PAGINATION) & ~F.lower(x.text).contains("reply"))


def naive_hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(r'href="([^"]*)"'), 1)


_RE = {name: re.compile(pattern.replace(r"\z", r"\Z").replace("(?m)", "").replace("(?i)", ""), re.ASCII | (re.I if "(?i)" in pattern else 0)) for name, pattern in (("link", LINK), ("image", IMAGE), ("bold", BOLD), ("italic", ITALIC), ("code", CODE), ("css_class", CSS_CLASS_LINE), ("css_blob", CSS_BLOB_LINE), ("page", PAGINATION), ("quote", QUOTE_LINE), ("rule", TABLE_RULE), ("number", STAT_NUMBER), ("label", STAT_LABEL))}
_EXEMPT = re.compile(r"\||- |\* |\+ |\d+\. |>")


def table_row(line: str) -> str:
    """A table row with trimmed cells and no empty outer cells."""
    cells = [c.strip() for c in line.split("|")]
    if cells and not cells[0]:
        cells = cells[1:]
    if cells and not cells[-1]:
        cells = cells[:-1]
    return "| " + " | ".join(cells) + " |"


def _slim_line(line: str) -> str | None:
    m = _RE["image"].search(line)
    if m and not m.group(1).strip():
        return None
    y = _RE["link"].sub(r"\1", _RE["image"].sub(r"\1", line))
    y = _RE["code"].sub(r"\1", _RE["italic"].sub(r"\1\2\3", _RE["bold"].sub(r"\1", y)))
    y = _RE["quote"].sub("", y, count=1).strip()
    if y.startswith("|"):
        return None if _RE["rule"].search(y) else table_row(y)
    if y and (_RE["css_class"].search(y) or _RE["css_blob"].search(y) or _RE["page"].search(y)):
        return None
    return y


def _is_logo(x: str) -> bool:
    return bool(x) and len(x.encode()) < 40 and not any(c in x for c in ".!?|:") and not x.startswith(("#", "|", "- ", ">"))


def without_logo_runs(lines: list[str]) -> list[str]:
    """Lines without runs of two or more short bare lines."""
    logo = [False, *map(_is_logo, lines), False]
    return [x for i, x in enumerate(lines, 1) if not (logo[i] and (logo[i - 1] or logo[i + 1]))]


def with_merged_stats(lines: list[str]) -> list[str]:
    """A number line followed by a label line becomes 'label: number'."""
    out: list[str] = []
    for x in lines:
        if out and _RE["number"].search(out[-1]) and _RE["label"].search(x):
            out[-1] = f"{x.strip()}: {out[-1].strip()}"
        else:
            out.append(x)
    return out


def slim_markdown(md: str | None) -> str | None:
    """Markdown slimmed for a model: marks, logo runs, repeated paragraphs and extra blank lines go."""
    if md is None:
        return None
    lines = with_merged_stats(without_logo_runs([y for x in md.split("\n") if (y := _slim_line(x)) is not None]))
    seen: set[str] = set()
    out = []
    for x in lines:
        if x and not _EXEMPT.match(x):
            if x in seen:
                continue
            seen.add(x)
        if x or not out or out[-1]:
            out.append(x)
    return "\n".join(out).strip()


def llm_body(md: Column | str) -> Column:
    """slim_markdown of a column, in Arrow batches: line by line state is dearer in nested array lambdas than in Python."""
    return _slim_udf()(_col(md))


@lru_cache(maxsize=1)
def _slim_udf():
    @F.pandas_udf("string")
    def slim(texts: pd.Series) -> pd.Series:
        return texts.map(slim_markdown, na_action="ignore")

    return slim


def llm_header(title: Column, source: Column, description: Column, author: Column, date: Column) -> Column:
    """Title, source, description and byline; empty if all five are."""
    e = lambda c: one_line(F.coalesce(c, F.lit("")))
    t, s, d, a, w = map(e, (title, source, description, author, date))
    by = F.concat_ws(" · ", F.when(a != "", F.concat(F.lit("By "), a)), F.when(w != "", w))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.when(t == "", "Untitled").otherwise(t)), F.when(s != "", F.concat(F.lit("> Source: "), s)), F.when(d != "", F.concat(F.lit("> "), d)), F.when(by != "", F.concat(F.lit("> "), by)))
    return F.when(F.concat(t, s, d, a, w) == "", "").otherwise(head)
