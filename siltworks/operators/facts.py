"""Page facts: each page is parsed once, inside an Arrow batch; everything else is a projection.

Defined results: pages without HTML give no row; absent facts are null or empty, never an
error; other columns of the input are not carried (join on the id, which is unique).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonops
from ..functions.dom import Node, parse, select
from ..functions.markdown import fallback, page_markdown
from ..session import spread

FACTS = {
    "id": pa.int64(), "title": pa.string(), "lang": pa.string(), "description": pa.string(), "author": pa.string(), "date": pa.string(), "site_name": pa.string(), "image": pa.string(), "favicon": pa.string(), "canonical": pa.string(), "h1": pa.string(),
    "sidecar": pa.string(), "hrefs": pa.list_(pa.string()), "link_count": pa.int32(), "visible_chars": pa.int32(), "script_bytes": pa.int32(), "colors": pa.list_(pa.string()), "fonts": pa.list_(pa.string()), "logo": pa.string(), "hidden": pa.int32(), "social": pa.string(),
}
_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.bool_(): "boolean"}
# Styles that hide text; a size or opacity that starts with 0 counts for sizes.
HIDDEN_STYLES = tuple(re.compile(p, re.I) for p in (r"display\s*:\s*none", r"visibility\s*:\s*hidden", r"font-size\s*:\s*0", r"opacity\s*:\s*0(?:\.0+)?\s*(;|\Z)"))
_HEX = re.compile(r"#[0-9a-fA-F]{3,8}\b", re.A)
_FONT = re.compile(r"font-family\s*:\s*([^;{}]+)", re.I)
_NUXT = re.compile(r"window\.__NUXT__\s*=\s*(\{.*?\});?\s*</script>")


def ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_DDL[t]}" for k, t in kinds.items())


def resolve(base: str, href: str) -> str:
    """href against base; absolute references and what can't be parsed stay as they are."""
    try:
        return href if urlsplit(href).scheme else urljoin(base, href)
    except ValueError:
        return href


def _meta(root: Node) -> dict[str, str]:
    """First non-blank content of each meta name or property, keys in lower case."""
    out: dict[str, str] = {}
    for m in select(root, "meta"):
        key = (m.attrs.get("property") or m.attrs.get("name") or "").lower()
        value = m.attrs.get("content", "").strip()
        if key and value:
            out.setdefault(key, value)
    return out


def sidecar(root: Node, page: str) -> str | None:
    """Embedded JSON: linked-data scripts in order, then framework state; one block as it stands, several as an array."""
    blocks = [s.content().strip() for s in select(root, 'script[type="application/ld+json"]')]
    blocks += [s.content().strip() for s in select(root, "#__NEXT_DATA__")]
    blocks += _NUXT.findall(page)
    good = [b for b in blocks if jsonops.is_valid(b)]
    if len(good) < 2:
        return good[0] if good else None
    return jsonops.marshalled([jsonops.strict(b) for b in good])


def is_hidden(n: Node) -> bool:
    style = n.attrs.get("style", "")
    return "hidden" in n.attrs or bool(style) and any(p.search(style) for p in HIDDEN_STYLES)


def strip_hidden(page: str) -> tuple[str, int]:
    """(page without hidden elements and comments, how many were removed); the page itself if there are none."""
    root = parse(page)
    gone = [n for n in root.walk() if n.tag == "#comment" or not n.tag.startswith("#") and is_hidden(n)]
    for n in gone:
        n.remove()
    return (root.outer(), len(gone)) if gone else (page, 0)


def scoped(page: str, include: list[str], exclude: list[str]) -> str:
    """The included subtrees (all if none is given or valid) without the excluded ones; at most 100 selectors a list."""
    if len(include) > 100 or len(exclude) > 100:
        raise ValueError("more than 100 selectors")
    root = parse(page)

    def found(selectors: list[str]) -> tuple[list[Node], bool]:
        out, valid = [], False
        for s in selectors:
            try:
                out += select(root, s)
                valid = True
            except ValueError:
                continue
        return out, valid

    kept, valid = found(include)
    if include and not valid and not exclude:
        return page
    cut = found(exclude)[0]
    for n in cut:
        n.remove()
    if include and valid:
        gone = set(map(id, cut))
        return "".join(n.outer() for n in kept if id(n) not in gone)
    return root.outer()


def brand(root: Node) -> tuple[list[str] | None, list[str] | None, str | None]:
    css = "\n".join([s.content() for s in select(root, "style")] + [n.attrs["style"] for n in select(root, "[style]")])
    colors = sorted({c.lower() for c in _HEX.findall(css)})
    fonts = sorted({f for m in _FONT.findall(css) for x in m.split(",") if (f := x.strip().strip("\"'"))})
    logo = next((n.attrs["src"].strip() for n in select(root, 'img[src*="logo" i]')[:1] if n.attrs["src"].strip()), None)
    if logo is None:
        for n in select(root, 'svg[class*="logo" i]')[:1]:
            logo = n.attrs.get("class", "").strip() or (f"#{n.attrs['id'].strip()}" if n.attrs.get("id", "").strip() else None)
    return colors or None, fonts or None, logo


def page_facts_row(i: int, url: str, page: str, root: Node | None = None) -> tuple:
    root = parse(page) if root is None else root
    meta = _meta(root)
    side = sidecar(root, page)
    titles = select(root, "title")
    html_nodes = select(root, "html")
    date = meta.get("article:published_time") or next((n.attrs["datetime"].strip() for n in select(root, "time[datetime]") if n.attrs["datetime"].strip()), None)
    icon = next((n.attrs["href"] for n in select(root, "link[href]") if "icon" in n.attrs.get("rel", "").lower().split()), None)
    writer = meta.get("author") or (jsonops.author(jsonops.strict(side)) if side else "") or None
    visible = script = links = hidden = 0
    hrefs = []
    for n in root.walk():
        if n.tag == "#text":
            if n.parent is not None and n.parent.tag not in ("script", "style"):
                visible += len(n.text.strip())
            elif n.parent is not None and n.parent.tag == "script":
                script += len(n.text.encode())
        elif n.tag == "#comment":
            hidden += 1
        elif n.tag != "#document":
            if n.tag == "script":
                script += len(n.attrs.get("src", "").encode())
            if n.tag == "a" and "href" in n.attrs:
                h = n.attrs["href"]
                if h and not h.startswith("#"):
                    links += 1
                if h.strip():
                    hrefs.append(resolve(url, h.strip()))
            if is_hidden(n):
                hidden += 1
    colors, fonts, logo = brand(root)
    canonical = next((n.attrs["href"] for n in select(root, "link[href]") if n.attrs.get("rel", "").lower() == "canonical"), None)
    h1 = next((n.content().strip() for n in select(root, "h1") if n.content().strip()), None)
    social = {k.replace(":", "_"): v for k, v in meta.items() if k in ("og:title", "og:description", "og:image", "og:url", "og:type", "twitter:card", "twitter:title", "twitter:description", "twitter:image")}
    return (
        i, titles[0].content().strip() if titles else None, html_nodes[0].attrs.get("lang") if html_nodes else None, meta.get("description") or meta.get("og:description"), writer, date, meta.get("og:site_name"), meta.get("og:image"), resolve(url, icon) if icon else None, canonical, h1,
        side, hrefs, links, visible, script, colors, fonts, logo or meta.get("og:image"), hidden, jsonops.marshalled(social) if social else None,
    )


def _per_page(df: DataFrame, id_col: str, url_col: str, html_col: str, kinds: dict[str, pa.DataType], row, carry: list[str] | None = None) -> DataFrame:
    """row(id, url, page) of every page with HTML; the columns ``carry`` stay beside it, so that nothing has to be joined back."""
    carry = carry or []
    wanted = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.col(html_col).cast("string").alias("html"), *(F.col(c).alias(f"c_{c}") for c in carry)).where("id is not null and html is not null and html <> ''")
    extra = "".join(f", `c_{f.name}` {f.dataType.simpleString()}" for f in df.select(*carry).schema.fields) if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = [row(*x) for x in zip(*(c.to_pylist() for c in part.columns[:3]))]
                if rows:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())), *part.columns[3:]], names=[*kinds, *part.schema.names[3:]])

    out = spread(wanted).mapInArrow(run, ddl(kinds) + extra)
    return out.select(*kinds, *(F.col(f"c_{c}").alias(f"page_{c}" if c in kinds else c) for c in carry)) if carry else out


def page_facts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """One row of facts per page with HTML, with the ``carry`` columns beside them; a narrow scan without a shuffle."""
    return _per_page(df, id_col, url_col, html_col, FACTS, page_facts_row, carry)


def page_content(df: DataFrame, carry: list[str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Facts, markdown and fell_back of every page with HTML in one parse, with the page's ``carry`` columns beside them: no join."""

    def row(i: int, url: str, page: str) -> tuple:
        root = parse(page)
        return (*page_facts_row(i, url, page, root), *page_markdown(root))

    return _per_page(df, id_col, url_col, html_col, FACTS | {"markdown": pa.string(), "fell_back": pa.bool_()}, row, carry)


def page_markdowns(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, markdown, fell_back, fallback): main content as Markdown, and the plain fallback rendering."""

    def row(i: int, url: str, page: str) -> tuple:
        root = parse(page)
        md, fell = page_markdown(root)
        return i, md, fell, md if fell else fallback(root)

    return _per_page(df, id_col, url_col, html_col, {"id": pa.int64(), "markdown": pa.string(), "fell_back": pa.bool_(), "fallback": pa.string()}, row)


def hidden_stripped(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, html, removed): pages without hidden text."""
    return _per_page(df, id_col, url_col, html_col, {"id": pa.int64(), "html": pa.string(), "removed": pa.int32()}, lambda i, url, page: (i, *strip_hidden(page)))


def dom_scoped(df: DataFrame, include: list[str], exclude: list[str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, html): pages cut to a DOM scope."""
    return _per_page(df, id_col, url_col, html_col, {"id": pa.int64(), "html": pa.string()}, lambda i, url, page: (i, scoped(page, include, exclude)))
