"""Main content of a page tree as Markdown, and a plain fallback for pages without any."""

from __future__ import annotations

import re

from .dom import Node, select

_DROP = frozenset("script style noscript template nav aside footer form iframe svg button head".split())
_ROLE = re.compile(r"(?i)(?:[a-z0-9]+[-_]+)*(?:nav|navbar|menu|footer|sidebar|cookies?|consent|share|sharing|social|breadcrumbs?|related|promo|advert|ads?|comments?|byline|newsletter)(?:[-_]+(?!less|free|off|none|no\b)[a-z0-9]+)*")
_INNER = frozenset("a abbr b br cite code em i img q small span strong sub sup time mark u s label button option script style title".split())
_WS = re.compile(r"\s+")


def _dropped(n: Node) -> bool:
    if n.tag in _DROP or n.attrs.get("role") in ("navigation", "banner", "contentinfo"):
        return True
    names = (n.attrs.get("class", "") + " " + n.attrs.get("id", "")).split()
    return (n.tag == "header" or any(map(_ROLE.fullmatch, names))) and not select(n, "h1")


def _text_size(n: Node, links: bool = False) -> int:
    todo, size = [(n, False)], 0
    while todo:
        x, linked = todo.pop()
        if x.tag == "#text":
            if not links or linked:
                size += len(_WS.sub(" ", x.text).strip())
        elif x.tag not in ("script", "style"):
            todo += [(c, linked or x.tag == "a") for c in x.children]
    return size


def main_node(root: Node) -> Node | None:
    """The article or main element, else the element whose own paragraphs hold most text that is not linked."""
    for selector in ("article", "main", "[role=main]"):
        found = select(root, selector)
        if found:
            best = max(found, key=_text_size)
            if _text_size(best) >= 80:
                return best
    scores: dict[int, tuple[float, Node]] = {}
    for p in root.elements():
        # what holds text of its own speaks for the element around it
        if p.tag in _INNER or not any(c.tag == "#text" and c.text.strip() for c in p.children) or any(_dropped(a) for a in _line(p)):
            continue
        worth = _text_size(p) - 2 * _text_size(p, links=True)
        up = p.parent
        if worth < 25 or up is None:
            continue
        while up.parent is not None and up.tag in ("ul", "ol", "tr", "tbody", "table", "blockquote"):
            up = up.parent
        scores[id(up)] = (scores.get(id(up), (0, up))[0] + worth, up)
    return max(scores.values(), key=lambda s: s[0])[1] if scores else None


def _line(n: Node) -> list[Node]:
    out = []
    while n is not None and n.tag != "#document":
        out.append(n)
        n = n.parent
    return out


def _inline(n: Node) -> str:
    out = []
    for c in n.children:
        if c.tag == "#text":
            out.append(_WS.sub(" ", c.text))
        elif c.tag == "br":
            out.append("\n")
        elif c.tag.startswith("#") or _dropped(c):
            continue
        elif c.tag in ("b", "strong") and _inline(c).strip():
            out.append(f"**{_inline(c).strip()}**")
        elif c.tag in ("i", "em") and _inline(c).strip():
            out.append(f"*{_inline(c).strip()}*")
        elif c.tag in ("code", "tt") and c.content().strip():
            out.append(f"`{c.content().strip()}`")
        elif c.tag == "a":
            t, href = _inline(c).strip(), c.attrs.get("href", "")
            out.append(f"[{t}]({href})" if t and href else t)
        elif c.tag == "img":
            if c.attrs.get("src"):
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
        else:
            out.append(_inline(c))
    return "".join(out)


def _table(n: Node) -> str:
    rows = []
    for tr in select(n, "tr"):
        cells = []
        for c in tr.children:
            if c.tag in ("td", "th"):
                cells.append(_WS.sub(" ", _inline(c)).strip().replace("|", "\\|"))
                cells += [""] * (min(int(c.attrs.get("colspan", "1") or 1), 50) - 1 if c.attrs.get("colspan", "1").isdigit() else 0)
        if cells:
            rows.append(cells)
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    size = [max(3, *(len(r[k]) for r in rows)) for k in range(width)]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, size)) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join("-" * (w + 2) for w in size) + "|", *map(line, rows[1:])])


_BLOCKS = frozenset("p div section article main ul ol li table pre blockquote h1 h2 h3 h4 h5 h6 dl dt dd figure figcaption details summary center header body html address fieldset".split())


def to_markdown(n: Node) -> str:
    out: list[str] = []
    loose: list[Node] = []

    def flush() -> None:
        if loose:
            box = Node("span")
            box.children = list(loose)
            t = "\n".join(x.strip() for x in _inline(box).split("\n")).strip()
            if t:
                out.append(t)
            loose.clear()

    for c in n.children:
        if c.tag.startswith("#") and c.tag != "#text" or c.tag != "#text" and _dropped(c):
            continue
        if c.tag not in _BLOCKS and c.tag != "hr" and not any(d.tag in _BLOCKS for d in c.elements() if d is not c):
            loose.append(c)
            continue
        flush()
        if c.tag[0] == "h" and c.tag[1:].isdigit():
            t = _WS.sub(" ", _inline(c)).strip()
            if t:
                out.append("#" * int(c.tag[1]) + " " + t)
        elif c.tag in ("ul", "ol"):
            items = []
            for k, li in enumerate([x for x in c.children if x.tag == "li"], 1):
                body = to_markdown(li).replace("\n", "\n  ")
                if body:
                    items.append((f"{k}. " if c.tag == "ol" else "- ") + body)
            if items:
                out.append("\n".join(items))
        elif c.tag == "table":
            t = _table(c)
            if t:
                out.append(t)
        elif c.tag == "pre":
            body = c.content().strip("\n")
            if body.strip():
                out.append("```\n" + body + "\n```")
        elif c.tag == "blockquote":
            body = to_markdown(c)
            if body:
                out.append("\n".join("> " + x if x else ">" for x in body.split("\n")))
        elif c.tag == "hr":
            out.append("---")
        else:
            t = to_markdown(c)
            if t:
                out.append(t)
    flush()
    return "\n\n".join(out)


def fallback(root: Node) -> str:
    """Headings, paragraphs, list items and link texts in document order, then the rows of all tables."""
    marks = {"h1": "# {}\n\n", "h2": "## {}\n\n", "h3": "### {}\n\n", "li": "- {}\n"}
    out = []
    for n in select(root, "h1, h2, h3, p, li, a"):
        t = n.content().strip()
        if t:
            out.append(marks.get(n.tag, "{}\n\n").format(t))
    for table in select(root, "table"):
        for tr in select(table, "tr"):
            cells = [c.content().strip() for c in select(tr, "th, td")]
            if cells:
                out.append("| " + " | ".join(cells) + " |\n")
        out.append("\n")
    return "".join(out).strip()


def page_markdown(root: Node) -> tuple[str, bool]:
    """(Markdown of the main content, whether the fallback had to serve)."""
    main = main_node(root)
    md = to_markdown(main) if main is not None else ""
    return (md, False) if md.strip() else (fallback(root), True)
