"""Visible text blocks of an HTML page, in one pass over its tags.

A block is a maximal run of visible text not interrupted by any tag other than the inline
ones; entities are decoded, white space is folded, empty runs are dropped; head, script,
style, noscript and comments are not visible.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

INLINE = frozenset("a abbr b br cite code em i img q small span strong sub sup time".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|head|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_SPACE = re.compile(r"[ \t\r\n\f]+")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: What an unclosed element is closed by.
_CLOSES = {"p": frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 blockquote pre section article aside footer nav main header form".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # enclosing elements, each as tag or tag.class
    linked: int  # characters of its text inside links
    coded: int  # characters of its text inside code
    owners: tuple[int, ...] = ()  # numbers of the enclosing elements in the page


def folded(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip(" \t\r\n\f")


def html_blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[str] = []
    names: list[str] = []
    numbers: list[int] = []
    parts: list[str] = []
    opened = 0
    links = codes = linked = coded = 0

    def close() -> None:
        nonlocal parts, linked, coded
        if parts:
            text = folded("".join(parts))
            if text:
                out.append(Block(text, tuple(names), linked, coded, tuple(numbers)))
        parts, linked, coded = [], 0, 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
            if codes:
                coded += len(piece)
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1) and m.group(1).lower() in ("script", "style", "noscript", "template"):
                close()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if m.group(2) else links + 1
            elif tag == "code":
                codes = max(0, codes - 1) if m.group(2) else codes + 1
            continue
        close()
        if m.group(2):
            if tag in stack:
                while stack:
                    names.pop()
                    numbers.pop()
                    if stack.pop() == tag:
                        break
        elif tag not in _VOID:
            while stack and stack[-1] in _CLOSES and tag in _CLOSES[stack[-1]]:
                stack.pop()
                names.pop()
                numbers.pop()
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m.group(4))}
            name = tag + "".join(f".{v}" for k, v in sorted(found.items()) if v)
            opened += 1
            stack.append(tag)
            names.append(name)
            numbers.append(opened)
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def noscript_texts(page: str) -> list[str]:
    """Blocks inside noscript elements."""
    out = []
    for m in re.finditer(r"<noscript\b[^>]*>(.*?)</noscript\s*>", page, re.S | re.I):
        out += [b.text for b in html_blocks(m.group(1))]
    return out
