"""A small HTML tree with a CSS selector matcher. Used inside Arrow batches, one parse per page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])
_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"})}
_TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<!([^>]*)>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None, text: str = ""):
        self.tag, self.attrs, self.parent, self.text = tag, attrs or {}, parent, text
        self.children: list[Node] = []

    def walk(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def elements(self) -> Iterator["Node"]:
        return (n for n in self.walk() if not n.tag.startswith("#"))

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag == "#text")

    def outer(self) -> str:
        if self.tag == "#text":
            raw = self.parent is not None and self.parent.tag in ("script", "style")
            return self.text if raw else escape(self.text, quote=False)
        if self.tag == "#comment":
            return f"<!--{self.text}-->"
        inner = "".join(c.outer() for c in self.children)
        if self.tag == "#document":
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


def parse(page: str) -> Node:
    """The page's tree: implied end tags of p, li, dt, dd, table parts and option, raw text elements, void elements."""
    root = Node("#document")
    at, here = 0, root

    def text(s: str) -> None:
        if s:
            here.children.append(Node("#text", None, here, unescape(s) if "&" in s else s))

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        if m.group(1) is not None:
            here.children.append(Node("#comment", None, here, m.group(1)))
            continue
        if m.group(4) is None:
            continue
        tag = m.group(4).lower()
        if m.group(3):
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in _BLOCK:
            p = here
            while p is not root and p.tag not in ("p", "td", "th", "li", "div", "button"):
                p = p.parent
            if p.tag == "p":
                here = p.parent
        if tag in _IMPLIED:
            closes, stops = _IMPLIED[tag]
            up, last = here, None
            while up is not root and up.tag not in stops:
                if up.tag in closes:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent
        attrs: dict[str, str] = {}
        for k, a, b, c in _ATTR.findall(m.group(5)):
            attrs.setdefault(k.lower(), unescape(a or b or c))
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in VOID or m.group(6):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            body = page[pos : end.start() if end else n]
            if body:
                node.children.append(Node("#text", None, node, body if tag in ("script", "style") else unescape(body)))
            pos = end.end() if end else n
            continue
        here = node
    return root


class SelectorError(ValueError):
    """A selector outside the supported part of CSS."""


_SIMPLE = re.compile(r"""\*|[a-zA-Z][\w-]*|\#[\w-]+|\.[\w-]+|\[\s*[\w:-]+\s*(?:[~|^$*]?=\s*(?:"[^"]*"|'[^']*'|[^\]\s]+)\s*[iI]?\s*)?\]|:(?:nth-of-type|nth-child)\(\s*\d+\s*\)|:(?:first-of-type|first-child|last-child)|:not\([^()]*\)""")
_ATTR_TEST = re.compile(r"""\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*([iI]?)\s*)?\]""")


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    """Alternatives, each a chain of (combinator, simple tests) from left to right."""
    out = []
    for alternative in re.split(r",(?![^\[(]*[\])])", selector):
        chain, comb = [], " "
        rest = alternative.strip()
        if not rest:
            raise SelectorError(selector)
        while rest:
            m = re.match(r"\s*([>+~])\s*|\s+", rest)
            if m and chain:
                comb, rest = (m.group(1) or " "), rest[m.end() :]
                continue
            tests = []
            while m2 := _SIMPLE.match(rest):
                tests.append(m2.group())
                rest = rest[m2.end() :]
            if not tests:
                raise SelectorError(selector)
            chain.append((comb, tuple(tests)))
            comb = " "
        out.append(tuple(chain))
    return tuple(out)


def _passes(n: Node, test: str) -> bool:
    c = test[0]
    if test == "*":
        return True
    if c == "#":
        return n.attrs.get("id") == test[1:]
    if c == ".":
        return test[1:] in n.attrs.get("class", "").split()
    if c == "[":
        name, op, a, b, d, fold = _ATTR_TEST.match(test).groups()
        if name.lower() not in n.attrs:
            return False
        if not op:
            return True
        have, want = n.attrs[name.lower()], next((x for x in (a, b, d) if x is not None), "")
        if fold:
            have, want = have.lower(), want.lower()
        if op == "=":
            return have == want
        if op == "~=":
            return want in have.split()
        if op == "|=":
            return have == want or have.startswith(want + "-")
        return bool(want) and {"^=": have.startswith(want), "$=": have.endswith(want), "*=": want in have}[op]
    if c == ":":
        if test.startswith(":not("):
            return not any(_matches(n, chain) for chain in compiled(test[5:-1]))
        kin = [k for k in n.parent.children if not k.tag.startswith("#")] if n.parent else [n]
        same = [k for k in kin if k.tag == n.tag]
        number = re.search(r"\d+", test)
        if test.startswith(":nth-of-type"):
            return same.index(n) + 1 == int(number.group())
        if test.startswith(":nth-child"):
            return kin.index(n) + 1 == int(number.group())
        return {":first-of-type": same[0] is n, ":first-child": kin[0] is n, ":last-child": kin[-1] is n}[test]
    return n.tag == test.lower()


def _matches(n: Node, chain: tuple) -> bool:
    comb, tests = chain[-1]
    if not all(_passes(n, t) for t in tests):
        return False
    if len(chain) == 1:
        return True
    rest = chain[:-1]
    if comb == ">":
        return n.parent is not None and not n.parent.tag.startswith("#") and _matches(n.parent, rest)
    if comb in "+~":
        kin = [k for k in n.parent.children if not k.tag.startswith("#")] if n.parent else [n]
        before = kin[: kin.index(n)]
        return any(_matches(k, rest) for k in (before[-1:] if comb == "+" else before))
    up = n.parent
    while up is not None and not up.tag.startswith("#"):
        if _matches(up, rest):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Matching elements in document order."""
    chains = compiled(selector)
    return [n for n in root.elements() if n is not root and any(_matches(n, c) for c in chains)]
