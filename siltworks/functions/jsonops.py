"""JSON walks that need recursion: embedded data of pages and their gates. Plain Python, called inside Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator


def strict(text: str) -> object:
    """The value of a strict JSON text; ValueError for NaN, Infinity and trailing text."""

    def refuse(name: str) -> object:
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def is_valid(text: str | None) -> bool:
    try:
        strict(text or "")
        return bool(text and text.strip())
    except (ValueError, RecursionError):
        return False


def marshalled(value: object, indent: int | None = None) -> str:
    """Sorted keys, compact unless indented, HTML-safe, whole numbers without a fraction."""

    def plain(v: object) -> object:
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    s = json.dumps(plain(value), sort_keys=True, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))
    for c, e in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        s = s.replace(c, e)
    return s


def balanced_objects(text: str) -> Iterator[str]:
    """Top-level objects of a text that holds JSON among other things; braces in strings don't count."""
    depth = start = 0
    quoted = False
    i = 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]
        i += 1


def walk_path(value: object, path: str) -> object:
    """Value at '$.a.b.0.c'; over an array root the first element that resolves; None if nothing does."""
    if not path.startswith("$."):
        return None
    steps = path[2:].split(".")

    def go(v: object) -> object:
        for s in steps:
            if isinstance(v, dict) and s in v:
                v = v[s]
            elif isinstance(v, list) and s.isdigit() and int(s) < len(v):
                v = v[int(s)]
            else:
                return None
        return v

    if isinstance(value, list) and not steps[0].isdigit():
        return next((x for x in map(go, value) if x is not None), None)
    return go(value)


def leaf_texts(value: object, least: int = 40, cap: int = 4000) -> str:
    """Prose among the string leaves: long ones without code marks, each once, cut at a paragraph within cap bytes."""
    out: list[str] = []
    seen: set[str] = set()
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, str):
            s = v.strip()
            if len(s.encode()) >= least and not any(c in s for c in "{};") and not s.startswith("function(") and s not in seen:
                seen.add(s)
                out.append(s)
    text = "\n\n".join(out)
    raw = text.encode()
    if len(raw) <= cap:
        return text
    head = raw[:cap].decode("utf-8", "ignore")
    at = head.rfind("\n\n")
    return head[:at] if at > 0 else head


def nodes_of_type(value: object, kind: str) -> list[dict]:
    """Objects whose @type is the kind, in document order, through arrays and nested values."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            t = v.get("@type")
            if t == kind or isinstance(t, list) and kind in t:
                out.append(v)
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))
    return out


def author(value: object) -> str:
    """Name of the first author found depth first: a string, an object with a name, or a list of such."""

    def named(v: object) -> str:
        if isinstance(v, str):
            return v.strip()
        if isinstance(v, dict):
            return named(v.get("name")) if isinstance(v.get("name"), str) else ""
        if isinstance(v, list):
            return next((n for n in map(named, v) if n), "")
        return ""

    if isinstance(value, dict):
        if got := named(value.get("author")):
            return got
        return next((n for n in map(author, value.values()) if n), "")
    if isinstance(value, list):
        return next((n for n in map(author, value) if n), "")
    return ""


def gated(raw: str | None, body: str, cap: int = 16_384) -> str:
    """Structured data worth keeping beside the body, as a fenced block; '' if nothing is left.

    Site and page blocks go, so do article bodies and long strings that the body already has.
    """
    if not raw:
        return ""
    try:
        value = json.loads(raw)
    except ValueError:
        return ""
    known = lambda s: len(s.encode()) > 500 and s.encode()[:200].decode("utf-8", "ignore") in body

    def scrub(v: object) -> object:
        if isinstance(v, dict):
            if v.get("@type") in ("WebSite", "WebPage"):
                return None
            kept = {k: scrub(x) for k, x in v.items() if k != "articleBody" and not (isinstance(x, str) and known(x))}
            return {k: x for k, x in kept.items() if x is not None}
        if isinstance(v, list):
            return [scrub(x) for x in v]
        return "" if isinstance(v, str) and known(v) else v

    text = marshalled(scrub(value), indent=2)
    if len(text.encode()) > cap:
        text = text.encode()[:cap].decode("utf-8", "ignore") + "\n…(truncated)"
    return "" if text.strip() in ("null", "{}", "[]") else f"```json\n{text}\n```\n"
