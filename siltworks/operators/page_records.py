"""Typed records read from pages themselves: products, reviews, social metadata."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import jsonops
from ..functions.dom import Node, parse, select
from .facts import _per_page, sidecar

# The metadata of link previews.
OG = ("title", "description", "image", "url", "type")
TWITTER = ("card", "title", "description", "image")


class NoRecord(LookupError):
    """The page holds nothing for the record."""


def _fold(text: str) -> str:
    return " ".join(text.split())


def _text(value: object, *keys: str) -> str:
    for k in keys:
        if isinstance(value, dict) and isinstance(value.get(k), str) and value[k]:
            return value[k]
    return ""


def _number(value: object, key: str) -> float:
    v = value.get(key) if isinstance(value, dict) else None
    try:
        return float(v)
    except (TypeError, ValueError):
        return 0.0


def social(root: Node, page: str, url: str) -> dict:
    """Link-preview metadata, title, description, canonical link and first heading, as far as they are there."""
    metas = select(root, "meta")
    first = lambda attr, name: next((_fold(m.attrs.get("content", "")) for m in metas if m.attrs.get(attr) == name), "")
    out = {f"og_{k}": first("property", f"og:{k}") for k in OG} | {f"twitter_{k}": first("name", f"twitter:{k}") for k in TWITTER}
    out["title"] = next((_fold(n.content()) for n in select(root, "title")), "")
    out["description"] = first("name", "description")
    out["canonical"] = next((_fold(n.attrs.get("href", "")) for n in select(root, "link[rel=canonical]")), "")
    out["h1"] = next((_fold(n.content()) for n in select(root, "h1")), "")
    out = {k: v for k, v in out.items() if v}
    if not out:
        raise NoRecord("no metadata")
    return out


def _is_product(kind: object) -> bool:
    return any(isinstance(k, str) and "Product" in k for k in (kind if isinstance(kind, list) else [kind]))


def product(root: Node, page: str, url: str) -> dict:
    """The first product block of the embedded data; loose script objects serve only where there is no embedded data."""
    raw = sidecar(root, page)
    if raw is not None:
        value = jsonops.strict(raw)
        blocks = value if isinstance(value, list) else [value]
    else:
        blocks = []
        for s in select(root, "script"):
            for text in jsonops.balanced_objects(s.content()) if "Product" in s.content() else ():
                if jsonops.is_valid(text):
                    blocks.append(jsonops.strict(text))
    for b in blocks:
        if isinstance(b, dict) and _is_product(b.get("@type")):
            offers = b.get("offers")
            offers = offers[0] if isinstance(offers, list) and offers else offers
            brand = b.get("brand")
            return {
                "name": _text(b, "name", "title"), "brand": brand if isinstance(brand, str) else _text(brand, "name"), "price": offers.get("price") if isinstance(offers, dict) else None,
                "currency": _text(offers, "priceCurrency"), "availability": _text(offers, "availability"), "url": _text(b, "url") or url,
            }
    raise NoRecord("no product data")


def reviews(root: Node, page: str, url: str) -> dict:
    """Name, rating and reviews of the organisation in the linked data; a page without linked data is an error."""
    out: dict = {}
    found, items = False, []
    for s in select(root, 'script[type="application/ld+json"]'):
        try:
            value = jsonops.strict(s.content())
        except ValueError:
            continue
        found = True
        for org in jsonops.nodes_of_type(value, "Organization"):
            out.setdefault("name", _text(org, "name"))
            if isinstance(org.get("aggregateRating"), dict) and "rating_value" not in out:
                out["rating_value"], out["review_count"] = _number(org["aggregateRating"], "ratingValue"), _number(org["aggregateRating"], "reviewCount")
        items += [{"author": _text(r.get("author"), "name"), "rating": _number(r.get("reviewRating"), "ratingValue"), "date": _text(r, "datePublished"), "body": _text(r, "reviewBody")} for r in jsonops.nodes_of_type(value, "Review")]
    if not found:
        raise NoRecord("no linked data")
    return out | {"reviews": items}


READERS = {"og": social, "ecommerce_product": product, "trustpilot": reviews}


def page_records(pages: DataFrame, name: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record, error): the record as JSON text, or why there is none."""
    reader = READERS[name]

    def row(i: int, url: str, page: str) -> tuple:
        try:
            return i, jsonops.marshalled(reader(parse(page), page, url)), None
        except (NoRecord, ValueError) as e:
            return i, None, str(e)

    return _per_page(pages, id_col, url_col, html_col, {"id": pa.int64(), "record": pa.string(), "error": pa.string()}, row)
