"""Learned selectors: applied to pages, learned from samples, healed when fields go missing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonops
from ..functions.dom import Node, parse, select
from .facts import sidecar

# Attributes that identify an element, classes that only lay out, bound of a joined class selector.
KEY_ATTRIBUTES = ("name", "itemprop", "data-testid", "data-test", "data-id")
LAYOUT = re.compile(r"^(col|row|container|grid|flex|w|h|m|p|mt|mb|ml|mr|pt|pb|pl|pr|text|bg|d)(-|$)")
CLASS_CHARS = 160


def _number(text: str) -> float | None:
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return None


def coerce_value(text: str, kind: str | None) -> object:
    s = text.strip()
    if kind == "int":
        n = _number(s)
        return None if n is None else int(n)
    if kind == "float":
        return _number(s)
    if kind == "eur_decimal":
        return _number(re.sub("[€    ']", "", s))
    if kind == "bool":
        return True if s.lower() in ("true", "yes", "ja", "oui", "1", "y", "j") else False if s.lower() in ("false", "no", "nein", "non", "0", "n") else None
    return s


def field_value(root: Node, side: object, selector: dict) -> object:
    """Value of one selector {type, expr, regex, coerce, multiple} on a parsed page, None if it finds nothing."""
    if selector.get("type") == "jsonld":
        return jsonops.walk_path(side, selector["expr"])

    def one(text: str) -> object:
        if selector.get("regex"):
            m = re.search(selector["regex"], text)
            if not m:
                return None
            text = m.group(1) if m.groups() else m.group()
        return coerce_value(text, selector.get("coerce"))

    try:
        found = select(root, selector["expr"])
    except ValueError:
        return None
    if selector.get("multiple"):
        values = [v for n in found if n.content().strip() and (v := one(n.content().strip())) is not None]
        return values or None
    if not found:
        return None
    text = found[0].content().strip()
    return one(text) if text else None


def apply_selectors(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, record, missing): record in JSON of each page (id, domain, html) by its domain's document (domain, fields).

    fields: JSON object field -> selector. missing holds the fields that came out null. Pages of
    unknown domains have null record. The cache is the small side of a left join on domain.
    """
    joined = pages.select("id", "domain", "html").join(cache.select("domain", "fields"), "domain", "left").select("id", "html", "fields")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, dict] = {}
        for batch in batches:
            rows = []
            for i, page, fields in zip(*(c.to_pylist() for c in batch.columns)):
                if fields is None:
                    rows.append((i, None, None))
                    continue
                doc = docs.get(fields)
                if doc is None:
                    if len(docs) > 1000:
                        docs.clear()
                    doc = docs[fields] = json.loads(fields)
                root = parse(page or "")
                raw = sidecar(root, page or "") if any(s.get("type") == "jsonld" for s in doc.values()) else None
                side = jsonops.strict(raw) if raw else None
                record = {f: field_value(root, side, s) for f, s in doc.items()}
                rows.append((i, jsonops.marshalled(record), sorted(f for f, v in record.items() if v is None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.list_(pa.string())))], names=["id", "record", "missing"])

    return joined.mapInArrow(run, "id bigint, record string, missing array<string>")


def needed(n: int) -> int:
    """Samples on which a selector must agree."""
    return n - 1 if n >= 3 else n


def _own(e: Node) -> Iterator[str]:
    i = e.attrs.get("id", "")
    if re.fullmatch(r"[A-Za-z_][\w-]*", i):
        yield f"#{i}"
        yield f"{e.tag}#{i}"
    classes = [c for c in e.attrs.get("class", "").split() if re.fullmatch(r"[A-Za-z_][\w-]*", c) and not LAYOUT.match(c)]
    joined = e.tag + "".join(f".{c}" for c in classes)
    if classes and len(joined.encode()) < CLASS_CHARS:
        yield joined
    for a in KEY_ATTRIBUTES:
        v = e.attrs.get(a, "")
        if v and '"' not in v:
            yield f'{e.tag}[{a}="{v}"]'
    kin = [k for k in e.parent.children if k.tag == e.tag] if e.parent else [e]
    yield f"{e.tag}:nth-of-type({kin.index(e) + 1})"


def candidates(root: Node, needles: list[str]) -> list[str]:
    """Selectors of the elements that hold one of the needles, deepest first, each with up to four ancestors' own selectors."""
    found = [e for e in root.elements() if any(n in e.content() for n in needles)]
    depth = lambda e: sum(1 for _ in _up(e))
    out: dict[str, None] = {}
    for e in sorted(found, key=lambda e: -depth(e)):
        for a in [e, *list(_up(e))[:4]]:
            for s in _own(a):
                out.setdefault(s)
    return list(out)


def _up(e: Node) -> Iterator[Node]:
    while e.parent is not None and not e.parent.tag.startswith("#"):
        e = e.parent
        yield e


def needles_of(value: object) -> list[str]:
    """How a scalar may stand in a page; numbers with point or comma, and with two places."""
    if value is None or isinstance(value, (dict, list)):
        return []
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    out = [jsonops.marshalled(value)]
    if isinstance(value, float):
        out += [f"{value:.2f}", out[0].replace(".", ","), f"{value:.2f}".replace(".", ",")]
    return out


def agreement(samples: list[dict], field: str, selector: dict) -> int:
    """Samples {root, side, truth} on which the selector gives the true value; both null counts."""
    return sum(jsonops.marshalled(field_value(s["root"], s["side"], selector)) == jsonops.marshalled(s["truth"].get(field)) for s in samples)


def synthesized(samples: list[dict], hints: dict[str, dict], fields: list[str], propose: Callable[[list[str], list[dict]], dict[str, str]] | None = None) -> dict[str, dict]:
    """Selector per field that enough samples agree on: path hint, CSS hint, generated candidates, proposals, in this order."""
    n, out, missing = len(samples), {}, []
    for f in sorted(fields):
        h = hints.get(f, {})
        extra = {k: h[k] for k in ("regex", "coerce") if h.get(k)}
        if h.get("jsonld_path"):
            s = {"type": "jsonld", "expr": h["jsonld_path"]}
            if n and agreement(samples, f, s) >= needed(n):
                out[f] = s
            else:
                missing.append(f)
            continue
        best: tuple[int, dict] | None = None
        options = ([h["css_hint"]] if h.get("css_hint") else []) + [c for s in samples[:1] for c in candidates(s["root"], needles_of(s["truth"].get(f)))]
        for k, expr in enumerate(options):
            s = {"type": "css", "expr": expr, **extra}
            hits = agreement(samples, f, s)
            if k == 0 and h.get("css_hint") and hits >= needed(n):
                best = (hits, s)
                break
            if best is None or hits > best[0]:
                best = (hits, s)
            if hits == n:
                break
        if best and best[0] >= needed(n):
            out[f] = best[1]
        else:
            missing.append(f)
    if missing and propose is not None:
        for f, expr in propose(missing, samples).items():
            s = {"type": "css", "expr": expr, **{k: hints.get(f, {})[k] for k in ("regex", "coerce") if hints.get(f, {}).get(k)}}
            if f in missing and expr and agreement(samples, f, s) >= needed(n):
                out[f] = s
    return out


def learn(samples: DataFrame, hints: dict[str, dict], fields: list[str]) -> DataFrame:
    """(domain, fields, samples_used) from samples (domain, seq, html, truth in JSON): the last three of each domain."""
    from .sequences import retained

    last = retained(samples.select("domain", "seq", "html", "truth"), ["domain"], "seq")

    def run(key, group):  # at most RETAINED rows
        rows = []
        for page, truth in zip(group.html, group.truth):
            root = parse(page or "")
            raw = sidecar(root, page or "")
            rows.append({"root": root, "side": jsonops.strict(raw) if raw else None, "truth": json.loads(truth)})
        import pandas as pd

        return pd.DataFrame({"domain": [key[0]], "fields": [jsonops.marshalled(synthesized(rows, hints, fields))], "samples_used": [len(rows)]})

    return last.groupBy("domain").applyInPandas(run, "domain string, fields string, samples_used int")


def healed(old: str, new: dict[str, dict], broken: list[str], total: int) -> tuple[dict[str, dict], bool]:
    """(document, full): broken fields replaced or dropped; at half of the fields or more everything is learned anew."""
    doc = json.loads(old)
    full = 2 * len(broken) >= total
    if full:
        return dict(new), True
    for f in broken:
        doc.pop(f, None)
        if f in new:
            doc[f] = new[f]
    return doc, False


def cleared(cache: DataFrame, domain: str | None = None, schema_hash: str | None = None) -> DataFrame:
    """The cache without the documents of a domain, of a schema, or of both together; without either all go."""
    gone = F.lit(True)
    if domain is not None:
        gone = gone & (F.col("domain") == domain)
    if schema_hash is not None:
        gone = gone & (F.col("schema_hash") == schema_hash)
    return cache.where(~F.coalesce(gone, F.lit(False)))


def cacheable(df: DataFrame, fields: str, known: str) -> DataFrame:
    """Adds non_cacheable: schema fields without a selector."""
    return df.withColumn("non_cacheable", F.array_sort(F.array_except(fields, known)))
