"""Modules by name: transforms of frames and of JSON texts, with a version gate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("source", "fetcher", "cleaner", "extractor", "transform", "exporter", "model")
MAJOR = 1


class RegistryError(ValueError):
    """A module that can't be registered or found."""


@dataclass(frozen=True)
class Module:
    kind: str
    name: str
    version: str
    run: Callable


class Registry:
    def __init__(self) -> None:
        self._modules: dict[tuple[str, str], Module] = {}

    def register(self, kind: str, name: str, version: str, run: Callable) -> None:
        if kind not in KINDS:
            raise RegistryError(f"unknown kind {kind!r}")
        m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)", version)
        if not m or int(m.group(1)) != MAJOR:
            raise RegistryError(f"{name}: version {version!r} does not fit {MAJOR}.x")
        if (kind, name) in self._modules:
            raise RegistryError(f"{kind} {name} is there already")
        self._modules[kind, name] = Module(kind, name, version, run)

    def get(self, kind: str, name: str) -> Module:
        try:
            return self._modules[kind, name]
        except KeyError:
            raise RegistryError(f"no {kind} {name}") from None

    def listing(self) -> list[tuple[str, str, str]]:
        return sorted((m.kind, m.name, m.version) for m in self._modules.values())

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        return self.get("transform", name).run(df)


def json_transform(df: DataFrame, col: str, change: Callable[[str], str]) -> DataFrame:
    """df with the JSON column changed by a function of one text, in Arrow batches; a failure keeps the text and tells why in <col>_error."""
    names = df.columns
    at = names.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, errors = [], []
            for t in batch.column(at).to_pylist():
                try:
                    new.append(None if t is None else change(t))
                    errors.append(None)
                except Exception as e:  # a module's failure is data on the row
                    new.append(t)
                    errors.append(str(e))
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(errors, pa.string())], names=[*names, f"{col}_error"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(f"{col}_error", T.StringType())]))


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions page_links(html, base), sitemap_locs(xml) and ld_nodes(html, type)."""
    from ..functions import jsonops
    from ..functions.dom import parse, select
    from .facts import resolve, sidecar
    from .robots import sitemap_entries

    @F.udtf(returnType="url string")
    class PageLinks:
        def eval(self, html: str, base: str):
            for a in select(parse(html or ""), "a[href]"):
                if a.attrs["href"].strip():
                    yield (resolve(base or "", a.attrs["href"].strip()),)

    @F.udtf(returnType="url string")
    class SitemapLocs:
        def eval(self, xml: str):
            for u in sitemap_entries((xml or "").encode())[1]:
                yield (u,)

    @F.udtf(returnType="node string")
    class LdNodes:
        def eval(self, html: str, kind: str):
            side = sidecar(parse(html or ""), html or "")
            for n in jsonops.nodes_of_type(jsonops.strict(side), kind) if side else []:
                yield (jsonops.marshalled(n),)

    for name, f in (("page_links", PageLinks), ("sitemap_locs", SitemapLocs), ("ld_nodes", LdNodes)):
        spark.udtf.register(name, f)
