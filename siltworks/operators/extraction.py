"""Model-backed extraction behind a seam: the model is a function (system, user) -> text that the caller injects."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonops
from ..functions.text import cap_words, truncate_sentences
from .schema import RecordSchema
from .selectors import coerce_value

#: Tries of the repair loop.
ATTEMPTS = 3
Complete = Callable[[str, str], str]


def prompt(sidecar: Column, markdown: Column, extra: str = "") -> Column:
    """Embedded data first, then the text, then what the caller adds."""
    return F.concat_ws("\n\n", F.when(F.coalesce(sidecar, F.lit("")) != "", F.concat(F.lit("Embedded data:\n"), sidecar)), F.when(F.coalesce(markdown, F.lit("")) != "", F.concat(F.lit("Page:\n"), markdown)), F.lit(extra) if extra else F.lit(None))


def problems(record: object, schema: RecordSchema) -> list[str]:
    """The checks of schema.errors over a parsed record."""
    if not isinstance(record, dict):
        return ["/: not an object"]
    props = schema.doc.get("properties", {})
    out = [f"/{f}: required" for f in schema.required if f not in record]
    if schema.doc.get("additionalProperties") is False:
        out += [f"/: additional {k}" for k in sorted(record) if k not in props]
    for f, v in record.items():
        p = props.get(f) or {}
        if "type" in p:
            want = p["type"] if isinstance(p["type"], list) else [p["type"]]
            have = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) or isinstance(v, float) and v.is_integer() else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
            if have not in want and not (have == "integer" and "number" in want):
                out.append(f"/{f}: want {'|'.join(want)}, have {have}")
        if "enum" in p and v not in p["enum"]:
            out.append(f"/{f}: not in enum")
    return out


def repaired(user: str, side: object, schema: RecordSchema, complete: Complete) -> tuple[str | None, int, str]:
    """(record, attempts, errors): ask, validate, fill from embedded data, coerce, validate again; errors go back to the model."""
    system = "Answer with one JSON object for this schema:\n" + jsonops.marshalled(schema.doc)
    ask, errors = user, ""
    for attempt in range(1, ATTEMPTS + 1):
        reply = complete(system, ask)
        try:
            record = jsonops.strict(reply)
        except ValueError as e:
            record, errors = None, f"/: {e}"
        if record is not None:
            bad = problems(record, schema)
            if bad and isinstance(record, dict):
                for f, h in schema.hints.items():
                    if h.get("jsonld_path") and record.get(f) is None:
                        got = jsonops.walk_path(side, h["jsonld_path"])
                        if got is not None:
                            record[f] = got
                    if h.get("coerce") and isinstance(record.get(f), str):
                        got = coerce_value(record[f], h["coerce"])
                        record[f] = got if got is not None else record[f]
                bad = problems(record, schema)
            if not bad:
                return jsonops.marshalled(record), attempt, ""
            errors = "\n".join(bad)
        ask = f"{user}\n\nThe last answer was not valid:\n{errors}"
    return None, ATTEMPTS, errors


def chain(models: dict[str, Complete]) -> Complete:
    """A model that asks the given ones in order and takes the first answer; if all fail, one error names them all."""

    def complete(system: str, user: str) -> str:
        failed = []
        for name, model in models.items():
            try:
                return model(system, user)
            except Exception as e:  # the next one may do
                failed.append(f"{name}: {e}")
        raise RuntimeError("; ".join(failed) or "no model")

    return complete


def extract(pages: DataFrame, schema: RecordSchema, complete: Complete, extra: str = "") -> DataFrame:
    """(id, record, attempts, error) of pages (id, sidecar, markdown); a failing model call is the row's error."""
    asked = pages.select(F.col("id").cast("bigint").alias("id"), "sidecar", prompt(F.col("sidecar"), F.col("markdown"), extra).alias("user"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, side, user in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = json.loads(side) if side else None
                except ValueError:
                    value = None
                try:
                    rows.append((i, *repaired(user, value, schema, complete)))
                except Exception as e:  # transport errors are data on the row
                    rows.append((i, None, 1, f"model: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.string()))], names=["id", "record", "attempts", "error"])

    return asked.mapInArrow(run, "id bigint, record string, attempts int, error string")


def cache_first(pages: DataFrame, cached: DataFrame, schema: RecordSchema, complete: Complete) -> DataFrame:
    """(id, record, from_cache, error): pages whose cached record lacks no field cost no model call; the others are extracted and filled in.

    cached: (id, record, missing) of apply_selectors. Rows are split before the model, which a CASE would not guard.
    """
    full = cached.where(F.col("record").isNotNull() & (F.size("missing") == 0)).select("id", "record", F.lit(True).alias("from_cache"), F.lit("").alias("error"))
    rest = pages.join(full.select("id"), "id", "left_anti")
    got = extract(rest, schema, complete).join(cached.select("id", F.col("record").alias("known")), "id", "left")

    def merge(known: Column, new: Column) -> Column:
        a, b = F.from_json(known, "map<string,string>"), F.from_json(new, "map<string,string>")
        kept = F.map_filter(F.coalesce(a, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
        return F.to_json(F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(kept, k)), kept))

    filled = F.when(F.col("known").isNull(), F.col("record")).when(F.col("record").isNull(), F.col("known")).otherwise(merge(F.col("known"), F.col("record")))
    return full.unionByName(got.select("id", filled.alias("record"), F.lit(False).alias("from_cache"), "error"))


def summaries(pages: DataFrame, complete: Complete, sentences: int = 3, words: int = 4000) -> DataFrame:
    """(id, summary): the model's summary of at most ``words`` words of each page, cut to whole sentences."""
    asked = pages.select("id", cap_words("markdown", words).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([complete("Summarize the page.", t or "") for t in batch.column(1).to_pylist()])], names=["id", "s"])

    return asked.mapInArrow(run, "id bigint, s string").select("id", truncate_sentences("s", sentences).alias("summary"))
