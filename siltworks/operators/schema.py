"""JSON Schema of records: load, types, hints, and validation as Column predicates."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonops
from ..functions.coerce import KINDS, coerced

HINTS = "x-hints"


class SchemaError(ValueError):
    """A schema that can't serve."""


@dataclass
class RecordSchema:
    doc: dict
    hints: dict[str, dict] = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        return sorted(self.doc.get("properties", {}))

    @property
    def required(self) -> list[str]:
        return list(self.doc.get("required", []))

    @property
    def columns(self) -> list[str]:
        """Required fields in their order, then the others sorted."""
        return self.required + [f for f in self.fields if f not in self.required]

    @property
    def hash(self) -> str:
        return hashlib.sha256(jsonops.marshalled(self.doc).encode()).hexdigest()


#: What serves where no schema is given.
PERMISSIVE = {"type": "object", "properties": {"title": {"type": "string"}}}


def load(text: str | None, hint_key: str = HINTS) -> RecordSchema:
    """A schema from JSON or YAML; unknown coercions are an error at load."""
    if text is None:
        return RecordSchema(PERMISSIVE)
    try:
        doc = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise SchemaError("a YAML schema needs the yaml package") from e
        doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("properties", {}), dict):
        raise SchemaError("a schema is an object with properties")
    hints = {}
    for name, prop in doc.get("properties", {}).items():
        own = (prop or {}).get(hint_key, {})
        if own.get("coerce") and own["coerce"] not in KINDS:
            raise SchemaError(f"{name}: unknown coercion {own['coerce']!r}")
        if own:
            hints[name] = own
    return RecordSchema(doc, hints)


def spark_type(prop: dict) -> T.DataType:
    kinds = prop.get("type", "string")
    kind = next((k for k in kinds if k != "null"), "string") if isinstance(kinds, list) else kinds
    if kind == "array":
        return T.ArrayType(spark_type(prop.get("items") or {}))
    if kind == "object":
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in prop.get("properties", {}).items()])
    return {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def struct_type(schema: RecordSchema) -> T.StructType:
    return T.StructType([T.StructField(f, spark_type(schema.doc["properties"][f]), f not in schema.required) for f in schema.columns])


def _kind(v: Column) -> Column:
    """JSON type name of a variant."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | (s == "VOID"), "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("BIGINT"), "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number").when(s.startswith("ARRAY"), "array").otherwise("object")


def with_errors(df: DataFrame, record: str, schema: RecordSchema, out: str = "errors") -> DataFrame:
    """df with the record's errors; the record is parsed once."""
    staged = df.withColumns({"_v": F.try_parse_json(record), "_keys": F.json_object_keys(record)})
    return staged.withColumn(out, errors(F.col(record), schema, F.col("_v"), F.col("_keys"))).drop("_v", "_keys")


def errors(record: Column, schema: RecordSchema, parsed: Column | None = None, names: Column | None = None) -> Column:
    """Array of '/field: reason' of a record in JSON text, empty if it is valid; null and malformed records have '/: not an object'.

    Checked: type, required, additionalProperties, enum, minimum, maximum, minLength, maxLength, pattern.
    """
    v = F.try_parse_json(record) if parsed is None else parsed
    is_object = F.coalesce(_kind(v) == "object", F.lit(False))
    out: list[Column] = []
    name_error = lambda f, reason: F.lit(f"/{f}: {reason}")
    keys = F.json_object_keys(record) if names is None else names
    for f in schema.required:
        out.append(F.when(~F.coalesce(F.array_contains(keys, f), F.lit(False)), name_error(f, "required")))
    if schema.doc.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, schema.fields)))) if schema.fields else F.array_sort(keys)
        out.append(F.when(F.size(extra) > 0, F.concat(F.lit("/: additional "), F.concat_ws(",", extra))))
    for f in schema.fields:
        prop = schema.doc["properties"][f] or {}
        x = F.try_variant_get(v, f"$['{f}']", "variant")
        there = F.coalesce(F.array_contains(keys, f), F.lit(False))
        kind = _kind(x)
        if "type" in prop:
            want = prop["type"] if isinstance(prop["type"], list) else [prop["type"]]
            have = F.when((kind == "integer") & F.lit("integer" not in want), "number").otherwise(kind)
            whole = F.try_variant_get(v, f"$['{f}']", "double")
            have = F.when((kind == "number") & F.lit("integer" in want) & (whole == F.floor(whole)), "integer").otherwise(have)
            out.append(F.when(there & ~have.isin(*want), F.concat(F.lit(f"/{f}: want {'|'.join(want)}, have "), kind)))
        text, number = F.try_variant_get(v, f"$['{f}']", "string"), F.try_variant_get(v, f"$['{f}']", "double")
        if "enum" in prop:
            out.append(F.when(there & ~F.coalesce(text.isin(*[str(e) for e in prop["enum"]]), F.lit(False)), name_error(f, "not in enum")))
        numeric = kind.isin("integer", "number")
        for key, bad in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m)):
            if key in prop:
                out.append(F.when(there & numeric & bad(prop[key]), name_error(f, key)))
        for key, bad in (("minLength", lambda m: F.length(text) < m), ("maxLength", lambda m: F.length(text) > m), ("pattern", lambda m: ~text.rlike(m))):
            if key in prop:
                out.append(F.when(there & (kind == "string") & bad(prop[key]), name_error(f, key)))
    found = F.filter(F.array(*out), lambda e: e.isNotNull()) if out else F.array().cast("array<string>")
    return F.when(is_object, found).otherwise(F.array(F.lit("/: not an object")))


def typed(df: DataFrame, record: str, schema: RecordSchema) -> DataFrame:
    """The record's fields as typed columns after the hints' coercions; what can't be read is null."""
    cols = []
    for f in schema.columns:
        prop, hint = schema.doc["properties"].get(f) or {}, schema.hints.get(f, {})
        raw = F.get_json_object(record, f"$['{f}']")
        value = coerced(raw, hint.get("coerce"), hint.get("regex"), bool(hint.get("trim")))
        kind = spark_type(prop)
        cols.append((F.from_json(raw, kind) if isinstance(kind, (T.ArrayType, T.StructType)) else value.try_cast(kind)).alias(f))
    return df.select("*", *cols)


def required_present(schema: RecordSchema) -> Column:
    out = F.lit(True)
    for f in schema.required:
        out = out & F.col(f).isNotNull()
    return out


def for_csv(df: DataFrame, schema: RecordSchema) -> DataFrame:
    """Columns in CSV order; nested fields are an error before anything is written."""
    nested = [f.name for f in df.schema.fields if f.name in schema.columns and isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    if nested:
        raise SchemaError(f"CSV holds no nested fields: {nested}")
    return df.select(*schema.columns)
