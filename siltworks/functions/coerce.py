"""Coercion of text to typed values; null where a value can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed
from .urls import _col

KINDS = ("int", "float", "eur_decimal", "iso_date", "bool", "trim", "regex")
# Words of truth in the accepted languages.
TRUE = ("true", "yes", "ja", "oui", "1", "y", "j")
FALSE = ("false", "no", "nein", "non", "0", "n")


def to_int(c: Column | str) -> Column:
    s = trimmed(c)
    whole = F.when(s.rlike(r"^[+-]?\d+\z"), s.try_cast("bigint"))
    return F.coalesce(whole, to_float(c).try_cast("bigint"))


def to_float(c: Column | str) -> Column:
    s = F.replace(trimmed(c), F.lit(","), F.lit("."))
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), s.try_cast("double"))


def eur_decimal(c: Column | str) -> Column:
    """Price with euro sign, thin spaces or apostrophes; two separators of thousands and decimals fail."""
    s = F.translate(_col(c), "€\u00a0\u202f\u2009 '", "")
    return to_float(s)


def to_bool(c: Column | str) -> Column:
    s = F.lower(trimmed(c))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def iso_date(c: Column | str) -> Column:
    """yyyy-MM-dd of the first layout that fits; else of the first d.m.yyyy in the text, unchecked."""
    s = trimmed(c)
    day = lambda x, f: F.date_format(F.try_to_timestamp(x, F.lit(f)), "yyyy-MM-dd")
    guarded = lambda pattern, f: F.when(s.rlike(pattern), day(s, f))
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"
    at = lambda g: F.regexp_extract(s, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", g)
    loose = F.when(at(3) != "", F.concat_ws("-", at(3), F.lpad(at(2), 2, "0"), F.lpad(at(1), 2, "0")))
    return F.coalesce(
        guarded(r"^\d{4}-\d\d-\d\d\z", "yyyy-MM-dd"),
        F.when(s.rlike(stamp), F.substring(s, 1, 10)),
        guarded(r"^\d\d\.\d\d\.\d{4}\z", "dd.MM.yyyy"),
        guarded(r"^\d\d/\d\d/\d{4}\z", "dd/MM/yyyy"),
        guarded(r"^\d\d/\d\d/\d{4}\z", "MM/dd/yyyy"),
        guarded(r"^\d{1,2}\.\d{1,2}\.\d{4}\z", "d.M.yyyy"),
        guarded(r"^[A-Z][a-z]+ \d{1,2}, \d{4}\z", "MMMM d, yyyy"),
        guarded(r"^\d{1,2} [A-Z][a-z]{2} \d{4}\z", "d MMM yyyy"),
        loose,
    )


def apply_regex(c: Column | str, pattern: str) -> Column:
    """First group, or the whole match if there is no group; null without a match."""
    import re

    return F.when(_col(c).rlike(pattern), F.regexp_extract(_col(c), pattern, 1 if re.compile(pattern).groups else 0))


def coerced(c: Column | str, kind: str | None = None, regex: str | None = None, trim: bool = False) -> Column:
    """regex, then the kind, then trim; the kind 'regex' keeps the regular expression's result."""
    v = _col(c).cast("string")
    if regex:
        v = apply_regex(v, regex)
    if kind and kind not in KINDS:
        raise ValueError(f"unknown coercion {kind!r}")
    v = {"int": to_int, "float": to_float, "eur_decimal": eur_decimal, "iso_date": iso_date, "bool": to_bool, "trim": trimmed}.get(kind or "", lambda x: x)(v)
    return trimmed(v) if trim and kind not in ("int", "float", "eur_decimal", "bool") else v


def call_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of tokens at prices for a million of them; null prices cost 0."""
    return prompt / 1e6 * F.coalesce(price_in, F.lit(0.0)) + F.coalesce(completion, F.lit(0)) / 1e6 * F.coalesce(price_out, F.lit(0.0))


def projected_cost(text: Column | str, price_in: Column, fallback: float = 2.0) -> Column:
    return F.floor(F.octet_length(_col(text)) / 4) / 1e6 * F.coalesce(price_in, F.lit(fallback))
