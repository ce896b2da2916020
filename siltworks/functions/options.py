"""Options as agents send them: texts for numbers, flags, lists and maps are read as what they stand for."""

from __future__ import annotations

import json


class OptionError(ValueError):
    """An option of the wrong kind."""


def coerce_option(name: str, value: object, kind: str) -> object:
    """value as 'int', 'float', 'bool', 'str', 'list' or 'map'; None for null and ''."""
    if value is None or value == "":
        return None
    if kind == "str":
        return value if isinstance(value, str) else json.dumps(value)
    if kind == "bool":
        if isinstance(value, bool):
            return value
        if isinstance(value, str) and value.strip().lower() in ("true", "false"):
            return value.strip().lower() == "true"
    elif kind in ("int", "float"):
        if isinstance(value, (int, float)) and not isinstance(value, bool) or isinstance(value, str):
            try:
                n = float(value)
            except ValueError:
                raise OptionError(f"{name}: {value!r} is no number") from None
            if kind == "float":
                return n
            if n.is_integer():
                return int(n)
            raise OptionError(f"{name}: {value!r} is no whole number")
    elif kind == "list":
        if isinstance(value, list):
            return value
        if isinstance(value, str):
            try:
                got = json.loads(value)
                return got if isinstance(got, list) else [value]
            except ValueError:
                return [value]
    elif kind == "map":
        got = value
        if isinstance(value, str):
            try:
                got = json.loads(value)
            except ValueError:
                got = None
        if isinstance(got, dict):
            return got
    raise OptionError(f"{name}: want {kind}, have {value!r}")


def coerced_options(given: dict[str, object], kinds: dict[str, str]) -> dict[str, object]:
    """All declared options that are set; undeclared ones are an error."""
    unknown = sorted(set(given) - set(kinds))
    if unknown:
        raise OptionError(f"unknown options: {', '.join(unknown)}")
    return {k: v for k in given if (v := coerce_option(k, given[k], kinds[k])) is not None}


def widened(schema: dict) -> dict:
    """An input schema whose scalar and container fields also take texts."""
    props = {}
    for name, p in schema.get("properties", {}).items():
        kinds = p.get("type", "string")
        kinds = kinds if isinstance(kinds, list) else [kinds]
        props[name] = {**p, "type": sorted({*kinds, "string", "null"})}
    return {**schema, "properties": props}
