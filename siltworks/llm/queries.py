"""The queries of this subpackage and, where one exists, their SQL."""

from __future__ import annotations

import importlib

MODULES = ("mainbody", "markup", "neardup", "sitelines", "leakage", "mixing", "mojibake", "reading", "residue")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), attribute, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
