"""All core queries and their SQL, gathered by module."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("nested_queries", "web_queries", "ledger_queries", "graph_queries", "record_queries", "vertical_queries", "value_queries", "flow_queries", "page_queries", "stream_queries")
#: What stands for null in the columns of a query's report, so that it prints alike everywhere.
BLANKS: dict[str, dict[str, object]] = {
    "p1_comments": {"text": ""},
    "p1_threads": {"author": "", "score": -1, "body": ""},
    "p1_answers": {"score": -1, "body": ""},
    "p1_repos": {"description": "", "language": "", "stargazers_count": -1},
    "pypi_records": dict.fromkeys(("name", "version", "summary", "author", "requires_python", "url", "error"), ""),
    "hub_records": {"pipeline_tag": ""},
    "product_records": dict.fromkeys(("name", "brand", "currency", "availability", "url", "error"), "") | {"price": -1},
    "review_records": dict.fromkeys(("name", "author", "body", "error"), "") | {"rating": -1.0, "reviews": -1, "stars": -1},
    "json_paths": {"value": ""},
    "coerced_prices": {"none": -1.0},
    "video_ids": {"video": ""},
    "viewports": {"pixels": -1},
    "repaired_answers": {"record": ""},
    "jsonl_round_trip": {"url": "", "title": "", "markdown_md5": ""},
    "csv_round_trip": {"size": -1},
    "whole_files": {"n_chars": -1},
    "run_events": {"finished_at": -1},
    "built_social": {"error": ""},
}


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), attribute, {})
    return out


def _filled(query: Callable[[SparkSession, str], DataFrame], blanks: dict) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).fillna(blanks)

    return run


def _filled_sql(sql: str, blanks: dict) -> str:
    shown = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, {shown(v)}) AS {c}" for c, v in blanks.items()) + f") FROM ({sql}) t"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _filled(q, BLANKS[n]) if n in BLANKS else q for n, q in _gather("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return {n: _filled_sql(s, BLANKS[n]) if n in BLANKS else s for n, s in _gather("SQL").items()}
