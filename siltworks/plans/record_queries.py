"""Queries of the record layer: search hits, typed records, schemas, selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema as S
from ..operators import verticals as V
from ..operators.page_records import page_records
from ..session import table

EVENT_SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}}}


def repo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of repositories and issues."""
    t = V.records(table(spark, sf_dir, "api_body").where("extractor = 'github_repo'"), "github_repo").where("error is null")
    return t.select("body_id", "record.kind", "record.full_name", "record.stars", "record.license", "record.title", "record.state", "record.comments")


def story_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.records(table(spark, sf_dir, "api_body").where("extractor = 'hackernews'"), "hackernews").where("error is null")
    return t.select("body_id", "record.kind", "record.title", "record.points", "record.author", "record.comments")


def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.records(table(spark, sf_dir, "api_body").where("extractor = 'stackoverflow'"), "stackoverflow").where("error is null")
    return t.select("body_id", "record.title", "record.score", F.coalesce(F.size("record.answers"), F.lit(0)).alias("n_answers"), "record.owner")


def thread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.records(table(spark, sf_dir, "api_body").where("extractor = 'reddit'"), "reddit").where("error is null")
    return t.select("body_id", "record.title", "record.author", "record.score")


def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API bodies that give no record, by reason; errors are data on the row."""
    t = table(spark, sf_dir, "api_body")
    out = None
    for name in ("github_repo", "hackernews", "stackoverflow", "reddit"):
        part = V.records(t.where(F.col("extractor") == name), name).where("error is not null").select("extractor", "error")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("extractor", "error").agg(F.count("*").alias("n"))


def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation errors of event properties against a schema with bounds (a stand-in for extracted records)."""
    schema = S.RecordSchema(EVENT_SCHEMA)
    t = S.with_errors(table(spark, sf_dir, "events").select("event_id", "props"), "props", schema)
    return t.select("event_id", F.concat_ws("; ", "errors").alias("errors"))


def json_path_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def social_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link-preview metadata of every page."""
    r = page_records(table(spark, sf_dir, "raw_page"), "og")
    return r.select(F.col("id").alias("page_id"), F.get_json_object("record", "$.title").alias("title"), F.get_json_object("record", "$.h1").alias("h1"), "error")


QUERIES = {f.__name__: f for f in (repo_records, story_records, question_records, thread_records, record_errors, schema_validate, json_path_walk, social_records)}

_BODY = """SELECT body_id, url, extractor, CASE WHEN starts_with(b, '"') AND json_valid(b) THEN regexp_replace(json_extract_string(b, '$'), '^[\\s\\x{FEFF}]+', '') ELSE b END AS j FROM (SELECT *, regexp_replace(regexp_replace(body, '^[\\s\\x{FEFF}]+', ''), '\\s+$', '') AS b FROM api_body WHERE status BETWEEN 200 AND 299)"""
_OK = f"WITH t AS ({_BODY}), g AS (SELECT * FROM t WHERE CASE WHEN json_valid(j) THEN json_type(j) IN ('OBJECT', 'ARRAY') ELSE false END) "
SQL = {
    "repo_records": _OK + """SELECT body_id, CASE WHEN json_extract(j, '$.number') IS NOT NULL THEN 'issue' ELSE 'repo' END AS kind, coalesce(j->>'$.full_name', '') AS full_name, coalesce(TRY_CAST(j->>'$.stargazers_count' AS DOUBLE), 0.0) AS stars, lower(coalesce(j->>'$.license.name', '')) AS license, coalesce(j->>'$.title', '') AS title, coalesce(j->>'$.state', '') AS state, coalesce(TRY_CAST(j->>'$.comments' AS DOUBLE), 0.0) AS comments
        FROM g WHERE extractor = 'github_repo'""",
    "story_records": _OK + """SELECT body_id, CASE WHEN (j->>'$.parent_id') IS NOT NULL THEN 'comment' ELSE 'story' END AS kind, coalesce(j->>'$.title', '') AS title, coalesce(TRY_CAST(j->>'$.points' AS DOUBLE), 0.0) AS points, coalesce(j->>'$.author', '') AS author, CAST(coalesce(json_array_length(j, '$.children'), 0) AS DOUBLE) AS comments FROM g WHERE extractor = 'hackernews'""",
    "question_records": _OK + """SELECT body_id, coalesce(j->>'$.items[0].title', '') AS title, coalesce(TRY_CAST(j->>'$.items[0].score' AS DOUBLE), 0.0) AS score, CAST(coalesce(len(list_filter(CAST(json_extract(j, '$.items') AS JSON[]), lambda x: (x->>'$.answer_id') IS NOT NULL)), 0) AS INTEGER) AS n_answers, coalesce(j->>'$.items[0].owner.display_name', '') AS owner FROM g WHERE extractor = 'stackoverflow'""",
    "thread_records": _OK + """SELECT body_id, coalesce(j->>'$[0].data.children[0].data.title', '') AS title, coalesce(j->>'$[0].data.children[0].data.author', '') AS author, coalesce(TRY_CAST(j->>'$[0].data.children[0].data.score' AS DOUBLE), 0.0) AS score FROM g WHERE extractor = 'reddit'""",
    "record_errors": """WITH b AS (SELECT extractor, status, regexp_replace(regexp_replace(coalesce(body, ''), '^[\\s\\x{FEFF}]+', ''), '\\s+$', '') AS b FROM api_body), j AS (SELECT extractor, status, CASE WHEN starts_with(b, '"') AND json_valid(b) THEN regexp_replace(regexp_replace(json_extract_string(b, '$'), '^[\\s\\x{FEFF}]+', ''), '\\s+$', '') ELSE b END AS j FROM b)
        SELECT extractor, CASE WHEN NOT coalesce(status BETWEEN 200 AND 299, false) THEN 'status ' || coalesce(CAST(status AS VARCHAR), 'none') ELSE 'malformed' END AS error, count(*) AS n FROM j WHERE NOT coalesce(status BETWEEN 200 AND 299, false) OR NOT json_valid(j) GROUP BY ALL""",
    "schema_validate": "SELECT event_id, CASE WHEN k < 10 THEN '/k: minimum' WHEN k > 90 THEN '/k: maximum' ELSE '' END AS errors FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)",
    "json_path_walk": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
}
