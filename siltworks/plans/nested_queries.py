"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import API_SHAPES, flatten_nested, node_links, node_tables
from ..session import table


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "api_body").where(F.col("status").between(200, 299))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every accepted body with its parent's key."""
    nodes = node_links(accepted(spark, sf_dir), API_SHAPES)
    return nodes.select(F.col("id").alias("body_id"), "entity", "node_key", "parent_key")


def p1_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat comment table: the text of every comment and answer with its links."""
    nodes = flatten_nested(accepted(spark, sf_dir), API_SHAPES)
    return nodes.where(F.col("entity").isin("comment", "answer")).select(F.col("id").alias("body_id"), "entity", "node_key", "parent_key", F.element_at("attrs", -1).alias("text"))


def _typed(name: str, *columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = name.split("_")[0] if not name.startswith("github") else "github_repo"
        nodes = flatten_nested(accepted(spark, sf_dir).where(F.col("extractor") == kind), {kind: API_SHAPES[kind]})
        return node_tables(nodes, API_SHAPES)[name].select(F.col("id").alias("body_id"), "node_key", "parent_key", *columns)

    query.__doc__ = f"The typed table {name} with its parent links."
    return query


p1_threads = _typed("reddit_comment", "author", "score", "body")
p1_answers = _typed("stackoverflow_answer", "score", "is_accepted", "body")
p1_repos = _typed("github_repo_repo", "description", "language", "stargazers_count")

QUERIES = {"p1_found": p1_found, "p1_comments": p1_comments, "p1_threads": p1_threads, "p1_answers": p1_answers, "p1_repos": p1_repos}

#: Accepted bodies as JSON, and the comment trees walked by recursion.
_WALK = r"""WITH RECURSIVE b AS (SELECT body_id, extractor, regexp_replace(regexp_replace(body, '^[\s\x{FEFF}]+', ''), '[\s\x{FEFF}]+$', '') AS b FROM api_body WHERE status BETWEEN 200 AND 299),
        q AS (SELECT body_id, extractor, CASE WHEN starts_with(b, '"') AND json_valid(b) THEN regexp_replace(regexp_replace(json_extract_string(b, '$'), '^[\s\x{FEFF}]+', ''), '\s+$', '') ELSE b END AS t FROM b),
        v AS MATERIALIZED (SELECT body_id, extractor, CAST(t AS JSON) AS j FROM q WHERE json_valid(t) AND (starts_with(t, '{') OR starts_with(t, '['))),
        rd AS (SELECT body_id, unnest(json_extract(j, '$[*].data.children[*]')) AS node FROM v WHERE extractor = 'reddit'),
        posts AS (SELECT body_id, node->>'$.data.id' AS k FROM rd WHERE node->>'$.kind' = 't3' AND (node->>'$.data.id') IS NOT NULL),
        n AS (SELECT rd.body_id, 'c' AS s, node, coalesce(posts.k, '') AS parent FROM rd LEFT JOIN posts ON posts.body_id = rd.body_id
            UNION ALL SELECT body_id, 'h', unnest(json_extract(j, '$.children[*]')), j->>'$.id' FROM v WHERE extractor = 'hackernews' AND (j->>'$.id') IS NOT NULL
            UNION ALL SELECT body_id, s, unnest(CASE s WHEN 'c' THEN json_extract(node, '$.data.replies.data.children[*]') ELSE json_extract(node, '$.children[*]') END), CASE s WHEN 'c' THEN node->>'$.data.id' ELSE node->>'$.id' END
                FROM n WHERE CASE s WHEN 'c' THEN node->>'$.kind' = 't1' AND (node->>'$.data.id') IS NOT NULL ELSE (node->>'$.id') IS NOT NULL END),
        so AS (SELECT body_id, unnest(json_extract(j, '$.items[*]')) AS i FROM v WHERE extractor = 'stackoverflow'),
        sc AS (SELECT body_id, i->>'$.answer_id' AS a, unnest(json_extract(i, '$.comments[*]')) AS c FROM so),
        gl AS (SELECT body_id, j->>'$.number' AS p, unnest(json_extract(j, '$.labels[*]')) AS l FROM v WHERE extractor = 'github_repo' AND (j->>'$.number') IS NOT NULL)"""

SQL = {
    "p1_found": _WALK
    + r""",
        o(body_id, entity, node_key, parent_key) AS (
            SELECT body_id, 'post', k, '' FROM posts
            UNION ALL SELECT body_id, 'comment', node->>'$.data.id', parent FROM n WHERE s = 'c' AND node->>'$.kind' = 't1'
            UNION ALL SELECT body_id, 'story', j->>'$.id', '' FROM v WHERE extractor = 'hackernews'
            UNION ALL SELECT body_id, 'comment', node->>'$.id', parent FROM n WHERE s = 'h'
            UNION ALL SELECT body_id, 'repo', j->>'$.full_name', '' FROM v WHERE extractor = 'github_repo'
            UNION ALL SELECT body_id, 'license', j->>'$.license.spdx_id', j->>'$.full_name' FROM v WHERE extractor = 'github_repo' AND (j->>'$.full_name') IS NOT NULL
            UNION ALL SELECT body_id, 'issue', j->>'$.number', '' FROM v WHERE extractor = 'github_repo'
            UNION ALL SELECT body_id, 'label', l->>'$.name', p FROM gl
            UNION ALL SELECT body_id, 'question', i->>'$.question_id', '' FROM so WHERE (i->>'$.answer_id') IS NULL
            UNION ALL SELECT body_id, 'answer', i->>'$.answer_id', i->>'$.question_id' FROM so
            UNION ALL SELECT body_id, 'comment', c->>'$.comment_id', a FROM sc)
        SELECT DISTINCT * FROM o WHERE node_key IS NOT NULL""",
    "p1_comments": _WALK
    + r"""
        SELECT body_id, 'comment' AS entity, node->>'$.data.id' AS node_key, parent AS parent_key, node->>'$.data.body' AS text FROM n WHERE s = 'c' AND node->>'$.kind' = 't1' AND (node->>'$.data.id') IS NOT NULL
        UNION ALL SELECT body_id, 'comment', node->>'$.id', parent, node->>'$.text' FROM n WHERE s = 'h' AND (node->>'$.id') IS NOT NULL
        UNION ALL SELECT body_id, 'answer', i->>'$.answer_id', coalesce(i->>'$.question_id', ''), i->>'$.body' FROM so WHERE (i->>'$.answer_id') IS NOT NULL
        UNION ALL SELECT body_id, 'comment', c->>'$.comment_id', a, c->>'$.body' FROM sc WHERE (c->>'$.comment_id') IS NOT NULL AND a IS NOT NULL""",
    "p1_threads": _WALK
    + r"""
        SELECT body_id, node->>'$.data.id' AS node_key, parent AS parent_key, node->>'$.data.author' AS author, TRY_CAST(node->>'$.data.score' AS INTEGER) AS score, node->>'$.data.body' AS body
        FROM n WHERE s = 'c' AND node->>'$.kind' = 't1' AND (node->>'$.data.id') IS NOT NULL""",
    "p1_answers": _WALK
    + r"""
        SELECT body_id, i->>'$.answer_id' AS node_key, coalesce(i->>'$.question_id', '') AS parent_key, TRY_CAST(i->>'$.score' AS INTEGER) AS score, TRY_CAST(i->>'$.is_accepted' AS BOOLEAN) AS is_accepted, i->>'$.body' AS body
        FROM so WHERE (i->>'$.answer_id') IS NOT NULL""",
    "p1_repos": _WALK
    + r"""
        SELECT body_id, j->>'$.full_name' AS node_key, '' AS parent_key, j->>'$.description' AS description, j->>'$.language' AS language, TRY_CAST(j->>'$.stargazers_count' AS INTEGER) AS stargazers_count
        FROM v WHERE extractor = 'github_repo' AND (j->>'$.full_name') IS NOT NULL""",
}
