import json

import random
import time

import pyarrow as pa

from siltworks.operators.jsonindex import JsonIndex
from siltworks.operators.nested import API_SHAPES, flatten_nested, node_links, node_tables

SCHEMA = "body_id bigint, extractor string, body string, id string, entity int"


def nodes(spark, rows):
    df = spark.createDataFrame([(i, e, b, "x", 1) for i, (e, b) in enumerate(rows)], SCHEMA)
    return {tuple(r) for r in node_links(df, API_SHAPES).collect()}


def comment(key, *kids, **more):
    return {"kind": "t1", "data": {"id": key, "replies": {"kind": "Listing", "data": {"children": list(kids)}} if kids else "", **more}}


def thread(*kids):
    return json.dumps([{"kind": "Listing", "data": {"children": [{"kind": "t3", "data": {"id": "p"}}]}}, {"kind": "Listing", "data": {"children": list(kids)}}])


def test_thread_with_more_null_and_scalar_parts(spark):
    body = thread(comment("a", comment("b"), {"kind": "more", "data": {"id": "m"}}, {"kind": "t1", "data": None}), {"kind": "t1", "data": {"author": "no id"}}, None)
    assert nodes(spark, [("reddit", body)]) == {(0, "post", "p", ""), (0, "comment", "a", "p"), (0, "comment", "b", "a")}


def test_any_depth(spark):
    deep = comment("c149")
    for k in range(148, -1, -1):
        deep = comment(f"c{k}", deep)
    got = nodes(spark, [("reddit", thread(deep)), ("reddit", thread(comment("z")))])
    assert (0, "comment", "c149", "c148") in got and (1, "comment", "z", "p") in got and len(got) == 153


def test_story_and_quoting(spark):
    story = {"id": 5, "children": [{"id": 6, "children": None}, {"id": "7"}, {"children": [{"id": 8}]}], "future": {"children": ["x"]}}
    for body in (json.dumps(story), "﻿ " + json.dumps(story), json.dumps(json.dumps(story)), json.dumps(story, indent=1)):
        assert nodes(spark, [("hackernews", body)]) == {(0, "story", "5", ""), (0, "comment", "6", "5"), (0, "comment", "7", "5")}


def test_broken_bodies_give_nothing_and_spare_their_neighbours(spark):
    bad = [None, "", "null", "[1", '{"id": 1', '{"id": 1} x', '{"id": 1} {"id": 2}', "<html>", '{"message": "no"}', '"{\\"id\\": 1"', '{"id": tru}', '1}, {"r": 2', '{"id": {"a": 1}}', '{"a": "\\u00"}']
    got = nodes(spark, [("hackernews", b) for b in bad] + [("hackernews", '{"id": 99}')])
    assert got == {(len(bad), "story", "99", "")}


def test_repository_issue_question(spark):
    rows = [("github_repo", '{"full_name": "o/r", "license": {"spdx_id": "MIT", "name": "x"}}'), ("github_repo", '{"full_name": "o/s", "license": "MIT"}'), ("github_repo", '{"full_name": "o/t", "license": {"spdx_id": null}}'), ("github_repo", '{"number": 3, "labels": [{"name": "bug"}, {"name": "bug"}, {"name": null}, null]}'), ("stackoverflow", '{"items": [{"question_id": 1, "title": "t"}]}'), ("stackoverflow", '{"items": [{"answer_id": 2, "question_id": 1, "comments": [{"comment_id": 9}]}]}')]
    assert nodes(spark, rows) == {(0, "repo", "o/r", ""), (0, "license", "MIT", "o/r"), (1, "repo", "o/s", ""), (2, "repo", "o/t", ""), (3, "issue", "3", ""), (3, "label", "bug", "3"), (4, "question", "1", ""), (5, "answer", "2", "1"), (5, "comment", "9", "2")}


def test_empty_table_and_unknown_kinds(spark):
    assert nodes(spark, []) == set()
    assert nodes(spark, [("other", '{"id": 1}'), (None, '{"id": 1}')]) == set()


def story(depth):
    """A story with a chain of comments, written without recursion."""
    return "".join(f'{{"id": {k}, "children": [' for k in range(depth)) + "]}" * depth


def flat(kind, *bodies):
    rows = []
    for ids, c in API_SHAPES[kind].batches(pa.array(range(len(bodies))), pa.array(list(bodies), pa.string())):
        rows += zip(ids.to_pylist(), *(c[k].to_pylist() for k in ("entity", "node_key", "parent_key", "seq", "parent_seq", "attrs")))
    return rows


def test_depth_costs_nothing():
    bodies = [story(5000), *[story(3)] * 400]
    flat("hackernews", story(3))
    began = time.time()
    rows = flat("hackernews", *bodies)
    assert time.time() - began < 1
    assert [r[:5] for r in rows[:5000]] == [(0, "comment" if k else "story", str(k), str(k - 1) if k else "", k) for k in range(5000)]
    assert len(rows) == 5000 + 3 * 400
    assert len(flat("hackernews", "[" * 100_000 + "]" * 100_000, story(60_000))) == 60_000


def test_equal_keys_are_nodes_of_their_own(spark):
    body = json.dumps({"id": 1, "children": [{"id": 2, "text": "b"}, {"id": 2, "text": "a", "children": [{"id": 3}]}]})
    assert [(r[1], r[4], r[5], r[6][1]) for r in flat("hackernews", body)] == [("story", 0, None, None), ("comment", 1, 0, "b"), ("comment", 2, 0, "a"), ("comment", 3, 2, None)]
    df = spark.createDataFrame([(1, "stackoverflow", '{"items": [{"answer_id": 4, "question_id": 2, "score": "7", "is_accepted": true, "body": "a\\u00e9\\n"}, {"answer_id": 5, "score": "many"}]}')], "body_id bigint, extractor string, body string")
    t = node_tables(flatten_nested(df, API_SHAPES), API_SHAPES)["stackoverflow_answer"]
    assert [tuple(r) for r in t.orderBy("seq").collect()] == [(1, 0, "4", None, "2", 7, True, "aé\n"), (1, 1, "5", None, "", None, None, None)]


def test_index_accepts_what_json_accepts():
    r = random.Random(3)

    def value(depth):
        k = r.randrange(9 if depth < 5 else 6)
        if k < 6:
            return r.choice([1, -2.5, 1e300, True, None, "", 'q"\\', "é\n{}[]:,", "plain", 0])
        if k < 8:
            return {r.choice(["id", "children", "x", 'a"b']): value(depth + 1) for _ in range(r.randrange(4))}
        return [value(depth + 1) for _ in range(r.randrange(4))]

    docs = []
    for _ in range(3000):
        d = json.dumps(value(0), ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 1]))
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(d) + 1)
            d = d[:k] + r.choice(["", "", *'{}[]:,"\\ 01ex\t\n-', "true", "null"]) + d[k + r.randrange(2) :]
        docs.append(d)

    def accepted(d):
        try:
            json.loads(d, parse_constant=lambda c: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    j = JsonIndex(pa.array(docs, pa.string()), ["id", "children", 'a"b'])
    assert sorted(set(j.row.tolist())) == [i for i, d in enumerate(docs) if accepted(d)]

    def count(v):
        return 1 + sum(map(count, v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))

    for i, d in enumerate(docs):
        if accepted(d):
            pairs = []
            json.loads(d, object_pairs_hook=lambda p: pairs.extend(k for k, _ in p) or dict(p))
            assert (j.name[j.row == i] == 0).sum() == pairs.count("id") and (j.name[j.row == i] == 2).sum() == pairs.count('a"b')
