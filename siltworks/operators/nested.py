"""Deeply nested JSON records to flat tables with parent links.

A shape says, per record kind, which objects are nodes, which field is a node's key and where
its child nodes stand. All bodies of an Arrow batch are indexed together (``jsonindex``): every
value has the index of its parent, so a node's place in the shape is tested by following parent
indices, all nodes of all depths at once. Nodes whose enclosing node fell away go by pointer
doubling, and keys reach the children by a vectorised ``take``. No body, node or level is
visited in Python, and a body of any depth costs what its length costs.

Defined results
- null, empty, truncated or non-JSON bodies, bodies with trailing text, and bodies that lack
  the shape's root give no rows;
- a leading byte-order mark, outer white space and one layer of JSON string quoting are removed;
- absent or null lists have no children, null elements are no nodes, nodes without a key are
  left out together with what they enclose; of a member that occurs twice the last counts;
- numbers and strings serve as keys alike, printed as they stand;
- nodes of equal keys are nodes of their own, told apart by ``seq``; repeated bodies each give
  their own rows;
- other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jsonindex import JsonIndex

NODE_SCHEMA = "id bigint, kind string, seq int, parent_seq int, entity string, node_key string, parent_key string, attrs array<string>"
LINK_SCHEMA = "id bigint, entity string, node_key string, parent_key string"
#: Bytes of JSON indexed in one go; a longer body is indexed alone.
CHUNK_BYTES = 4_000_000
_TRIM = " \t\r\n\ufeff"


@dataclass(frozen=True)
class Node:
    """One kind of node.

    path: fields and, as ``[]``, list steps from the enclosing node to the candidates.
    where: (field, value) pairs that a candidate must have; value None: the field must be absent or null.
    body: field that holds the node's own object ('' for the candidate itself).
    key: field of that object with the node's key. attrs: scalar fields to carry along, each
    ``name`` or ``name:type`` (the type of its column in the node's table).
    children: nodes found below the node's object; recursive: path to nodes of the same kind.
    parent: field of the node's object with the parent's key, if not the enclosing node's.
    """

    entity: str
    path: tuple[str, ...]
    key: str
    where: tuple[tuple[str, str | None], ...] = ()
    body: str = ""
    attrs: tuple[str, ...] = ()
    children: tuple["Node", ...] = ()
    recursive: tuple[str, ...] = ()
    parent: str = ""

    @property
    def columns(self) -> tuple[tuple[str, str], ...]:
        """(field, type) of the carried fields."""
        return tuple((a.partition(":")[0], a.partition(":")[2] or "string") for a in self.attrs)


class Flattener:
    """Flattens JSON bodies of one record kind.

    roots: the root nodes. anchor: entity of the root node that is the parent of the other roots
    of the same body.
    """

    def __init__(self, roots: tuple[Node, ...], anchor: str = ""):
        self.roots, self.anchor = roots, anchor
        #: The kinds of nodes, enclosing ones first; of each: (number of the enclosing kind or -1, path from there), its own kind last.
        self.nodes: list[Node] = []
        self.edges: list[list[tuple[int, tuple[str, ...]]]] = []
        todo = [(node, -1) for node in roots]
        while todo:
            node, above = todo.pop(0)
            me = len(self.nodes)
            self.nodes.append(node)
            self.edges.append([(above, node.path), *([(me, node.recursive)] if node.recursive else [])])
            todo += [(child, me) for child in node.children]
        names: dict[str, None] = {}
        for node in self.nodes:
            names |= dict.fromkeys(x for x in (*node.path, *node.recursive, node.body, node.key, node.parent, *(a for a, _ in node.columns), *(w for w, _ in node.where)) if x not in ("", "[]"))
        self.names = list(names)

    def batches(self, ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, dict[str, pa.Array]]]:
        """(ids of the nodes, their columns) by chunks of bodies; texts without nulls."""
        texts = _unquoted(texts.cast(pa.large_string()))
        size = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy()
        for a, b in _chunks(size, CHUNK_BYTES):
            got = self._nodes(JsonIndex(texts.slice(a, b - a), self.names))
            if got is not None:
                yield ids.slice(a, b - a).take(pa.array(got.pop("row"))), got

    def _nodes(self, j: JsonIndex) -> dict | None:
        if not len(j.kind):
            return None
        everything = np.flatnonzero(j.is_object(np.arange(len(j.kind))))
        found, own_of, total = [], [], 0
        for me, node in enumerate(self.nodes):  # enclosing kinds come first
            at, own, keys = _candidates(j, everything, node)
            above, number = np.full(len(at), -2, np.int64), np.full(len(j.kind), -1, np.int64)  # -1: a root; -2: stands nowhere in the shape
            for parent, path in self.edges[me]:
                up, ok = _climb(j, at, path)
                if parent == me:
                    number[own] = np.arange(len(at))
                    inner = np.flatnonzero(ok & (above == -2) & (number[up] >= 0))
                    # every round doubles the distance to the outermost of a chain
                    jump = np.arange(len(at))
                    jump[inner] = number[up[inner]]
                    chain = jump.copy()
                    while not (chain[chain] == chain).all():
                        chain = chain[chain]
                    live = np.flatnonzero(above[chain] != -2)
                    place = np.full(len(at), -1, np.int64)
                    place[live] = np.arange(len(live))
                    above = np.where(jump != np.arange(len(at)), total + place[jump], above)[live]
                else:
                    held = np.where(j.parent[up] < 0, -1, -2) if parent < 0 else np.where(own_of[parent][up] >= 0, own_of[parent][up], -2)
                    above = np.where(ok, held, -2)
                    live = np.flatnonzero(above != -2) if len(self.edges[me]) == 1 else np.arange(len(at))
                    above = above[live]
                at, own, keys = at[live], own[live], keys[live]
            number[:] = -1
            number[own] = total + np.arange(len(own))
            own_of.append(number)
            total += len(own)
            found.append((at, own, keys, above, np.full(len(at), me)))
        if not total:
            return None
        at, own, keys, above, spec = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        new = np.empty(total, np.int64)
        new[order] = np.arange(total)
        at, own, keys, spec = at[order], own[order], keys[order], spec[order]
        above = np.where(above[order] >= 0, new[np.maximum(above[order], 0)], -1)
        row = j.row[at]
        if self.anchor:
            anchors = np.flatnonzero(np.array([n.entity == self.anchor for n in self.nodes])[spec])
            rows, k = np.unique(row[anchors], return_index=True)
            if len(rows):
                of_row = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
                held = anchors[k][of_row]
                above = np.where((above < 0) & (rows[of_row] == row) & ~np.isin(np.arange(len(row)), anchors), held, above)
        node_keys = j.texts(keys)
        parent_keys = node_keys.take(pa.array(above, mask=above < 0))
        for me, node in enumerate(self.nodes):
            if node.parent and (spec == me).any():
                said = np.where(spec == me, j.member(own, node.parent), -1)
                parent_keys = pc.if_else(pa.array(spec == me), j.texts(said), parent_keys)
                above = np.where(spec == me, -1, above)
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        seq = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        return {
            "row": row,
            "seq": pa.array(seq.astype(np.int32)),
            "parent_seq": pa.array(seq[np.maximum(above, 0)].astype(np.int32), mask=above < 0),
            "entity": pa.array([n.entity for n in self.nodes]).take(pa.array(spec)),
            "node_key": node_keys,
            "parent_key": pc.fill_null(parent_keys, ""),
            "attrs": self._attrs(j, own, spec),
        }

    def _attrs(self, j: JsonIndex, own: np.ndarray, spec: np.ndarray) -> pa.Array:
        size = np.array([len(n.attrs) for n in self.nodes])[spec]
        ends = np.concatenate(([0], np.cumsum(size)))
        values = np.full(int(ends[-1]), -1, np.int64)
        for me, node in enumerate(self.nodes):
            mine = np.flatnonzero(spec == me)
            for k, (name, _) in enumerate(node.columns):
                values[ends[mine] + k] = j.member(own[mine], name)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), j.texts(values).cast(pa.string()))


def _candidates(j: JsonIndex, objects: np.ndarray, node: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, own object, key) of what is such a node by what it holds, wherever it stands."""
    at = objects
    for name, want in node.where:
        text = j.texts(j.member(at, name))
        ok = pc.is_null(text) if want is None else pc.fill_null(pc.equal(text, want), False)
        at = at[ok.to_numpy(zero_copy_only=False)]
    own = j.member(at, node.body) if node.body else at
    at, own = at[j.is_object(own)], own[j.is_object(own)]
    keys = j.member(own, node.key)
    ok = np.flatnonzero(keys >= 0)
    ok = ok[pc.is_valid(j.texts(keys[ok])).to_numpy(zero_copy_only=False)]
    return at[ok], own[ok], keys[ok]


def _climb(j: JsonIndex, at: np.ndarray, path: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(where the path to each value starts, whether it is that path)."""
    up, ok = at, np.ones(len(at), bool)
    for step in reversed(path):
        ok &= j.name[up] == (-2 if step == "[]" else j.names.index(step))
        up = j.parent[up]
        ok &= up >= 0
        up = np.maximum(up, 0)
    return up, ok


def _unquoted(texts: pa.Array) -> pa.Array:
    texts = pc.utf8_trim(texts, characters=_TRIM)
    quoted = pc.starts_with(texts, '"')
    if pc.any(quoted).as_py():
        inner = []
        for text in texts.filter(quoted).to_pylist():  # only rows with the extra layer
            try:
                value = json.loads(text)
            except ValueError:
                value = ""
            inner.append(value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(value, str) else "")
        texts = pc.replace_with_mask(texts, quoted, pc.utf8_trim(pa.array(inner, pa.large_string()), characters=_TRIM))
    return texts


def _chunks(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(ends):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield a, b
        a = b


def _wanted(df: DataFrame, shapes: dict[str, Flattener], id_col: str, kind_col: str, body_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(kind_col).cast("string").alias("kind"), F.col(body_col).cast("string").alias("body")).where(F.col("body").isNotNull() & F.col("kind").isin(list(shapes)))


def _flattened(batch: pa.RecordBatch, shapes: dict[str, Flattener]) -> Iterator[tuple[str, pa.Array, dict[str, pa.Array]]]:
    for kind, flattener in shapes.items():
        part = batch.filter(pc.equal(batch.column("kind"), kind))
        if part.num_rows:
            for ids, columns in flattener.batches(part.column("id"), part.column("body")):
                yield kind, ids, columns


def flatten_nested(df: DataFrame, shapes: dict[str, Flattener], id_col: str = "body_id", kind_col: str = "extractor", body_col: str = "body") -> DataFrame:
    """Every node of nested JSON bodies as a row of NODE_SCHEMA.

    seq numbers the nodes of a body in the order of the text, parent_seq is the number of the node
    that encloses it (null for roots and for parents named by a field). attrs holds the node's
    carried fields in the order of its ``attrs``. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "kind", "seq", "parent_seq", "entity", "node_key", "parent_key", "attrs"]
        for batch in batches:
            for kind, ids, c in _flattened(batch, shapes):
                kinds = pa.array([kind]).take(pa.array(np.zeros(len(ids), np.int64)))
                got = pa.Table.from_arrays([ids, kinds, c["seq"], c["parent_seq"], c["entity"], c["node_key"].cast(pa.string()), c["parent_key"].cast(pa.string()), c["attrs"]], names=names)
                yield from got.to_batches(max_chunksize=20_000)

    return _wanted(df, shapes, id_col, kind_col, body_col).mapInArrow(run, NODE_SCHEMA)


def node_links(df: DataFrame, shapes: dict[str, Flattener], id_col: str = "body_id", kind_col: str = "extractor", body_col: str = "body") -> DataFrame:
    """(id, entity, node_key, parent_key) of every node, equal rows of one body once; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "entity", "node_key", "parent_key"]
        for batch in batches:
            for _, ids, c in _flattened(batch, shapes):
                got = pa.Table.from_arrays([ids, c["entity"], c["node_key"].cast(pa.string()), c["parent_key"].cast(pa.string())], names=names)
                yield from got.group_by(names, use_threads=False).aggregate([]).select(names).combine_chunks().to_batches(max_chunksize=20_000)

    return _wanted(df, shapes, id_col, kind_col, body_col).mapInArrow(run, LINK_SCHEMA)


def node_tables(nodes: DataFrame, shapes: dict[str, Flattener]) -> dict[str, DataFrame]:
    """One typed table per kind and entity, named ``kind_entity``, of the rows that flatten_nested gives.

    Columns: id, seq, node_key, parent_seq, parent_key, then the node's carried fields, each cast
    to its type (null where it doesn't fit). (id, seq) is the key, (id, parent_seq) the link.
    """
    out = {}
    for kind, flattener in shapes.items():
        for node in flattener.nodes:
            fields = [F.expr(f"try_cast(try_element_at(attrs, {k + 1}) as {t})").alias(name) for k, (name, t) in enumerate(node.columns)]
            out[f"{kind}_{node.entity}"] = nodes.where((F.col("kind") == kind) & (F.col("entity") == node.entity)).select("id", "seq", "node_key", "parent_seq", "parent_key", *fields)
    return out


def _listing(*inner: str) -> tuple[str, ...]:
    return (*inner, "data", "children", "[]")


_COMMENT = Node("comment", _listing("[]"), "id", where=(("kind", "t1"),), body="data", attrs=("author", "score:int", "body"), recursive=_listing("replies"))
#: Shapes of the API bodies of this project.
API_SHAPES: dict[str, Flattener] = {
    "reddit": Flattener((Node("post", _listing("[]"), "id", where=(("kind", "t3"),), body="data", attrs=("author", "score:int", "title")), _COMMENT), anchor="post"),
    "hackernews": Flattener((Node("story", (), "id", attrs=("author", "points:int", "title"), children=(Node("comment", ("children", "[]"), "id", attrs=("author", "text"), recursive=("children", "[]")),)),)),
    "github_repo": Flattener(
        (
            Node("repo", (), "full_name", attrs=("description", "language", "stargazers_count:int"), children=(Node("license", ("license",), "spdx_id", attrs=("name",)),)),
            Node("issue", (), "number", attrs=("title", "state", "body"), children=(Node("label", ("labels", "[]"), "name", attrs=("color",)),)),
        )
    ),
    "stackoverflow": Flattener(
        (
            Node("question", ("items", "[]"), "question_id", where=(("answer_id", None),), attrs=("title", "score:int", "body")),
            Node("answer", ("items", "[]"), "answer_id", attrs=("score:int", "is_accepted:boolean", "body"), parent="question_id", children=(Node("comment", ("comments", "[]"), "comment_id", attrs=("body",)),)),
        )
    ),
}
