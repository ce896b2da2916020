"""Index of many JSON documents at once: every value with its parent, found by array operations.

The bytes of a batch lie in one buffer. Quotes, brackets, colons and commas are found for all
documents together; nesting depths are a running sum, and the container of a token is the last
bracket opened one level above it, found by one sorted search. There is no loop over documents,
values or levels, so depth costs nothing.

The grammar of JSON is checked by the same arrays: which token may follow which, whether
brackets match, and the form of numbers, literals, escapes and strings. A document that breaks
it has no values and does not touch its neighbours.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS, _STRUCT, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _WS
_CLASS[[ord(c) for c in "{}[]:,"]] = _STRUCT
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_ESCAPES = np.zeros(256, bool)
_ESCAPES[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_LITERAL = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
_OBJECT, _ARRAY, _STRING, _PLAIN = ord("{"), ord("["), ord('"'), ord("p")
_COLON, _COMMA = ord(":"), ord(",")


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches [start, end) of data as strings."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    at = np.arange(offsets[-1], dtype=np.int64) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def _unescaped(raw: list[str]) -> list[str]:
    """The strings that stand for the escaped ones; lone surrogates become a question mark."""
    return [s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for s in json.loads('["' + '","'.join(raw) + '"]')]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """As slices, of the insides of JSON strings, with their escapes resolved."""
    got = slices(data, start, end)
    escaped = pc.find_substring(got, "\\").to_numpy(zero_copy_only=False) >= 0
    if escaped.any():
        mask = pa.array(escaped)
        got = pc.replace_with_mask(got, mask, pa.array(_unescaped(got.filter(mask).to_pylist()), pa.large_string()))
    return got


class JsonIndex:
    """Values of the documents ``texts`` (no nulls).

    kind: the byte ``{``, ``[``, ``"`` or ``p`` (number or literal); start, end: its bytes, strings without their quotes;
    parent: the enclosing container, -1 for the document's own value; name: place of its member name
    in ``names``, -1 for other names, -2 for list items and documents; row: its document.
    Values stand in the order of their text.
    """

    def __init__(self, texts: pa.Array, names: list[str]):
        lines = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        lines = pa.concat_arrays([lines])
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        whole = lines.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[: offsets[-1]] if whole else np.zeros(0, np.uint8)
        self.data, self.rows, self.names = data, len(texts), names
        begins = offsets[:-1]
        bad = np.zeros(len(texts), bool)

        def row_of(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(begins, at, side="right") - 1

        quote = data == 0x22
        back = np.flatnonzero(data == 0x5C)
        if len(back):
            first = np.flatnonzero(np.diff(back, prepend=-9) != 1)
            size = np.diff(np.append(first, len(back)))
            odd = size % 2 == 1
            escaped = (back[first] + size)[odd]
            quote[escaped] = False
            wrong = ~_ESCAPES[data[escaped]]
            units = escaped[data[escaped] == ord("u")]
            digits = np.minimum(units[:, None] + np.arange(1, 5), len(data) - 1)
            bad[row_of(escaped[wrong])] = True
            bad[row_of(units[~_HEX[data[digits]].all(axis=1)])] = True
        quotes = np.bincount(row_of(np.flatnonzero(quote)), minlength=len(texts))
        bad |= quotes % 2 == 1
        if bad.any():  # quotes of broken documents must not shift the others
            quote &= ~np.repeat(bad, np.diff(offsets))
        inside = (np.cumsum(quote, dtype=np.uint8) & 1).astype(bool)
        bad[row_of(np.flatnonzero(inside & (data < 0x20)))] = True
        outside = ~(inside | quote)
        kinds = _CLASS[data]
        marks = np.flatnonzero(outside & (kinds == _STRUCT))
        edge = np.flatnonzero(np.diff((outside & (kinds == _OTHER)).view(np.int8), prepend=0, append=0))
        ends = np.flatnonzero(quote)
        start = np.concatenate((marks, ends[::2], edge[::2]))
        end = np.concatenate((marks + 1, ends[1::2], edge[1::2]))
        kind = np.concatenate((data[marks], np.full(len(ends) // 2, _STRING, np.uint8), np.full(len(edge) // 2, _PLAIN, np.uint8)))
        order = np.argsort(start, kind="stable")
        start, end, kind = start[order], end[order], kind[order]
        row = row_of(start)
        plain = kind == _PLAIN
        form = pc.match_substring_regex(slices(data, start[plain], end[plain]), _LITERAL).to_numpy(zero_copy_only=False)
        bad[row[plain][~form]] = True
        # brackets that don't close, or close too early
        step = _STEP[kind] * (kind != _STRING)
        bad |= np.bincount(row, weights=step, minlength=len(texts)) != 0
        depth = np.cumsum(step, dtype=np.int64)
        has = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
        if len(has):
            low = np.minimum.reduceat(depth, has) - np.concatenate(([0], depth[has[1:] - 1]))
            bad[row[has][low < 0]] = True
        keep = ~bad[row]
        start, end, kind, row, step = start[keep], end[keep], kind[keep], row[keep], step[keep]
        n = len(kind)
        level = np.cumsum(step, dtype=np.int64)
        opens, closes = step == 1, step == -1
        level[closes] += 1  # brackets stand at the level of their inside
        at = np.flatnonzero(opens)
        keys = level[at] * n + at
        by = np.argsort(keys, kind="stable")
        keys, at = keys[by], at[by]

        def opened(lev: np.ndarray, before: np.ndarray) -> np.ndarray:
            """The last bracket of that level opened before a token, -1 at level 0."""
            k = np.searchsorted(keys, lev * n + before) - 1
            return np.where(lev > 0, at[np.maximum(k, 0)], -1) if len(at) else np.full(len(lev), -1, np.int64)

        idx = np.arange(n, dtype=np.int64)
        holder = opened(level - opens, idx)
        in_object = np.zeros(n, bool)
        in_object[holder >= 0] = kind[holder[holder >= 0]] == _OBJECT
        prev = np.zeros(n, np.uint8)
        prev[1:] = kind[:-1]
        new = np.diff(row, prepend=-1) != 0
        prev[new] = 0
        is_key = (kind == _STRING) & in_object & ((prev == _OBJECT) | (prev == _COMMA))
        after_key = np.zeros(n, bool)
        after_key[1:] = is_key[:-1]
        after_key[new] = False
        value = (opens | (kind == _STRING) | plain[keep]) & ~is_key
        value_end = np.zeros(n, bool)
        value_end[1:] = (value & ~opens | closes)[:-1]
        value_end[new] = False
        good = np.zeros(n, bool)
        good |= value & (new | (prev == _COLON) | ((prev == _ARRAY) | (prev == _COMMA)) & ~in_object & (holder >= 0))
        good |= is_key
        good |= (kind == _COLON) & after_key
        good |= (kind == _COMMA) & value_end & (holder >= 0)
        close_ok = closes & (value_end | (prev == _OBJECT) | (prev == _ARRAY))
        close_ok[closes] &= kind[closes] == kind[np.maximum(holder[closes], 0)] + 2  # '{' and '}', '[' and ']' are two apart
        good |= close_ok
        bad[row[~good]] = True
        tops = np.bincount(row[value & (holder < 0)], minlength=len(texts))
        bad |= tops != 1
        # what a colon leads to has the name before the colon
        name = np.full(n, -2, np.int64)
        named = np.flatnonzero(value & (prev == _COLON))
        named = named[~bad[row[named]]]
        if len(named):
            texts_ = strings(data, start[named - 2] + 1, end[named - 2])
            name[named] = pc.fill_null(pc.index_in(texts_, value_set=pa.array(names, pa.large_string())), -1).to_numpy(zero_copy_only=False)
        chosen = np.flatnonzero(value & ~bad[row])
        place = np.full(n + 1, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        self.kind, self.start, self.end, self.row, self.name = kind[chosen], start[chosen], end[chosen], row[chosen], name[chosen]
        self.start = self.start + (self.kind == _STRING)
        self.parent = place[holder[chosen]]
        self._members = self.parent * (len(names) + 1) + self.name
        self._members[(self.name < 0) | (self.parent < 0)] = -1
        self._order = np.argsort(self._members, kind="stable")
        self._members = self._members[self._order]

    def member(self, of: np.ndarray, name: str) -> np.ndarray:
        """The value of that member of each value, -1 if there is none; the last of several counts."""
        if not len(self._members):
            return np.full(len(of), -1, np.int64)
        want = of * (len(self.names) + 1) + self.names.index(name)
        k = np.maximum(np.searchsorted(self._members, want, side="right") - 1, 0)
        return np.where((of >= 0) & (self._members[k] == want), self._order[k], -1)

    def texts(self, of: np.ndarray) -> pa.Array:
        """Strings as they read, numbers and true and false as they stand; null for null, containers and -1."""
        there = np.maximum(of, 0)
        kind = np.where(of >= 0, self.kind[there], 0) if len(self.kind) else np.zeros(len(of), np.uint8)
        out = np.full(len(of), -1, np.int64)
        quoted, plain = np.flatnonzero(kind == _STRING), np.flatnonzero(kind == _PLAIN)
        plain = plain[self.data[self.start[of[plain]]] != ord("n")]
        out[quoted] = np.arange(len(quoted))
        out[plain] = len(quoted) + np.arange(len(plain))
        both = pa.concat_arrays([strings(self.data, self.start[of[quoted]], self.end[of[quoted]]), slices(self.data, self.start[of[plain]], self.end[of[plain]])])
        return both.take(pa.array(out, mask=out < 0))

    def is_object(self, of: np.ndarray) -> np.ndarray:
        return (of >= 0) & (self.kind[np.maximum(of, 0)] == _OBJECT) if len(self.kind) else np.zeros(len(of), bool)
