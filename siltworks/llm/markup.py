"""Markup residue in text documents: which kinds a text carries, and clean text with its structure.

A text becomes a sequence of leaves (its lines, each with the path of open elements and
fences). A bidirectional LSTM in numpy reads the sequence. A leaf is the sum of the hashed
vectors of its marks, the mean of those of its words, and the vector of its tag path; both
directions give every leaf the context of the whole document. Two heads give each leaf the
probability of each kind of markup (html, markdown, wiki, latex) and its role (text, heading,
list, code, formula, table, quote). The network decides: a record carries a kind if one of its
leaves reaches ``DECIDE``.

A mark is a run of one non-letter with the classes of the characters around it, a command, a
tag or an entity; delimiters that open and later close are a further mark. What a mark means
is learnt: the labels come from markup planted in clean lines (``planting``), never from
patterns. The weights are fitted once (``python -m siltworks.llm.markup_fit``) and travel with
the package; every query reads the same ones.

Defined results: null and empty texts carry nothing; markup shown inside fences, pre or code
does not count, the fences, spans and tags themselves do; texts of any length are read whole,
in windows of ``WINDOW`` leaves; repeated rows are each judged.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import API_SHAPES, flatten_nested
from ..session import table

KINDS = ("html", "markdown", "wiki", "latex")
ROLES = ("text", "heading", "list", "code", "formula", "table", "quote")
#: Leaves of a window, probability from which a leaf carries a kind.
WINDOW, DECIDE = 128, 0.5
#: Hashed vectors of marks, of words, and of tag paths; their width; width of each direction.
MARKS, WORDS, PATHS, WIDTH, HIDDEN = 4096, 1024, 128, 16, 16
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "markup_weights.npz")

_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_SPAN = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_CODE = re.compile(r"(<code\b[^<>]*>).*?(</code>|$)|(<pre\b[^<>]*>).*?(</pre>|$)", re.I)
_OPEN = re.compile(r"<(/?)(pre|code|ul|ol|li|table|tr|td|th|blockquote|div|details|p|h[1-6])\b[^<>]*?(/?)>", re.I)
_NESTING = frozenset("pre code ul ol table blockquote div details".split())
_MARK = re.compile(r"\\[a-zA-Z]+\*?|\\.|<!--|</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<[a-z]+:[^\s<>]+>|&#?\w{2,10};|\d+[.)](?=\s)|([^\w\s.,;?!\"%/@“”‘’„…—–«»·€£¥©°±¿¡�()\x00-\x1f])\1*|(?<!\w)_+|_+(?!\w)|[_(](?=[{\[])|\]\(|\]\[|:\s*//|^\s*[;:]+")
_PAIRED = frozenset(["*", "**", "***", "_", "__", "`", "~~", "$", "$$", "''", "'''", "'''''", "==", "|"])
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[^<>]*)?/?>|<!--.*?-->|<!DOCTYPE[^>]*>", re.I)


def leaves(text: str) -> list[tuple[str, str]]:
    """(line, path) of every line that is not blank; path names the fence or elements it stands in."""
    out: list[tuple[str, str]] = []
    fence, stack = "", []
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line[m.end() :].strip():
                fence = ""
                out.append((line, "fence/edge"))
            elif line.strip():
                out.append((line, "fence"))
            continue
        if m and "pre" not in stack:
            fence = m.group(1)
            out.append((line, "fence/edge"))
            continue
        if line.strip():
            out.append((line, "/".join(stack[-3:])))
        if "<" in line:
            for close, tag, _ in _OPEN.findall(line):
                tag = tag.lower()
                if tag not in _NESTING:
                    continue
                if not close:
                    if len(stack) < 64:
                        stack.append(tag)
                elif tag in stack:
                    while stack.pop() != tag:
                        pass
    return out


def _class(c: str) -> str:
    return "a" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else c


def marks(line: str, path: str) -> list[str]:
    """The marks of a leaf as text."""
    if "pre" in path or "code" in path:
        end = re.search(r"</(?:pre|code)>", line, re.I)
        if path == "fence" or not end:
            return []
        line = line[end.start() :]
    if path == "fence":
        return []
    if "`" in line:
        line = _SPAN.sub(lambda m: m.group(1) + "\x01" + m.group(1), line)
    if "<" in line:
        line = _CODE.sub(lambda m: (m.group(1) or m.group(3)) + (m.group(2) or m.group(4) or ""), line)
    out, opened = [], {}
    n = len(line)
    for m in _MARK.finditer(line):
        a, b = m.span()
        t = m.group()
        first = t[0]
        left = "^" if a == 0 or line[:a].isspace() else _class(line[a - 1])
        right = "$" if b >= n else _class(line[b])
        if first == "<" and len(t) > 2:
            name = re.match(r"</?[a-zA-Z0-9]+|<!--|<", t).group().lower()
            out.append("<@>" if name == "<" or "://" in t[:12] else "<t>")
            out.append(name)
            out.append(left + "<")
        elif first == "&" and len(t) > 2:
            out += ["&;", t.lower()]
        elif first == "\\" and len(t) > 1:
            out += ["\\a" + right if t[1].isalpha() else t + right, left + t if right in "{[" else t, left + "\\a" + right]
        elif first.isdigit():
            out.append(left + "0" + t[-1])
        else:
            if len(t) > 6:
                t = t[:6]
            t = t.strip() or t
            out.append(left + t + right)
            out.append(t + right if left in "^ a0" else left + t)
            if t in _PAIRED:
                if t in opened and left not in " ^" and not (right.isalnum() and first != "|"):
                    out.append("P" + t)
                    out.append("P" + t + opened.pop(t)[0] + left)
                elif right not in " $" and not left.isalnum() or t == "|" and left == "^":
                    opened[t] = (right, len(out))
    if "P$" in out:  # what stands between the dollars
        out += ["in$" + c for c in set(re.findall(r"[\\^_={+<]", line[line.find("$") :]))]
    return out


class _Ids(dict):
    def __init__(self, cells: int):
        self.cells = cells

    def __missing__(self, t: str) -> int:
        if len(self) > 300_000:
            self.clear()
        i = self[t] = xxhash.xxh32_intdigest(t) % self.cells
        return i


class Features:
    """Ids of the marks, words and paths of leaves; those of short leaves are kept."""

    def __init__(self) -> None:
        self.marks, self.words, self.paths = _Ids(MARKS - 32), _Ids(WORDS - 1), _Ids(PATHS)
        self.short: dict[tuple[str, str], tuple[list[int], list[int]]] = {}

    def of(self, line: str, path: str) -> tuple[list[int], list[int]]:
        known = self.short.get((line, path))
        if known is not None:
            return known
        m = list(set(map(self.marks.__getitem__, marks(line, path))))
        m.append(MARKS - 32 + min(len(line) // 20, 15))  # length class
        m.append(MARKS - 16 + min(len(line) - len(line.lstrip()), 7))  # indent
        w = list(set(map(self.words.__getitem__, line.lower().split()))) or [WORDS - 1]
        if len(line) <= 80:
            if len(self.short) > 100_000:
                self.short.clear()
            self.short[line, path] = (m, w)
        return m, w


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM over leaf vectors with two linear heads, trained by Adam on whole windows."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 11):
        if weights is not None:
            self.w = weights
            return
        r = np.random.default_rng(seed)
        d, h = 3 * WIDTH, HIDDEN
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        e = lambda n: (0.2 * r.standard_normal((n, WIDTH))).astype(np.float32)
        self.w = {
            "mark": e(MARKS), "word": e(WORDS), "path": e(PATHS),
            "xf": f(d, 4 * h), "hf": f(h, 4 * h), "bf": np.zeros(4 * h, np.float32), "xb": f(d, 4 * h), "hb": f(h, 4 * h), "bb": np.zeros(4 * h, np.float32),
            "ok": f(2 * h + d, len(KINDS)), "bk": np.full(len(KINDS), -2, np.float32), "or": f(2 * h + d, len(ROLES)), "br": np.zeros(len(ROLES), np.float32),
        }

    def inputs(self, tokens: list[tuple[list[int], list[int]]], paths: list[int]) -> np.ndarray:
        both = []
        for k, name in enumerate(("mark", "word")):
            flat = np.fromiter(chain.from_iterable(t[k] for t in tokens), np.int64)
            size = np.array([len(t[k]) for t in tokens])
            total = np.add.reduceat(self.w[name][flat], np.concatenate(([0], np.cumsum(size)[:-1])))
            both.append(total if k == 0 else total / size[:, None].astype(np.float32))
        return np.hstack((*both, self.w["path"][np.array(paths)]))

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """x: time, window, width; mask: time, window. Hidden states, zero where masked."""
        t, b, _ = x.shape
        n, wh = HIDDEN, self.w["h" + side]
        pre = x @ self.w["x" + side] + self.w["b" + side]
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out = np.zeros((t, b, n), np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = pre[k] + h @ wh
            i, f, o, g = _sig(z[:, :n]), _sig(z[:, n : 2 * n] + 1), _sig(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            c2 = f * c + i * g
            th = np.tanh(c2)
            h2 = o * th
            m = mask[k][:, None]
            if keep is not None:
                keep.append((k, i, f, o, g, c, th, h, m))
            c, h = m * c2 + (1 - m) * c, m * h2 + (1 - m) * h
            out[k] = m * h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        kf, kb = ([], []) if keep is not None else (None, None)
        s = np.concatenate((self._run(x, mask, "f", kf), self._run(x, mask, "b", kb), x), axis=2)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "s": s}
        return s @ self.w["ok"] + self.w["bk"], s @ self.w["or"] + self.w["br"]

    def _back(self, kept: list, dh_out: np.ndarray, x: np.ndarray, side: str, grad: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh = np.zeros(dh_out.shape[1:], np.float32)
        dc = np.zeros_like(dh)
        for k, i, f, o, g, c, th, h, m in reversed(kept):
            d = (dh + dh_out[k]) * m
            pass_h, pass_c = dh * (1 - m), dc * (1 - m)
            dcc = dc * m + d * o * (1 - th * th)
            dz = np.hstack((dcc * g * i * (1 - i), dcc * c * f * (1 - f), d * th * o * (1 - o), dcc * i * (1 - g * g)))
            grad["h" + side] += h.T @ dz
            grad["x" + side] += x[k].T @ dz
            grad["b" + side] += dz.sum(0)
            dx[k] = dz @ self.w["x" + side].T
            dh = dz @ self.w["h" + side].T + pass_h
            dc = dcc * f + pass_c
        return dx

    def train(self, docs: list[tuple[list[tuple[str, str]], np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.01, batch: int = 48) -> None:
        """docs: (leaves, kinds as 0 or 1, roles) of each document."""
        feats = Features()
        windows = []
        for doc, kinds, roles in docs:
            for a in range(0, len(doc), WINDOW):
                part = doc[a : a + WINDOW]
                windows.append(([feats.of(*leaf) for leaf in part], [feats.paths[p] for _, p in part], kinds[a : a + WINDOW].astype(np.float32), roles[a : a + WINDOW]))
        r = np.random.default_rng(5)
        m1, m2, step = {}, {}, 0
        for _ in range(epochs):
            windows.sort(key=lambda w: len(w[0]))
            groups = [windows[a : a + batch] for a in range(0, len(windows), batch)]
            for g in r.permutation(len(groups)):
                step += 1
                done = step / (epochs * len(groups))
                self._step(groups[g], m1, m2, step, rate * (1 if done < 0.5 else 0.3 if done < 0.8 else 0.1))

    def _step(self, group: list, m1: dict, m2: dict, step: int, rate: float) -> None:
        tokens = [t for w in group for t in w[0]]
        paths = np.array([p for w in group for p in w[1]])
        rows, x, mask, put = _padded([len(w[0]) for w in group], self.inputs(tokens, list(paths)))
        kept: dict = {}
        lk, lr = self.logits(x, mask, kept)
        yk = np.zeros_like(lk)
        yk[put] = np.concatenate([w[2] for w in group])
        n = mask.sum()
        weight = mask[..., None] / n
        dk = (_sig(lk) - yk) * weight
        e = np.exp(lr - lr.max(2, keepdims=True))
        dr = e / e.sum(2, keepdims=True)
        roles = np.concatenate([w[3] for w in group])
        dr[put[0], put[1], roles] -= 1
        dr *= mask[..., None] / n
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = kept["s"]
        flat = s.reshape(-1, s.shape[2])
        grad["ok"], grad["bk"] = flat.T @ dk.reshape(-1, len(KINDS)), dk.sum((0, 1))
        grad["or"], grad["br"] = flat.T @ dr.reshape(-1, len(ROLES)), dr.sum((0, 1))
        ds = dk @ self.w["ok"].T + dr @ self.w["or"].T
        h = HIDDEN
        dx = ds[..., 2 * h :] + self._back(kept["f"], ds[..., :h], x, "f", grad) + self._back(kept["b"], ds[..., h : 2 * h], x, "b", grad)
        dx = dx[put]
        for k, name in enumerate(("mark", "word")):
            size = np.array([len(t[k]) for t in tokens])
            part = dx[:, k * WIDTH : (k + 1) * WIDTH]
            np.add.at(grad[name], np.fromiter(chain.from_iterable(t[k] for t in tokens), np.int64), np.repeat(part / (size[:, None] if k else 1), size, axis=0))
        np.add.at(grad["path"], paths, dx[:, 2 * WIDTH :])
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m1[k] = 0.9 * m1.get(k, 0) + 0.1 * g
            m2[k] = 0.99 * m2.get(k, 0) + 0.01 * g * g
            self.w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def label(self, docs: list[list[tuple[str, str]]], feats: Features) -> list[tuple[np.ndarray, np.ndarray]]:
        """(kind probabilities, role index) of the leaves of each document."""
        parts = [(d, a) for d, doc in enumerate(docs) for a in range(0, len(doc), WINDOW)]
        out = [(np.zeros((len(doc), len(KINDS)), np.float32), np.zeros(len(doc), np.int64)) for doc in docs]
        parts.sort(key=lambda p: min(WINDOW, len(docs[p[0]]) - p[1]))
        for g in range(0, len(parts), 64):
            group = parts[g : g + 64]
            own = [docs[d][a : a + WINDOW] for d, a in group]
            flat = [leaf for w in own for leaf in w]
            _, x, mask, put = _padded([len(w) for w in own], self.inputs([feats.of(*leaf) for leaf in flat], [feats.paths[p] for _, p in flat]))
            lk, lr = self.logits(x, mask)
            pk, pr, at = _sig(lk[put]), lr[put].argmax(1), 0
            for (d, a), w in zip(group, own):
                out[d][0][a : a + len(w)] = pk[at : at + len(w)]
                out[d][1][a : a + len(w)] = pr[at : at + len(w)]
                at += len(w)
        return out


def _padded(sizes: list[int], flat: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    t, b = max(sizes), len(sizes)
    put = (np.concatenate([np.arange(n) for n in sizes]), np.repeat(np.arange(b), sizes))
    x, mask = np.zeros((t, b, flat.shape[1]), np.float32), np.zeros((t, b), np.float32)
    x[put], mask[put] = flat, 1
    return t, x, mask, put


def load_weights(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def _labelled(records: DataFrame, weights: dict[str, np.ndarray] | None, emit, schema: str) -> DataFrame:
    """emit(ids, leaves and labels) for the records (tab, rec_id, text) in groups; one pass, no shuffle."""
    sent = records.sparkSession.sparkContext.broadcast(weights or load_weights())  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, feats = Labeller(sent.value), Features()
        for batch in batches:
            tabs, ids, texts = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(ids), 256):
                docs = [leaves(t) if t else [] for t in texts[a : a + 256]]
                got = emit(list(zip(tabs[a : a + 256], ids[a : a + 256], docs, labeller.label(docs, feats))))
                if got is not None:
                    yield got

    return records.mapInArrow(run, schema)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types)) if rows else None


def markup_kinds(records: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(tab, rec_id, markup) of the records (tab, rec_id, text), one row per kind that a leaf carries by the network's judgement."""

    def emit(group: list) -> pa.RecordBatch | None:
        rows = [(tab, i, KINDS[k]) for tab, i, doc, (p, _) in group if doc for k in np.flatnonzero(p.max(axis=0) >= DECIDE)]
        return _batch(rows, {"tab": pa.string(), "rec_id": pa.int64(), "markup": pa.string()})

    return _labelled(records, weights, emit, "tab string, rec_id bigint, markup string")


_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+\"[^\"]*\")?\)"), r"\1"), (re.compile(r"\[\[(?:File|Image|Category|Datei|Fichier):[^\[\]]*\]\]", re.I), ""), (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]"), r"\1"),
    (re.compile(r"\[https?://[^\s\]]+[ \t]+([^\]\n]+)\]"), r"\1"), (re.compile(r"'{2,3}([^'\n]+)'{2,3}"), r"\1"), (re.compile(r"(?<!~)~{3,5}(?!~)"), ""), (re.compile(r"\*\*([^*\n]+)\*\*"), r"\1"), (re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])"), r"\1"), (re.compile(r"`+([^`\n]+)`+"), r"\1"),
    (re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}"), ""), (re.compile(r"\\(?:textbf|textit|emph|texttt|underline|section|subsection|href\{[^}]*\})\*?\{([^{}]*)\}"), r"\1"), (re.compile(r"\\(?:cite|label|ref|footnote)\{[^{}]*\}"), ""),
)


def clean_text(doc: list[tuple[str, str]], roles: np.ndarray) -> str:
    """The leaves without markup; headings keep '#', lists '-', formulas their source, code its lines between fences."""
    out: list[str] = []
    in_code = False
    for (line, path), r in zip(doc, roles):
        name = "code" if path == "fence" else ROLES[r]
        if path == "fence/edge":
            continue
        if name == "code":
            bare = html.unescape(_TAG.sub("", line)) if path != "fence" else line
            if bare.strip():
                if not in_code:
                    out.append("```")
                in_code = True
                out.append(bare.rstrip())
            continue
        if in_code:
            out.append("```")
            in_code = False
        s = line.strip()
        math: list[str] = []

        def hold(m: re.Match) -> str:
            math.append(m.group())
            return f"\x00{len(math) - 1}\x00"

        s = re.sub(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[\\^_][^$\n]*\$|\\begin\{(equation|align)\*?\}.*?\\end\{\1\*?\}", hold, s)
        level = len(m.group(1)) if (m := re.match(r"(#{1,6})\s", s)) else len(m.group(1)) if (m := re.match(r"(={2,6})", s)) else 2
        s = re.sub(r"^(?:#{1,6}\s+|>\s?|={2,6}\s*)|\s*={2,6}$", "", s) if name in ("heading", "quote") else s
        s = re.sub(r"\s*\\item\s*", "\n- ", s) if "\\item" in s else s
        s = re.sub(r"<li\b[^>]*>", "\n- ", s, flags=re.I)
        s = re.sub(r"</?(?:td|th)\b[^>]*>", " | ", s, flags=re.I)
        s = re.sub(r"<br\s*/?>", "\n", s, flags=re.I)
        for p, to in _INLINE:
            s = p.sub(to, s)
        s = html.unescape(_TAG.sub("", s))
        s = re.sub(r"\x00(\d+)\x00", lambda m: math[int(m.group(1))], s)
        if name == "table" and re.fullmatch(r"[|\s:{}-]*", s):
            continue
        s = re.sub(r"[ \t]+", " ", s).strip()
        if s:
            out.append(("#" * level + " " + s) if name == "heading" else s)
    if in_code:
        out.append("```")
    return "\n".join(out)


def cleaned(records: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(tab, rec_id, text, headings, lists, code, formulas) of the records, converted to clean text."""

    def emit(group: list) -> pa.RecordBatch | None:
        rows = [(tab, i, clean_text(doc, r), *(int((r == ROLES.index(x)).sum()) for x in ("heading", "list", "code", "formula"))) for tab, i, doc, (_, r) in group]
        return _batch(rows, {"tab": pa.string(), "rec_id": pa.int64(), "text": pa.string()} | dict.fromkeys(("headings", "lists", "code", "formulas"), pa.int32()))

    return _labelled(records, weights, emit, "tab string, rec_id bigint, text string, headings int, lists int, code int, formulas int")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, text): markdown of items, and body fields of questions, answers and issues."""
    items = table(spark, sf_dir, "batch_item").select(F.lit("batch_item").alias("tab"), F.col("item_id").alias("rec_id"), F.col("markdown").alias("text"))
    shapes = {k: API_SHAPES[k] for k in ("github_repo", "stackoverflow")}
    nodes = flatten_nested(table(spark, sf_dir, "api_body").where(F.col("status").between(200, 299)), shapes)
    bodies = nodes.where(F.col("entity").isin("question", "answer", "issue")).select(F.lit("api_body").alias("tab"), F.col("id").alias("rec_id"), F.element_at("attrs", 3).alias("text"))
    return items.unionByName(bodies).where("text is not null and text <> ''")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of markup in items and API bodies."""
    return markup_kinds(records(spark, sf_dir)).distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of items and API bodies with counts of the structure that was kept."""
    return cleaned(records(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
