"""Fits the labeller of ``markup`` to planted documents and writes its weights.

    python -m siltworks.llm.markup_fit SF_DIR [OUT]

Clean lines come from ``documents.text``: a bounded sample (LINES lines without any mark). The
test documents are planted in lines that no training document uses.
"""

from __future__ import annotations

import re
import sys

import numpy as np

from .markup import DECIDE, KINDS, ROLES, WEIGHTS, Features, Labeller, leaves
from .planting import Line, documents

#: Clean lines, planted documents for training and for the test.
LINES, TRAIN, TEST = 20_000, 9_000, 2_000
_CLEAN = re.compile(r"[\w ,.;:?!“”‘’„«»€£$—–%’()'-]{15,400}")


def clean_lines(texts: list[str]) -> list[str]:
    out: dict[str, None] = {}
    for text in texts:
        for line in text.split("\n"):
            s = line.strip()
            if _CLEAN.fullmatch(s) and "_" not in s and "''" not in s and not s.startswith(("-", "'")) and not re.match(r"\d+[.)]", s) and not re.search(r"\$\D|(?<!\w)-(?!\w)", s):
                out[s] = None
    return list(out)


def labelled(doc: list[Line]) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
    """Leaves with the labels of the planted lines; blank lines stand between some."""
    found = leaves("\n".join(line for line, _, _ in doc))
    kept = [x for x in doc if x[0].strip()]
    kinds = np.array([[k in x[1] for k in KINDS] for x in kept], np.float32).reshape(-1, len(KINDS))
    return found, kinds, np.array([ROLES.index(x[2]) for x in kept], np.int64)


def scores(labeller: Labeller, docs: list) -> dict[str, tuple[float, float, float, float]]:
    """Of each kind: precision and recall by leaf, then by document."""
    got = labeller.label([d for d, _, _ in docs], Features())
    leaf_p = np.concatenate([p for p, _ in got]) >= DECIDE
    leaf_y = np.concatenate([k for _, k, _ in docs]) > 0
    doc_p = np.array([(p >= DECIDE).any(axis=0) for p, _ in got])
    doc_y = np.array([(k > 0).any(axis=0) for _, k, _ in docs])
    out = {}
    for k, name in enumerate(KINDS):
        one = []
        for p, y in ((leaf_p[:, k], leaf_y[:, k]), (doc_p[:, k], doc_y[:, k])):
            both = (p & y).sum()
            one += [both / max(1, p.sum()), both / max(1, y.sum())]
        out[name] = tuple(round(float(x), 4) for x in one)
    return out


def fit(texts: list[str], train: int = TRAIN, epochs: int = 8) -> tuple[Labeller, dict]:
    lines = clean_lines(texts)[:LINES]
    cut = len(lines) * 4 // 5
    labeller = Labeller()
    labeller.train([labelled(d) for d in documents(lines[:cut], train, 1)], epochs=epochs)
    return labeller, scores(labeller, [labelled(d) for d in documents(lines[cut:], TEST, 2)])


def main() -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sys.argv[1]}/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    labeller, test = fit(texts)
    for kind, s in test.items():
        print(kind, "precision, recall by leaf and by document:", *s)
    np.savez_compressed(sys.argv[2] if len(sys.argv) > 2 else WEIGHTS, **{k: v.astype(np.float16) for k, v in labeller.w.items()})


if __name__ == "__main__":
    main()
