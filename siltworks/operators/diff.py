"""Word diffs between versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that may differ on either side after common ends are cut.
MAX_WORDS = 2000


def diff_words(prev: str, cur: str) -> tuple[str, str]:
    """(diff, error): runs of '- word' lines before '+ word' lines, '' if equal; an error if the differing parts are too long."""
    a, b = prev.split(), cur.split()
    s = 0
    while s < min(len(a), len(b)) and a[s] == b[s]:
        s += 1
    e = 0
    while e < min(len(a), len(b)) - s and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[s : len(a) - e], b[s : len(b) - e]
    if len(a) > MAX_WORDS or len(b) > MAX_WORDS:
        return "", "too large"
    ids = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    x, y = np.array([ids[w] for w in a], np.int64), np.array([ids[w] for w in b], np.int64)
    # lengths of longest common subsequences of suffixes, a row at a time
    table = np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i in range(len(a) - 1, -1, -1):
        best = np.maximum(table[i + 1, :-1], np.where(y == x[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out: list[str] = []
    gone: list[str] = []
    new: list[str] = []

    def flush() -> None:
        out.extend(f"- {w}\n" for w in gone)
        out.extend(f"+ {w}\n" for w in new)
        gone.clear()
        new.clear()

    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            flush()
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and table[i + 1, j] >= table[i, j + 1]:
            gone.append(a[i])
            i += 1
        else:
            new.append(b[j])
            j += 1
    flush()
    return "".join(out), ""


def word_diffs(pairs: DataFrame, id_col: str, prev: str, cur: str) -> DataFrame:
    """(id, diff, error) of each pair of versions; null versions are empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [diff_words(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["id", "diff", "error"])

    return pairs.select(F.col(id_col).cast("bigint").alias("id"), F.col(prev).cast("string"), F.col(cur).cast("string")).mapInArrow(run, "id bigint, diff string, error string")
