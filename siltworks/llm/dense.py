"""Sums of fixed-size count arrays over all partitions, with a bounded sample beside them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "part int, counts binary, sample string"
_NAMES = ["part", "counts", "sample"]


def packed(counts: np.ndarray, sample: dict[int, str], part: int) -> pa.RecordBatch:
    """One row: the counts, compressed, and sample texts by their hash."""
    data = zstandard.ZstdCompressor(level=1).compress(counts.astype(np.int64).tobytes())
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([data], pa.binary()), pa.array([json.dumps(list(sample.items()))])], names=_NAMES)


def least(sample: dict[int, str], most: int) -> dict[int, str]:
    return dict(sorted(sample.items())[:most]) if len(sample) > most else sample


#: Rows that one task merges.
FAN = 32


def summed(parts: DataFrame, size: int, most: int) -> tuple[np.ndarray, list[str]]:
    """The sum of all counts and the ``most`` sample texts of least hash: a tree of merging stages, FAN rows to one, each task a stream."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sample, unpack = np.zeros(size, np.int64), {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for data, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total += np.frombuffer(unpack.decompress(data), np.int64)
                sample = least(sample | {int(h): t for h, t in json.loads(texts)}, most)
        yield packed(total, sample, int(np.int64(total.sum()) & 0x7FFFFFFF))

    n = parts.rdd.getNumPartitions()  # a scan without shuffles: nothing runs for this
    n = max(n, 2)  # an empty table has none
    while n > 1:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(merge, SCHEMA)
    rows = parts.collect()  # one row
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(rows[0].counts)), np.int64), [t for _, t in sorted((int(h), t) for h, t in json.loads(rows[0].sample))]
