"""Sinks: JSON lines, a JSON array, CSV, parquet append, a process per partition, a webhook per change."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Rows of a JSON array document, which is one value in one place.
ARRAY_ROWS = 100_000


class SinkError(RuntimeError):
    """A sink that failed."""


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def corpus_rows(df: DataFrame) -> DataFrame:
    """The corpus projection: url, title, depth, markdown."""
    return df.select("url", "title", "depth", "markdown")


def json_array(df: DataFrame) -> str:
    """All rows as one JSON array in the frame's order; '[]' without rows; more than ARRAY_ROWS are an error."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(ARRAY_ROWS + 1).collect()
    if len(rows) > ARRAY_ROWS:
        raise SinkError("too many rows for one JSON array; write JSON lines")
    return "[" + ",".join(r.j for r in rows) + "]"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, nulls as empty cells; nested columns are an error before writing."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "struct", "map", "variant"))]
    if nested:
        raise SinkError(f"CSV holds no nested columns: {nested}")
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_process(df: DataFrame, command: list[str]) -> DataFrame:
    """Feeds rows as JSON lines to one process per partition; (partition, sent, code, message): failures are told, not raised."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True)
        n = 0
        try:
            for pdf in batches:
                for line in pdf["j"]:
                    p.stdin.write(line + "\n")
                    n += 1
        except BrokenPipeError:
            pass
        try:
            p.stdin.close()
        except BrokenPipeError:
            pass
        message = p.stderr.read()
        yield pd.DataFrame({"partition": [TaskContext.get().partitionId()], "sent": [n], "code": [p.wait()], "message": [message[:2000]]})

    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).mapInPandas(run, "partition int, sent bigint, code int, message string")


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and what can be asked after it has run: the number of its rows, and further aggregates by name. Counted while rows pass, in no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())), seen


def record_hook(each: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands every row of a batch to a function, in the executors; a failing hook fails no batch."""

    def one(rows: Iterator) -> None:
        for r in rows:
            try:
                each(r.asDict(True))
            except Exception:  # a hook must not stop the stream
                continue

    return lambda batch, epoch: batch.foreachPartition(one)


def webhook_payload(row: dict) -> str:
    return json.dumps({k: row.get(k) for k in ("url", "changed", "old_hash", "new_hash", "diff")}, ensure_ascii=False)


def webhook_sink(post: Callable[[str], int], record: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that posts each changed row once; the status or error of each post is recorded, never raised."""

    def each(batch: DataFrame, epoch: int) -> None:
        for r in batch.where("changed").toLocalIterator():
            try:
                record(r.url, str(post(webhook_payload(r.asDict()))))
            except Exception as e:  # a failed hook must not stop the stream
                record(r.url, f"error: {e}")

    return each


def write_records(df: DataFrame, path: str, keys: list[str], at: str = "updated_at") -> int:
    """Puts rows into the keyed record table at path; rows of equal keys are replaced by the latest, so a delivery twice changes nothing.

    Each write is a new version of the table; the number of the version is returned. A version
    counts once it is complete, so a lost writer leaves the table as it was. Older versions stay
    until drop_versions.
    """
    from ..operators.ledger import upserted

    spark = df.sparkSession
    last = _version(spark, path)
    none = spark.createDataFrame([], df.schema)
    merged = upserted(spark.read.parquet(f"{path}/v={last}") if last else none, df, keys)
    merged.write.mode("overwrite").parquet(f"{path}/v={last + 1}")
    return last + 1


def read_records(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={_version(spark, path)}")


def drop_versions(spark, path: str) -> None:
    """Deletes all versions but the last complete one."""
    last = _version(spark, path)
    fs, at = _files(spark, path)
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        if name.startswith("v=") and int(name[2:]) < last:
            fs.delete(s.getPath(), True)


def _files(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _version(spark, path: str) -> int:
    """The last complete version, 0 if there is none."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return 0
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v=") and fs.exists(child(s.getPath(), "_SUCCESS"))]
    return max(done, default=0)
