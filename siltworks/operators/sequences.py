"""Operators over ordered sequences: sliding rates, folds with resets, latest and previous versions.

A fold whose every step needs the state before it can't be split within a key. Its events are
hashed by key, sorted within partitions (spilling as needed) and walked as a stream: memory is
one Arrow batch and one state, however many events a key has, and nothing is gathered. A
streaming twin keeps the same state across batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# Fixed values of the healing window and of adaptive pacing.
WINDOW, THRESHOLD, RETAINED = 50, 0.30, 3
BACKOFF_CAP_S, RETRY_AFTER_CAP_S = 60.0, 300.0


def null_rate(events: DataFrame, keys: list[str], order: list[str], is_null: str, window: int = WINDOW) -> DataFrame:
    """Share of nulls among the last ``window`` outcomes of each key, at every outcome."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, Window.currentRow)
    return events.withColumn("null_rate", F.avg(F.col(is_null).cast("double")).over(w)).withColumn("seen", F.count("*").over(w))


def walked(events: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, last: Callable | None, out: str, kinds: list[pa.DataType]) -> DataFrame:
    """Each key's rows in order through step(state, row) -> (state, output values or None); last(state) ends a key.

    Rows are tuples of the columns after the keys. The output holds the keys and the values.
    """
    names = [f.split()[0] for f in out.split(", ")]
    n = len(keys)
    ordered = events.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != row[:n] or state is None:
                    if state is not None and last is not None:
                        rows.append((*key, *last(state)))
                    key, state = row[:n], start()
                state, value = step(state, row[n:])
                if value is not None:
                    rows.append((*key, *value))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if state is not None and last is not None:
            rows.append((*key, *last(state)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return ordered.mapInArrow(run, out)


def heal_step(ring: tuple[bool, ...], null: bool, window: int = WINDOW, threshold: float = THRESHOLD) -> tuple[tuple[bool, ...], bool]:
    """(ring, fired): the ring takes the outcome; a full enough ring beyond the threshold fires and empties."""
    ring = (*ring, bool(null))[-window:]
    fire = len(ring) >= window // 5 and sum(ring) / len(ring) > threshold
    return (() if fire else ring), fire


def heal_triggers(events: DataFrame, keys: list[str], seq: str, is_null: str, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, seq) of every outcome at which a key's null rate passes the threshold; the ring starts anew after each.

    Keys come out as strings; outcomes that are null count as present.
    """

    def step(ring: tuple, row: tuple) -> tuple:
        ring, fire = heal_step(ring, row[1], window, threshold)
        return ring, (row[0],) if fire else None

    wanted = events.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(seq).cast("bigint").alias(seq), F.coalesce(F.col(is_null), F.lit(False)).alias("_null"))
    return walked(wanted, keys, [seq], tuple, step, None, ", ".join([*(f"{k} string" for k in keys), f"{seq} bigint"]), [*[pa.string()] * len(keys), pa.int64()])


def retained(events: DataFrame, keys: list[str], order: str, n: int = RETAINED) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest(versions: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def changes(versions: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Every version with its content hash, the one before, and whether it changed; the first is an unchanged baseline."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hashed = versions.withColumn("new_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    return hashed.withColumn("old_hash", F.lag("new_hash").over(w)).withColumn("changed", F.coalesce(F.col("old_hash") != F.col("new_hash"), F.lit(False)))


def throttle_step(delay: float, status: int, retry_after: float | None, floor: float = 1.0) -> float:
    """The next delay of a host: doubled on refusals up to a minute (Retry-After wins up to five), eased by a quarter on success, never below the floor."""
    d = max(delay, floor)
    if status == 429 or 500 <= status <= 599:
        return min(retry_after, RETRY_AFTER_CAP_S) if retry_after is not None and retry_after > 0 else min(2 * d, BACKOFF_CAP_S)
    return max(0.75 * d, floor) if 200 <= status <= 299 else delay


def throttle_delays(events: DataFrame, host: str, seq: str, status: str, retry_after: str | None, floor: float = 1.0) -> DataFrame:
    """(host, delay_s, responses): the delay after all of a host's responses in order; unknown statuses change nothing."""
    wait = F.col(retry_after).cast("double") if retry_after else F.lit(None).cast("double")
    wanted = events.select(F.col(host).cast("string").alias(host), F.col(seq).cast("bigint").alias("_s"), F.coalesce(F.col(status).cast("int"), F.lit(0)).alias("_st"), wait.alias("_ra"))
    return walked(wanted, [host], ["_s"], lambda: (0.0, 0), lambda st, row: ((throttle_step(st[0], row[1], row[2], floor), st[1] + 1), None), lambda st: st, f"{host} string, delay_s double, responses bigint", [pa.string(), pa.float64(), pa.int64()])


#: Rows of one key beyond which running values are worked out in blocks of its order.
HOT_ROWS = 1_000_000


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with running sums and maxima of each key's rows in order, the row itself included.

    Sums and maxima add up over stretches of the order. Where a key holds more than hot_rows rows
    (counted), rows are put into ranges of (key, order), each range is worked out by itself, and
    the totals of a key's earlier ranges, a table of one row per key and range, are carried in:
    no task holds a hot key. The values are the same either way.
    """
    sums, maxima = sums or {}, maxima or {}
    both = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.max, c) for n, c in maxima.items()}

    def window(by: list[str]):
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= hot_rows:
        return df.withColumns({n: f(c).over(window(keys)) for n, (f, c) in both.items()})
    ranged = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(*(f(c).alias(f"_{n}") for n, (f, c) in both.items()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), *(f(F.col(f"_{n}")).over(before).alias(f"_{n}") for n, (f, _) in both.items()))
    own = ranged.withColumns({n: f(c).over(window([*keys, "_range"])) for n, (f, c) in both.items()})
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = own.join(carried, same, "left")
    out = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.col(n) for n in sums} | {n: F.greatest(F.col(f"_{n}"), F.col(n)) for n in maxima}
    return joined.withColumns(out).select(*df.columns, *both)


def admissions(events: DataFrame, host: str, order: str, at_s: str, rate: float = 1.0, burst: int = 3) -> DataFrame:
    """Admission time of each request of a host under a token bucket: with a full bucket at first, request k waits for k - burst tokens.

    The k-th request enters no earlier than the (k - burst)-th plus burst intervals; unfolded this is a running maximum.
    """
    numbered = running(events, [host], [order], {"_k": F.lit(1)})
    led = running(numbered, [host], [order], maxima={"_lead": F.col(at_s) - (F.col("_k") - 1) / rate})
    return led.withColumn("admitted_s", F.greatest(F.col(at_s), F.col("_lead") + (F.col("_k") - 1) / rate - (burst - 1) / rate)).drop("_k", "_lead")


def every_nth(events: DataFrame, keys: list[str], order: list[str], n: int = 25) -> DataFrame:
    """Every n-th row of each key, as flush points."""
    return running(events, keys, order, {"position": F.lit(1)}).withColumn("position", F.col("position").cast("int")).where(F.col("position") % n == 0)


def round_robin(requests: DataFrame, order: list[str], pool: list[str], keys: list[str]) -> DataFrame:
    """Requests of each key dealt over the pool in turn."""
    if not pool:
        raise ValueError("empty pool")
    numbered = running(requests, keys, order, {"_k": F.lit(1)})
    return numbered.withColumn("proxy", F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.col("_k") - 1, F.lit(len(pool))) + 1).cast("int"))).drop("_k")


def retry_schedule(tries: int = 4, start_s: float = 0.5, factor: float = 2.0, cap_s: float = 30.0, budget_s: float = 120.0) -> list[float]:
    """Waits between tries without jitter, as far as the budget goes."""
    out, wait = [], start_s
    for _ in range(tries - 1):
        if sum(out) + wait > budget_s:
            break
        out.append(min(wait, cap_s))
        wait *= factor
    return out
