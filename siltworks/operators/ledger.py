"""Run ledger: append-only logs and the roll-ups derived from them. All native, all partial aggregates before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "inflight", "done", "error")
#: Tables whose rows may be counted by name.
COUNTABLE = ("batch_item", "frontier", "llm_call", "raw_page")


def latest_status(log: DataFrame, keys: tuple[str, ...] = ("run_id", "url_hash"), at: str = "updated_at", tie: str = "seq") -> DataFrame:
    """The last report of every key: greatest time (unknown times first), ties by sequence. One hash aggregate, no sort."""
    order = F.struct(F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp")).alias("at"), F.col(tie).alias("tie"))
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def status_counts(current: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """One row per run with a column per status; unknown statuses count in none."""
    return current.groupBy(run).agg(*(F.count_if(F.col(status) == s).alias(s) for s in STATUSES))


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and cost per key (whole log without keys); null token counts add nothing."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.sum(F.coalesce("usd_estimate", F.lit(0.0))).alias("usd"))


def telemetry(pages: DataFrame, run: str, body: str, millis: str) -> DataFrame:
    """Pages, bytes and milliseconds fetched per run."""
    return pages.groupBy(run).agg(F.count("*").alias("fetch_pages"), F.sum(F.coalesce(F.octet_length(body), F.lit(0))).alias("fetch_bytes"), F.sum(F.coalesce(F.col(millis), F.lit(0))).alias("fetch_ms"))


def terminal_status(ok: Column, err: Column) -> Column:
    return F.when((ok == 0) & (err > 0), "error").otherwise("finished")


def newest(runs: DataFrame, at: str, tie: str, n: int | None = None) -> DataFrame:
    out = runs.orderBy(F.desc(at), F.desc(tie))
    return out.limit(n) if n else out


def claim(current: DataFrame, n: int) -> DataFrame:
    """Up to n pending rows, shallow first, in a fixed order."""
    return current.where("status = 'pending'").orderBy("depth", "url", "url_hash").limit(n).withColumn("status", F.lit("inflight"))


def reset_inflight(current: DataFrame) -> DataFrame:
    """What a resumed run starts from: rows in flight are pending again, finished ones stay."""
    return current.withColumn("status", F.when(F.col("status") == "inflight", "pending").otherwise(F.col("status")))


def run_state(events: DataFrame) -> DataFrame:
    """Current row of each run from its begin, finish and resume events (run_id, seq, event, status, at)."""
    last = events.groupBy("run_id").agg(F.min_by("at", "seq").alias("started_at"), F.max_by(F.struct("event", "status", "at"), "seq").alias("e"))
    return last.select("run_id", "started_at", F.when(F.col("e.event") == "finish", F.col("e.at")).alias("finished_at"), F.when(F.col("e.event") == "finish", F.col("e.status")).otherwise("running").alias("status"))


class UnknownRun(LookupError):
    """No run of that id."""


def one_run(runs: DataFrame, run_id: str) -> DataFrame:
    found = runs.where(F.col("run_id") == run_id)
    if found.limit(1).isEmpty():
        raise UnknownRun(run_id)
    return found


class NotCountable(ValueError):
    """A table that is not on the list."""


def row_counts(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(name, n) of the named tables; names that are not on the list are an error before any work."""
    bad = sorted(set(names) - set(COUNTABLE))
    if bad:
        raise NotCountable(", ".join(bad))
    out = None
    for name in names:
        one = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def stamped(df: DataFrame, column: str, now: str | None = None) -> DataFrame:
    """df with a stamp of RFC 3339 in UTC, the time of the query or the given one."""
    at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    return df.withColumn(column, F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys; the last of equal new rows by updated_at."""
    rows = new.withColumn("_n", F.lit(1)).unionByName(old.withColumn("_n", F.lit(0)))
    rest = [c for c in old.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_n", "updated_at")).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def with_columns_added(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Schema evolution: absent columns are added with their type and default, null values take the default."""
    out = df
    for name, (kind, default) in wanted.items():
        value = F.lit(default).cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value)
    return out


def cost_ceiling(calls: DataFrame, keys: list[str], order: list[str], cost: str, ceiling: float, flat_rate: Column | None = None) -> DataFrame:
    """Running cost of each key's calls and whether the call would pass the ceiling; flat-rate calls cost nothing and never abort.

    Once a call is refused all later ones of the key are.
    """
    from .sequences import running

    flat = F.lit(False) if flat_rate is None else flat_rate
    spent = running(calls, keys, order, {"running_cost": F.when(flat, 0.0).otherwise(F.coalesce(F.col(cost), F.lit(0.0)))})
    return running(spent, keys, order, maxima={"aborted": (F.col("running_cost") > ceiling) & ~flat})
