"""Queries over the run ledger, call log and ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import urls as U
from ..operators import diff as D
from ..operators import ledger as L
from ..operators import sequences as S
from ..session import table

#: Prices for a million tokens in and out; a table of the caller's. This one serves the queries.
PRICES = (("qm-2", 0.6, 1.8), ("tiny-free", 0.0, 0.0), ("norvane-max", 3.0, 12.0))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last reported status of every (run, URL)."""
    t = table(spark, sf_dir, "frontier").select("run_id", "url_hash", "seq", "status", "depth", "updated_at")
    return L.latest_status(t).select("run_id", "url_hash", "status", "depth", "seq")


def run_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "frontier").select("run_id", "url_hash", "seq", "status", "updated_at")
    return L.status_counts(L.latest_status(t))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost per run and purpose."""
    u = L.usage(table(spark, sf_dir, "llm_call"), "run_id", "purpose")
    return u.withColumn("usd", F.round("usd", 6))


def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usage(table(spark, sf_dir, "llm_call"), "run_id").select("run_id", "calls", F.round("usd", 6).alias("usd"))


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every call by a price table; unknown models cost 0 and are flagged."""
    prices = spark.createDataFrame(PRICES, "model string, price_in double, price_out double")
    j = table(spark, sf_dir, "llm_call").join(F.broadcast(prices), "model", "left")
    return j.select("id", F.round(C.call_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out")), 9).alias("usd"), F.col("price_in").isNull().alias("unknown_model"))


def cost_ceiling_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "llm_call")
    c = L.cost_ceiling(t, ["run_id"], ["ts", "id"], "usd_estimate", 0.05, F.col("provider") == "localbox")
    return c.select("id", F.round("running_cost", 6).alias("running_cost"), "aborted")


def list_runs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten runs that started last (a top-k report)."""
    runs = table(spark, sf_dir, "frontier").groupBy("run_id").agg(F.min("discovered_at").alias("started_at"), F.count("*").alias("reports"))
    return L.newest(runs, "started_at", "run_id", 10).withColumn("started_at", F.unix_micros("started_at"))


def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with status counts and usage: the status poll as two joins on run_id."""
    t = table(spark, sf_dir, "frontier").select("run_id", "url_hash", "seq", "status", "updated_at")
    counts = L.status_counts(L.latest_status(t))
    cost = L.usage(table(spark, sf_dir, "llm_call"), "run_id").select("run_id", "calls", F.round("usd", 6).alias("usd"))
    j = counts.join(cost, "run_id", "left")
    return j.select("run_id", "pending", "inflight", "done", "error", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("usd", F.lit(0.0)).alias("usd"), L.terminal_status(F.col("done"), F.col("error")).alias("terminal"))


def claim_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 32 pending rows in a fixed order (a bounded claim)."""
    t = table(spark, sf_dir, "frontier").select("run_id", "url_hash", "seq", "url", "depth", "status", "updated_at")
    return L.claim(L.latest_status(t), 32).select("run_id", "url_hash", "url", "depth", "status")


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "frontier").select("run_id", "url_hash", "seq", "status", "updated_at")
    return L.reset_inflight(L.latest_status(t)).groupBy("run_id", "status").agg(F.count("*").alias("n"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages ok and failed per run and the terminal status."""
    t = table(spark, sf_dir, "batch_item")
    c = t.groupBy("run_id").agg(F.count_if(F.col("ok")).alias("pages_ok"), F.count_if(~F.col("ok")).alias("pages_err"), F.sum(F.coalesce(F.octet_length("markdown"), F.lit(0))).alias("bytes"))
    return c.withColumn("status", L.terminal_status(F.col("pages_ok"), F.col("pages_err")))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest delivered version of every item URL."""
    t = table(spark, sf_dir, "batch_item").select(U.canonical_url("url").alias("u"), "item_id", "ingested_at", F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("hash"))
    return S.latest(t, ["u"], "ingested_at", "item_id").select("u", "item_id", "hash")


def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of an item URL against the one before."""
    t = table(spark, sf_dir, "batch_item").where("ok").select(U.canonical_url("url").alias("u"), "item_id", "ingested_at", "markdown")
    return S.changes(t, ["u"], ["ingested_at", "item_id"], "markdown").select("item_id", "changed", F.coalesce("old_hash", F.lit("")).alias("old_hash"), "new_hash")


def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word diffs of the page text of every version of an item URL against the one before, as change_detect pairs them; empty for unchanged ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("u").orderBy("ingested_at", "item_id")
    t = table(spark, sf_dir, "batch_item").where("ok").select(U.canonical_url("url").alias("u"), "item_id", "ingested_at", F.coalesce("markdown", F.lit("")).alias("cur"))
    v = t.withColumn("prev", F.lag("cur").over(w)).where("prev is not null")
    return D.word_diffs(v, "item_id", "prev", "cur").select(F.col("id").alias("item_id"), "diff", "error")


def null_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of missing titles among the last 50 items of each host."""
    t = table(spark, sf_dir, "batch_item").select("host", "item_id", F.col("title").isNull().alias("missing"))
    return S.null_rate(t, ["host"], ["item_id"], "missing").select("item_id", F.round("null_rate", 9).alias("null_rate"), "seen")


def healer_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items at which a host's share of missing titles passes the threshold, with reset."""
    t = table(spark, sf_dir, "batch_item").select("host", "item_id", F.col("title").isNull().alias("missing"))
    return S.heal_triggers(t, ["host"], "item_id", "missing", threshold=0.1)


def retain_last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "batch_item").where("ok and title is not null").select("host", "item_id")
    return S.retained(t, ["host"], "item_id")


def throttle_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pacing delay of every host after all of its responses."""
    t = table(spark, sf_dir, "raw_page").where("status > 0").select(U.hostname("url").alias("host"), "page_id", "status")
    return S.throttle_delays(t, "host", "page_id", "status", None).withColumn("delay_s", F.round("delay_s", 9))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page request of a host would be admitted at one a second, burst three, if all came by their number."""
    t = table(spark, sf_dir, "raw_page").select(U.hostname("url").alias("host"), "page_id", (F.col("page_id") / 10.0).alias("at_s"))
    return S.admissions(t, "host", "page_id", "at_s").select("page_id", F.round("admitted_s", 6).alias("admitted_s"))


def flush_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.every_nth(table(spark, sf_dir, "batch_item").select("host", "item_id"), ["host"], ["item_id"]).select("host", "item_id", "position")


def proxy_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "batch_item").select("run_id", "item_id")
    return S.round_robin(t, ["item_id"], ["p1", "p2", "p3"], ["run_id"]).select("item_id", "proxy")


def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coercions over texts derived from orders and lineitem (stand-ins for scraped values)."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" ")).alias("q"), F.concat(F.replace(F.format_string("%.2f", F.col("l_extendedprice").cast("double")), F.lit("."), F.lit(",")), F.lit(" €")).alias("p"), F.date_format("l_shipdate", "dd.MM.yyyy").alias("d"), F.when(F.col("l_returnflag") == "R", "ja").when(F.col("l_returnflag") == "A", "No").otherwise("?").alias("b"))
    return t.select("l_orderkey", "l_linenumber", C.to_int("q").alias("i"), C.eur_decimal("p").alias("price"), C.iso_date("d").alias("day"), C.to_bool("b").alias("flag"))


def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First price of every document that has one."""
    t = table(spark, sf_dir, "documents").select("doc_id", C.apply_regex("text", r"([0-9]+[.,][0-9]{2}) ?€").alias("price"))
    return t.where("price is not null")


QUERIES = {f.__name__: f for f in (latest_status, run_status_counts, usage_rollup, run_cost, cost_estimate, cost_ceiling_running, list_runs_topk, run_overview, claim_pending, resumed, batch_summary, latest_snapshot, change_detect, word_diff, null_rate_window, healer_triggers, retain_last_samples, throttle_delays, token_bucket, flush_points, proxy_round_robin, coerce_values, regex_extract)}

from .web_queries import _HOST, _canon  # noqa: E402

_LATEST = "latest AS (SELECT * FROM frontier QUALIFY row_number() OVER (PARTITION BY run_id, url_hash ORDER BY coalesce(updated_at, TIMESTAMP '1970-01-01') DESC, seq DESC) = 1)"
_COUNTS = "SELECT run_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'inflight') AS inflight, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error FROM latest GROUP BY run_id"
SQL = {
    "latest_status": f"WITH {_LATEST} SELECT run_id, url_hash, status, depth, seq FROM latest",
    "run_status_counts": f"WITH {_LATEST} {_COUNTS}",
    "usage_rollup": "SELECT run_id, purpose, count(*) AS calls, sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(completion_tokens, 0))::BIGINT AS completion_tokens, round(sum(coalesce(usd_estimate, 0.0)), 6) AS usd FROM llm_call GROUP BY run_id, purpose",
    "run_cost": "SELECT run_id, count(*) AS calls, round(sum(coalesce(usd_estimate, 0.0)), 6) AS usd FROM llm_call GROUP BY run_id",
    "cost_estimate": "SELECT id, round(prompt_tokens / 1e6 * coalesce(i, 0.0) + coalesce(completion_tokens, 0) / 1e6 * coalesce(o, 0.0), 9) AS usd, i IS NULL AS unknown_model FROM llm_call LEFT JOIN (VALUES ('qm-2', 0.6, 1.8), ('tiny-free', 0.0, 0.0), ('norvane-max', 3.0, 12.0)) p(model, i, o) USING (model)",
    "cost_ceiling_running": """WITH r AS (SELECT id, run_id, ts, provider, sum(CASE WHEN provider = 'localbox' THEN 0.0 ELSE coalesce(usd_estimate, 0.0) END) OVER (PARTITION BY run_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS c FROM llm_call)
        SELECT id, round(c, 6) AS running_cost, bool_or(c > 0.05 AND provider <> 'localbox') OVER (PARTITION BY run_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS aborted FROM r""",
    "list_runs_topk": "SELECT run_id, epoch_us(min(discovered_at)) AS started_at, count(*) AS reports FROM frontier GROUP BY run_id ORDER BY started_at DESC, run_id DESC LIMIT 10",
    "run_overview": f"""WITH {_LATEST}, c AS ({_COUNTS}), u AS (SELECT run_id, count(*) AS calls, round(sum(coalesce(usd_estimate, 0.0)), 6) AS usd FROM llm_call GROUP BY run_id)
        SELECT run_id, pending, inflight, done, error, coalesce(calls, 0) AS calls, coalesce(usd, 0.0) AS usd, CASE WHEN done = 0 AND error > 0 THEN 'error' ELSE 'finished' END AS terminal FROM c LEFT JOIN u USING (run_id)""",
    "claim_pending": f"WITH {_LATEST} SELECT run_id, url_hash, url, depth, 'inflight' AS status FROM latest WHERE status = 'pending' ORDER BY depth, url, url_hash LIMIT 32",
    "resumed": f"WITH {_LATEST} SELECT run_id, CASE WHEN status = 'inflight' THEN 'pending' ELSE status END AS status, count(*) AS n FROM latest GROUP BY ALL",
    "batch_summary": "SELECT run_id, count(*) FILTER (ok) AS pages_ok, count(*) FILTER (NOT ok) AS pages_err, sum(coalesce(strlen(markdown), 0))::BIGINT AS bytes, CASE WHEN count(*) FILTER (ok) = 0 AND count(*) FILTER (NOT ok) > 0 THEN 'error' ELSE 'finished' END AS status FROM batch_item GROUP BY run_id",
    "latest_snapshot": _canon("batch_item") + "SELECT canonical AS u, item_id, sha256(coalesce(markdown, '')) AS hash FROM canon QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY ingested_at DESC, item_id DESC) = 1",
    "change_detect": _canon("batch_item") + ", v AS (SELECT item_id, canonical, ingested_at, sha256(coalesce(markdown, '')) AS h FROM canon WHERE ok), w AS (SELECT item_id, h, lag(h) OVER (PARTITION BY canonical ORDER BY ingested_at, item_id) AS o FROM v) SELECT item_id, coalesce(o <> h, false) AS changed, coalesce(o, '') AS old_hash, h AS new_hash FROM w",
    "null_rate_window": "SELECT item_id, round(avg(CASE WHEN title IS NULL THEN 1.0 ELSE 0.0 END) OVER w, 9) AS null_rate, count(*) OVER w AS seen FROM batch_item WINDOW w AS (PARTITION BY host ORDER BY item_id ROWS 49 PRECEDING)",
    "retain_last_samples": "SELECT host, item_id FROM batch_item WHERE ok AND title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY item_id DESC) <= 3",
    "throttle_delays": f"""WITH RECURSIVE e AS (SELECT {_HOST('url')} AS host, status, row_number() OVER (PARTITION BY {_HOST('url')} ORDER BY page_id) AS k FROM raw_page WHERE status > 0),
        f AS (SELECT host, 0 AS k, CAST(0.0 AS DOUBLE) AS d FROM (SELECT DISTINCT host FROM e) UNION ALL SELECT f.host, f.k + 1, CASE WHEN e.status = 429 OR e.status BETWEEN 500 AND 599 THEN least(greatest(d, 1.0) * 2, 60.0) WHEN e.status BETWEEN 200 AND 299 THEN greatest(greatest(d, 1.0) * 0.75, 1.0) ELSE d END FROM f JOIN e ON e.host = f.host AND e.k = f.k + 1)
        SELECT host, round(d, 9) AS delay_s, k AS responses FROM f QUALIFY row_number() OVER (PARTITION BY host ORDER BY k DESC) = 1""",
    "flush_points": "SELECT host, item_id, p AS position FROM (SELECT host, item_id, row_number() OVER (PARTITION BY host ORDER BY item_id) AS p FROM batch_item) WHERE p % 25 = 0",
    "proxy_round_robin": "SELECT item_id, ['p1', 'p2', 'p3'][(row_number() OVER (PARTITION BY run_id ORDER BY item_id) - 1) % 3 + 1] AS proxy FROM batch_item",
    "token_bucket": f"""WITH e AS (SELECT page_id, {_HOST('url')} AS host, page_id / 10.0 AS a, row_number() OVER (PARTITION BY {_HOST('url')} ORDER BY page_id) AS k FROM raw_page)
        SELECT page_id, round(greatest(a, max(a - (k - 1)) OVER (PARTITION BY host ORDER BY page_id ROWS UNBOUNDED PRECEDING) + (k - 1) - 2), 6) AS admitted_s FROM e""",
    "coerce_values": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS BIGINT) AS i, CAST(printf('%.2f', CAST(l_extendedprice AS DOUBLE)) AS DOUBLE) AS price, strftime(l_shipdate, '%Y-%m-%d') AS day, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS flag FROM lineitem",
    "regex_extract": "SELECT doc_id, regexp_extract(text, '([0-9]+[.,][0-9]{2}) ?€', 1) AS price FROM documents WHERE regexp_matches(text, '([0-9]+[.,][0-9]{2}) ?€')",
    "healer_triggers": """WITH RECURSIVE o AS (SELECT host, item_id, title IS NULL AS missing, row_number() OVER (PARTITION BY host ORDER BY item_id) AS n FROM batch_item),
        f(host, n, item_id, ring, fire) AS (SELECT host, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BOOLEAN[]), false FROM o WHERE n = 1
            UNION ALL SELECT host, n, item_id, CASE WHEN fire THEN CAST([] AS BOOLEAN[]) ELSE ring END, fire FROM (SELECT *, len(ring) >= 10 AND len(list_filter(ring, lambda x: x)) / len(ring) > 0.1 AS fire FROM (SELECT o.host, o.n, o.item_id, list_append(f.ring, o.missing)[-50:] AS ring FROM f JOIN o ON o.host = f.host AND o.n = f.n + 1)))
        SELECT host, item_id FROM f WHERE fire""",
    "word_diff": _canon("(SELECT * FROM batch_item WHERE ok)") + ", v AS (SELECT item_id, coalesce(markdown, '') AS cur, lag(coalesce(markdown, '')) OVER (PARTITION BY canonical ORDER BY ingested_at, item_id) AS prev FROM canon) SELECT item_id, '' AS diff, '' AS error FROM v WHERE prev = cur",
}
