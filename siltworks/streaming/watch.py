"""Stateful operators as streams; each keeps the state of its batch fold across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.diff import diff_words
from ..operators.sequences import THRESHOLD, WINDOW, heal_step, throttle_step


def watch(snapshots: DataFrame) -> DataFrame:
    """Changes of a stream of snapshots (url, content_hash, markdown, seq): url, changed, old_hash, new_hash, diff, seq.

    State per URL: the last hash and text. The first snapshot of a URL is an unchanged baseline.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old_hash, old_text = state.get if state.exists else (None, "")
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            changed = old_hash is not None and r.content_hash != old_hash
            diff = ""
            if changed:
                diff, error = diff_words(old_text or "", r.markdown or "")
                diff = error or diff
            out.append((key[0], changed, old_hash, r.content_hash, diff, r.seq))
            old_hash, old_text = r.content_hash, r.markdown
        state.update((old_hash, old_text))
        yield pd.DataFrame(out, columns=["url", "changed", "old_hash", "new_hash", "diff", "seq"])

    return snapshots.groupBy("url").applyInPandasWithState(step, "url string, changed boolean, old_hash string, new_hash string, diff string, seq bigint", "hash string, text string", "append", GroupStateTimeout.NoTimeout)


def watch_hashes(snapshots: DataFrame) -> DataFrame:
    """Changes of a stream of snapshots (url, content_hash, seq): url, changed, old_hash, new_hash, old_seq, seq.

    State per URL: the last hash and its number, no text. with_diffs adds the diffs of what changed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old_hash, old_seq = state.get if state.exists else (None, None)
        rows = sorted((seq, h) for b in batches for seq, h in zip(b.seq, b.content_hash))
        out = []
        for seq, h in rows:
            out.append((key[0], old_hash is not None and h != old_hash, old_hash, h, old_seq, seq))
            old_hash, old_seq = h, int(seq)
        state.update((old_hash, old_seq))
        got = pd.DataFrame(out, columns=["url", "changed", "old_hash", "new_hash", "old_seq", "seq"])
        yield got.astype({"old_seq": "Int64", "old_hash": "string"})

    wanted = snapshots.select("url", "content_hash", "seq")
    return wanted.groupBy("url").applyInPandasWithState(step, "url string, changed boolean, old_hash string, new_hash string, old_seq bigint, seq bigint", "hash string, seq bigint", "append", GroupStateTimeout.NoTimeout)


def with_diffs(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """The changed rows of watch_hashes with their word diffs; versions (url, seq, markdown) is the table of all snapshots. For batches of the stream or its written output."""
    from ..operators.diff import word_diffs

    v = versions.select("url", F.col("seq").alias("_s"), F.coalesce("markdown", F.lit("")).alias("_md"))
    old = v.select("url", F.col("_s").alias("old_seq"), F.col("_md").alias("prev"))
    new = v.select("url", F.col("_s").alias("seq"), F.col("_md").alias("cur"))
    changed = changes.where("changed")
    diffs = word_diffs(changed.join(old, ["url", "old_seq"]).join(new, ["url", "seq"]), "seq", "prev", "cur")
    return changed.join(diffs.select(F.col("id").alias("seq"), "diff", F.col("error").alias("diff_error")), "seq", "left")


def heal_stream(outcomes: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """Triggers of a stream of outcomes (domain, field, seq, is_null): domain, field, seq. State: the ring of last outcomes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = tuple(c == "1" for c in (state.get[0] if state.exists else ""))
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            ring, fire = heal_step(ring, r.is_null, window, threshold)
            if fire:
                out.append((*key, r.seq))
        state.update(("".join("1" if x else "0" for x in ring),))
        yield pd.DataFrame(out, columns=["domain", "field", "seq"])

    return outcomes.groupBy("domain", "field").applyInPandasWithState(step, "domain string, field string, seq bigint", "ring string", "append", GroupStateTimeout.NoTimeout)


def throttle_stream(responses: DataFrame, floor: float = 1.0) -> DataFrame:
    """Delay of a host after every response of a stream (host, seq, status, retry_after): host, seq, delay_s."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay = state.get[0] if state.exists else 0.0
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            delay = throttle_step(delay, r.status, None if pd.isna(r.retry_after) else r.retry_after, floor)
            out.append((key[0], r.seq, delay))
        state.update((delay,))
        yield pd.DataFrame(out, columns=["host", "seq", "delay_s"])

    return responses.groupBy("host").applyInPandasWithState(step, "host string, seq bigint, delay_s double", "delay double", "append", GroupStateTimeout.NoTimeout)


def seen_once(links: DataFrame) -> DataFrame:
    """A stream of links without those of a run that were seen before; the set is kept without bound, as the crawl asks."""
    return links.dropDuplicates(["run_id", "url_hash"])


def url_key(df: DataFrame, url: str = "url") -> DataFrame:
    from ..functions.urls import canonical_url, url_hash

    return df.withColumn("url_hash", url_hash(canonical_url(F.col(url))))
