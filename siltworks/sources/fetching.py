"""Fetching a table of URLs over an injected transport, with retries, pacing, proxies and warm-up.

URLs are hashed by host, and a host's URLs over ``lanes`` tasks, each with its share of the
host's rate; within a task they are walked host by host. The clock is part of the policy, so
tests run on a virtual one. Failures are data on the row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import retry_schedule, throttle_step
from .pages import FetchError, ProxyPool, decoded, is_public

PERMANENT = (400, 401, 403, 404, 410)
#: Statuses of a refusal that a visit to the homepage may lift.
REFUSED = (401, 403, 429, 503)
SCHEMA = "url string, final_url string, status int, headers map<string,array<string>>, html string, error string, attempts int, waited double, proxy string"
_TYPES = (pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.list_(pa.string())), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string())


class Clock:
    """Wall time."""

    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class VirtualClock(Clock):
    """Time that passes only by sleeping."""

    def __init__(self) -> None:
        self.at = 0.0

    def now(self) -> float:
        return self.at

    def sleep(self, seconds: float) -> None:
        self.at += seconds


@dataclass
class Policy:
    """rate and burst of a host; waits between tries; proxies in turn or by host; headers by profile, dealt in turn over the hosts; warm_up: visit the homepage once after a refusal."""

    rate: float = 1.0
    burst: int = 3
    waits: list[float] = field(default_factory=retry_schedule)
    proxies: list[str] = field(default_factory=list)
    sticky: bool = False
    profiles: dict[str, dict[str, str]] = field(default_factory=dict)
    warm_up: bool = True
    allow_private: bool = False
    resolve: Callable[[str], list[str]] | None = None
    clock: Callable[[], Clock] = Clock


class _Host:
    """Bucket, adaptive delay and warm-up state of one host."""

    def __init__(self, policy: Policy, clock: Clock, lanes: int):
        self.rate, self.burst = policy.rate / lanes, max(1, policy.burst // lanes)
        self.tokens, self.at, self.delay, self.warm = float(self.burst), clock.now(), 0.0, False

    def admit(self, clock: Clock) -> None:
        now = clock.now()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        wait = max((1 - self.tokens) / self.rate if self.tokens < 1 else 0.0, self.delay if self.delay > 1 / self.rate else 0.0)
        if wait:
            clock.sleep(wait)
            self.tokens = min(self.burst, self.tokens + wait * self.rate)
        self.tokens -= 1
        self.at = clock.now()


class Fetcher:
    """One task's fetches: transport(url, attempt, proxy, headers) -> {status, body, headers, final_url}."""

    def __init__(self, transport: Callable[..., dict], policy: Policy, lanes: int = 1):
        self.transport, self.policy, self.lanes, self.clock = transport, policy, lanes, policy.clock()
        self.pool = ProxyPool(policy.proxies, policy.sticky) if policy.proxies else None
        self.hosts: dict[str, _Host] = {}

    def _headers(self, host: str) -> dict[str, str]:
        names = sorted(self.policy.profiles)
        return dict(self.policy.profiles[names[sum(host.encode()) % len(names)]]) if names else {}

    def _once(self, url: str, host: str, attempt: int) -> tuple[dict | None, str, str | None]:
        """(response, error, proxy): egress errors go to the next proxy, at most three."""
        error, proxy = "", None
        for _ in range(min(3, len(self.pool.proxies)) if self.pool else 1):
            proxy = self.pool.pick(host, self.clock.now()) if self.pool else None
            try:
                return self.transport(url, attempt=attempt, proxy=proxy, headers=self._headers(host)), "", proxy
            except FetchError as e:
                error = str(e)
                if self.pool:
                    self.pool.failed(proxy, self.clock.now())
        return None, error, proxy

    def fetch(self, url: str) -> tuple:
        p = self.policy
        if not is_public(url, allow_private=p.allow_private, resolve=p.resolve):
            return (url, None, None, None, None, "address not allowed", 0, 0.0, None)
        host = urlsplit(url).netloc.lower()
        if len(self.hosts) > 10_000:
            self.hosts.clear()
        state = self.hosts.setdefault(host, _Host(p, self.clock, self.lanes))
        waited, attempt = 0.0, 0
        while True:
            state.admit(self.clock)
            attempt += 1
            got, error, proxy = self._once(url, host, attempt)
            status = got["status"] if got else None
            headers = {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in (got or {}).get("headers", {}).items()}
            after = next((v[0] for k, v in headers.items() if k.lower() == "retry-after"), None)
            after = float(after) if after and after.isdigit() else None
            state.delay = throttle_step(state.delay, status or 0, after, 1 / state.rate)
            if status in REFUSED and p.warm_up and not state.warm:
                state.warm = True
                self._once(f"{urlsplit(url).scheme}://{host}/", host, 1)
                continue
            if got and (200 <= status < 400 or status in PERMANENT) or attempt > len(p.waits):
                break
            wait = after if after is not None else p.waits[attempt - 1]
            waited += wait
            self.clock.sleep(wait)
        if not got:
            return (url, None, None, None, None, error, attempt, waited, proxy)
        try:
            encoding = next((v[0] for k, v in headers.items() if k.lower() == "content-encoding"), None)
            html, error = decoded(got["body"], encoding).decode("utf-8", "replace"), None
        except FetchError as e:
            html, error = None, str(e)
        return (url, got.get("final_url", url), status, list(headers.items()), html, error, attempt, waited, proxy)


def fetch_urls(urls: DataFrame, transport: Callable[..., dict], policy: Policy | None = None, url_col: str = "url", lanes: int = 1) -> DataFrame:
    """Every URL of the column fetched (SCHEMA). lanes: tasks over which one host's URLs are spread."""
    policy = policy or Policy()
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    lane = F.pmod(F.xxhash64(url_col), F.lit(lanes))
    placed = urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).cast("string").alias("url"), host.alias("host"), lane.alias("lane")).repartition("host", "lane").sortWithinPartitions("host", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = Fetcher(transport, policy, lanes)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                rows = [fetcher.fetch(u) for u in batch.column(0).slice(a, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return placed.mapInArrow(run, SCHEMA)
