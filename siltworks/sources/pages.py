"""Page sources: a Spark data source over an injected transport, files, URL lists, content decoding."""

from __future__ import annotations

import base64
import gzip
import ipaddress
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bounds of a fetched body and of captured requests.
MAX_BODY = 50 << 20
XHR_COUNT, XHR_BYTES = 50, 64 << 10
PAGE_DDL = "url string, final_url string, status int, headers map<string,array<string>>, html string, error string"


class FetchError(RuntimeError):
    """A failed fetch; becomes the row's error."""


def decoded(body: bytes, encoding: str | None, cap: int = MAX_BODY) -> bytes:
    """The body with its content encodings undone, last one first; unknown encodings and bodies beyond the cap are errors."""
    for name in reversed([e.strip().lower() for e in (encoding or "").split(",") if e.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body, cap + 1)
            elif name == "deflate":
                try:
                    body = zlib.decompressobj().decompress(body, cap + 1)
                except zlib.error:
                    body = zlib.decompressobj(-15).decompress(body, cap + 1)
            elif name == "zstd":
                import zstandard

                body = zstandard.ZstdDecompressor().stream_reader(body).read(cap + 1)
            elif name == "br":
                try:
                    import brotli
                except ImportError as e:
                    raise FetchError("no brotli decoder here") from e
                body = brotli.decompress(body)
            elif name != "identity":
                raise FetchError(f"unknown content encoding {name!r}")
        except (zlib.error, OSError, EOFError, gzip.BadGzipFile) as e:
            raise FetchError(f"bad {name} body") from e
    if len(body) > cap:
        raise FetchError("body too large")
    return body


def is_public(url: str, allow_file: bool = False, allow_private: bool = False, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """Whether egress to the URL is allowed: web schemes, no loopback or metadata names, no private addresses.

    Names pass only if all addresses that ``resolve`` gives are public; without it names are not looked up.
    """
    try:
        u = urlsplit(url)
        host = (u.hostname or "").lower().rstrip(".")
    except ValueError:
        return False
    if u.scheme == "file":
        return allow_file
    if u.scheme not in ("http", "https") or not host:
        return False
    if host in ("localhost", "metadata.google.internal") or host.endswith((".localhost", ".metadata.google.internal")):
        return False

    def public(a: str) -> bool:
        ip = ipaddress.ip_address(a)
        if isinstance(ip, ipaddress.IPv6Address) and ip.ipv4_mapped:
            ip = ip.ipv4_mapped
        private4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
        private = any(ip in ipaddress.ip_network(n) for n in private4) if ip.version == 4 else ip in ipaddress.ip_network("fc00::/7")
        return not (ip.is_loopback or private or ip.is_unspecified or ip.is_multicast or ip.is_link_local)

    try:
        return allow_private or public(host)
    except ValueError:
        if allow_private or resolve is None:
            return True
        found = resolve(host)
        return bool(found) and all(map(public, found))


def ssrf_verdicts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls (url) with allowed, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([is_public(u or "") for u in batch.column(0).to_pylist()])], names=["url", "allowed"])

    return urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "url string, allowed boolean")


def parse_proxy(line: str, session: str = "") -> str | None:
    """Proxy URL of a line: a URL, or host:port[:user:password]; {{session}} is filled in; None for blanks and comments."""
    s = line.strip().replace("{{session}}", session)
    if not s or s.startswith("#"):
        return None
    if "://" in s:
        u = urlsplit(s)
        if u.scheme not in ("http", "https", "socks5", "socks5h") or not u.hostname:
            raise ValueError(f"bad proxy {redacted(s)}")
        return s
    p = s.split(":")
    if len(p) == 2 and p[1].isdigit():
        return f"http://{p[0]}:{p[1]}"
    if len(p) == 4 and p[1].isdigit():
        return f"http://{p[2]}:{p[3]}@{p[0]}:{p[1]}"
    raise ValueError("bad proxy line")


def redacted(endpoint: str) -> str:
    return re.sub(r"^([a-z0-9+.-]+://)[^/@]*@", r"\1", endpoint, flags=re.I)


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


class ProxyPool:
    """Proxies in turn or by host; one that fails rests for a minute. The clock is injected."""

    def __init__(self, proxies: list[str], sticky: bool = False, cooldown_s: float = 60.0):
        if not proxies:
            raise ValueError("empty pool")
        self.proxies, self.sticky, self.cooldown_s, self.dead, self.turn = proxies, sticky, cooldown_s, {}, 0

    def pick(self, host: str, now: float) -> str:
        alive = [p for p in self.proxies if self.dead.get(p, 0) <= now] or self.proxies
        if self.sticky:
            return alive[fnv1a(host) % len(alive)]
        self.turn += 1
        return alive[(self.turn - 1) % len(alive)]

    def failed(self, proxy: str, now: float) -> None:
        self.dead[proxy] = now + self.cooldown_s


_TRANSPORTS: dict[str, Callable[[str], dict]] = {}


def register_transport(name: str, fetch: Callable[[str], dict]) -> None:
    """A fetch function url -> {status, body, headers, final_url}; FetchError becomes the row's error."""
    _TRANSPORTS[name] = fetch


class PageSource(DataSource):
    """Format 'silt-pages': options urls (one a line) and transport ('module:function'); one partition per host."""

    @classmethod
    def name(cls) -> str:
        return "silt-pages"

    def schema(self) -> str:
        return PAGE_DDL

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _Hosts(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u.strip() for u in options.get("urls", "").split("\n") if u.strip()]
        self.transport = options.get("transport", "")

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [_Hosts(v) for v in hosts.values()] or [_Hosts([])]

    def read(self, partition: _Hosts) -> Iterator[tuple]:
        import importlib

        module, _, name = self.transport.partition(":")
        fetch = _TRANSPORTS.get(self.transport) or getattr(importlib.import_module(module), name)
        for u in partition.urls:
            if not is_public(u):
                yield (u, None, None, None, None, "address not allowed")
                continue
            try:
                r = fetch(u)
                headers = {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in r.get("headers", {}).items()}
                encoding = next((v[0] for k, v in headers.items() if k.lower() == "content-encoding"), None)
                yield (u, r.get("final_url", u), r["status"], headers, decoded(r["body"], encoding).decode("utf-8", "replace"), None)
            except FetchError as e:
                yield (u, None, None, None, None, str(e))


def fetch_pages(spark: SparkSession, urls: list[str], transport: str) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format("silt-pages").option("urls", "\n".join(urls)).option("transport", transport).load()


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file, trimmed, blanks skipped."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def whole_files(spark: SparkSession, path: str, cap: int = MAX_BODY) -> DataFrame:
    """(url, html, truncated) of whole files; bodies beyond the cap are null."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.col("path").alias("url"), F.when(F.col("length") <= cap, F.decode("content", "UTF-8")).alias("html"), (F.col("length") > cap).alias("truncated"))


def captured_requests(xhr: DataFrame, patterns: list[str], key: str = "page_id", order: str = "seq") -> DataFrame:
    """XHR and fetch captures (key, order, kind, url, body, is_base64) whose URL meets a pattern: the first 50 of a page, bodies cut at 64 KiB."""
    from pyspark.sql import Window

    wanted = xhr.where(F.lower("kind").isin("xhr", "fetch") & F.col("url").rlike("|".join(f"(?:{p})" for p in patterns)))
    raw = F.when(F.col("is_base64"), F.unbase64("body")).otherwise(F.encode("body", "UTF-8"))
    w = Window.partitionBy(key).orderBy(order)
    cut = wanted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= XHR_COUNT).drop("_n")
    return cut.withColumn("truncated", F.length(raw) > XHR_BYTES).withColumn("body", F.decode(F.substring(raw, 1, XHR_BYTES), "UTF-8"))


def viewport(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(\d+)[xX](\d+)\s*", text)
    if not m or not int(m.group(1)) or not int(m.group(2)):
        raise ValueError(f"bad viewport {text!r}")
    return int(m.group(1)), int(m.group(2))


# The verbs of page actions, how many words each takes, and the longest wait.
ACTIONS = {"click": 1, "type": 2, "wait": 1, "scroll": 1, "press": 1, "select": 2, "screenshot": 0}
MAX_WAIT_MS = 30_000


class ActionError(ValueError):
    """A bad action line; names the line and the verb."""


def parse_actions(lines: list[str]) -> list[tuple[str, list[str]]]:
    out = []
    for k, line in enumerate(lines, 1):
        verb, _, rest = line.strip().partition(" ")
        verb = verb.lower()
        if not verb:
            continue
        if verb not in ACTIONS:
            raise ActionError(f"line {k}: unknown action {verb!r}")
        n = ACTIONS[verb]
        args = rest.strip().split(None, n - 1) if n > 1 else [rest.strip()] if rest.strip() else []
        if len(args) < n:
            raise ActionError(f"line {k}: {verb} needs {n} argument(s)")
        if verb == "wait" and (not args[0].isdigit() or int(args[0]) > MAX_WAIT_MS):
            raise ActionError(f"line {k}: wait takes 0 to {MAX_WAIT_MS} ms")
        out.append((verb, args))
    return out


def base64_of(data: bytes) -> str:
    return base64.b64encode(data).decode()
