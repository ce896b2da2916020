"""URL algebra as Column expressions. No Python runs per row.

Strings are split by the generic URI syntax with one regular expression, because parse_url
rejects spaces and bars that pages do contain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query (with '?'), fragment (with '#')
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME, _AUTHORITY, _PATH, _QUERY = 1, 2, 3, 4

# Tracking parameters, default ports, extensions that are not pages.
TRACKING_PREFIX = "utm_"
TRACKING = ("gclid", "fbclid", "msclkid")
ASSET_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "avif", "mp4", "webm", "mp3", "avi", "mov", "zip", "gz", "tgz", "rar", "7z", "exe", "dmg", "msi", "woff", "woff2", "ttf", "eot", "otf")
FETCHABLE = ("http", "https", "file")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(F.trim(_col(url)), _URI, group)


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, _SCHEME))


def host_port(url: Column | str) -> Column:
    """Lower-case authority without userinfo."""
    return F.lower(F.regexp_replace(part(url, _AUTHORITY), r"^.*@", ""))


def hostname(url: Column | str) -> Column:
    """Lower-case host without port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(host_port(url), r":\d*$", ""), r"\.$", "")


def path(url: Column | str) -> Column:
    return part(url, _PATH)


def _encoded(value: Column) -> Column:
    """Form encoding, space as '+', '~' and '*' as browsers' form encoders leave them out of reserved bytes."""
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pairs(query: Column) -> Column:
    """Array of (key, value) of the well-formed pairs of a query string."""
    raw = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: (p != "") & ~p.contains(";") & ~p.rlike(r"%(?![0-9A-Fa-f]{2})"))
    return F.transform(raw, lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)).alias("v")))


def canonical_url(url: Column | str) -> Column:
    """The URL's canonical form, null where there is none.

    Lower-case scheme and host, default port and fragment dropped, tracking parameters dropped,
    the other parameters re-encoded and sorted by key (values of a key keep their order), an
    empty path becomes '/'. ``file`` URLs need a path, all others a host.
    """
    u = F.trim(_col(url))
    s, hp, p, q = scheme(u), host_port(u), path(u), part(u, _QUERY)
    user = F.regexp_extract(part(u, _AUTHORITY), r"^(.*@)", 1)
    host = F.when(s == "http", F.regexp_replace(hp, r":80$", "")).when(s == "https", F.regexp_replace(hp, r":443$", "")).otherwise(hp)
    tracked = lambda x: F.lower(x.k).startswith(TRACKING_PREFIX) | F.lower(x.k).isin(*TRACKING)
    kept = F.filter(_pairs(q), lambda x: ~tracked(x))
    numbered = F.transform(kept, lambda x, i: F.struct(x.k.alias("k"), i.alias("i"), x.v.alias("v")))
    query = F.concat_ws("&", F.transform(F.array_sort(numbered), lambda x: F.concat(_encoded(x.k), F.lit("="), _encoded(x.v))))
    tail = F.when(q == "", "").when(q == "?", "?").when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise("")
    clean_path = F.replace(F.replace(F.replace(F.replace(p, F.lit(" "), F.lit("%20")), F.lit("|"), F.lit("%7C")), F.lit('"'), F.lit("%22")), F.lit("<"), F.lit("%3C"))
    web = F.concat(s, F.lit("://"), user, host, F.when(p == "", "/").otherwise(clean_path), tail)
    local = F.concat(F.lit("file://"), host, clean_path, tail)
    valid = ~u.rlike(r"[\x00-\x1f\x7f]") & ~p.rlike(r"%(?![0-9A-Fa-f]{2})")
    return F.when(valid & (s == "file") & (p != ""), local).when(valid & (s != "") & (s != "file") & (F.regexp_replace(hp, r":\d*$", "") != ""), web)


def url_hash(canonical: Column | str) -> Column:
    return F.sha2(_col(canonical), 256)


def domain_key(url: Column | str) -> Column:
    """Lower-case host with port; 'file' where there is no host, 'invalid' where there is no URL."""
    u = F.trim(_col(url))
    return F.when(u.isNull() | u.rlike(r"[\x00-\x1f\x7f]|^:"), "invalid").when(host_port(u) == "", "file").otherwise(host_port(u))


def segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def last_segment(url: Column | str) -> Column:
    s = segments(url)
    return F.when(F.size(s) > 0, F.element_at(s, -1)).otherwise("")


def query_param(url: Column | str, name: str) -> Column:
    return F.element_at(F.transform(F.filter(_pairs(part(url, _QUERY)), lambda x: x.k == name), lambda x: x.v), 1)


def _first(values: Column) -> Column:
    return F.when(F.size(values) > 0, values[0])


def homepage(url: Column | str) -> Column:
    return F.when((scheme(url) != "") & (host_port(url) != ""), F.concat(scheme(url), F.lit("://"), host_port(url), F.lit("/"))).otherwise("")


def pdf_title(url: Column | str) -> Column:
    stem = F.regexp_replace(last_segment(url), r"(?i)\.pdf$", "")
    return F.when(stem == "", "document").otherwise(stem)


def redacted(endpoint: Column | str) -> Column:
    """An endpoint without userinfo."""
    return F.regexp_replace(_col(endpoint), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@?#]*@", "$1")


def unwrapped(url: Column | str, search_host: str, param: str = "uddg") -> Column:
    """The target of a search engine's redirect; URLs of other hosts stay as they are."""
    u = F.when(_col(url).startswith("//"), F.concat(F.lit("https:"), _col(url))).otherwise(_col(url))
    own = (hostname(u) == search_host) | hostname(u).endswith("." + search_host)
    value = F.try_url_decode(F.regexp_extract(part(u, _QUERY), rf"[?&]{re.escape(param)}=([^&]*)", 1))
    return F.when(own & (F.coalesce(value, F.lit("")) != ""), value).otherwise(u)


def video_id(url: Column | str) -> Column:
    """Id in any of the four shapes of video URLs, null if there is none of 11 characters."""
    h, p = F.regexp_replace(hostname(url), r"^(www|m|music)\.", ""), path(url)
    found = F.when(h == "youtu.be", F.regexp_extract(p, r"^/([^/]+)", 1)).when((h == "youtube.com") & (p == "/watch"), F.regexp_extract(part(url, _QUERY), r"[?&]v=([^&]*)", 1)).when(h == "youtube.com", F.regexp_extract(p, r"^/(?:shorts|embed|live)/([^/]+)", 1)).otherwise("")
    return F.when(found.rlike(r"^[A-Za-z0-9_-]{11}\z"), found)


def has_asset_extension(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1)).isin(*ASSET_EXTENSIONS)


def is_fetchable(url: Column | str) -> Column:
    return scheme(url).isin(*FETCHABLE)


class GlobError(ValueError):
    """A glob that is too long or too wide."""


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ** any text, * any text without '/', ? one character of that."""
    if len(glob) > 1024 or glob.count("**") > 4:
        raise GlobError(f"glob too long or too wide: {glob[:40]!r}")
    names = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(names.get(x) or re.escape(x) for x in re.findall(r"\*\*|\*|\?|[^*?]+", glob)) + r"\z"


def in_scope(url: Column | str, seed: str, same_host: bool = True, allow_subdomains: bool = False, path_prefix: str = "", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Crawl scope: host (or its subdomains), path prefix, any include glob, no exclude glob; globs meet the path."""
    base = re.sub(r":\d*$", "", re.sub(r"^.*@", "", re.match(_URI, seed).group(2) or "")).lower().rstrip(".")
    h, p = hostname(url), F.when(path(url) == "", "/").otherwise(path(url))
    ok = F.lit(True)
    if same_host:
        ok = (h == base) | (h.endswith("." + base) if allow_subdomains else F.lit(False))
    if path_prefix:
        ok = ok & p.startswith(path_prefix)
    if include:
        ok = ok & p.rlike("|".join(f"(?:{glob_regex(g)})" for g in include))
    if exclude:
        ok = ok & ~p.rlike("|".join(f"(?:{glob_regex(g)})" for g in exclude))
    return ok


def bypasses_proxy(url: Column | str, no_proxy: str) -> Column:
    """Whether the host is exempt: '*', an exact name, or a suffix at a dot."""
    entries = [e.strip().lower().lstrip(".") for e in no_proxy.split(",") if e.strip()]
    if "*" in entries:
        return F.lit(True)
    h = hostname(url)
    ok = F.lit(False)
    for e in entries:
        ok = ok | (h == e) | h.endswith("." + e)
    return ok
