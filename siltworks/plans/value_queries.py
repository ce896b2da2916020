"""Queries of text, URL, JSON and option values, over texts built from the tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import jsonops as J
from ..functions import options as O
from ..functions import quality as Q
from ..functions import text as X
from ..functions import urls as U
from ..operators import schema as S
from ..operators import sequences as N
from ..session import table
from ..sources import pages as P


def _mapped(fn, kind: str = "string"):
    """A function of one text as a column, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn)

    return run


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def json_valid_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which API bodies are valid JSON as they stand."""
    t = table(spark, sf_dir, "api_body").where("body is not null")
    return t.select("body_id", _mapped(J.is_valid, "boolean")("body").alias("valid"))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at a path of the bodies, over object and array roots."""

    def at(text: str) -> str | None:
        try:
            return J.walk_path(J.strict(text), "$.data.children.0.data.id") or J.walk_path(J.strict(text), "$.items.0.score")
        except (ValueError, RecursionError):
            return None

    t = table(spark, sf_dir, "api_body").where("body is not null and status = 200 and extractor in ('reddit', 'stackoverflow') and body not like '\"%'")
    return t.select("body_id", _mapped(lambda s: None if (v := at(s)) is None else str(v))("body").alias("value"))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with sorted keys, whole numbers without fraction and HTML-safe text, and the hash of that."""
    raw = F.concat(F.lit('{ "z": "<'), "event_type", F.lit('>", "b": '), F.col("k").cast("string"), F.lit('.0, "a": [1.50, true, null] }'))
    t = _events(spark, sf_dir).select("event_id", _mapped(lambda s: J.marshalled(J.strict(s)))(raw).alias("canonical"))
    return t.withColumn("hash", F.sha2("canonical", 256))


def schema_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, columns and required fields of a schema per event type."""

    def read(kind: str) -> str:
        s = S.load(json.dumps({"type": "object", "required": [kind], "properties": {"zz": {"type": "string"}, kind: {"type": "integer"}}}))
        return "|".join((s.hash, ",".join(s.columns)))

    t = table(spark, sf_dir, "events").select("event_type").distinct()
    return t.select("event_type", F.split(_mapped(read)("event_type"), r"\|").alias("s")).select("event_type", F.col("s")[0].alias("hash"), F.col("s")[1].alias("columns"))


def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that stand among other text; braces in strings don't count."""
    raw = F.concat(F.lit("var a = "), "props", F.lit('; b = {"t": "}'), "event_type", F.lit('"}; {'))
    objects = _mapped(lambda s: "\n".join(J.balanced_objects(s)))
    return _events(spark, sf_dir).select("event_id", objects(raw).alias("objects"))


def leaf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose among the leaves of objects: long ones, each once, none that look like code."""
    long = F.concat(F.lit("A sentence about the item named "), "p_name", F.lit(" which is long enough"))
    raw = F.to_json(F.struct(F.lit("short").alias("a"), long.alias("b"), F.struct(long.alias("c"), F.concat(long, F.lit("; x = {1}")).alias("d")).alias("e"), F.array(F.concat(F.col("p_brand"), F.lit(" — "), long)).alias("f")))
    return table(spark, sf_dir, "part").select("p_partkey", _mapped(lambda s: J.leaf_texts(json.loads(s)))(raw).alias("text"))


def typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a type in linked data, and the first author's name."""
    name = F.when(F.col("p_size") % 3 == 0, F.to_json(F.struct(F.col("p_name").alias("name")))).when(F.col("p_size") % 3 == 1, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.concat(F.lit('[{}, {"name": "'), "p_name", F.lit('"}]')))
    raw = F.concat(F.lit('{"@graph": [{"@type": "Thing"}, {"@type": ["Article", "X"], "n": '), F.col("p_size"), F.lit(', "author": '), name, F.lit(', "part": {"@type": "Article", "n": 1}}]}'))
    found = _mapped(lambda s: ",".join(str(n["n"]) for n in J.nodes_of_type(json.loads(s), "Article")) + "|" + J.author(json.loads(s)))
    return table(spark, sf_dir, "part").select("p_partkey", F.split(found(raw), r"\|").alias("x")).select("p_partkey", F.col("x")[0].alias("nodes"), F.col("x")[1].alias("author"))


def gated_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data that is kept beside a body: site blocks and article bodies go."""
    raw = F.concat(F.lit('[{"@type": "'), F.when(F.col("p_size") % 2 == 0, "WebSite").otherwise("Product"), F.lit('", "n": "'), "p_name", F.lit('", "articleBody": "x"}]'))
    kept = _mapped(lambda s: J.gated(s, ""))(raw)
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(kept, r"\s+", "").alias("kept"))


def coerced_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, floats, whole numbers and trimmed texts read back from their printed forms, through a regular expression."""
    t = table(spark, sf_dir, "part").withColumn("p", F.format_string("%.2f", "p_retailprice"))
    euro = F.concat(F.lit("€ "), F.replace("p", F.lit("."), F.lit(",")))
    return t.select(
        "p_partkey", C.coerced(euro, "eur_decimal").alias("euro"), C.coerced(F.concat(F.lit(" "), "p"), "float").alias("number"), C.coerced(F.concat(F.col("p_size"), F.lit(".0")), "int").alias("size"),
        C.coerced(F.concat(F.lit("size="), F.col("p_size"), F.lit(" x")), "int", r"size=(\d+)").alias("by_regex"), C.coerced(F.concat(F.lit("\t "), "p_name", F.lit(" \n")), "trim").alias("name"), C.coerced("p_name", "float").alias("none"),
    )


def parsed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read from their words."""
    unit = F.when(F.col("p_size") % 3 == 0, F.lit("k")).when(F.col("p_size") % 3 == 1, F.lit(" M")).otherwise(F.lit(" comments"))
    return table(spark, sf_dir, "part").select("p_partkey", X.parse_count(F.concat(F.lit("about "), F.col("p_size"), F.lit(","), F.lit("500"), unit)).alias("n"), X.parse_count("p_type").alias("none"), X.css_escape(F.concat("p_brand", F.lit(" .x/"), "p_name")).alias("css"))


def projected_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of sending every document, by a price per source; unknown prices fall back."""
    price = F.when(F.col("source").isNull(), None).otherwise(F.length("source") / 10.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.projected_cost("text", price), 9).alias("usd"))


def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in the four shapes of video URLs; ids of another length are none."""
    shapes = F.array(*map(F.lit, ("https://youtu.be/", "https://www.youtube.com/watch?t=1&v=", "https://music.youtube.com/shorts/", "https://youtube.com/embed/", "https://www.youtube.com/user/")))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", U.video_id(F.concat(F.element_at(shapes, (k % 5 + 1).cast("int")), F.lpad(k.cast("string"), 11, "v"), F.when(k % 11 == 0, F.lit("z")).otherwise(F.lit("")))).alias("video"))


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of files from their URLs, and which bodies are PDFs by their first bytes or content type."""
    t = table(spark, sf_dir, "raw_page").where("url is not null")
    u = F.when(F.col("page_id") % 4 == 0, F.regexp_extract("url", r"^(https?://[^/]+/)", 1)).otherwise(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit(".PDF")))
    head = F.when(F.col("page_id") % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.coalesce("html", F.lit("")))
    kind = F.when(F.col("page_id") % 5 == 0, F.lit(" Application/PDF; x=1")).otherwise(F.col("content_type"))
    return t.select("page_id", U.pdf_title(u).alias("title"), Q.is_pdf(head, kind).alias("pdf"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy lines read and redacted, and which hosts go past the proxy."""
    line = F.concat("host", F.lit(":8"), F.col("item_id") % 100, F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(":u"), "item_id", F.lit(":s{{session}}"))).otherwise(F.lit("")))
    t = table(spark, sf_dir, "batch_item").select("item_id", "host", _mapped(lambda s: P.parse_proxy(s, "q7"))(line).alias("proxy"))
    return t.select("item_id", "proxy", U.redacted("proxy").alias("shown"), U.bypasses_proxy(F.concat(F.lit("http://"), "host", F.lit("/")), "example, .paperlantern.test").alias("direct"))


def sticky_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy of every host by the hash of its name, and after that proxy has failed."""

    def pick(host: str) -> str:
        pool = P.ProxyPool(["a", "b", "c"], sticky=True)
        first = pool.pick(host, 0.0)
        pool.failed(first, 0.0)
        return f"{first}{pool.pick(host, 1.0) != first}{pool.pick(host, 61.0) == first}"

    hosts = table(spark, sf_dir, "batch_item").select("host").distinct()
    return hosts.select("host", _mapped(pick)("host").alias("x")).select("host", F.substring("x", 2, 4).alias("moved"), F.substring("x", 6, 5).alias("back"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code of every run by how its items went."""
    runs = table(spark, sf_dir, "batch_item").groupBy("run_id").agg(F.count_if(F.col("ok")).alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    name = F.when((F.col("good") == 0) & (F.col("bad") > 0), "all-failed").when(F.col("bad") > 0, "partial").otherwise("")
    return runs.select("run_id", Q.exit_code(name).alias("code"))


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that a page waits in all for its tries, by its status; permanent failures are not tried again."""
    waits = [0.0]
    for w in N.retry_schedule():
        waits.append(waits[-1] + w)
    retried = Q.retry_outcome("status") == "retry"
    tries = F.when(retried, F.col("page_id") % len(waits)).otherwise(0).cast("int")
    return table(spark, sf_dir, "raw_page").where("status is not null").select("page_id", F.element_at(F.array(*map(F.lit, waits)), tries + 1).alias("waited"))


def coerced_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options sent as texts, read as what they stand for; what can't be read names the option."""

    def read(text: str) -> str:
        try:
            got = O.coerced_options({"n": text, "flag": "TRUE", "list": f'["{text}"]'}, {"n": "int", "flag": "bool", "list": "list"})
            return f"{got['n']} {got['flag']} {got['list'][0]}"
        except O.OptionError as e:
            return str(e).split(":")[0]

    k = F.col("k")
    text = F.when(k % 3 == 0, F.concat(k, F.lit(".5"))).when(k % 3 == 1, F.concat(k, F.lit(".0"))).otherwise(k.cast("string"))
    return _events(spark, sf_dir).select("event_id", _mapped(read)(text).alias("read"))


def parsed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action lines of a page, and the line that is wrong."""

    def read(text: str) -> str:
        try:
            return ";".join(f"{v}({','.join(a)})" for v, a in P.parse_actions(text.split("\n")))
        except P.ActionError as e:
            return str(e).split(":")[0]

    k = F.col("k")
    lines = F.concat(F.lit("Click #b"), k, F.lit("\n\ntype #q two words\n"), F.when(k % 4 == 0, F.lit("jump 3")).when(k % 4 == 1, F.lit("wait 40000")).when(k % 4 == 2, F.lit("type #q")).otherwise(F.concat(F.lit("wait "), k)), F.lit("\nscreenshot"))
    return _events(spark, sf_dir).select("event_id", _mapped(read)(lines).alias("actions"))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(text: str) -> int | None:
        try:
            w, h = P.viewport(text)
            return w * h
        except ValueError:
            return None

    k = F.col("k")
    text = F.concat(k, F.when(k % 2 == 0, F.lit("x")).otherwise(F.lit("X")), F.when(k % 5 == 0, F.lit("0")).otherwise(F.lit("600")))
    return _events(spark, sf_dir).select("event_id", _mapped(read, "bigint")(text).alias("pixels"))


def decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a round trip through chains of content encodings; unknown encodings are errors."""
    import gzip
    import zlib

    import zstandard

    chains = {"gzip": gzip.compress, "deflate": zlib.compress, "zstd": lambda b: zstandard.ZstdCompressor().compress(b), "gzip, deflate": lambda b: zlib.compress(gzip.compress(b)), "identity": bytes, "rot13": bytes}

    @F.pandas_udf("string")
    def trip(texts: pd.Series, names: pd.Series) -> pd.Series:
        def one(text: str, name: str) -> str:
            try:
                return P.decoded(chains[name](text.encode()), name).decode()
            except P.FetchError as e:
                return str(e)

        return pd.Series([one(t, n) for t, n in zip(texts, names)])

    name = F.element_at(F.array(*map(F.lit, chains)), (F.col("doc_id") % len(chains) + 1).cast("int"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(trip("text", name)).alias("md5"))


def naive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted href values of every page, whatever they stand on."""
    return table(spark, sf_dir, "raw_page").where("html is not null").select("page_id", F.size(X.naive_hrefs("html")).alias("links"), F.concat_ws(" ", X.naive_hrefs("html")).alias("hrefs"))


QUERIES = {
    f.__name__: f
    for f in (
        json_valid_bodies, json_paths, canonical_json, schema_hashes, first_objects, leaf_texts, typed_nodes, gated_data, coerced_prices, parsed_counts, projected_costs, video_ids, document_titles, endpoints, sticky_proxies, exit_codes, retry_waits, coerced_options, parsed_actions, viewports, decoded_bodies, naive_links,
    )
}

_E = "(SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"
_LONG = "'A sentence about the item named ' || p_name || ' which is long enough'"
SQL = {
    "json_valid_bodies": "SELECT body_id, json_valid(body) AS valid FROM api_body WHERE body IS NOT NULL",
    "json_paths": "SELECT body_id, CASE WHEN json_valid(body) THEN CASE extractor WHEN 'reddit' THEN body->>'$[0].data.children[0].data.id' ELSE body->>'$.items[0].score' END END AS value FROM api_body WHERE body IS NOT NULL AND status = 200 AND extractor IN ('reddit', 'stackoverflow') AND body NOT LIKE '\"%'",
    "canonical_json": f"SELECT event_id, c AS canonical, sha256(c) AS hash FROM (SELECT event_id, '{{\"a\":[1.5,true,null],\"b\":' || k || ',\"z\":\"\\u003c' || event_type || '\\u003e\"}}' AS c FROM {_E})",
    "schema_hashes": "SELECT DISTINCT event_type, sha256('{\"properties\":{\"' || event_type || '\":{\"type\":\"integer\"},\"zz\":{\"type\":\"string\"}},\"required\":[\"' || event_type || '\"],\"type\":\"object\"}') AS hash, event_type || ',zz' AS columns FROM events",
    "first_objects": "SELECT event_id, props || chr(10) || '{\"t\": \"}' || event_type || '\"}' AS objects FROM events",
    "leaf_texts": f"SELECT p_partkey, {_LONG} || chr(10) || chr(10) || p_brand || ' — ' || {_LONG} AS text FROM part",
    "typed_nodes": "SELECT p_partkey, p_size || ',1' AS nodes, p_name AS author FROM part",
    "gated_data": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '```json[null]```' ELSE '```json[{\"@type\":\"Product\",\"n\":\"' || replace(p_name, ' ', '') || '\"}]```' END AS kept FROM part",
    "coerced_prices": "SELECT p_partkey, round(p_retailprice, 2) AS euro, round(p_retailprice, 2) AS number, CAST(p_size AS BIGINT) AS size, CAST(p_size AS BIGINT) AS by_regex, p_name AS name, CAST(NULL AS DOUBLE) AS none FROM part",
    "parsed_counts": "SELECT p_partkey, CAST((CAST(p_size AS BIGINT) * 1000 + 500) * CASE p_size % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS BIGINT) AS n, CAST(0 AS BIGINT) AS none, regexp_replace(p_brand || 'x' || p_name, '[^A-Za-z0-9_-]', '', 'g') AS css FROM part",
    "projected_costs": "SELECT doc_id, round(strlen(text) // 4 / 1e6 * coalesce(length(source) / 10.0, 2.0), 9) AS usd FROM documents",
    "video_ids": "SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 5 <> 4 THEN lpad(CAST(p_partkey AS VARCHAR), 11, 'v') END AS video FROM part",
    "document_titles": r"SELECT page_id, CASE WHEN page_id % 4 = 0 OR s = '' THEN CASE WHEN page_id % 4 = 0 THEN 'document' ELSE 'document' END ELSE s END AS title, page_id % 3 = 0 OR page_id % 5 = 0 OR starts_with(coalesce(html, ''), '%PDF-') OR starts_with(lower(trim(coalesce(content_type, ''))), 'application/pdf') AS pdf FROM (SELECT *, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]*/?.*?([^/]*)$', 1) AS s FROM raw_page WHERE url IS NOT NULL)",
    "endpoints": "SELECT item_id, CASE WHEN e THEN 'http://u' || item_id || ':sq7@' ELSE 'http://' END || host || ':8' || (item_id % 100) AS proxy, 'http://' || host || ':8' || (item_id % 100) AS shown, host LIKE '%.example' OR host LIKE '%.paperlantern.test' OR host = 'paperlantern.test' AS direct FROM (SELECT *, item_id % 2 = 0 AS e FROM batch_item)",
    "sticky_proxies": "SELECT DISTINCT host, 'True' AS moved, 'True' AS back FROM batch_item",
    "exit_codes": "SELECT run_id, CASE WHEN count(*) FILTER (ok) = 0 AND count(*) FILTER (NOT ok) > 0 THEN 3 WHEN count(*) FILTER (NOT ok) > 0 THEN 4 ELSE 0 END AS code FROM batch_item GROUP BY run_id",
    "retry_waits": "SELECT page_id, CASE WHEN status BETWEEN 200 AND 299 OR status IN (400, 401, 403, 404, 410) THEN 0.0::DOUBLE ELSE CASE page_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 ELSE 3.5 END::DOUBLE END AS waited FROM raw_page WHERE status IS NOT NULL",
    "coerced_options": f"SELECT event_id, CASE k % 3 WHEN 0 THEN 'n' WHEN 1 THEN k || ' True ' || k || '.0' ELSE k || ' True ' || k END AS read FROM {_E}",
    "parsed_actions": f"SELECT event_id, CASE WHEN k % 4 = 3 THEN 'click(#b' || k || ');type(#q,two words);wait(' || k || ');screenshot()' ELSE 'line 4' END AS actions FROM {_E}",
    "viewports": f"SELECT event_id, CASE WHEN k % 5 <> 0 AND k > 0 THEN CAST(k * 600 AS BIGINT) END AS pixels FROM {_E}",
    "decoded_bodies": "SELECT doc_id, md5(CASE WHEN doc_id % 6 = 5 THEN 'unknown content encoding ''rot13''' ELSE text END) AS md5 FROM documents WHERE text IS NOT NULL",
    "naive_links": "SELECT page_id, CAST(len(h) AS INTEGER) AS links, array_to_string(h, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM raw_page WHERE html IS NOT NULL)",
}
