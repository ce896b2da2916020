import json
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltworks.functions import urls as U
from siltworks.operators import extraction as X
from siltworks.operators import frontier as G
from siltworks.operators import ledger as L
from siltworks.operators import robots as R
from siltworks.operators import schema as S
from siltworks.operators import selectors as K
from siltworks.operators import sequences as Q
from siltworks.operators import verticals as V
from siltworks.operators.registry import Registry, RegistryError, json_transform, register_table_functions
from siltworks.sources import pages as P
from siltworks.sources import sinks as W

T0 = datetime(2026, 1, 1)


#: A small site: cycles, a subdomain, an asset, a tracking duplicate, a tail beyond depth 3.
SITE = (
    ("https://site.test/", "https://site.test/a"), ("https://site.test/", "https://site.test/b?utm_source=x"), ("https://site.test/", "https://sub.site.test/s"), ("https://site.test/", "mailto:a@site.test"),
    ("https://site.test/a", "https://site.test/b"), ("https://site.test/a", "https://site.test/"), ("https://site.test/b", "https://site.test/c#top"), ("https://site.test/b", "https://site.test/file.pdf"),
    ("https://site.test/c", "https://SITE.test:443/d"), ("https://site.test/d", "https://site.test/e"), ("https://site.test/e", "https://site.test/a"),
)

def test_crawl_depths_and_caps(spark):
    links = spark.createDataFrame(SITE, "src string, url string").select(U.url_hash(U.canonical_url("src")).alias("src_hash"), "url")
    seeds = spark.createDataFrame([("https://site.test/",), ("https://site.test/#x",)], "url string")
    scope = U.in_scope("url", "https://site.test/")
    got = {r.url.rsplit("/", 1)[1]: r.depth for r in G.crawl(seeds, links, 3, None, scope).collect()}
    assert got == {"": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert {r.url for r in G.crawl(seeds, links, 3, 3, scope).collect()} == {"https://site.test/", "https://site.test/a", "https://site.test/b"}
    assert G.crawl(seeds, links, 0, None, scope).count() == 1


def test_robots():
    body = "User-agent: Silt\nDisallow: /x\nCrawl-delay: 3\n\nuser-agent: *\nDisallow: /\nAllow: /pub/*.html$\n"
    assert R.allowed(body, 200, "siltbot", "/y") and not R.allowed(body, 200, "siltbot", "/xy")
    assert R.allowed(body, 200, "other", "/pub/a.html") and not R.allowed(body, 200, "other", "/pub/a.htm")
    assert R.allowed(None, 404, "b", "/") and not R.allowed(None, 503, "b", "/") and not R.allowed(None, None, "b", "/")
    assert R.crawl_delay(body, "siltbot") == 3 and R.crawl_delay(body, "other") == 0


def test_sitemap_documents():
    import gzip

    xml = b'<urlset xmlns="n"><url><loc> http://a/?x=1&amp;y=2 </loc></url><url><loc>http://a/?x=1&amp;y=2</loc></url></urlset>'
    assert R.sitemap_entries(gzip.compress(xml)) == ("urlset", ["http://a/?x=1&y=2"])
    assert R.sitemap_entries(b"<urlset><url>") == ("", []) and R.sitemap_entries(None) == ("", [])


def test_healing_fold_fires_and_resets(spark):
    rows = [("d", "f", i, i > 35) for i in range(1, 61)] + [("d", "g", i, i % 10 < 3) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "domain string, field string, seq bigint, is_null boolean")
    got = {(r.field, r.seq) for r in Q.heal_triggers(df, ["domain", "field"], "seq", "is_null").collect()}

    def fold(outcomes):
        ring, out = [], []
        for s, n in outcomes:
            ring = (ring + [n])[-50:]
            if len(ring) >= 10 and sum(ring) / len(ring) > 0.30:
                out.append(s)
                ring = []
        return out

    assert got == {(f, s) for f in "fg" for s in fold([(i, n) for _, g, i, n in rows if g == f])}
    assert ("f", 51) in got and ("g", 11) in got


def test_throttle_vectors(spark):
    rows = [("h", 1, 200, None), ("h", 2, 429, None), ("h", 3, 503, 7.0), ("h", 4, 200, None), ("k", 1, 404, None), ("m", 1, 429, 900.0)] + [("z", i, 500, None) for i in range(20)]
    df = spark.createDataFrame(rows, "host string, seq int, status int, ra double")
    got = {r.host: r.delay_s for r in Q.throttle_delays(df, "host", "seq", "status", "ra").collect()}
    assert got == {"h": 5.25, "k": 0.0, "m": 300.0, "z": 60.0}


def test_token_bucket_against_simulation(spark):
    times = [0, 0, 0, 0, 0.2, 5, 5, 5, 5, 5]
    df = spark.createDataFrame([("h", i, float(t)) for i, t in enumerate(times)], "host string, i int, at double")
    got = [r.admitted_s for r in Q.admissions(df, "host", "i", "at").orderBy("i").collect()]
    tokens, last, want = 3.0, 0.0, []
    for t in times:
        now = max(t, last)
        tokens = min(3.0, tokens + now - last)
        wait = max(0.0, 1 - tokens)
        last, tokens = now + wait, tokens + wait - 1
        want.append(last)
    assert got == pytest.approx(want)


def test_versions_and_ledger(spark):
    v = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("w", 1, None)], "u string, seq int, md string")
    assert [(r.u, r.seq, r.changed) for r in Q.changes(v, ["u"], ["seq"], "md").orderBy("u", "seq").collect()] == [("u", 1, False), ("u", 2, False), ("u", 3, True), ("w", 1, False)]
    log = spark.createDataFrame([("r", "x", 1, "pending", None), ("r", "x", 2, "inflight", T0), ("r", "x", 3, "done", T0), ("r", "y", 4, "inflight", T0), ("r", "y", 5, "error", None)], "run_id string, url_hash string, seq int, status string, updated_at timestamp")
    cur = L.latest_status(log)
    assert {(r.url_hash, r.status) for r in cur.collect()} == {("x", "done"), ("y", "inflight")}
    assert {r.status for r in L.reset_inflight(cur).collect()} == {"done", "pending"}
    events = spark.createDataFrame([("r", 1, "begin", "running", T0), ("r", 2, "finish", "finished", T0 + timedelta(hours=1)), ("s", 3, "begin", "running", T0), ("r", 4, "resume", "running", T0)], "run_id string, seq int, event string, status string, at timestamp")
    state = L.run_state(events)
    assert {(r.run_id, r.status, r.finished_at) for r in state.collect()} == {("r", "running", None), ("s", "running", None)}
    with pytest.raises(L.UnknownRun):
        L.one_run(state, "none")
    old = spark.createDataFrame([("d", 1, T0)], "k string, n int, updated_at timestamp")
    new = spark.createDataFrame([("d", 2, T0), ("e", 3, T0)], "k string, n int, updated_at timestamp")
    assert {(r.k, r.n) for r in L.upserted(old, new, ["k"]).collect()} == {("d", 2), ("e", 3)}
    grown = L.with_columns_added(old, {"proxy": ("string", ""), "n": ("bigint", 0)})
    assert grown.first().proxy == ""


def test_schema_errors_types_and_load(spark):
    doc = {"type": "object", "required": ["name", "price"], "additionalProperties": False, "properties": {"name": {"type": "string", "x-hints": {"trim": True}}, "price": {"type": "number", "x-hints": {"coerce": "eur_decimal"}}, "kind": {"enum": ["a", "b"]}, "n": {"type": ["integer", "null"]}}}
    schema = S.load(json.dumps(doc))
    rows = ['{"name":"W","price":"12.99"}', '{"name":"W","price":1}', '{"name":"W","price":1.5,"n":2.0,"kind":"a"}', '{"price":1}', '{"name":"W","price":1,"x":1,"kind":"c","n":1.5}', "no", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(S.errors(F.col("r"), schema)).collect()]
    assert got == [["/price: want number, have string"], [], [], ["/name: required"], ["/: additional x", "/kind: not in enum", "/n: want integer|null, have number"], ["/: not an object"], ["/: not an object"]]
    t = S.typed(spark.createDataFrame([('{"name":" W ","price":"7,50 €"}',)], "r string"), "r", schema).first()
    assert (t["name"], t["price"]) == ("W", 7.5) and schema.columns == ["name", "price", "kind", "n"]
    with pytest.raises(S.SchemaError):
        S.load('{"properties": {"a": {"x-hints": {"coerce": "roman"}}}}')
    assert S.load(None).fields == ["title"] and len(schema.hash) == 64


def test_learning_prefers_hints_and_heals():
    from siltworks.functions.dom import parse

    page = '<h1>{n}</h1><div><b class="price">{p} €</b></div>'
    samples = [{"root": parse(page.format(n=n, p=p)), "side": None, "truth": {"name": n, "price": p + 0.0, "gone": None}} for n, p in (("A", 5), ("B", 6), ("C", 7))]
    doc = K.synthesized(samples, {"name": {"css_hint": "h1"}, "price": {"coerce": "eur_decimal"}}, ["name", "price", "color"], lambda fields, _: {"color": "i"})
    assert doc["name"]["expr"] == "h1" and doc["price"]["expr"] == "b.price" and doc["color"]["expr"] == "i"
    new = {"price": {"type": "css", "expr": "b"}}
    assert K.healed(json.dumps(doc), new, ["price"], 3) == ({**doc, "price": new["price"]}, False)
    assert K.healed(json.dumps(doc), new, ["price", "name"], 3) == (new, True)
    assert K.needed(1) == 1 and K.needed(2) == 2 and K.needed(3) == 2


def test_apply_selectors_reports_missing(spark):
    fields = json.dumps({"name": {"type": "css", "expr": "h1"}, "tags": {"type": "css", "expr": "li", "multiple": True}, "p": {"type": "jsonld", "expr": "$.offers.price"}})
    cache = spark.createDataFrame([("d", fields)], "domain string, fields string")
    pages = spark.createDataFrame([(1, "d", '<h1>x</h1><li>a</li><li>b</li><script type="application/ld+json">{"offers":{"price":3}}</script>'), (2, "d", "<p>"), (3, "e", "<h1>x")], "id bigint, domain string, html string")
    got = {r.id: (r.record, r.missing) for r in K.apply_selectors(pages, cache).collect()}
    assert got == {1: ('{"name":"x","p":3,"tags":["a","b"]}', []), 2: ('{"name":null,"p":null,"tags":null}', ["name", "p", "tags"]), 3: (None, None)}


def test_repair_loop_and_cache_first(spark):
    schema = S.load(json.dumps({"type": "object", "required": ["name", "price"], "properties": {"name": {"type": "string"}, "price": {"type": "number", "x-hints": {"coerce": "eur_decimal", "jsonld_path": "$.p"}}}}))

    def model(system, user):
        if "boom" in user:
            raise ConnectionError("down")
        return '{"name": "N", "price": "2,50 €"}' if "not valid" in user else "oops"

    pages = spark.createDataFrame([(1, None, "text"), (2, None, "boom")], "id bigint, sidecar string, markdown string")
    got = {r.id: tuple(r)[1:] for r in X.extract(pages, schema, model).collect()}
    assert got == {1: ('{"name":"N","price":2.5}', 2, ""), 2: (None, 1, "model: down")}
    cached = spark.createDataFrame([(1, '{"name":"C","price":1}', []), (2, None, None)], "id bigint, record string, missing array<string>")
    first = {r.id: (r.record, r.from_cache) for r in X.cache_first(pages, cached, schema, model).collect()}
    assert first == {1: ('{"name":"C","price":1}', True), 2: (None, False)}


def test_typed_records(spark):
    rows = [("pypi", "https://pypi.org/project/x/", '{"info": {"name": "x", "version": "1"}}'), ("npm", "https://npmjs.com/package/y", '{"name": "y", "dist-tags": {"latest": "2.0"}, "versions": {"2.0": {"version": "2.0", "description": "d2"}}, "description": "d"}'), ("crates_io", "https://crates.io/crates/z", '{"crate": {"name": "z", "downloads": 7}}'), ("dockerhub", "https://hub.docker.com/r/o/r", '{"name": "r", "star_count": 3}'), ("huggingface", "https://huggingface.co/datasets/o/n", '{"id": "o/n", "tags": ["t"]}'), ("shopify_product", "https://s.test/products/p", '{"title": "P", "price": 1999, "images": [{"src": "i"}, {}]}'), ("youtube", "https://youtu.be/abcdefghijk", '{"videoDetails": {"title": "V", "viewCount": "12"}}'), ("arxiv", "https://arxiv.org/abs/1.2v3", '<feed xmlns="x"><entry><title> A </title><author><name>N1</name></author><author><name>N2</name></author></entry></feed>'), ("ecommerce_product", "https://s.test/", '{"name": "E", "brand": {"name": "B"}, "offers": [{"price": 5, "priceCurrency": "EUR"}]}'), ("trustpilot", "https://www.trustpilot.com/review/d", '{"name": "O", "aggregateRating": {"ratingValue": "4.5"}}')]
    got = {}
    for name, url, body in rows:
        got[name] = V.records(spark.createDataFrame([(url, 200, body)], "url string, status int, body string"), name).first().record.asDict(True)
    assert got["pypi"]["version"] == "1" and got["npm"]["description"] == "d2" and got["crates_io"]["downloads"] == 7 and got["dockerhub"]["star_count"] == 3
    assert got["huggingface"]["kind"] == "dataset" and got["huggingface"]["tags"] == ["t"] and abs(got["shopify_product"]["price"] - 19.99) < 1e-9 and got["shopify_product"]["images"] == ["i"]
    assert got["youtube"]["views"] == 12 and got["arxiv"]["authors"] == ["N1", "N2"] and got["arxiv"]["title"] == "A" and got["ecommerce_product"]["brand"] == "B" and got["ecommerce_product"]["price"] == "5" and got["trustpilot"]["rating_value"] == 4.5
    bad = spark.createDataFrame([("u", 500, "{}"), ("u", 200, "x"), ("u", None, "{}")], "url string, status int, body string")
    assert [r.error for r in V.records(bad, "pypi").collect()] == ["status 500", "malformed", "status none"]


def test_content_decoding_and_egress():
    import gzip
    import zlib

    assert P.decoded(gzip.compress(zlib.compress(b"x")), "deflate, gzip") == b"x" and P.decoded(b"x", "identity") == b"x"
    with pytest.raises(P.FetchError):
        P.decoded(b"x", "magic")
    with pytest.raises(P.FetchError):
        P.decoded(gzip.compress(b"x" * 100), "gzip", cap=10)
    for url, ok in {"https://ex.com/": True, "http://127.0.0.1/": False, "http://10.1.1.1/": False, "http://169.254.169.254/": False, "http://[::1]/": False, "http://localhost./": False, "ftp://ex.com/": False, "file:///x": False, "http://8.8.8.8/": True, "http://metadata.google.internal/": False}.items():
        assert P.is_public(url) is ok, url
    assert not P.is_public("http://ex.com/", resolve=lambda h: ["10.0.0.1"])
    assert P.parse_proxy("h:1:u:p") == "http://u:p@h:1" and P.parse_proxy("# c") is None and P.redacted("http://u:p@h:1") == "http://h:1"
    pool = P.ProxyPool(["a", "b"])
    assert [pool.pick("h", 0) for _ in range(3)] == ["a", "b", "a"]
    pool.failed("a", 0)
    assert {pool.pick("h", 1) for _ in range(3)} == {"b"}
    assert P.viewport("800x600") == (800, 600) and P.parse_actions(["click #a", "wait 500", "type #q a b"]) == [("click", ["#a"]), ("wait", ["500"]), ("type", ["#q", "a b"])]
    with pytest.raises(P.ActionError, match="line 2: wait"):
        P.parse_actions(["click a", "wait 99999"])


def fake_fetch(url):
    if url.endswith("bad"):
        raise P.FetchError("refused")
    return {"status": 200, "body": f"<title>{url}</title>".encode(), "headers": {"X": "1"}}


def test_page_source_over_a_transport(spark):
    mod = sys.modules[__name__]
    sys.modules.setdefault("silt_fake_transport", mod)
    reader = P._PageReader({"urls": "https://a.test/1\nhttps://a.test/bad\nhttps://b.test/2\nhttp://127.0.0.1/", "transport": "silt_fake_transport:fake_fetch"})
    assert len(reader.partitions()) == 3
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {(r[0], r[2], r[5]) for r in rows} == {("https://a.test/1", 200, None), ("https://a.test/bad", None, "refused"), ("https://b.test/2", 200, None), ("http://127.0.0.1/", None, "address not allowed")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", "t", 0, "m"), ("v", None, 1, "n")], "url string, title string, depth int, markdown string")
    assert json.loads(W.json_array(df.orderBy("url")))[0]["url"] == "u" and W.json_array(df.where("false")) == "[]"
    W.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(W.SinkError):
        W.write_csv(df.withColumn("a", F.array("url")), str(tmp_path / "d"))
    got = W.export_process(df.repartition(2), [sys.executable, "-c", "import sys; n=len(sys.stdin.readlines()); sys.stderr.write(str(n)); sys.exit(3)"]).collect()
    assert sum(r.sent for r in got) == 2 and {r.code for r in got} == {3}
    sent, log = [], []
    W.webhook_sink(lambda b: sent.append(b) or 204, lambda u, s: log.append((u, s)))(spark.createDataFrame([("u", True, "a", "b", "d"), ("v", False, "a", "a", "")], "url string, changed boolean, old_hash string, new_hash string, diff string"), 0)
    assert log == [("u", "204")] and json.loads(sent[0])["new_hash"] == "b"


def test_registry_and_table_functions(spark):
    r = Registry()
    r.register("transform", "upper", "1.2.0", lambda df: df.select(F.upper("v").alias("v")))
    assert r.apply("upper", spark.createDataFrame([("a",)], "v string")).first().v == "A"
    for bad in (("transform", "upper", "1.0.0"), ("nope", "x", "1.0.0"), ("transform", "x", "2.0.0")):
        with pytest.raises(RegistryError):
            r.register(*bad, None)
    got = json_transform(spark.createDataFrame([("{}",), ("bad",), (None,)], "v string"), "v", lambda t: json.dumps({"n": len(json.loads(t))})).collect()
    assert got[0].v == '{"n": 0}' and got[1].v == "bad" and got[1].v_error and got[2].v is None
    register_table_functions(spark)
    assert spark.sql("SELECT url FROM page_links('<a href=\"/x\">x</a>', 'https://a.test/')").first().url == "https://a.test/x"
    assert spark.sql("SELECT count(*) n FROM sitemap_locs('<urlset><url><loc>u</loc></url></urlset>')").first().n == 1


def test_records_of_pages(spark):
    from siltworks.operators.page_records import page_records

    pages = [
        (1, "u1", '<meta property="og:title" content=" A  b "><h1> H </h1>'),
        (2, "u2", ""),
        (3, "u3", "<p>x"),
        (4, "u4", '<script type="application/ld+json">{"@type": ["Product"], "name": "P", "brand": {"name": "B"}, "offers": [{"price": "5", "priceCurrency": "EUR"}]}</script>'),
        (5, "u5", '<script>var x = {"@type": "Product", "name": "Q"};</script>'),
        (6, "u6", '<script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "O", "aggregateRating": {"ratingValue": "4.5"}}, {"@type": "Review", "reviewBody": "ok", "author": {"name": "N"}}]}</script>'),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    og = {r.id: r for r in page_records(df, "og").collect()}
    assert json.loads(og[1].record) == {"og_title": "A b", "h1": "H"} and og[3].error == "no metadata" and 2 not in og
    products = {r.id: r.record and json.loads(r.record) for r in page_records(df, "ecommerce_product").collect()}
    assert products[4] == {"name": "P", "brand": "B", "price": "5", "currency": "EUR", "availability": "", "url": "u4"} and products[5]["name"] == "Q" and products[6] is None
    reviews = {r.id: r for r in page_records(df, "trustpilot").collect()}
    assert json.loads(reviews[6].record) == {"name": "O", "rating_value": 4.5, "review_count": 0, "reviews": [{"author": "N", "body": "ok", "date": "", "rating": 0}]} and reviews[1].error == "no linked data"


def test_seeds_and_model_chain(spark):
    listed = spark.createDataFrame([("https://b.test/1",), ("https://a.test/1",), ("https://a.test/2",)], "url string")
    seed = spark.createDataFrame([("https://a.test",)], "url string")
    scope = U.in_scope("url", "https://a.test/")
    urls = lambda df: {r.url for r in df.collect()}
    assert urls(G.seeded(seed, listed, scope)) == {"https://a.test/", "https://a.test/1", "https://a.test/2"}
    assert urls(G.seeded(seed, listed, F.col("url").contains("b.test"), 2)) == {"https://a.test/"} and urls(G.seeded(seed, listed, F.col("url").contains("b.test"), 2, cap_first=False)) == {"https://a.test/", "https://b.test/1"}
    with pytest.raises(ValueError):
        G.seeded(seed, listed.where("false"), None, sitemap_only=True)

    def down(system, user):
        raise OSError("down")

    assert X.chain({"a": down, "b": lambda s, u: "yes"})("", "") == "yes"
    with pytest.raises(RuntimeError, match="a: down"):
        X.chain({"a": down})("", "")


def test_word_diff_compares_the_text_of_versions_of_a_url(spark, tmp_path):
    from datetime import datetime

    from siltworks.plans.ledger_queries import word_diff

    long = " ".join(f"w{i}" for i in range(2001))
    rows = [
        (1, "https://a.example/x", "a.example", True, "same title", "one two three", 1),
        (2, "https://a.example/y", "a.example", True, "other title", "one two three", 2),
        (3, "https://a.example/x", "a.example", True, "same title", "one 2 three", 4),
        (4, "https://a.example/x", "a.example", True, "new title", "one 2 three", 5),
        (5, "https://a.example/x", "a.example", False, "same title", None, 3),
        (6, "https://a.example/y", "a.example", True, "other title", long, 3),
        (7, "https://a.example/y", "a.example", True, "other title", None, 4),
    ]
    df = spark.createDataFrame([(*r[:6], datetime(2024, 1, r[6])) for r in rows], "item_id bigint, url string, host string, ok boolean, title string, markdown string, ingested_at timestamp")
    df.write.parquet(f"{tmp_path}/batch_item.parquet")
    got = {r.item_id: (r.diff, r.error) for r in word_diff(spark, str(tmp_path)).collect()}
    assert got == {3: ("- two\n+ 2\n", ""), 4: ("", ""), 6: ("", "too large"), 7: ("", "too large")}
