"""Fetch policy, searches, record store, running values and the small additions of the ledger."""

import random
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from siltworks.operators import frontier, ledger, robots, search, selectors, sequences
from siltworks.session import checkpointed
from siltworks.sources import sinks
from siltworks.sources.fetching import Fetcher, Policy, VirtualClock, fetch_urls
from siltworks.sources.pages import FetchError


def fetcher(transport, **policy):
    return Fetcher(transport, Policy(clock=VirtualClock, **policy))


def test_retries_follow_the_schedule_and_retry_after():
    def site(url, attempt, proxy, headers):
        return {"status": 503 if attempt < 3 else 200, "body": b"x", "headers": {"retry-after": "7"} if attempt == 2 else {}}

    f = fetcher(site, warm_up=False)
    got = f.fetch("https://a.test/")
    assert got[2] == 200 and got[6] == 3 and got[7] == 0.5 + 7


def test_pacing_lets_a_burst_pass_and_then_one_a_second():
    f = fetcher(lambda url, **_: {"status": 200, "body": b""})
    at = []
    for _ in range(6):
        f.fetch("https://a.test/x")
        at.append(f.clock.now())
    assert at == [0, 0, 0, 1, 2, 3]
    f.fetch("https://b.test/")
    assert f.clock.now() == 3


def test_egress_errors_move_on_to_the_next_proxy():
    asked = []

    def site(url, attempt, proxy, headers):
        asked.append(proxy)
        if proxy == "p1":
            raise FetchError("refused")
        return {"status": 200, "body": b""}

    f = fetcher(site, proxies=["p1", "p2"])
    assert f.fetch("https://a.test/")[8] == "p2" and asked == ["p1", "p2"]
    assert f.fetch("https://a.test/")[8] == "p2"  # p1 rests


def test_a_refusal_is_followed_by_one_visit_to_the_homepage():
    asked = []

    def site(url, **_):
        asked.append(url)
        return {"status": 403 if asked.count("https://a.test/x") < 2 and url.endswith("x") else 200, "body": b""}

    assert fetcher(site).fetch("https://a.test/x")[2] == 200
    assert asked == ["https://a.test/x", "https://a.test/", "https://a.test/x"]


def test_errors_and_private_addresses_are_rows(spark):
    def site(url, attempt, proxy, headers):
        if "down" in url:
            raise FetchError("down")
        return {"status": 200, "body": b"\x00", "headers": {"Content-Encoding": "odd"}}

    urls = spark.createDataFrame([("https://a.test/down",), ("http://127.0.0.1/",), ("https://a.test/odd",), (None,)], "url string")
    got = {r.url: r for r in fetch_urls(urls, site, Policy(clock=VirtualClock), lanes=3).collect()}
    assert got["https://a.test/down"].error == "down" and got["https://a.test/down"].attempts == 4
    assert got["http://127.0.0.1/"].error == "address not allowed" and "odd" in got["https://a.test/odd"].error and len(got) == 3


@pytest.mark.parametrize("provider", search.ENDPOINTS)
def test_search_requests(provider):
    r = search.request(provider, "a b&c", 7, "k/1", "https://s.test/")
    assert r["method"] in ("GET", "POST") and r["url"].startswith("https://") and ("a+b%26c" in r["url"] or "a b&c" in r["body"])
    with pytest.raises(search.SearchError):
        search.request("none", "q")
    if provider in ("brave", "serper", "serpapi", "exa"):
        with pytest.raises(search.SearchError):
            search.request(provider, "q")


def test_record_store_survives_a_lost_writer(spark, tmp_path):
    at = f"file://{tmp_path}/r"
    rows = lambda *x: spark.createDataFrame(x, "k int, v string, updated_at int")
    assert sinks.write_records(rows((1, "a", 1), (1, "b", 2), (2, "c", 1)), at, ["k"]) == 1
    (tmp_path / "r" / "v=2").mkdir()  # a write that never ended
    assert sinks.write_records(rows((2, "d", 0)), at, ["k"]) == 2
    assert sinks.write_records(rows((2, "d", 0)), at, ["k"]) == 3
    sinks.drop_versions(spark, at)
    assert {(r.k, r.v) for r in sinks.read_records(spark, at).collect()} == {(1, "b"), (2, "d")}
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["v=3"]


def test_running_values_in_blocks(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]) if i % 3 else "a", i, r.randint(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, x int").repartition(4)
    got = [sequences.running(df, ["k"], ["o"], {"s": F.col("x"), "n": F.lit(1)}, {"m": F.col("x")}, hot_rows=h).orderBy("o").collect() for h in (5, 1000)]
    assert got[0] == got[1] and len(got[0]) == 400


def test_row_counts_and_stamps(spark):
    with pytest.raises(ledger.NotCountable):
        ledger.row_counts({}, ["users"])
    row = ledger.stamped(spark.range(1), "at", "2026-01-02T03:04:05Z").first()
    assert row["at"] == "2026-01-02T03:04:05Z"
    cache = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "1")], "domain string, schema_hash string")
    assert selectors.cleared(cache, "a", "1").count() == 2 and selectors.cleared(cache).count() == 0 and selectors.cleared(cache, "a").count() == 1


def test_robots_by_join_and_by_broadcast(spark, monkeypatch):
    files = spark.createDataFrame([("a", 200, "user-agent: *\ndisallow: /x\nallow: /x/y$"), ("b", 503, None), ("c", 404, "gone")], "host string, status int, body string")
    pages = spark.createDataFrame([(1, "a", "/x/z"), (2, "a", "/x/y"), (3, "b", "/"), (4, "c", "/x"), (5, "d", "/x"), (6, None, "/")], "id bigint, host string, path string")
    want = {1: False, 2: True, 3: False, 4: True, 5: True, 6: True}
    assert {r.id: r.allowed for r in robots.robots_verdicts(pages, files, "bot").collect()} == want
    monkeypatch.setattr(robots, "BROADCAST_BYTES", -1)
    assert {r.id: r.allowed for r in robots.robots_verdicts(pages, files, "bot").collect()} == want


def test_progress_and_record_hooks(spark, tmp_path):
    df, seen = sinks.observed(spark.range(10), "ten", odd=F.count_if(F.col("id") % 2 == 1))
    assert df.count() == 10 and seen.get == {"rows": 10, "odd": 5}
    at = str(tmp_path / "hook")

    def each(row):
        if row["id"] == 3:
            raise ValueError
        with open(f"{at}-{row['id']}", "w"):
            pass

    sinks.record_hook(each)(spark.range(5), 0)
    assert len(list(tmp_path.iterdir())) == 4


def test_a_batch_has_a_limit(spark):
    from siltworks.api import Engine, OptionError

    pages = spark.range(101).selectExpr("id as page_id", "id as pos", "'https://a.test/' as url", "'' as final_url", "200 as status", "'<p>x</p>' as html")
    with pytest.raises(OptionError):
        Engine(spark).batch(pages)


def test_crawl_of_lists_and_of_their_pairs(spark):
    r = random.Random(5)
    rows = [(r.choice("abc"), r.randrange(6), f"https://h.test/{r.randrange(25)}{r.choice(['', '#x', '.pdf'])}") for _ in range(60)]
    at = checkpointed(frontier.discovered(spark.createDataFrame(rows, "run string, pos int, url string"), "url", keep=("run", "pos")))
    links = at.select(F.col("url_hash").alias("src_hash"), "run", (F.col("pos") + 1).alias("pos"))
    seeds, scope = at.where("pos = 0").select("url"), ~F.col("url").endswith("7")
    for cap in (None, 9):
        want = frontier.crawl(seeds, links.join(at.drop("url_hash"), ["run", "pos"]), 2, cap, scope).collect()
        got = frontier.crawl(seeds, links, 2, cap, scope, at).collect()
        assert {tuple(x) for x in got} == {tuple(x) for x in want} and len(got) == len(want) > 2


#: Items of one run in HOT; by four positions they would make 100 million pairs.
HOT = 20_000


def crawled(spark, tmp_path, query):
    """{number: depth} of a crawl over a run of HOT items, stopped after a minute."""
    rows = spark.range(HOT).selectExpr("id AS item_id", "'r' AS run_id", "CAST(id % 4 AS INT) AS pos", "concat('h', id % 5, '.test') AS host", "format_string('https://h%d.test/%05d', id % 5, id) AS url")
    rows.write.parquet(f"{tmp_path}/batch_item.parquet")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        return {int(r.url[-5:]): r.depth for r in E.queries()[query](spark, str(tmp_path)).collect()}
    finally:
        stop.cancel()


def test_capped_crawl_of_a_large_run_ends(spark, tmp_path):
    assert crawled(spark, tmp_path, "crawl_capped") == {0: 0, 1: 0, 2: 0} | dict.fromkeys([i for i in range(0, HOT, 5) if i % 4][:17], 1)


def test_crawl_of_a_large_run_ends(spark, tmp_path):
    assert crawled(spark, tmp_path, "frontier_bfs") == {i: (0, 1, 2, 1)[i % 4] for i in range(HOT)}
