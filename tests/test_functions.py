import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.functions import coerce as C
from siltworks.functions import jsonops as J
from siltworks.functions import quality as Q
from siltworks.functions import text as X
from siltworks.functions import urls as U
from siltworks.functions.dom import parse, select
from siltworks.functions.markdown import fallback, page_markdown
from siltworks.operators.diff import diff_words
from siltworks.operators.facts import page_facts_row, scoped, sidecar, strip_hidden


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_canonical_urls(spark):
    table = {"HTTP://EX.com:80/a?utm_x=1&b=2": "http://ex.com/a?b=2", "https://ex.com:443/a": "https://ex.com/a", "https://ex.com/?z=1&b=2": "https://ex.com/?b=2&z=1", "https://ex.com/p?gclid=1&fbclid=2&msclkid=3&utm_source=q#frag": "https://ex.com/p", "http://ex.com": "http://ex.com/", "": None, "://bad": None, "http://": None, "https://ex.com/?a&b=x y": "https://ex.com/?a=&b=x+y", "https://ex.com/?a=2&a=1": "https://ex.com/?a=2&a=1", "https://ex.com/?": "https://ex.com/?", "file:///x/y#z": "file:///x/y"}
    assert col(spark, list(table), U.canonical_url) == list(table.values())
    again = [u for u in table.values() if u]
    assert col(spark, again, U.canonical_url) == again


def test_host_path_and_redirects(spark):
    assert col(spark, ["https://U:p@Ex.com:8080/a//b/?q", "file:///x", None], U.domain_key) == ["ex.com:8080", "file", "invalid"]
    assert col(spark, ["https://ex.com/a//b/", "https://ex.com"], U.last_segment) == ["b", ""]
    assert col(spark, ["https://x.test/d/File.PDF", "https://x.test/"], U.pdf_title) == ["File", "document"]
    assert col(spark, ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.test%2F&x=1", "https://b.test/"], lambda c: U.unwrapped(c, "duckduckgo.com")) == ["https://a.test/", "https://b.test/"]
    assert col(spark, ["https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?x=1&v=abcdefghijk", "https://youtube.com/shorts/abcdefghijk", "https://youtube.com/watch?v=short"], U.video_id) == ["abcdefghijk"] * 3 + [None]
    assert col(spark, ["https://a.test/x.PDF", "https://a.test/x?f=y.pdf", "https://a.test/x.html"], U.has_asset_extension) == [True, False, False]


def test_scope(spark):
    urls = ["https://ex.com/a", "https://sub.ex.com/a", "https://evil-ex.com/a", "https://ex.com./a"]
    assert col(spark, urls, lambda c: U.in_scope(c, "https://ex.com/")) == [True, False, False, True]
    assert col(spark, urls, lambda c: U.in_scope(c, "https://ex.com/", allow_subdomains=True)) == [True, True, False, True]
    assert col(spark, ["https://ex.com/a/b/c", "https://ex.com/a/b"], lambda c: U.in_scope(c, "https://ex.com/", include=("/a/*",))) == [False, True]
    assert col(spark, ["https://ex.com/a/b/c.x"], lambda c: U.in_scope(c, "https://ex.com/", include=("/**",), exclude=("/**/*.x",))) == [False]
    with pytest.raises(U.GlobError):
        U.glob_regex("**" * 5)


def test_word_counts_and_plain_text(spark):
    md = ["", "# Hi\n\n**bold** and [link](http://x) here", "```\ncode here\n```", "![a](b) x", "a b"]
    assert col(spark, md, X.word_count) == [0, 5, 2, 1, 2]
    assert col(spark, ["# T\n\n> q **b** *i* `c`\n\n\n\nend"], X.to_text) == ["T\nq b i c\n\nend"]
    assert col(spark, ["éé" * 10], lambda c: X.cap_tokens(c, 3)) == ["é" * 6]
    assert col(spark, ["aaaaa\nbbbbbbbb", "aaaa\nbbbbbbbb"], lambda c: X.cap_tokens(c, 2)) == ["aaaaa", "aaaa\nbbb"]
    assert col(spark, ["One. Two! Three? Four", "no end"], lambda c: X.truncate_sentences(c, 2)) == ["One. Two!", "no end"]
    assert col(spark, ["42 comments", "12.3k", "•", "1,204"], X.parse_count) == [42, 12300, 0, 1204]


def test_links_are_ordered_and_unique(spark):
    md = "[a](http://x/1) ![i](http://x/i.png) [](http://x/2) [b](http://x/1) [f](#top)"
    assert [tuple(r) for r in col(spark, [md], X.links)[0]] == [("a", "http://x/1"), ("http://x/2", "http://x/2")]
    assert [r.url for r in col(spark, [md], X.images)[0]] == ["http://x/i.png"]


def test_slim_markdown():
    assert X.slim_markdown("![](x)\n**A** [b](c)\n| a | b |\n|---|---|\n| 1 | 2 |") == "A b\n| a | b |\n| 1 | 2 |"
    assert X.slim_markdown("Acme\nGlobex\n\nReal text here, with more.") == "Real text here, with more."
    assert X.slim_markdown("4.2%\nGrowth rate of all") == "Growth rate of all: 4.2%"
    assert X.slim_markdown("Same text.\n\nSame text.\n\n\n\nEnd.") == "Same text.\n\nEnd."
    assert X.slim_markdown(None) is None and X.slim_markdown("") == ""


def test_classification(spark):
    rich, thin = "word " * 250, "few words"
    rows = [(403, "akamai", thin), (401, "please sign in", thin), (503, "x", thin), (200, "<p>" + "w " * 300, thin), (200, "akamai", rich), (403, "akamai", rich), (404, "x", thin), (429, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status int, body string, md string")
    got = [r[0] for r in df.orderBy("i").select(Q.classify("status", "body", "md", F.lit("t"))).collect()]
    assert got == ["access-denied", "login-required", "unavailable", "empty", "", "", "empty", "unavailable"]


def test_challenge_and_headers(spark):
    df = spark.createDataFrame([("<p>h-captcha verify</p>", {"CF-Mitigated": ["challenge"]}), ("<p>h-captcha verify</p>", {}), ("fine", None)], "h string, m map<string,array<string>>")
    assert [r[0] for r in df.select(Q.challenge_vendor("h", "m")).collect()] == ["cloudflare", "hcaptcha", None]
    assert [r[0] for r in df.select(Q.header("m", "cf-mitigated")).collect()] == ["challenge", None, None]
    assert col(spark, [200, 404, 429, 503, 418], lambda c: Q.retry_outcome(c, F.lit("7")), "int") == ["ok", "permanent", "retry-after", "retry-after", "retry"]


def test_coercions(spark):
    assert col(spark, ["1 234,56 €", "12.99", "€7,5", "1.234,56", None], C.eur_decimal) == [1234.56, 12.99, 7.5, None, None]
    assert col(spark, ["42", " 7 ", "12,9", "x"], C.to_int) == [42, 7, 12, None]
    assert col(spark, ["ja", "NO", "maybe"], C.to_bool) == [True, False, None]
    assert col(spark, ["2024-03-12", "12.03.2024", "03/02/2024", "31/12/2024", "12/31/2024", "March 5, 2024", "5 Mar 2024", "am 1.2.2024 um", "2024-03-12T10:00:00Z", "none"], C.iso_date) == ["2024-03-12", "2024-03-12", "2024-02-03", "2024-12-31", "2024-12-31", "2024-03-05", "2024-03-05", "2024-02-01", "2024-03-12", None]
    assert col(spark, ["price 12,99 EUR", "none"], lambda c: C.apply_regex(c, r"[0-9]+[.,][0-9]{2}")) == ["12,99", None]
    with pytest.raises(ValueError):
        C.coerced("v", "roman")


def test_json_walks():
    assert J.walk_path({"offers": {"price": "49.99"}}, "$.offers.price") == "49.99"
    assert J.walk_path([{"a": 1}, {"b": [5, 6]}], "$.b.1") == 6
    assert not J.is_valid('{"a":1} x') and not J.is_valid("NaN") and J.is_valid("[]")
    assert list(J.balanced_objects('var a = {"x": "}"}; {b}')) == ['{"x": "}"}', "{b}"]
    assert J.author([{"@graph": [{"author": [{"name": " Ann "}]}]}]) == "Ann"
    assert J.gated('{"@type": "WebSite"}', "") == "" and '"a": 1' in J.gated('{"a": 1.0}', "")
    assert J.marshalled({"b": "<x>", "a": 1.0}) == '{"a":1,"b":"\\u003cx\\u003e"}'


PAGE = '<html lang="en"><head><title> T </title><meta name="Description" content="d"><meta property="og:site_name" content="S"><link rel="shortcut icon" href="/f.ico"><script type="application/ld+json">{"author": "A"}</script><style>p{color:#FF6600;font-family:Inter, "Arial"}</style></head><body><nav><a href="/n">N</a></nav><article><h1>H</h1><p>Some main text that is long enough to count as the content of this page, surely.</p><table><tr><th>a</th><th>b</th></tr><tr><td colspan=2>x</td></tr></table></article><img src="/logo.png"><div style="display: none">secret</div></body></html>'


def test_page_facts():
    f = dict(zip(["id", "title", "lang", "description", "author", "date", "site_name", "image", "favicon"], page_facts_row(1, "https://x.test/a/", PAGE)))
    assert f == {"id": 1, "title": "T", "lang": "en", "description": "d", "author": "A", "date": None, "site_name": "S", "image": None, "favicon": "https://x.test/f.ico"}
    row = page_facts_row(1, "https://x.test/a/", PAGE)
    assert row[12] == ["https://x.test/n"] and row[16] == ["#ff6600"] and row[17] == ["Arial", "Inter"] and row[18] == "/logo.png"


def test_main_content_and_fallback():
    md, fell = page_markdown(parse(PAGE))
    assert not fell and md.startswith("# H\n\nSome main text") and "| x   |     |" in md and "secret" not in md
    assert fallback(parse("<h1>A</h1><ul><li><a href=x>b</a></li></ul><table><tr><td>1<td>2</table>")) == "# A\n\n- b\nb\n\n| 1 | 2 |"


def test_hidden_scope_and_sidecar():
    assert strip_hidden("<p>a</p>") == ("<p>a</p>", 0)
    out, n = strip_hidden('<p style="opacity:0.5">a</p><p style="font-size:0.9em">b</p><p hidden>c</p><!-- d -->')
    assert n == 3 and out == '<p style="opacity:0.5">a</p>'
    assert scoped("<div><p class=a>1</p><p>2</p></div>", ["p"], [".a"]) == "<p>2</p>"
    assert scoped("<p>1</p>", ["p["], []) == "<p>1</p>" and scoped("<p>1</p>", ["h1"], []) == ""
    two = '<script type="application/ld+json">{"b":1}</script><script type="application/ld+json">bad</script><script id="__NEXT_DATA__">{"a":2}</script>'
    assert sidecar(parse(two), two) == '[{"b":1},{"a":2}]'


def test_selectors():
    t = parse('<ul id=u><li class="x y">1</li><li data-k="Ab">2</li><li>3</li></ul><p>4</p>')
    for s, want in {"ul > li.x": "1", "#u li:nth-of-type(2)": "2", '[data-k="ab" i]': "2", "li:not(.x):not([data-k])": "3", "ul + p": "4", "li:first-child, p": "14"}.items():
        assert "".join(n.content() for n in select(t, s)) == want, s
    with pytest.raises(ValueError):
        select(t, "li[")


def test_word_diff_vectors():
    assert diff_words("", "") == ("", "") and diff_words("a b", "a b") == ("", "")
    assert diff_words("the cat sat", "the dog sat") == ("- cat\n+ dog\n", "")
    assert diff_words("a c", "a b c") == ("+ b\n", "")
    long = " ".join(f"w{i}" for i in range(2001))
    assert diff_words(long, long.replace("w", "v"))[1] == "too large"
    assert diff_words(("f " * 5000) + "x " + "g " * 5000, ("f " * 5000) + "y " + "g " * 5000) == ("- x\n+ y\n", "")


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_word_diff_is_minimal_and_consistent(a, b):
    out, error = diff_words(" ".join(a), " ".join(b))
    lines = out.splitlines()
    gone, new = [x[2:] for x in lines if x[0] == "-"], [x[2:] for x in lines if x[0] == "+"]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert not error and len(gone) == len(a) - table[-1][-1] and len(new) == len(b) - table[-1][-1]
    assert sorted(set(gone)) == sorted(x for x in set(gone) if x in a) and datetime is not None
