import __spark_entry__ as E
from siltworks.api import Engine, OptionError
from siltworks.session import table

import pytest


def test_queries_and_sql_agree_on_names():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def test_engine_scrape_formats(spark, data):
    e = Engine(spark)
    pages = table(spark, data, "raw_page")
    for fmt in ("markdown", "llm", "text", "json", "html"):
        assert e.scrape(pages, fmt).where("content is not null").count() > 10
    with pytest.raises(OptionError):
        e.scrape(pages, "pdf")
    assert e.crawl(pages, pages.first().url, max_depth=1).count() >= 1
