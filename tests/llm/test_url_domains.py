"""Registered domains and suffixes of hosts."""

from pyspark.sql import functions as F

from tidemark.llm import url_filter


def test_levels(spark):
    want = {
        "a.spam.co.uk": ("spam.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.me.github.io:80": ("me.github.io", "github.io"), "a.b.org": ("b.org", "org"), "org": ("org", "org"), "": ("", ""),
        "10.0.0.1": ("10.0.0.1", "[address]"), "[::1]:8080": ("[::1]", "[address]"), "a.b.c.ck": ("b.c.ck", "c.ck"), "x.www.ck": ("www.ck", "ck"),
    }
    domain, suffix = url_filter.levels(F.col("host"), [*url_filter.SUFFIXES, "*.ck", "!www.ck"])
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(h,) for h in want], "host string").select("host", domain, suffix).collect()}
    assert got == want


def test_hosts_of_a_shared_suffix_do_not_share_a_domain(spark):
    rows = [("a.spam.co.uk", 1)] * 200 + [(f"h{i}.y{i}.co.uk", 0) for i in range(600)] + [("b.spam.co.uk", None), ("b.other.co.uk", None)]
    pages = spark.createDataFrame([(i, f"http://{h}/", b) for i, (h, b) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages.select("page_id", "url"), pages.where("bad is not null").select("page_id", "bad"), []).collect()}
    assert got["b.spam.co.uk"] == "block" and got["b.other.co.uk"] == "allow"
