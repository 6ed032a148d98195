import re

import duckdb
from pyspark.sql import functions as F

from helixmart.llm import url_filter as U

RULES = [("allow", "org", "/"), ("block", "a.org", "/x"), ("block", "b.a.org", ""), ("allow", "com", "/p/q")]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any(host == h or host.endswith("." + h) for h in ["bad.net"])
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "block" if listed else "allow", listed


def test_against_all_rules(spark):
    urls = [None, "", "no scheme", "http://A.ORG/xy?z", "https://b.a.org", "http://c.b.a.org/#f", "ftp://org/", "x://org", "http://bad.net",
            "http://sub.bad.net/p", "http://notbad.net/", "http://q.com/p/q/r", "http://q.com/p/", "http://d.com://e.com/p/q", "://org/é",
            "http://" + "a." * 300 + "org/" + "y" * 5000, "http://a.org./x", "http://a..org/x", "http://a.org:80/x", "http:///x\n/y", "HTTP://Ä.org/x"]
    urls += urls[:4]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = U.judge_urls(pages, U.entries(spark, RULES, ["bad.net"]), ["page_id"]).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.listed) == brute(urls[r.page_id]), urls[r.page_id]


def test_digest_collisions_are_told_apart_by_their_strings(spark):
    listed = U.entries(spark, RULES, ["bad.net"])
    array = U.digest_array(listed)
    wrong = array.withColumn("strings", F.lit(b"#" * 200))
    wanted = listed.select("kind", "key")
    assert U.probe(wanted, array, 2).count() == 5 and U.probe(wanted, wrong, 2).count() == 0


def test_many_shards_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(U, "SHARD_ENTRIES", 2)
    pages = spark.createDataFrame([(1, "http://sub.bad.net/"), (2, "http://b.a.org/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, U.entries(spark, RULES, ["bad.net"]), ["page_id"]).collect()}
    assert got == {1: "block", 2: "block"}
    assert U.judge_urls(pages.limit(0), U.entries(spark, RULES, []), ["page_id"]).count() == 0
    none = U.judge_urls(pages, spark.createDataFrame([], U.ENTRIES), ["page_id"]).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_matches_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tiny}/pages.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict", "listed"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({U.url_filter_sql()})").fetchall()
    got = [tuple(r[n] for n in names) for r in U.op1_url_filter(spark, tiny).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[4] for r in want}) == 2
