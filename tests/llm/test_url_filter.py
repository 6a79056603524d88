import duckdb
import pytest

from pyspark.sql import functions as F

from compare import rows_of
from twinloom.llm.queries import ORACLES, URL_RULES
from twinloom.llm.url_filter import judge_urls, registered_domain, suffix_of

URLS = [
    (1, "http://a.net/x"), (2, "http://a.net"), (3, "https://Example.NET/en/1?q#f"), (4, "https://m.example.net/en"),
    (5, "http://notexample.net/en/"), (6, "http://www.example.com/de/7#/de/"), (7, "http://b.org/fr/"), (8, "http://org/fr/x"),
    (9, None), (10, ""), (11, "no scheme/net/"), (12, "a://b://c.net/"), (13, "http://?x"), (14, "http://h.com#net/"),
    (15, "http://x.borg/fr/"), (1, "http://a.net/x"), (None, "http://bad.com/1"), (17, "http://u@H.Com:80/fr/"),
]
VERDICTS = {
    1: ("net/", "block"), 2: (None, None), 3: ("example.net/en/", "allow"), 4: ("net/", "block"), 5: ("net/", "block"),
    6: ("example.com/de/", "block"), 7: ("org/fr/", "allow"), 8: ("org/fr/", "allow"), 9: (None, None), 10: (None, None),
    11: (None, None), 12: (None, None), 13: (None, None), 14: (None, None), 15: (None, None), 17: (None, None),
}


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "x") for r in rows], "page_id long, url string, html string, host string")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_rules(spark):
    found = judge_urls(pages(spark, URLS), labelled(spark, []), URL_RULES).collect()
    assert len(found) == len(URLS)
    for row in found:
        if row["page_id"] is not None:
            rule, verdict = VERDICTS[row["page_id"]]
            assert (row["rule"], row["verdict"]) == (rule, verdict or "allow"), row
    hosts = {r["page_id"]: (r["host"], r["path"]) for r in found}
    assert hosts[3] == ("example.net", "/en/1") and hosts[9] == ("", "") and hosts[12] == ("b:", "//c.net/")
    assert hosts[14] == ("h.com", "") and hosts[17] == ("u@h.com:80", "/fr/")


def test_reputation(spark):
    rows = [(i, f"http://{h}.site.com/{i}") for h, r in (("bad", range(50)), ("good", range(50, 150)), ("new", (150,))) for i in r]
    marks = [(i, 0 if i < 50 else 1, 0) for i in range(150)] + [(3, 0, 0), (None, 0, 0), (60, None, None)]
    found = {r["page_id"]: r for r in judge_urls(pages(spark, rows), labelled(spark, marks), URL_RULES).collect()}
    assert found[0]["verdict"] == "block" and found[60]["verdict"] == "allow" and found[150]["verdict"] == "allow"
    # A host without outcomes is as uncertain as its domain.
    assert found[150]["bad_rate_bound"] < found[60]["bad_rate_bound"] < 0.1 < 0.5 < found[0]["bad_rate_bound"]


@pytest.mark.parametrize("kind", ["given", "none"])
def test_same_as_sql(spark, kind):
    rows = URLS + [(100 + i, f"http://h{i % 7}.d{i % 3}.com/{i}") for i in range(200)]
    hosts = ["a.b.co.uk", "c.b.co.uk:8080", "co.uk", "10.1.1.1", "10.1.1.1:80", "[2001:db8::1]", "b.com.br:", "com:80", "x.y.com.", "uk"]
    rows += [(300 + i, f"http://{hosts[i % len(hosts)]}/{i}") for i in range(60)]
    marks = [(i, int(i % 7 != 2), int(i % 5 == 0)) for i in range(0, 360, 2)] if kind == "given" else []
    ours = judge_urls(pages(spark, rows), labelled(spark, marks), URL_RULES)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    db.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    if marks:
        db.executemany("INSERT INTO labels VALUES (?, ?, ?)", marks)
    result = db.execute(ORACLES["op10_url_filters"])
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    assert rows_of(ours.columns, ours.collect()) == theirs


def test_levels(spark):
    want = {
        "shop.spam.co.uk": ("spam.co.uk", "co.uk"), "a.b.com.br": ("b.com.br", "com.br"), "b.com.br": ("b.com.br", "com.br"),
        "co.uk": ("co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "y.com": ("y.com", "com"), "com": ("com", "com"), "": ("", ""),
        "10.1.1.1": ("10.1.1.1", "10.1.1.1"), "10.1.1.1:80": ("10.1.1.1", "10.1.1.1"),
        "x.y.com:8080": ("y.com", "com"), "a.b.co.uk:1": ("b.co.uk", "co.uk"), "com:80": ("com", "com"),
        "[2001:db8::1.2.3.4]": ("[2001:db8::1.2.3.4]", "[2001:db8::1.2.3.4]"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    found = hosts.select("host", registered_domain(F.col("host")), suffix_of(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == want


def test_siblings_under_a_public_suffix(spark):
    """A new host learns from its own domain, not from others under the same suffix."""
    rows = [(i, f"http://s{i % 5}.{d}.co.uk/{i}") for d, r in (("bad", range(100)), ("good", range(100, 200))) for i in r]
    rows += [(200, "http://new.bad.co.uk/"), (201, "http://new.good.co.uk/")]
    marks = [(i, int(i >= 100), 0) for i in range(200)]
    found = {r["page_id"]: r for r in judge_urls(pages(spark, rows), labelled(spark, marks), URL_RULES).collect()}
    assert found[200]["verdict"] == "block" and found[201]["verdict"] == "allow"


def test_no_python_and_empty(spark):
    found = judge_urls(pages(spark, []), labelled(spark, []), URL_RULES)
    assert found.count() == 0
    plan = judge_urls(pages(spark, URLS), labelled(spark, []), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
