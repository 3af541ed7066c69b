"""The URL filter against its SQL, rules on awkward URLs, and tables without labels."""

import duckdb

from loomline.llm import oracle, queries, url_filter

SF = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = sorted(map(tuple, queries.op4_url_filter(spark, SF).collect()), key=repr)
    assert got == sorted(con.execute(oracle.ORACLE_SQL["op4_url_filter"]).fetchall(), key=repr)


ODD = [
    (1, "http://WWW.Example.COM/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "x://example.com/en", "example.com", "/en", "com/", "allow"),
    (4, "http://example.com", "example.com", "", None, None),
    (5, "http://notexample.net/es/1#f", "notexample.net", "/es/1", "net/es/", "block"),
    (6, "no scheme.com/", "", "", None, None),
    (7, None, "", "", None, None),
    (8, "", "", "", None, None),
    (9, "://net/fr/a://b", "net", "/fr/a://b", "net/fr/", "block"),
    (9, "://net/fr/a://b", "net", "/fr/a://b", "net/fr/", "block"),
    (None, "http://x.org/a\nb", "x.org", "/a\nb", None, None),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u, *_ in ODD], "page_id long, url string, host string")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).fillna("", ["rule"]).collect())
    want = sorted((i or 0, h, p, r or "", v) for i, _, h, p, r, v in ODD)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(w[4] in (None, g[4]) and g[4] in ("allow", "block") for g, w in zip(got, want, strict=True))


def test_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.org/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(pages).collect()] == ["allow", "allow"]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_learns_what_rules_block(spark):
    good = [f"http://news{i}.example.com/story/{i}" for i in range(200)]
    bad = [f"http://x{i}.net/es/casino-{i}" for i in range(200)]
    asked = [(1000 + i, f"http://y{i}.org/{'casino-' if i % 2 else 'story/'}{i}") for i in range(100)]
    pages = spark.createDataFrame([*enumerate(good + bad), *asked], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert sum(got[1000 + i] == ("block" if i % 2 else "allow") for i in range(100)) >= 95


def test_plan_is_native(spark):
    plan = url_filter.judge(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
