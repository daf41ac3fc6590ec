import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from oracle import compare
from priorview.llm import urls

ODD = [None, "", "no scheme/path", "http://", "http://A.NET", "http://a.net/", "x://b.EXAMPLE.net/en/1?q#f", "http://example.net/en/",
       "http://notexample.net/en/1", "https://org/fr/2", "https://x.org/fr", "https://x.org/fr/", "https://www.example.com/de/7.html",
       "https://example.com/de", "http://h?x/y", "http://h#x", "a://b://c/d", "http://ÀÉ.example.com/de/é", "http://h//x///y", "http://h/a\nb/c",
       "http://h/" + "s/" * 30, "http://h/*/x", "http://h/" + "long" * 50_000, "HTTP://H/%2F?://z/", "http://h/en/99999999999999999999"]


def fixture():
    rng = random.Random(4)
    rows = [u for u in ODD for _ in range(2)]
    for _ in range(3000):
        host = rng.choices(["big.example.com", "b.net", "c.org", "d.example.net", "e.com"], [60, 10, 10, 10, 10])[0]
        kind = rng.choice(["en", "de", "fr", "blog", "tag%d" % rng.randrange(200)])
        tail = rng.choice(["{}", "{}.html", "{}/", "p/{}", "p/q/r/s/t/u/{}", ""])
        rows.append(f"https://{host}/{kind}/" + tail.format(rng.randrange(5000)))
    labels = [(k, 0 if k % 3 == 0 else 1, 1 if k < 900 and k % 2 else 0) for k in range(0, 5000, 2) for _ in range(1 + (k % 10 == 0))]
    return [(k, u) for k, u in enumerate(rows)], labels


def test_against_sql(spark, tmp_path):
    rows, labels = fixture()
    pages = pd.DataFrame(rows, columns=["page_id", "url"])
    marks = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"])
    spark.createDataFrame(pages.astype(object).where(pages.notna(), None), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert compare(urls.op2_url_filter(spark, str(tmp_path)), con, urls.OP2_SQL) == ""


def test_rules_and_columns(spark):
    docs = spark.createDataFrame([(u, "h", 1, "t") for u in ODD], "url string, HOST string, path int, template string")
    got = urls.judged(docs)
    assert [c.lower() for c in got.columns] == ["url", "host", "path", "template", "rule", "verdict"]
    by = {r.url: r for r in got.collect()}
    assert len(by) == len(ODD) and by[None].host == by[None].path == "" and by[None].verdict == "allow"
    assert by["http://A.NET"].rule is None and by["http://a.net/"].rule == "net/"
    assert by["x://b.EXAMPLE.net/en/1?q#f"].rule == "example.net/en/" and by["http://notexample.net/en/1"].rule == "net/"
    assert by["a://b://c/d"].host == "b:" and by["http://ÀÉ.example.com/de/é"].host == "ÀÉ.example.com"
    assert urls.judged(docs.where("false")).count() == 0


def test_bad_templates_are_rejected(spark):
    rows = [(f"http://h.com/spam/{k}", True if k % 2 else None) for k in range(200)]
    rows += [(f"http://h.com/good/{k}", False if k % 2 else None) for k in range(200)]
    docs = spark.createDataFrame(rows, "url string, bad boolean")
    got = urls.judged(docs, bad_col="bad").groupBy("template", "verdict").count().collect()
    assert {(r.template, r.verdict): r["count"] for r in got} == {("/spam/*", "block"): 200, ("/good/*", "allow"): 200}
    assert got and docs.where(F.col("bad").isNull()).count() == 200


def test_small_and_deep_sections_are_told_apart(spark):
    rows = [(f"http://h.com/s{k % 30}/{k}", k % 30 == 7) for k in range(1200)]
    rows += [(f"http://d.com/a/b/c/d/e/f/{'bad' if k % 4 == 0 else 'good'}/{k}", k % 4 == 0) for k in range(400)]
    got = urls.judged(spark.createDataFrame(rows, "url string, bad boolean"), bad_col="bad").collect()
    assert {r.verdict == "block" for r in got if r.bad} == {True} and {r.verdict == "block" for r in got if not r.bad} == {False}
    assert {r.template for r in got if r.bad} == {"/s7/*", "/a/b/c/d/e/f/bad/*"}
