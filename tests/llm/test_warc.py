import duckdb
from pyspark.sql import functions as F

from modelgraph.llm import warc

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(warc.OP1_SQL).fetchall()
    got = warc.op1_revisit_resolution(spark, SF)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[5] for r in want} == {"resolved", "mismatch", "no original"}


def test_canonical_urls(spark):
    urls = {
        "http://WWW.Example.com:80/A/b/?b=2&utm_source=q&a=1#frag": "example.com/A/b?a=1&b=2",
        "https://user:pw@example.com/": "example.com",
        " example.com/x ": "example.com/x",
        "https://example.com?sid=4": "example.com",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.k for r in df.select("u", warc.canonical_url(F.col("u")).alias("k")).collect()} == urls


def test_odd_rows(spark):
    e = lambda tag: {"etag": tag, "content-type": "a"}
    rows = [
        (1, "http://a.x/", 10, 200, e("1")), (2, "https://a.x", 20, 200, e("2")), (3, "http://www.a.x/#q", 20, 304, e('W/2')), (3, "http://www.a.x/#q", 20, 304, e('W/2')),
        (0, "http://a.x", 20, 304, e("1")), (4, "http://a.x", 5, 304, e("1")), (5, "http://a.x", 30, 304, None), (6, None, 40, 304, e("2")), (7, "http://a.x", None, 304, e("2")),
        (8, "http://a.x", 50, 404, e("2")), (9, "http://a.x", 60, None, None), (10, "http://a.x", 70, 304, {"etag": "2", "content-type": "b", "expires": "z"}),
        (11, "http://b.x", 1, 200, None), (12, "http://b.x", 2, 304, e("1")), (None, "http://a.x", 80, 304, e("2")), (20, "http://a.x", 90, 304, e("2")), (20, "http://a.x", 90, 200, e("3")),
    ]
    df = spark.createDataFrame([(a, b, t, s, h, "c") for a, b, t, s, h in rows], "record_id long, url string, t long, status int, headers map<string,string>, outcome string")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    want = sorted(
        [(3, 2, "resolved"), (3, 2, "resolved"), (0, 1, "resolved"), (4, None, "no original"), (5, 2, "mismatch"), (6, None, "no original"), (7, None, "no original"), (10, 2, "resolved"), (12, 11, "mismatch"), (None, None, "no original"), (20, 2, "resolved")], key=str
    )
    got = warc.resolve_revisits(df, slices=4).collect()
    assert sorted(((r.record_id, r.original_id, r.outcome) for r in got), key=str) == want
    assert {r.record_id: r.headers for r in got}[10] == {"etag": "2", "content-type": "a", "expires": "z"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0
