import hashlib

import duckdb
import pytest

from modelgraph.llm import fillmiddle

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    x, y, z = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}", text
    return doc_id, n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}", text


def odd_rows():
    texts = [None, "", "a", "é🎉x", "has <P> in it", "two words", "long " * 20_000, "ab\u0000\n<M", "x" * 40_001]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(None, "no id"), (None, None), (3, "twice"), (3, "twice"), (3, "other")]
    return rows


@pytest.mark.parametrize("chunk", [3, 16_384])
def test_odd_rows(spark, chunk):
    rows = odd_rows() if chunk > 3 else [r for r in odd_rows() if len(r[1] or "") < 1000]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, form string, part int")
    got = [tuple(r) for r in fillmiddle.assembled(docs, chunk=chunk).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    outputs = spark.createDataFrame([(r[0], r[2], r[5]) for r in got], "doc_id long, form string, output string")
    assert sorted(map(tuple, fillmiddle.restored(outputs, chunk=chunk).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_second_sort_needs_no_exchange(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    first = fillmiddle._sorted(fillmiddle._placed(fillmiddle.cuts(docs), 2), 3)
    again = first.mapPartitions(fillmiddle._written(fillmiddle.Text), preservesPartitioning=True)
    assert again.partitioner == first.partitioner and fillmiddle._sorted(again, 3).partitioner == first.partitioner


def test_other_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("k7", "some text to cut")], "doc_id string, text string")
    (row,) = fillmiddle.assembled(docs).collect()
    assert row.restored == "some text to cut" and row.doc_id == "k7"
    assert fillmiddle.assembled(docs.limit(0)).collect() == []


def test_query_and_sql(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = []
    for r in rows:
        *known, output, text = brute(*r)
        want.append((*known, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = fillmiddle.op11_fill_in_middle(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(fillmiddle.OP11_SQL).fetchall()) == sorted(want)
