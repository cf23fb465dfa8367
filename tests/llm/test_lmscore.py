import duckdb
import numpy as np

from modelgraph.llm import lmscore

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(lmscore.OP2_SQL).fetchall()
    got = lmscore.op2_cross_entropy_difference(spark, SF)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scores_tell_target_from_rest(spark):
    a, b = "the cat sat on the mat ", "stock prices fell again today "
    rows = [(i, a * 3, "c") for i in range(5)] + [(10 + i, b * 3, "c") for i in range(5)] + [(20, None, "c"), (21, "", "c"), (22, "unseen words only", "c"), (None, a, "c"), (0, a * 3, "c"), (23, "x " * 100_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target = spark.createDataFrame([(i,) for i in (0, 1, 2, 99, None)], "doc_id long")
    got = lmscore.cross_entropy_difference(docs, target).collect()
    assert len(got) == len(rows)
    s = {r.doc_id: r.score for r in got}
    assert max(s[i] for i in range(5)) < 0 < min(s[i] for i in range(10, 15))
    assert s[20] is None and s[21] is None and s[22] is None and s[23] > 0
    assert lmscore.cross_entropy_difference(docs.limit(0), target).count() == 0
    assert lmscore.cross_entropy_difference(docs, target.limit(0)).count() == len(rows)


def test_packing():
    c = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert (lmscore.unpack_counts(lmscore.pack_counts(c), len(c)) == c).all()
    k = np.array([3, 2**16, 2**40 + 2**20, 2**63, 2**63 + 1, 2**64 - 1], np.uint64)
    assert (lmscore.unpack_keys(lmscore.pack_keys(k), len(k)) == k).all()
