import numpy as np
from pyspark.sql import functions as F

from modelgraph.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op10_quality_neighbours(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    x = got.where("held_out").join(labels, "doc_id").toPandas()
    assert ((x.predicted == 1) == (x.quality == 1)).mean() > 0.9
    assert x[x.quality == 1].predicted.mean() > 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_scores_match_brute_force():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.3, (60, 128)).astype(np.float32)
    space = quality.Space(counts[:40], (np.arange(40) % 2), (counts > 0).sum(0), 60, 16)
    z, _ = space.placed(counts)
    for i, got in enumerate(space.scores(counts, 5)):
        cos = z[i] @ space.vectors.T
        near = np.argsort(-cos)[:5]
        w = np.maximum(cos[near].astype(float), 0) ** 8
        assert abs(got - (w * space.label[near]).sum() / w.sum()) < 1e-4


def test_odd_rows(spark):
    rows = [(1, "good words here and there", 1), (1, "good words here and there", 1), (2, "@@@@ #### $$$$ %%%%", 0), (None, "x y z", None), (3, None, 1), (4, "", 0), (5, "ab " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("quality_score", F.lit("clash"))
    space = quality.fit(docs, docs)
    got = quality.score(docs, space).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    empty = docs.limit(0)
    assert quality.score(empty, quality.fit(empty, empty)).count() == 0
    assert quality.score(docs, quality.fit(docs, empty)).count() == len(rows)


def test_query_matches_brute_force(spark):
    """Every document's cosines with all labelled vectors, sorted; equal ones may vote either way."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    space = quality.fitted(spark, docs, sf)
    got = {r.doc_id: r.score for r in quality.op10_quality_neighbours(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        z, there = space.placed(quality.trigram_counts(t or "", len(space.idf))[None])
        cos = np.maximum((z @ space.vectors.T)[0].astype(float), 0)
        edge = np.sort(cos)[-15]
        sure, tied = cos > edge + 1e-6, np.abs(cos - edge) <= 1e-6
        free = 15 - sure.sum()
        w, votes = (cos[sure] ** 8).sum() + free * edge**8, (cos[sure] ** 8 * space.label[sure]).sum()
        ones = min(free, space.label[tied].sum())
        least = max(0, free - (1 - space.label[tied]).sum())
        if there[0] and w > 1e-12:
            assert (votes + least * edge**8) / w - 1e-4 <= got[d] <= (votes + ones * edge**8) / w + 1e-4
        else:
            assert got[d] == space.prior
