import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from modelgraph.llm import bpe, minhash

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "near-duplicates":
            sets = [minhash.shingles(r.text, 5) for r in docs.orderBy("doc_id").collect()]
            for i, a in enumerate(sets):
                assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for b in sets[:i])
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {r.doc_id for r in before.collect() if any(i in r.text for i in items)}
            assert hit and hit == {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
        if name == "personal data":
            assert docs.where(F.col("text").rlike("@mail[0-9]")).count() == 0 < before.where(F.col("text").rlike("@mail[0-9]")).count()
            texts = {r.doc_id: r.text for r in docs.collect()}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in docs.limit(50).collect():
        assert r.ids == lib.encode_ordinary(texts[r.doc_id])
    assert kept["quality"] > kept["near-duplicates"] > kept["decontamination"] == kept["personal data"] == kept["encoding"] > 500


def test_stages_of_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, columns that clash with the stages' own."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    clean = "the river runs past the old mill and the children count boats on a slow warm day in june"
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, item), (7, item), (7, clean), (8, clean + " indeed"), (8, clean + " indeed"), (9, None), (10, ""), (None, clean + " twice"), (11, long), (12, "write to a.b@c.de now")]
    kind = "doc_id long, text string, quality_score string, key string, key_ int, _c int, candidates string, n_chars long"
    docs = spark.createDataFrame([(i, t, "q", "k", 1, 2, "c", len(t) if t else None) for i, t in rows], kind)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert all((r.quality_score, r.key, r.candidates) == ("q", "k", "c") for r in out.collect())
        if name == "near-duplicates":
            assert texts(out) == sorted({*rows} - {(8, clean + " indeed")}, key=str)
        if name == "decontamination":
            assert texts(out) == sorted((r for r in rows if r[1] != item), key=str)
        if name == "personal data":
            assert texts(out) == sorted((r if r[0] != 12 else (12, "write to [EMAIL] now") for r in rows), key=str)
        assert stage(spark, docs.limit(0), SF).collect() == []
    out = corpus_pipeline.encoded(spark, docs, SF)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((i for i, _ in rows), key=str)
    assert corpus_pipeline.encoded(spark, docs.limit(0), SF).collect() == []
