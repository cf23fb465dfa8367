import itertools
import math

import numpy as np
import public_tokenizers
import pytest

from modelgraph.llm import langid

SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = sorted({"▁", "▁a", "a", "b", "ab", "ba", "▁ab", "c", "abc"})
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 1, 2)) / 20
    model = langid.Unigrams(pieces, p)

    def brute(word, k):
        w, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(w[at:i])
                    at = i
            parts.append(w[at:])
            x = 1.0
            for part in parts:
                x *= p[model.id[part], k] if part in model.id else p[0, k] if len(part) == 1 else 0
            total += x
        return math.log(total)

    group = ["abcab", "aaaab", "xbabc"]
    logs = model.forward(group)
    for i, w in enumerate(group):
        for k in range(2):
            assert logs[i, k] == pytest.approx(brute(w, k))
    assert np.isfinite(model.forward(["ab" * 4000])).all()
    into = {}
    from collections import defaultdict

    into = defaultdict(float)
    model.expected(["ab", "ab"], np.array([1, 2]), np.array([0, 1]), into)
    w = [math.exp(brute("ab", k)) for k in range(2)]
    assert into[0, model.id["b"]] == pytest.approx((p[model.id["▁"], 0] * p[model.id["a"], 0] + p[model.id["▁a"], 0]) * p[model.id["b"], 0] / w[0])


def test_held_out_accuracy(spark):
    got = langid.op7_language_unigrams(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    x = got.join(docs, "doc_id").toPandas()
    assert len(x) == docs.count()
    assert (x[x.held_out].lang_pred == x[x.held_out].lang).mean() > 0.95
    assert x.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "123 !!", None), (5, "", "en"), (None, "le chien", None), (5, "a" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    langs, p = langid.fit(docs, pieces)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, pieces, langs, p).collect()]
    assert sorted(got, key=str)[:7] and len(got) == 7
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "fr"), (1, "en"), (2, "fr")} <= set(got)
    langs, p = langid.fit(docs.limit(0), pieces)
    assert {r.lang_pred for r in langid.identify(docs, pieces, langs, p).collect()} == {"und"}
    assert langid.identify(docs.limit(0), pieces, langs, p).count() == 0


def test_words_of_any_length(spark):
    assert [len(g) for g in langid.by_length(["a" * 65_551, "a" * 65_552, "b" * 300_000, "c" * 300_000])] == [1, 1, 1, 1]
    model = langid.Unigrams(["a", "b", "ab"], np.full((4, 2), [[0.1, 0.2]]))
    logs = model.forward(["ab" * 35_000])
    assert np.isfinite(logs).all() and logs[0, 0] < logs[0, 1]
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the " * 20 + "a" * 10_000, "en"), (4, "le chat " + "é" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = ["▁", "▁the", "▁le", "a", "c", "h", "t"]
    langs, p = langid.fit(docs, pieces)
    assert {r.doc_id for r in langid.identify(docs, pieces, langs, p).collect()} == {1, 2, 3, 4}


def test_query_matches_brute_force(spark):
    """Each text's language by sums over all segmentations, written out."""
    pieces = sorted({"▁", "▁a", "a", "b", "ab", "ba", "▁ab", "c", "abcabcabcabca", "▁b"})
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 1, 3)) / 10
    number = {x: i + 1 for i, x in enumerate(pieces)}

    def total(word, k):
        if not word:
            return 1.0
        heads = (word[:i] for i in range(1, len(word) + 1))
        return sum((p[number[h], k] if h in number else p[0, k]) * total(word[len(h):], k) for h in heads if h in number or len(h) == 1)

    words = ["".join(rng.choice(list("abcx"), rng.integers(1, 9))) for _ in range(40)] + ["abcabcabcabca"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 5)))) for i in range(60)] + [(60, words[-1]), (60, words[-1]), (61, None)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    for langs, q in ((["x", "y", "z"], p), (["x", "y", "z"], p[:, [0, 0, 0]])):
        for r in langid.identify(docs, pieces, langs, q).collect():
            text = dict(rows)[r.doc_id]
            if text is None:
                assert (r.lang_pred, r.score) == ("und", 0)
                continue
            sums = [math.prod(total("▁" + w, list(p[0]).index(q[0, k])) for w in text.split()) for k in range(3)]
            best = max(range(3), key=lambda k: (sums[k], -k))
            assert r.lang_pred == langs[best] and r.score == pytest.approx(sums[best] / sum(sums), rel=1e-4)


def test_sample_is_the_first_by_hash(spark):
    rows = [(i, f"word{i % 7}", "en" if i % 3 else "fr") for i in range(900)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = ["▁", *"dorw"]
    few = langid.fit(docs, pieces, docs_per_language=5)[1]
    chosen = docs.selectExpr("*", "dense_rank() over (partition by lang order by xxhash64(doc_id), doc_id) as r").where("r <= 5")
    assert np.allclose(few, langid.fit(chosen, pieces, docs_per_language=99)[1])


def test_numerals_are_no_letters():
    assert langid.words("² ½ Ⅷ 12_3") == [] and langid.words("Été x² ß") == ["été", "x", "ß"]
