import random
import re
import string

import numpy as np

from modelgraph.llm import minhash
from modelgraph.llm.graph import components


def brute(rows, k):
    sets = [minhash.shingles(t or "", k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 20, 60, 200]))]
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            x = list(words)
            for _ in range(rng.choice([0, 1, max(1, len(x) // 25), max(1, len(x) // 12)])):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append(rng.choice([" ", "\t\n"]).join(x).upper())
    rows += [None, "", "  \n", "one", "ONE", "x " * 5000]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    for k in (2, 5):
        docs = spark.createDataFrame([(d, t, "y") for d, t in rows], "doc_id long, text string, n_shingles string")
        got = minhash.near_duplicates(docs, k=k).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b c")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, k=2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for a, b, j in ((h[:2000], h[1000:3000], 1 / 3), (h[:5], h[:4], 0.8), (h[:100], h[10:100], 0.9)):
        got = (minhash.sketch(a, 240) == minhash.sketch(b, 240)).mean()
        assert abs(got - j) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 150)}}


def test_words_that_polynomial_hashes_confuse(spark):
    """Two Thue-Morse words have one polynomial hash modulo 2**64; their texts share nothing."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word + " " + other), (4, other + " " + word)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_several_texts_of_one_document(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (2, "A  b c d"), (3, "e f g h"), (3, "e f g h")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 2, False)]


def test_query_matches_brute_force(spark):
    """Every document of the table and all pairs, by a plain reading of the contract."""
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(words[i : i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set()))
    low = [d for d, _ in docs]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    links.append((i, j))
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    want = sorted((d, len(s), c, d == c) for (d, _), s, c in zip(docs, sets, low))
    got = minhash.op8_minhash_near_duplicates(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert links and sorted(map(tuple, got)) == want


def test_long_texts_of_different_shingles(spark):
    rng = random.Random(8)
    words = [f"w{rng.getrandbits(60):x}" for _ in range(60_000)]
    near = [w if i % 50 else "other" for i, w in enumerate(words)]
    far = [w if i % 5 else "other" for i, w in enumerate(words)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(far))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 3, 3: 3, 4: 4}
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(minhash.shingles(t, 2)) for d, t in rows}
