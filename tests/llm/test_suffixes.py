import hashlib
import random
import re

import numpy as np

from modelgraph.llm import suffixes

SF = "/root/testdata/sf0.01"


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of rows (doc_id, text)."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1) if d is not None else ():
            s = b[p : p + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1) if d is not None else ():
            if first[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_sort_orders_suffixes():
    rng = np.random.default_rng(0)
    text = bytes(rng.choice(np.frombuffer(b"ab", np.uint8), 4000)) + b"abc" * 500 + b"a" * 400
    at = np.sort(rng.choice(len(text) - 60, 3000, replace=False))
    group = np.sort(rng.integers(0, 12, 3000))
    s = suffixes.Suffixes(text, 50)
    order = s.sort(at, group)
    want = sorted(range(3000), key=lambda i: (group[i], text[at[i] : at[i] + 50]))
    assert order.tolist() == want
    o, run = s.equal_runs(at, group)
    keys = [(group[i], text[at[i] : at[i] + 50]) for i in o]
    assert all((run[i] == run[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, 3000))


def test_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(1, rows[3][1]), (2, rows[3][1]), (4, None), (5, ""), (7, "x" * 49), (8, "x" * 50), (10, "x" * 51), (11, "xy" * 4000), (13, "x" * 5000), (None, "x" * 60)]
    rows += [(14, passages[0] + "!"), (14, passages[0] + "!"), (14, "other text " + passages[1]), (400, passages[1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_bytes string")
    got = suffixes.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(df, keep=False).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_whole_table_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = suffixes.op9_suffix_sort_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=200_000))
    rows = [(1, long[50_000:50_090] + "?"), (2, long), (3, "!" + long[:120_000] + "!" + long[120_000:]), (4, long[::-1])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=False).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_texts_are_shuffled_once(spark):
    rows = [(i, f"text {i % 7} " * 20) for i in range(60)] + [(None, "x" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Broadcasts hide the exchanges that large tables need.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = suffixes.remove_repeats(df, keep=False)
        got = cut.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan
    assert len(re.findall(r"(?<!, )Exchange hashpartitioning\(block#\d+, \d+\), REPARTITION_BY_COL", plan)) == 1
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_short_keys_are_equal_for_equal_hashes():
    h = np.random.default_rng(1).integers(0, 2**64, 10_000, np.uint64)
    short = suffixes.short_keys(h, 777)
    assert (short >> np.uint64(32) == h % np.uint64(777)).all()
    assert (short.astype(np.uint32) == (h >> np.uint64(32)).astype(np.uint32)).all()
