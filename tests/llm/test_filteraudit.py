import re
from itertools import permutations

import duckdb

from modelgraph.llm import filteraudit

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """docs (doc_id, text, lang), labels (doc_id, quality, toxic): the rows, doc by doc."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in text for c in "#$%&*|"),
            "E": i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs),
        }
        known.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part in sorted({k[0] for k in known}):
        mine = [k for k in known if k[0] == part]
        rows, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            there = mine
            for step, f in enumerate(order, 1):
                here = [k for k in there if f in k[1]]
                there = [k for k in there if f not in k[1]]
                failing = [k for k in mine if f in k[1]]
                sums[f] += len(here)
                rows.append((part, "".join(order), step, len(there), len(here), len(failing) - len(here), sum(k[1] == {f} for k in mine), sum(k[2] for k in here), sum(k[3] for k in here)))
        out += [(*r, sums[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (5, long, "de"), (None, long, "en"), (None, long, None),
        (3, None, "en"), (4, "", "en"), (9, "", None), (6, "A B C", "en"), (7, "x " * 400, "en"), (8, "has #", ""), (10, "é " * 250 + "|", "de"), (11, "tab\tbed\x0bw\x0cx\x1cy z", "de"), (2, "other", "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (6, 1, 1), (77, 1, 1), (7, 0, 0)]
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, lang string, n int, mask string")
    x = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert sorted(map(tuple, filteraudit.audit(d, x).collect())) == brute(docs, labels)
    assert sorted(map(tuple, filteraudit.audit(d, x.limit(0)).collect())) == brute(docs, [])
    assert filteraudit.audit(d.limit(0), x).collect() == []


def test_query_and_sql(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    got = filteraudit.op12_filter_audit(spark, SF)
    want = brute(docs, labels)
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.execute(filteraudit.OP12_SQL).fetchall()) == want
