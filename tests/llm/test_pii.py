import hashlib
import re

from pyspark.sql import functions as F

from modelgraph.llm import pii

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [
    None, "", "é\U0001f600 a@b.c_d@e.fg x@y", "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1", "4111 1111 1111 1111-4111-1111-1111-1111",
    "4111111111111111 5500-0000-0000-0004", "+1 (555) 123-4567 +12345678 +1234567890123456", "1" * 20_000, "a" * 20_000 + "@", "1.1.1.1 " * 700,
    "mail me: joe.doe (at) example (dot) com or (212) 555-0101", "write x@y.zz", "@@ ++1 ..",
]


def test_base_spans(spark):
    rows = [(i, t, "c") for i, t in enumerate(ODD)] + [(0, None, "c"), (None, "q@r.st", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(docs).select("doc_id", pii.as_text(F.col("base")).alias("b"), pii.as_text(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(ODD[r.doc_id] or "") if r.doc_id is not None else ["email:0:6"]
        assert r.b == ",".join(want), r.doc_id
        assert set(want) <= set(r.s.split(",")) or not want
    assert pii.find(docs.limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op5_pii_boosting(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]


def test_boosting_selects():
    cell = lambda kind, loose, cue: (kind, loose, 1, 0, 1, 1, cue)
    examples = [(cell(3, 0, 1), 500, 2), (cell(3, 0, 0), 5, 400), (cell(3, 1, 1), 0, 0)]
    trees = pii.boost(examples)
    limits = pii.thresholds(trees, examples)
    assert pii.evaluate(trees, cell(3, 1, 1)) >= limits[3] > pii.evaluate(trees, cell(3, 1, 0))
    assert limits[0] == float("inf")


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é a@b.cc and 1.2.3.4, +1 (555) 123-4567!"), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs, [], [float("inf")] * 4).collect()}
    assert got == {1: "é [EMAIL] and [IP], [PHONE]!", 2: None, 3: "clean"}


def test_added_spans_of_held_out_sentences(spark):
    """Precision and recall by kind of what the trees add to the base spans."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees, limits = pii.fit(docs)
    report = pii.held_out_report(spark, trees, limits)
    print(report)
    assert set(report) == set(pii.NAMES)
    assert all(p >= 0.95 and r >= 0.6 for p, r in report.values())
    examples = pii.examples_for(docs.select(pii.candidates(F.col("text")).alias("c")))
    for kind in range(5):
        mine = [(p, n) for x, p, n in examples if x[0] == kind and x[1]]
        assert sum(p for p, _ in mine) > 1000 < sum(n for _, n in mine)


def test_spans_are_added(spark):
    rows = [
        (1, "mail jane (at) example (dot) com today", "email"), (2, "look (at) this.then we go", None), (3, 'token = "' + "0a1b2c3d4e" * 4 + '"', "secret"),
        (4, "call (212) 555-0199 now", "phone"), (5, "order 012.055 0199", None), (6, "file report_of_the_meeting_of_2024_in_may", None), (7, "address 10[.]0[.]0[.]7", "ip"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    trees, limits = pii.fit(docs)
    c = pii.candidates(F.col("text"))
    for r in docs.select("want", "text", pii.as_text(pii.chosen_spans(c, trees, limits)).alias("s")).collect():
        assert r.s.split(":")[0] == (r.want or ""), r
    overlapping = F.filter(c, lambda x: F.lit(True))
    pair = docs.where("doc_id = 3").select(F.concat(overlapping, F.transform(overlapping, lambda x: x.withField("start", x.start + 1).withField("cue", F.lit(0)))).alias("c"))
    assert pair.select(pii.as_text(pii.chosen_spans(F.col("c"), trees, limits)).alias("s")).first().s == "secret:9:49"


def test_query_spans_match_a_second_run_of_the_trees(spark):
    """The whole result: base spans, and loose candidates that the trees choose, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees, limits = pii.fit(docs)
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.op5_pii_boosting(spark, SF).collect()}
    for r in docs.select("doc_id", pii.candidates(F.coalesce("text", F.lit(""))).alias("c")).collect():
        kept = [x for x in r.c if x.ok]
        n = len(kept)
        score = lambda x: pii.evaluate(trees, tuple(x[k] for k in pii.FEATURES))
        meets = lambda x, y: x.start < y.end and y.start < x.end
        more = [x for x in r.c if x.loose and score(x) >= limits[x.kind] - 1e-9 and not any(meets(x, b) for b in kept)]
        rank = lambda x: (round(score(x), 9), -x.start, -x.kind)
        kept += [x for x in more if not any(meets(x, y) and rank(y) > rank(x) for y in more)]
        spans = ",".join(f"{pii.NAMES[k]}:{a}:{b}" for k, a, b in sorted((x.kind, x.start, x.end) for x in kept))
        assert got[r.doc_id] == (spans, len(kept) - n)


def test_secrets_of_any_length(spark):
    token = "ab1" * 400
    rows = [(1, f"token = {token} end"), (2, f"key: {'a1' * 10}"), (3, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.c for r in docs.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    secret = pii.NAMES.index("secret")
    assert [(s.start, s.end) for s in got[1] if s.kind == secret] == [(8, 8 + len(token))]
    assert [(s.start, s.end) for s in got[2] if s.kind == secret] == [(5, 25)] and not [s for s in got[3] if s.kind == secret]


def test_parts_are_apart_and_other_words_are_reported(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees, limits = pii.fit(docs)
    rows = pii.labelled(spark)
    n = {part: pii._generated(spark, part).count() for part in ("fit", "calibrate", "report")}
    assert n["fit"] > n["calibrate"] > 3000 < n["report"] and sum(n.values()) <= rows.count()
    assert limits == pii.thresholds(trees, pii.calibration(spark))
    report = pii.held_out_report(spark, trees, limits, other=True)
    print(report)
    assert set(report) == set(pii.NAMES) and all(p >= 0.85 for p, _ in report.values())


def test_many_spans_of_one_text(spark):
    """Thousands of spans, overlapping across kinds: as by comparing all pairs."""
    piece = "call (212) 555-0199, token = Ab0_212-555-0199_Ab0_Ab0_Ab0 card 4111.1111.1111.1111 x@y.zz (at) example.com 10[.]0[.]0[.]7; "
    docs = spark.createDataFrame([(1, piece * 400), (2, piece), (3, None), (4, "")], "doc_id long, text string")
    trees, limits = pii.fit(docs)
    limits = [min(x, 0.0) for x in limits]
    got = {r.doc_id: [tuple(s) for s in r.s] for r in docs.select("doc_id", pii.chosen_spans(pii.candidates(F.col("text")), trees, limits).alias("s")).collect()}
    for r in docs.where("doc_id = 2").select(pii.candidates(F.col("text")).alias("c")).collect():
        score = lambda x: pii.evaluate(trees, tuple(x[k] for k in pii.FEATURES))
        meets = lambda x, y: x.start < y.end and y.start < x.end
        base_ = [x for x in r.c if x.ok]
        more = [x for x in r.c if x.loose and score(x) >= limits[x.kind] and not any(meets(x, b) for b in base_)]
        rank = lambda x: (score(x), -x.start, -x.kind)
        kept = base_ + [x for x in more if not any(meets(x, y) and rank(y) > rank(x) for y in more)]
        assert got[2] == sorted((x.kind, x.start, x.end) for x in kept) and len(kept) >= 4
    assert len(got[1]) >= 400 * (len(got[2]) - 1) and got[3] == got[4] == []
    text = pii.redact(docs, trees, limits).where("doc_id = 1").first().text
    assert text.count("[") >= 400 * 4 and "x@y.zz" not in text
