"""Operator 5 (DataFrame functions only): personal data by candidate gradient boosting.

Strict generators give the base spans (e-mail, ip, card, phone). Loose generators propose more
spans, which may overlap those and each other: written-out e-mails and addresses, phone numbers
without country code, grouped card numbers, long mixed runs that may be secrets. Every candidate
is described by coarse features of its format (length, separators, validity) and context.

There are no labels in the corpus, so two sets of examples are put together: the documents' own
base matches (positive if they pass their check) and generated sentences (`labelled`) whose loose
candidates are known to be personal data or to be versions, order and serial numbers, hashes or
plain words of the same form. Examples are counted by feature cell; the cells are bounded (the
product of the features' values), so boosted trees are fitted on the counts on the driver, and
the trees go back to the executors as SQL expressions. The generated sentences are in three parts:
three fifths to fit the trees, a fifth to calibrate the thresholds on, a fifth to report on
(`held_out_report`, which also reports on sentences with other words around the candidates).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import checkpointed, letters, table

#: Fixed order of the kinds.
KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans: secrets have no base form.
NAMES = (*KINDS, "secret")

# Fixed patterns. Possessive forms and look-behinds only spare backtracking: they match what the
# plain patterns match. \G lets a match begin where the one before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no base span of the kind that passes.
NEEDS = {
    "email": r"@[A-Za-z0-9-]++\.",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\[\.\]\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9.])[0-9]{4}+(?:[._/][0-9]{4}+){3}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/-])",
}
LOOSE_NEEDS = {
    "email": r"(?i)[(\[]at[)\]]",
    "ip": r"[0-9]\x20?\[\.\]",
    "card": r"[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}",
    "phone": r"[0-9]{3}[.\x20-][0-9]{4}",
    "secret": r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20}",
}
#: What stands just before a candidate: a way to reach somebody, a name of a secret, a number of a thing.
CUES = (
    r"(?i)(?:e-?mail|mail|contact|write|reach|phone|tel|call|fax|mobile|card|visa|payment|credit|ip|host|server|address|from)[:.]?\x20{0,2}$",
    r"(?i)(?:token|secret|key|password|passwd|pwd|auth|bearer)[\x20\"']{0,2}[=:]?[\x20\"']{0,3}$",
    r"(?i)(?:order|part|serial|invoice|ref|version|no|nr|id|isbn|commit|sha1|build|item|file|path|look|arrive)[.:#/]?\x20{0,2}$",
)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>>: leftmost non-overlapping matches with their places in code
    points. Gaps and matches alternate, so places are sums of lengths; the sums run over blocks
    of 256, which keeps texts with very many matches affordable."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), m.alias("m")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x.g + F.length(x.m))

    def place(x, blocks):
        def one(p, i):
            block = (i / 256).cast("int")
            before = F.aggregate(F.slice(blocks, 1, block), F.lit(0), lambda s, b: s + b)
            start = before + total(F.slice(x, block * 256 + 1, i % 256)) + p.g
            return F.struct(start.alias("start"), (start + F.length(p.m)).alias("end"), p.m.alias("m"))

        return F.transform(x, one)

    # A one-element array stands for "let": each array is computed once.
    def held(x):
        blocks = F.transform(F.sequence(F.lit(0), (F.size(x) / 256).cast("int")), lambda b: total(F.slice(x, b * 256 + 1, 256)))
        return F.flatten(F.transform(F.array(blocks), lambda bl: place(x, bl)))

    return F.flatten(F.transform(F.array(parts), held))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.substring(d, i, F.lit(1)).try_cast("int"), F.lit(0)) * (1 + (n - i) % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
    return n.between(9, 15)


#: Features and the number of their values: bounds the cells.
FEATURES = {"kind": 5, "loose": 2, "length": 5, "seps": 4, "before": 4, "after": 4, "cue": 4, "valid": 2}


def valid(kind: str, m: Column) -> Column:
    """A check of the format: Luhn, octets, a usual top-level domain, the mixture of characters."""
    if kind == "email":
        return m.rlike(r"(?i)(?:\.|dot[)\]])\x20?(?:com|org|net|edu|gov|info|biz|io|[a-z]{2})$")
    if kind == "ip":
        return F.forall(F.split(F.regexp_replace(m, r"[^0-9.]", ""), r"\."), lambda p: p.rlike("^(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return digits(m).rlike("^[2-9][0-9]{2}[2-9]") | m.startswith("+")
    return m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | m.rlike("^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/=_-]+$")


def described(text: Column, spans: Column, kind: str, loose: bool) -> Column:
    """Candidates with features: context is the 24 code points before and the one behind."""

    def one(s):
        left = F.substring(text, F.greatest(s.start - 23, F.lit(1)), F.least(s.start, F.lit(24)))
        right = F.substring(text, s.end + 1, F.lit(1))
        kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\s.,;:!?]"), 1).when(c.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(3)
        n = F.length(s.m) if kind == "email" else F.length(s.m) / 4 if kind == "secret" else F.length(digits(s.m))
        seps = F.when(s.m.rlike(r"[()\[\]]"), 3).when(s.m.rlike(r"[\x20-]"), 2).when(s.m.rlike(r"[._/]"), 1).otherwise(0)
        return F.struct(
            F.lit(NAMES.index(kind)).alias("kind"), s.start.alias("start"), s.end.alias("end"),
            F.lit(int(loose)).alias("loose"),
            (F.lit(False) if loose else passes(kind, s.m)).alias("ok"),
            F.when(n < 9, 0).when(n < 13, 1).when(n < 16, 2).when(n < 20, 3).otherwise(4).alias("length"),
            seps.alias("seps"), kind_of(F.substring(left, -1, 1)).alias("before"), kind_of(right).alias("after"),
            F.when(left.rlike(CUES[0]), 1).when(left.rlike(CUES[1]), 2).when(left.rlike(CUES[2]), 3).otherwise(0).alias("cue"),
            valid(kind, s.m).cast("int").alias("valid"),
        )

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """All generators' candidates of a text, as an array; most texts are dismissed by a search
    for what a generator needs."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,loose:int,ok:boolean,length:int,seps:int,before:int,after:int,cue:int,valid:int>>")
    got = []
    for kind in NAMES:
        for loose, pattern, needs in ((False, BASE, NEEDS), (True, LOOSE, LOOSE_NEEDS)):
            if kind in pattern:
                found = described(text, located(text, pattern[kind]), kind, loose)
                got.append(F.when(text.rlike(needs[kind]), found).otherwise(none))
    return F.concat(*got)


def cells(cands: DataFrame) -> list[tuple]:
    """Feature cells with their number of positive and negative examples among base candidates
    (cands(c array)); at most the product of FEATURES rows."""
    c = cands.select(F.explode("c").alias("c")).select("c.*")
    return _counted(c, F.col("ok"), ~F.col("ok") & (F.col("loose") == 0))


def _counted(c: DataFrame, positive: Column, negative: Column) -> list[tuple]:
    keys = list(FEATURES)
    rows = c.groupBy(*keys).agg(F.count_if(positive).alias("pos"), F.count_if(negative).alias("neg")).collect()
    return sorted((tuple(r[k] for k in keys), r.pos, r.neg) for r in rows)


def labelled(spark: SparkSession, n: int = 20_000, other: bool = False) -> DataFrame:
    """id, kind, label, text: n generated sentences with one candidate of a loose form each, and
    whether it is personal data. Both sorts come with telling words, misleading ones and none;
    the other construction uses none of the words that the features look for on their own."""

    def number(salt: int, below: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below))

    def digit(salt: int, count: int) -> Column:
        return F.lpad(number(salt, 10**count).cast("string"), count, "0")

    def pick(salt: int, *words: str) -> Column:
        return F.element_at(F.array(*(F.lit(w) for w in words)), (number(salt, len(words)) + 1).cast("int"))

    join, good, t = F.concat, F.col("label"), F.lit
    at, dot = pick(11, " (at) ", "(at)", " [at] "), pick(12, " (dot) ", "(dot)", " [dot] ", ".")
    email = join(pick(13, "jane", "sam.lee", "office", "k_77"), at, pick(14, "example", "mail-7", "corp"), dot, F.when(good, pick(15, "com", "org", "de", "net", "fr")).otherwise(pick(15, "then", "and", "later", "Monday")))
    octet = lambda salt: number(salt, 256).cast("string")
    ip = join(octet(21), t("[.]"), octet(22), t("[.]"), F.when(good, octet(23)).otherwise((256 + number(23, 700)).cast("string")), t("[.]"), octet(24))
    fifteen = digit(31, 15)
    check = F.element_at(F.filter(F.array(*(t(str(i)) for i in range(10))), lambda c: luhn(join(fifteen, c)) == good), 1)
    sixteen, mark = join(fifteen, check), pick(32, ".", "_", "/")
    card = join(F.substring(sixteen, 1, 4), mark, F.substring(sixteen, 5, 4), mark, F.substring(sixteen, 9, 4), mark, F.substring(sixteen, 13, 4))
    area = F.when(good, (200 + number(41, 800)).cast("string")).otherwise(digit(41, 3))
    phone = join(F.when(number(42, 2) == 0, join(t("("), area, t(") "))).otherwise(join(area, pick(43, "-", "."))), F.when(good, (200 + number(44, 800)).cast("string")).otherwise(digit(44, 3)), pick(45, "-", ".", " "), digit(46, 4))
    hexes = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40)
    secret = F.when(good, F.when(number(51, 3) == 0, F.upper(hexes)).when(number(51, 3) == 1, hexes).otherwise(F.translate(F.base64(F.unhex(hexes)), "=", "")))
    secret = secret.otherwise(F.when(number(51, 3) == 0, hexes).otherwise(join(pick(52, "report_of_the_meeting_", "some-long-file-name-part-", "very_long_identifier_"), digit(53, 3))))
    what = F.element_at(F.array(email, ip, card, phone, secret), F.col("kind") + 1)
    reach = F.when(F.col("kind") == 4, pick(61, 'token = "', "secret: ", "api_key=", "password ")).otherwise(pick(61, "call ", "contact: ", "mail ", "card ", "address "))
    thing = F.when(F.col("kind") == 0, pick(62, "look ", "arrive ")).otherwise(pick(62, "order ", "part ", "serial ", "version ", "no. ", "commit ", "ref. "))
    neutral = pick(63, "and ", "the ", "with ", "", "; ")
    if other:
        reach = F.when(F.col("kind") == 4, pick(61, "AUTH_TOKEN=", "set the api secret to ", "pwd: ")).otherwise(pick(61, "reach me at ", "my inbox: ", "dial ", "billed to ", "login from "))
        thing = pick(62, "lot ", "see chapter ", "rev. ", "ticket id ", "build no. ", "article ")
        neutral = pick(63, "(", "a, b, ", "then\n", "or maybe ")
    lead = F.when(number(64, 100) < 70, F.when(good, reach).otherwise(thing)).when(number(64, 100) > 97, F.when(good, thing).otherwise(reach)).otherwise(neutral)
    rows = spark.range(n).withColumn("kind", number(1, len(NAMES)).cast("int")).withColumn("label", number(2, 2) == 0)
    text = join(pick(71, "You may ", "", "As said, ", "1 "), lead, what, F.when(lead.endswith('"'), t('"')).otherwise(t("")), pick(72, " today.", ", please", "", " or later"))
    if other:
        text = join(pick(71, "Dear all,\n", "> ", "When in doubt ", "2) "), lead, what, F.when(lead.endswith("("), t(")")).otherwise(t("")), pick(72, "\n--\nsent later", "; thanks", "?", " (new)"))
    return rows.select("id", "kind", "label", text.alias("text"))


def _generated(spark: SparkSession, part: str, other: bool = False) -> DataFrame:
    """The loose candidates of the sentences' own kind, with their labels. Parts: fit (three fifths
    of the sentences), calibrate and report (a fifth each)."""
    fifth = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5))
    wanted = {"report": fifth == 0, "calibrate": fifth == 1, "fit": fifth > 1}[part]
    c = labelled(spark, other=other).where(wanted).select("label", F.col("kind").alias("k"), F.explode(candidates(F.col("text"))).alias("c"))
    return c.where("c.loose = 1 and c.kind = k").select("label", "c.*")


def examples_for(cands: DataFrame) -> list[tuple]:
    """Cells of the documents' base candidates and of the generated ones to fit trees on."""
    made = _generated(cands.sparkSession, "fit")
    return sorted(cells(cands) + _counted(made, F.col("label"), ~F.col("label")))


def calibration(spark: SparkSession) -> list[tuple]:
    """Cells of the generated candidates that no tree was fitted on, for the thresholds."""
    return _counted(_generated(spark, "calibrate"), F.col("label"), ~F.col("label"))


def held_out_report(spark: SparkSession, trees: list[tuple], limits: list[float], other: bool = False) -> dict[str, tuple[float, float]]:
    """Precision and recall, by kind, of the selected among generated candidates that neither trees
    nor thresholds have seen; `other`: in sentences of the other construction."""
    test, keys = selected(trees, limits), ["kind", "loose", *list(FEATURES)[2:]]
    c = _generated(spark, "report", other).select("label", "kind", test(F.struct(*keys)).alias("taken"))
    rows = c.groupBy("kind").agg(F.count_if(F.col("taken") & F.col("label")).alias("hit"), F.count_if("taken").alias("taken"), F.count_if("label").alias("all")).collect()
    return {NAMES[r.kind]: (r.hit / max(r.taken, 1), r.hit / max(r["all"], 1)) for r in rows}


def boost(examples: list[tuple], rounds: int = 30, rate: float = 0.3, leaf: float = 5.0) -> list[tuple]:
    """Gradient boosting (logistic loss, Newton leaves) of depth-two trees over the cells:
    [((feature, value), (feature, value), [leaf values])]. A tree asks for equality with two
    feature values. Ties are decided by the order of the tests."""
    data = [(x, p, n) for x, p, n in examples if p + n]
    score = [0.0] * len(data)
    seen = sorted({(f, v) for x, _, _ in data for f, v in enumerate(x)})
    trees = []
    for _ in range(rounds if data else 0):
        grads = []
        for s, (_, p, n) in zip(score, data):
            q = 1 / (1 + math.exp(-s))
            grads.append((p - (p + n) * q, (p + n) * q * (1 - q)))
        best = None
        for a, b in itertools.combinations_with_replacement(seen, 2):
            sums = [[0.0, 0.0] for _ in range(4)]
            for (x, _, _), (g, h) in zip(data, grads):
                side = sums[2 * (x[a[0]] == a[1]) + (x[b[0]] == b[1])]
                side[0] += g
                side[1] += h
            gain = sum(g * g / (h + leaf) for g, h in sums)
            if best is None or gain > best[0] + 1e-12:
                best = gain, a, b, [rate * g / (h + leaf) for g, h in sums]
        trees.append(best[1:])
        score = [s + best[3][2 * (x[best[1][0]] == best[1][1]) + (x[best[2][0]] == best[2][1])] for s, (x, _, _) in zip(score, data)]
    return trees


def evaluate(trees: list[tuple], x: tuple) -> float:
    """The trees' sum of a cell, added one by one as the expression adds: built-in sum() rounds
    otherwise, and thresholds are scores that candidates reach exactly."""
    out = 0.0
    for a, b, v in trees:
        out += v[2 * (x[a[0]] == a[1]) + (x[b[0]] == b[1])]
    return out


def thresholds(trees: list[tuple], examples: list[tuple], precision: float = 0.95) -> list[float]:
    """For each kind the smallest score from which on its examples reach the precision; infinite
    where none do. Loose examples decide where a kind has any."""
    out = []
    for kind in range(len(NAMES)):
        mine = [(x, p, n) for x, p, n in examples if x[0] == kind and p + n]
        got = sorted(((evaluate(trees, x), p, n) for x, p, n in mine if x[1] or not any(y[1] for y, _, _ in mine)), reverse=True)
        best, pos, total = math.inf, 0, 0
        for i, (s, p, n) in enumerate(got):
            pos, total = pos + p, total + p + n
            if (i + 1 == len(got) or got[i + 1][0] < s) and pos >= precision * total:
                best = s
        out.append(best)
    return out


def total_score(trees: list[tuple]):
    """The trees' sum as an expression of a candidate."""
    keys = list(FEATURES)

    def total(c):
        out = F.lit(0.0)
        for a, b, v in trees:
            one, two = c[keys[a[0]]] == a[1], c[keys[b[0]]] == b[1]
            out = out + F.when(one & two, v[3]).when(one, v[2]).when(two, v[1]).otherwise(v[0])
        return out

    return total


def selected(trees: list[tuple], limits: list[float]):
    """A test of a loose candidate: whether the trees' sum reaches its kind's threshold."""
    total = total_score(trees)

    def test(c):
        limit = F.try_element_at(F.array(*(F.lit(float(x)) for x in limits)), c["kind"] + 1)
        return (c["loose"] == 1) & F.coalesce(total(c) >= limit, F.lit(False))

    return test


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unbeaten(spans: Column, beats) -> Column:
    """Of structs with start and end, sorted by start, those that no overlapping one beats, in the
    order of their ends. One sweep: only spans that reach behind the present start are held
    (a kind's own spans don't overlap, so at most one a generator)."""
    flagged = F.transform(spans, lambda x: F.struct(x.alias("s"), F.lit(False).alias("beaten")))

    def step(acc, y):
        open_ = F.filter(acc.held, lambda x: x.s.end > y.s.start)
        still = F.transform(open_, lambda x: F.struct(x.s.alias("s"), (x.beaten | beats(y.s, x.s)).alias("beaten")))
        now = F.struct(y.s.alias("s"), F.exists(open_, lambda x: beats(x.s, y.s)).alias("beaten"))
        left = F.exists(acc.held, lambda x: (x.s.end <= y.s.start) & ~x.beaten)
        out = F.when(left, F.concat(acc.out, F.filter(acc.held, lambda x: (x.s.end <= y.s.start) & ~x.beaten))).otherwise(acc.out)
        return F.struct(F.concat(still, F.array(now)).alias("held"), out.alias("out"))

    def done(acc):
        return F.transform(F.concat(acc.out, F.filter(acc.held, lambda x: ~x.beaten)), lambda x: x.s)

    return let(flagged, lambda f: F.aggregate(f, F.struct(F.slice(f, 1, 0).alias("held"), F.slice(f, 1, 0).alias("out")), step, done))


def chosen_spans(c: Column, trees: list[tuple], limits: list[float]) -> Column:
    """array<struct<kind, start, end>> by kind and start: base spans that pass, and selected
    candidates that overlap no base span and no selected one of a higher score (of equal ones
    that which starts first stays, then the first kind)."""
    test, total = selected(trees, limits), total_score(trees)

    def ranked(x):
        rank = F.struct(F.when(x.ok, 0.0).otherwise(total(x)).alias("s"), (-x.start).alias("a"), (-x.kind).alias("k"))
        return F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"), x.ok.alias("base"), rank.alias("rank"))

    taken = F.array_sort(F.transform(F.filter(c, lambda x: x.ok | test(x)), ranked))
    free = unbeaten(taken, lambda y, x: y.base & ~x.base)
    best = unbeaten(F.array_sort(free), lambda y, x: ~y.base & ~x.base & (y.rank > x.rank))
    return F.array_sort(F.transform(best, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))))


def as_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def fit(docs: DataFrame) -> tuple[list[tuple], list[float]]:
    """Trees and thresholds from all documents' candidates and the generated ones."""
    trees = boost(examples_for(docs.select(candidates(letters()).alias("c"))))
    return trees, thresholds(trees, calibration(docs.sparkSession))


def redact(docs: DataFrame, trees: list[tuple], limits: list[float]) -> DataFrame:
    """docs with every chosen span of text replaced by its kind in brackets ([EMAIL], ...);
    overlapping spans become one, named by the first. Null texts stay null, texts without spans
    and all other columns stay as they are."""
    text = F.col("text")
    by_place = F.array_sort(F.transform(chosen_spans(candidates(text), trees, limits), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))

    def join(acc, s):
        last = F.element_at(acc, -1)
        overlap = (F.size(acc) > 0) & (s.start < F.coalesce(F.try_element_at(acc, F.lit(-1)).end, F.lit(-1)))
        return F.when(overlap, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"), last.kind.alias("kind"))))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(by_place, F.array().cast("array<struct<start:int,end:int,kind:int>>"), join)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in NAMES))

    def cut(m):
        pieces = F.transform(m, lambda s, i: F.concat(F.substring(text, F.when(i == 0, 1).otherwise(F.try_element_at(m, F.greatest(i, F.lit(1))).end + 1), s.start - F.when(i == 0, 0).otherwise(F.try_element_at(m, F.greatest(i, F.lit(1))).end)), F.element_at(names, s.kind + 1)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(m, -1).end + 1, F.length(text)))

    return docs.withColumn("text", let(merged, lambda m: F.when(F.size(m) > 0, cut(m)).otherwise(text)))


def find(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, base, spans (arrays of kind, start, end), one row per
    input row; fitted on the same documents. Null and empty texts have no spans; repeated rows
    give repeated rows; other columns are not read. Candidates are computed once and written,
    texts are read once."""
    cands = checkpointed(docs.select("doc_id", candidates(letters()).alias("c")))
    trees = boost(examples_for(cands))
    limits = thresholds(trees, calibration(docs.sparkSession))
    return cands.select("doc_id", chosen_spans(F.filter("c", lambda x: x.ok), [], [math.inf] * 4).alias("base"), chosen_spans(F.col("c"), trees, limits).alias("spans"))


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
