"""Operator 4 (DataFrame functions only): benchmark decontamination by canonical templates.

Words of a text become template tokens: a word with a digit is a number slot, a unit behind a
number a unit slot, a capitalised word inside a sentence a name slot, any other word its
lower-case letters and digits. In a second, loose form every capitalised word is a name slot, at
the start of a sentence, possessive and hyphenated too. Windows of template tokens of the
documents, in both forms, are joined by hash with those of the benchmark. Matches along one alignment of a document with an item are put
together: names must correspond (every name of the benchmark has a single counterpart), so a
question asked again with other parameters is found and a chance mixture of names is not. Numbers
and units change each for itself, as two of them may have the same value by chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import checkpointed, chosen, light, table

# Marks of the slots (private-use letters) and the units.
NUMBER, UNIT, NAME = "", "", ""
HEAD = "\ue003"  # before a word that is a name slot in the loose form only
_NAME_WORD = r"\p{Lu}\p{M}*+(?:['’]\p{Lu})?\p{Ll}[\p{L}\p{M}]*+(?:[-‐'’]\p{L}[\p{L}\p{M}]*+)*+"
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw v a j kj kcal cal "
    "k c f % percent usd eur gbp dollars euros pounds cents metres meters kilometres kilometers miles feet inches grams "
    "kilograms litres liters seconds minutes hours days weeks months years degrees"
).split()

_SPACES = r"[\x20\x09-\x0D]+"


def template(text: Column) -> tuple[Column, Column]:
    """(words, template tokens): arrays of equal length, but for an empty text. Tokens behind
    HEAD are plain words in the strict form and name slots in the loose one."""
    raw = F.array_remove(F.split(F.translate(text, NUMBER + UNIT + NAME + HEAD, ""), _SPACES), "")
    t = F.array_join(raw, " ")
    t = F.regexp_replace(t, r"(?<=[^.!?: ] )[^\p{L}\p{N} ]*+\p{Lu}\p{Ll}++[^\p{L}\p{N} ]*+(?![^ ])", NAME)
    t = F.regexp_replace(t, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", NUMBER)
    t = F.regexp_replace(t, rf"(?<={NUMBER} )(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})[^\p{{L}}\p{{N}} ]*+(?![^ ])", UNIT)
    t = F.regexp_replace(t, rf"(?<![^ ])(?=[^\p{{L}}\p{{N}} ]*+{_NAME_WORD}[^\p{{L}}\p{{N}} ]*+(?![^ ]))", HEAD)
    t = F.lower(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}} {NUMBER}{UNIT}{NAME}{HEAD}]++", ""))
    return raw, t


def bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]+", ""))


def tokens(texts: DataFrame, key: str, size: int) -> DataFrame:
    """key, raw, canon, loose (tokens in the two forms), plain (the words themselves) of the texts
    that have at least size words."""
    raw, marked = template(F.coalesce("text", F.lit("")))
    marked = texts.select(key, raw.alias("raw"), marked.alias("t")).where(F.size("raw") >= size)
    loose = F.regexp_replace("t", HEAD + "[^ ]*+", NAME)
    return marked.select(key, "raw", F.split(F.translate("t", HEAD, ""), " ").alias("canon"), F.split(loose, " ").alias("loose")).withColumn(
        "plain", F.transform("raw", lambda w: F.when(bare(w) == "", w).otherwise(bare(w)))
    )


FORMS = ("canon", "loose", "plain")


def windows(arrays: DataFrame, key: str, size: int, forms: tuple[str, ...] = FORMS[:2]) -> DataFrame:
    """key, pos (from 1), h: the different hashes of each window of size tokens in its forms.
    Tokens are hashed once, all forms in one struct, and the shifted arrays of these zipped, so windows are hashed in
    generated code; no array leaves the row it is in."""
    hashed = F.transform(F.arrays_zip(*forms), lambda t: F.struct(*(F.xxhash64(t[c]).alias(c) for c in forms)))
    hashed = arrays.where(F.size("raw") >= size).select(key, hashed.alias("t"))
    shifted = [(F.slice("t", i + 1, F.size("t")) if i else F.col("t")).alias(f"t{i}") for i in range(size)]
    rows = hashed.select(key, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w")).where(f"w.t{size - 1} is not null")
    rows = rows.select(key, (F.col("pos") + 1).alias("pos"), *(F.xxhash64(*(f"w.t{i}.{c}" for i in range(size))).alias(c) for c in forms))
    alike = reduce(Column.__and__, [F.col(forms[0]) == F.col(c) for c in forms[1:]])
    several = F.array_distinct(F.array(*forms))
    return rows.select(key, "pos", F.explode(F.when(alike, F.array(forms[0])).otherwise(several)).alias("h"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, form (place in FORMS), size, q (from 1), h, item_raw, item_canon: windows as
    above. In the loose form an item's first word may be a unit too, as behind a number."""
    part = lambda c: F.slice(c, F.col("q"), size)
    rows = items.select("item_id", "raw", F.posexplode(F.array(*FORMS)).alias("form", "canon"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("raw") - size + 1)).alias("q"))
    rows = rows.select("item_id", "form", F.lit(size).alias("size"), "q", part("raw").alias("item_raw"), part("canon").alias("item_canon"))
    unit = rows.where((F.col("q") == 1) & (F.col("form") == 1) & bare(F.get("item_raw", F.lit(0))).isin([u for u in UNITS if u != "%"]))
    rows = rows.unionByName(unit.withColumn("item_canon", F.concat(F.array(F.lit(UNIT)), F.slice("item_canon", 2, size))))
    return rows.withColumn("h", F.xxhash64(*(F.xxhash64(F.get("item_canon", F.lit(i))) for i in range(size))))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, least_windows: int = 6, least_words: int = 4, most_mb: float = 64
) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> one row per document and item:
    doc_id, item_id, n_windows (most item windows found along one alignment), n_slots (slots
    in it), n_changed (benchmark slot values with another value in the document), exact boolean.

    A pair is reported if along one alignment, in one form (the strict one if it is found in
    both), at least least_windows windows of the item (all, if it has fewer) are found and each
    name has a single counterpart, or so many of them, and over half of those found, agree word
    for word. Windows of fewer than least_words plain words are not used. An item of fewer than
    size words is one window of its own length, in which only strict slots change; items without
    a usable window are searched
    word for word. Null and empty texts match nothing, rows of null doc_id or item_id are left out, repeated rows
    count once, other columns are not read. The benchmark's windows (and their
    hashes) are broadcast up to most_mb megabytes and joined by shuffle beyond."""
    texts = checkpointed(tokens(benchmark.where("item_id is not null").select("item_id", "text").distinct(), "item_id", 1))
    n_words = F.least(F.size("raw"), F.lit(size))
    sizes = sorted(r.n for r in texts.select(n_words.alias("n")).distinct().collect()) or [size]
    items = reduce(DataFrame.unionByName, [item_windows(texts.where(n_words == n), n) for n in sizes])
    plain = F.size(F.filter("item_canon", lambda t: ~t.isin("", NUMBER, UNIT, NAME)))
    usable = items.where((F.col("form") < 2) & (plain >= least_words))
    # Items without a usable window are searched word for word.
    items = checkpointed(usable.unionByName(items.where("form = 2").join(usable.select("item_id").distinct(), "item_id", "left_anti")))
    totals = items.groupBy("item_id", "form", "size").agg(F.countDistinct("q").alias("n_item"))
    items = checkpointed(items.join(totals, ["item_id", "form", "size"]))
    searched = {r["size"]: r["f"] for r in items.groupBy("size").agg(F.max("form").alias("f")).collect()} or {size: 1}
    keys = items.select("h").distinct()
    if light(items, most_mb):
        items = F.broadcast(items)
    if light(keys, most_mb):
        keys = F.broadcast(keys)

    docs = docs.where("doc_id is not null").select("doc_id", "text")
    arrays = tokens(docs, "doc_id", min(searched))
    each = [windows(arrays, "doc_id", n, FORMS[: max(2, f + 1)]).join(keys, "h", "left_semi").withColumn("size", F.lit(n)) for n, f in searched.items()]
    found = checkpointed(reduce(DataFrame.unionByName, each).distinct())
    part = lambda c: F.slice(c, F.col("pos"), F.col("size"))
    hits = found.join(tokens(chosen(docs, found.select("doc_id")), "doc_id", min(searched)), "doc_id")
    hits = hits.select("doc_id", "size", "pos", "h", part("raw").alias("doc_raw"), *(part(c).alias(c) for c in FORMS))
    hits = hits.join(items, ["h", "size"]).where(F.get(F.array(*FORMS), F.col("form")) == F.col("item_canon"))
    # One window is little to go by: in items of fewer than size words only a slot of the strict
    # form may change, so a word at the start of a sentence must be the same.
    same = lambda w, o: bare(w) == bare(o)
    held = F.forall(F.arrays_zip("item_raw", "doc_raw", "strict", "canon"), lambda z: same(z.item_raw, z.doc_raw) | (z.strict == z.canon) & z.strict.isin(NUMBER, UNIT, NAME))
    strict = texts.select("item_id", F.col("raw").alias("item_raw"), F.col("canon").alias("strict")).where(F.size("item_raw") < size)
    short = hits.where(F.col("size") < size).join(strict, ["item_id", "item_raw"]).where(held).drop("strict")
    hits = hits.where(F.col("size") >= size).unionByName(short) if min(searched) < size else hits
    hits = checkpointed(hits.select("doc_id", "item_id", "form", "n_item", "q", (F.col("pos") - F.col("q")).alias("shift"), "item_raw", "item_canon", "doc_raw"))
    along = ["doc_id", "item_id", "form", "shift"]
    # In the loose form a possessive is the name itself.
    owned = lambda c: F.when(F.col("form") == 1, F.regexp_replace(c, r"(?<=\p{L})['’][sS](?=[^\p{L}\p{N}]*$)", "")).otherwise(c)
    word_for_word = F.forall(F.arrays_zip("item_raw", "doc_raw"), lambda z: bare(z.item_raw) == bare(z.doc_raw))
    counts = hits.groupBy(*along).agg(
        F.countDistinct("q").alias("n_windows"), F.countDistinct(F.when(word_for_word, F.col("q"))).alias("n_same"), F.first("n_item").alias("n_item")
    )

    trio = F.arrays_zip("item_canon", "item_raw", "doc_raw")
    slots = hits.select(*along, "q", F.posexplode(trio).alias("i", "s")).where(F.col("s.item_canon").isin(NUMBER, UNIT, NAME))
    slots = slots.select(*along, (F.col("s.item_canon") == NAME).alias("name"), (F.col("q") + F.col("i")).alias("at"), bare(owned(F.col("s.item_raw"))).alias("was"), bare(owned(F.col("s.doc_raw"))).alias("is")).distinct()
    values = slots.groupBy(*along, "was").agg(F.count("*").alias("n"), F.min("is").alias("lo"), F.max("is").alias("hi"), F.countDistinct(F.when(F.col("name"), F.col("is"))).alias("n_names"))
    values = values.groupBy(*along).agg(
        F.sum("n").alias("n_slots"), F.count_if(F.col("n_names") > 1).alias("n_mixed"), F.count_if((F.col("lo") != F.col("was")) | (F.col("hi") != F.col("was"))).alias("n_changed")
    )
    zero = F.lit(0).cast("long")
    good = (
        counts.where(f"n_windows >= least({least_windows}, n_item)")
        .join(values, along, "left")
        .select("doc_id", "item_id", "form", "n_item", "n_same", F.col("n_windows").cast("long"), *(F.coalesce(c, zero).alias(c) for c in ("n_slots", "n_mixed", "n_changed")))
        .where(f"n_mixed = 0 or n_same >= least({least_windows}, n_item) and 2 * n_same > n_windows")
    )
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct((-F.col("form")).alias("f"), "n_windows", (-F.col("n_changed")).alias("c"), "n_slots")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.n_slots", (-F.col("b.c")).alias("n_changed"), (F.col("b.c") == 0).alias("exact"))


def op4_template_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TOKENS = r"""
  SELECT k, raw, list_transform(range(1, len(raw) + 1), lambda i: CASE
      WHEN regexp_matches(raw[i], '[0-9]') THEN chr(57344)
      WHEN i > 1 AND NOT regexp_matches(raw[i - 1], '[.!?:]$') AND regexp_matches(raw[i], '^[^\p{L}\p{N}]*\p{Lu}\p{Ll}+[^\p{L}\p{N}]*$') THEN chr(57346)
      WHEN i > 1 AND regexp_matches(raw[i - 1], '[0-9]') AND regexp_matches(raw[i], '^(?i:UNITS_HERE)[^\p{L}\p{N}]*$') THEN chr(57345)
      ELSE lower(regexp_replace(raw[i], '[^\p{L}\p{N}]+', '', 'g')) END) AS canon
  FROM (SELECT KEY_HERE AS k, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw FROM SOURCE_HERE)
  WHERE len(raw) >= 8""".replace("UNITS_HERE", "|".join(UNITS))
_SQL_WINDOWS = "SELECT k, pos, list_slice(raw, pos, pos + 7) AS raw, list_slice(canon, pos, pos + 7) AS canon FROM (SELECT k, raw, canon, unnest(range(1, len(raw) - 6)) AS pos FROM {tokens})"

OP4_SQL = f"""
WITH dt AS ({_SQL_TOKENS.replace("KEY_HERE", "doc_id").replace("SOURCE_HERE", "documents")}),
it AS ({_SQL_TOKENS.replace("KEY_HERE", "item_id").replace("SOURCE_HERE", "benchmark")}),
dw AS ({_SQL_WINDOWS.format(tokens="dt")}),
iw AS (SELECT * FROM ({_SQL_WINDOWS.format(tokens="it")}) WHERE len(list_filter(canon, lambda t: t NOT IN ('', chr(57344), chr(57345), chr(57346)))) >= 4),
totals AS (SELECT k, count(DISTINCT pos) AS n_item FROM iw GROUP BY k),
hits AS (SELECT dw.k AS doc_id, iw.k AS item_id, n_item, iw.pos AS q, dw.pos - iw.pos AS shift, iw.raw AS item_raw, iw.canon AS item_canon, dw.raw AS doc_raw
  FROM dw JOIN iw ON dw.canon = iw.canon JOIN totals ON totals.k = iw.k),
counts AS (SELECT doc_id, item_id, shift, count(DISTINCT q) AS n_windows, any_value(n_item) AS n_item FROM hits GROUP BY ALL),
slots AS (SELECT DISTINCT doc_id, item_id, shift, q + i AS at, lower(regexp_replace(item_raw[i], '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS was, lower(regexp_replace(doc_raw[i], '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS has
  FROM (SELECT *, unnest(range(1, 9)) AS i FROM hits) WHERE item_canon[i] IN (chr(57344), chr(57345), chr(57346))),
vals AS (SELECT doc_id, item_id, shift, was, count(*) AS n, min(has) AS lo, max(has) AS hi FROM slots GROUP BY ALL),
per AS (SELECT doc_id, item_id, shift, sum(n) AS n_slots, count(*) FILTER (lo <> hi) AS n_mixed, count(*) FILTER (lo <> was OR hi <> was) AS n_changed FROM vals GROUP BY ALL),
good AS (SELECT doc_id, item_id, n_windows, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed
  FROM counts LEFT JOIN per USING (doc_id, item_id, shift) WHERE n_windows >= least(6, n_item) AND coalesce(n_mixed, 0) = 0)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_slots AS BIGINT) AS n_slots, CAST(n_changed AS BIGINT) AS n_changed, n_changed = 0 AS exact
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_changed, n_slots DESC) AS r FROM good) WHERE r = 1
"""
