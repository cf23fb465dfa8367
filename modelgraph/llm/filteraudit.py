"""Operator 12: filter interaction audit by higher-order SQL folds.

Each document fails some of the filters: a mask. Documents are counted by part and mask, so at
most 2 ** filters cells a part are left, whatever the corpus holds. Each cell is folded across the
array of all filter orders (a constant of the plan, sent with it) by `transform` and `aggregate`:
the fold walks an order, carries what is still there, and gives a struct of counts per step. The
cells' arrays of 5! * 5 = 600 structs are merged by sums of their elements.

Filter E (an equal text with a smaller doc_id) is table-wide. Equal texts fail the others alike,
so a group of copies is counted before its rows meet: no copies are gathered.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelgraph.llm.common import letters, table

FILTERS = "ABCDE"
#: Separators of words: space, and tab to carriage return.
_SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails filter k), n, good, toxic long: documents counted by part and
    mask, and those of them that a label calls good or toxic."""
    text = letters()
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(text_failures(text))), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "same", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = rows.join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    # By equal texts: how many rows, and how many of these have the smallest doc_id. Rows without
    # a doc_id are neither smaller than others nor is one smaller than they.
    numbered = F.col("doc_id").isNotNull()
    group = rows.groupBy("same", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(numbered, F.col("n"))), F.lit(0)).alias("numbered"), F.min(F.when(numbered, F.struct("doc_id", "n"))).alias("lo")
    )
    first = F.min("lo.doc_id").over(Window.partitionBy("same"))
    group = group.withColumn("copies", F.col("numbered") - F.when(F.col("lo.doc_id") == first, F.col("lo.n")).otherwise(F.lit(0)))
    e = 1 << FILTERS.index("E")
    cells = group.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + e).alias("mask"), F.col("copies").alias("n")))).alias("c"))
    total = lambda x: F.sum(x).cast("long")
    return cells.groupBy("part", "c.mask").agg(total("c.n").alias("n"), total(F.col("c.n") * F.col("good")).alias("good"), total(F.col("c.n") * F.col("toxic")).alias("toxic"))


def orders(filters: int = len(FILTERS)) -> Column:
    """All orders of the filters, an array of arrays of their numbers."""
    return F.array(*(F.array(*map(F.lit, o)) for o in permutations(range(filters))))


def folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """The fold of one cell: for each order and step a struct of its counts, one array for all."""
    zero = F.lit(0).cast("long")

    def step(state: Column, k: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), k)
        fails = mask.bitwiseAND(bit) != 0
        here, before = state["there"] & fails, ~state["there"] & fails
        there = state["there"] & ~fails
        found = F.struct(
            F.when(there, n).otherwise(zero).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"), F.when(before, n).otherwise(zero).alias("redundant"),
            F.when(mask == bit, n).otherwise(zero).alias("unique_fails"), F.when(here, good).otherwise(zero).alias("good_lost"), F.when(here, toxic).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct(there.alias("there"), F.concat(state["steps"], F.array(found)).alias("steps"))

    kind = f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>"
    start = F.struct(F.lit(True).alias("there"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(orders(), lambda o: F.aggregate(o, start, step)["steps"]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...), labels(doc_id, quality, toxic) -> part, filter_order, step and
    the counts of COUNTS and shapley (removed by the step's filter, summed over all orders), one
    row per part, order and step.

    A null text is empty (fails A alone, unless a smaller doc_id has an empty text too), a null
    lang is the part ''. Rows without a doc_id have no labels and are never copies. A repeated row
    counts each time; of equal texts all rows of the smallest doc_id stay. A document is good
    (toxic) if any of its labels says so. An empty table has no parts and no rows. Other columns
    are not read."""
    cells = masked(docs, labels)
    steps = cells.select("part", F.posexplode(folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"))).alias("at", "c"))
    sums = steps.groupBy("part", "at").agg(*(F.sum(f"c.{c}").alias(c) for c in COUNTS))
    size = len(FILTERS)
    names = F.array(*(F.lit("".join(FILTERS[k] for k in o)) for o in permutations(range(size))))
    order = F.element_at(names, (F.col("at") / size).cast("int") + 1)
    step = (F.col("at") % size + 1).cast("int")
    rows = sums.select("part", order.alias("filter_order"), step.alias("step"), *COUNTS)
    share = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.withColumn("shapley", F.sum("removed").over(share))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS lo FROM t),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > lo, false) AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY ALL),
fl AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS o FROM fl f1, fl f2, fl f3, fl f4, fl f5 WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
v AS (SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM m),
s AS (SELECT part, o AS filter_order, k AS step, n, g, x, fails, substr(o, k, 1) AS f, contains(fails, substr(o, k, 1)) AS hit,
  k > 1 AND fails <> '' AND regexp_matches(substr(o, 1, k - 1), '[' || fails || ']') AS gone FROM (SELECT part, n, g, x, CASE WHEN fails = '' THEN 'z' ELSE fails END AS fails FROM v), o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS k)),
r AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND hit THEN g ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND hit THEN x ELSE 0 END) AS BIGINT) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
