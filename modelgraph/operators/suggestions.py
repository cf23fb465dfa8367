"""Suggested relationships: prompts, replies, and what of them is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgraph.operators.definitions import RELATIONSHIP_TYPES

REPLY = "relationships array<struct<parent:string,child:string,relationship:string,label:string,is_bidirectional:boolean,comment:string>>"


def prompt_text(text: Column) -> Column:
    """A name or text as the prompt shows it: one line, trimmed, lower case, quoted."""
    return F.concat(F.lit("'"), F.lower(F.regexp_replace(F.replace(text, F.lit("\\n"), F.lit("")), r"(?U)^\s+|\s+$", "")), F.lit("'"))


def prompts(terms: DataFrame, functions: DataFrame, args: DataFrame) -> DataFrame:
    """ontology_id, classes, functions: the two lists of a prompt, a line for each term and for each
    function in order; an ontology without functions has an empty second list."""

    def text(df, line, name):
        lines = df.groupBy("ontology_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
        return lines.select("ontology_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias(name))

    q = lambda c: prompt_text(F.col(c))
    a = args.groupBy("ontology_id", F.col("function").alias("name")).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(q("term"), F.lit(": "), q("label")).alias("t")))).alias("a"))
    inputs = F.array_join(F.coalesce(F.transform("a", lambda x: x.t), F.array().cast("array<string>")), ", ")
    line = F.concat(q("name"), F.lit(", "), q("label"), F.lit(", ("), inputs, F.lit(") -> "), q("output_term"), F.lit(": "), q("output_label"))
    classes = text(terms, F.concat_ws(", ", q("name"), q("label"), q("description")), "classes")
    return classes.join(text(functions.join(a, ["ontology_id", "name"], "left"), line, "functions"), "ontology_id", "full").fillna("", ["classes", "functions"])


def reply_json(reply: Column) -> Column:
    """The block in braces of a reply, from the first to the last; else the reply itself."""
    found = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.replace(F.trim(F.when(found == "", reply).otherwise(found)), F.lit("\\\\"), F.lit("\\"))


def reply_relationships(replies: DataFrame) -> DataFrame:
    """replies(ontology_id, conv_id, turn, reply) -> the same keys, pos, parent, child, relationship,
    title, bidirectional, comment. A reply in which any relationship is not valid yields nothing: all
    fields must be there, and only the label may be null."""
    of = ["ontology_id", "conv_id", "turn"]
    json = reply_json(F.col("reply"))
    rows = replies.select(*of, F.from_json(json, REPLY).alias("j"), F.from_json(json, "relationships array<map<string,string>>").alias("m")).where("j.relationships is not null")
    given = lambda r: r.parent.isNotNull() & r.child.isNotNull() & r.is_bidirectional.isNotNull() & r.comment.isNotNull()
    ok = F.forall("j.relationships", lambda r: given(r) & F.coalesce(r.relationship.isin(*RELATIONSHIP_TYPES), F.lit(False)))
    rows = rows.where(ok & F.forall("m.relationships", lambda m: F.map_contains_key(m, "label")))
    rows = rows.select(*of, F.posexplode("j.relationships").alias("pos", "r"))
    return rows.select(*of, "pos", "r.parent", "r.child", "r.relationship", F.col("r.label").alias("title"), F.col("r.is_bidirectional").alias("bidirectional"), "r.comment")


def resolve(suggested: DataFrame, terms: DataFrame) -> DataFrame:
    """Suggestions between terms(ontology_id, name) of their ontology; inheritance has its ends swapped."""
    swap = F.col("relationship") == "inheritance"
    s = suggested.withColumns({"parent": F.when(swap, F.col("child")).otherwise(F.col("parent")), "child": F.when(swap, F.col("parent")).otherwise(F.col("child"))})
    names = terms.select("ontology_id", "name").distinct()
    return s.join(names.withColumnRenamed("name", "parent"), ["ontology_id", "parent"], "left_semi").join(names.withColumnRenamed("name", "child"), ["ontology_id", "child"], "left_semi")


def keep_first(suggested: DataFrame) -> DataFrame:
    """The first suggestion of each (parent, child) in an ontology."""
    order = Window.partitionBy("ontology_id", "parent", "child").orderBy("conv_id", "turn", "pos")
    return suggested.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def new_only(suggested: DataFrame, relationships: DataFrame) -> DataFrame:
    """Suggestions for which their ontology has no relationship of any type in that direction."""
    there = relationships.select("ontology_id", "parent", "child").distinct()
    return keep_first(suggested.join(there, there.columns, "left_anti"))


def snippets(accepted: DataFrame) -> DataFrame:
    """conv_id, snippet: the lines to put into a file."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("title: '"), "title", F.lit("'")))
    marks = F.array_compact(F.array(title, F.when(F.col("bidirectional"), "direction: 'bidirectional'")))
    line = F.concat(F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("  # "), "comment", F.lit("\n"))).otherwise(""), F.lit("  "), "parent", F.lit(" "), "relationship", F.lit(" "), "child", F.when(F.size(marks) > 0, F.concat(F.lit(", { "), F.array_join(marks, ", "), F.lit(" }"))).otherwise(""))
    lines = accepted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "pos", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.concat(F.lit("hierarchy:\n"), F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("snippet"))


def merged_hierarchy(relationships: DataFrame, accepted: DataFrame) -> DataFrame:
    """Existing relationships followed by the accepted suggestions."""
    old = relationships.select("ontology_id", F.lit(0).alias("part"), F.col("seq").cast("long").alias("seq"), "parent", "relationship", "child")
    return old.unionByName(accepted.select("ontology_id", F.lit(1).alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("seq"), "parent", "relationship", "child"))
