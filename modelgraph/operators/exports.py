"""Whole documents per ontology: diagram source, DSL text and JSON, each of all sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgraph.functions import render
from modelgraph.operators.definitions import ATTRIBUTE_KEYS, META_TAGS

#: First and last lines of a diagram.
HEADER = (
    "@startuml", "skinparam backgroundColor #F0F8FF", "skinparam defaultTextAlignment center", "skinparam shadowing false",
    "skinparam dpi 150", "skinparam linetype ortho", "skinparam ranksep 40", "skinparam nodesep 30",
)
FOOTER = ("}", "@enduml")


#: Lines of one section, of all texts together, that are joined in one step.
PIECE = 1 << 16


def in_order(field: str, *order: str | Column) -> Column:
    """The values of a field of a group's rows, as an array in the order of these columns. By sort_array and field
    access, as array_sort and transform call an interpreted function for each comparison and element."""
    return F.sort_array(F.collect_list(F.struct(*order)))[field]


def pieces(lines: DataFrame, key: str, separator: str) -> DataFrame:
    """key, section, piece, text of lines(key, section, seq, at (optional), line): the lines in order,
    joined in pieces, which are stretches of seq of equal length, as many as a section has lines by PIECE. So a
    long text is sorted and joined in many tasks; only lines of equal seq are never parted."""
    order = [c for c in ("seq", "at", "line") if c in lines.columns]
    spread = lines.groupBy("section").agg(F.min("seq").alias("low"), F.expr(f"(max(seq) - min(seq)) div greatest(count(*) div {PIECE}, 1) + 1").alias("width"))
    placed = lines.join(F.broadcast(spread), "section", "left").withColumn("piece", F.expr("(seq - low) div width"))
    text = F.array_join(in_order("line", *order), separator)
    return placed.groupBy(key, "section", "piece").agg(F.when(F.count("line") > 0, text).alias("text"))


def joined(lines: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """One text per key from lines(key, section, seq, at (optional), line) in this order; null lines are
    left out. Only the text itself is held whole, as its pieces and joined, by concat_ws, which allocates it once."""
    return pieces(lines, key, separator).groupBy(key).agg(F.concat_ws(separator, in_order("text", "section", "piece", "text")).alias(text))


def _every(parts: list[DataFrame]) -> DataFrame:
    """The lines of all parts."""
    zero = F.lit(0).cast("long")
    parts = [p if "at" in p.columns else p.withColumn("at", zero) for p in parts]
    out = parts[0].select("ontology_id", "section", "seq", "at", "line")
    for p in parts[1:]:
        out = out.unionByName(p.select("ontology_id", "section", "seq", "at", "line"))
    return out


def _lines(df: DataFrame, section: int, line: Column) -> DataFrame:
    return df.select("ontology_id", F.lit(section).alias("section"), F.col("seq").cast("long").alias("seq"), line.alias("line"))


def _columns(kind: str) -> dict[str, Column]:
    """The attributes of a kind, in the order in which they are written."""
    return {k: F.col(k) for k in ATTRIBUTE_KEYS[kind]}


def term_lines(terms: DataFrame) -> DataFrame:
    c = F.col
    both = F.concat(render.puml_box(c("name"), c("label"), c("description"), c("color")), F.lit("\n"), render.puml_note(c("name"), c("note")))
    return _lines(terms, 1, both)


def edge_lines(relationships: DataFrame) -> DataFrame:
    c = F.col
    known = relationships.where(c("relationship").isin(*render.ARROWS))
    line = render.puml_edge(c("parent"), c("child"), c("relationship"), c("direction"), c("color"), c("leftChar"), c("rightChar"), c("title"))
    return _lines(known, 4, F.concat(line, F.lit("\n")))


def described_functions(functions: DataFrame, args: DataFrame) -> DataFrame:
    """functions with `inputs`: the arguments' texts in order."""
    a = args.groupBy("ontology_id", F.col("function").alias("name")).agg(in_order("t", "pos", render.argument(F.col("term"), F.col("label")).alias("t")).alias("a"))
    f = functions.join(a, ["ontology_id", "name"], "left")
    return f.withColumn("inputs", F.array_join(F.coalesce("a", F.array().cast("array<string>")), ", ")).drop("a")


def function_boxes(functions: DataFrame, args: DataFrame) -> DataFrame:
    f = described_functions(functions, args)
    text = F.concat("inputs", F.lit(" -> "), render.argument(F.col("output_term"), F.col("output_label")))
    return _lines(f, 2, render.puml_box(F.col("name"), F.col("label"), text, F.col("color")))


def function_edges(functions: DataFrame, bags: DataFrame, terms: DataFrame) -> DataFrame:
    """Known input terms to their function (their number as mark if above 1), function to output."""
    c, none = F.col, F.lit(None).cast("string")
    type_ = F.coalesce("type", F.lit("directAssociation"))
    known = terms.select("ontology_id", c("name").alias("term")).distinct()
    bags = bags.join(known, ["ontology_id", "term"], "left_semi").withColumnRenamed("function", "name")
    into = bags.join(functions.select("ontology_id", "name", "seq", "type", "colorArrow", "inputTitle"), ["ontology_id", "name"])
    mark = F.when(c("n") > 1, c("n").cast("string"))
    one = into.select("ontology_id", "name", "seq", (c("first_pos").cast("long")).alias("at"), "term", render.puml_edge(c("term"), c("name"), type_, F.lit("forward"), c("colorArrow"), mark, none, c("inputTitle")).alias("line"))
    out = functions.select("ontology_id", "name", "seq", F.lit(1_000_000).cast("long").alias("at"), c("output_term").alias("term"), render.puml_edge(c("name"), c("output_term"), type_, F.lit("forward"), c("colorArrow"), none, none, c("outputTitle")).alias("line"))
    return one.unionByName(out)


def class_lines(terms: DataFrame, functions: DataFrame, args: DataFrame, relationships: DataFrame) -> DataFrame:
    """The class diagram style: terms and functions as classes, relationships as connectors."""
    c = F.col
    term = F.concat(F.lit("class "), "name", F.lit(" {\n  "), "description", F.lit("\n}"))
    out = render.argument(c("output_term"), c("output_label"))
    function = F.concat(F.lit("class "), "name", F.lit(" <<Function>>"), render.some(" ", c("color"), ""), F.lit(" {\n  +"), "name", F.lit("("), "inputs", F.lit(") : ("), out, F.lit(")\n  "), "label", F.lit("\n}"))
    edges = _lines(relationships, 3, render.class_edge(c("parent"), c("relationship"), c("child")))
    return _lines(terms, 1, term).unionByName(_lines(described_functions(functions, args), 2, function)).unionByName(edges)


def puml_lines(terms: DataFrame, functions: DataFrame, args: DataFrame, bags: DataFrame, relationships: DataFrame, titles: DataFrame) -> DataFrame:
    """ontology_id, section, seq, at, line: header with the title, boxes and notes, functions' boxes and
    edges, relationships, footer."""
    head = titles.select("ontology_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("\n".join(HEADER) + '\npackage "'), F.coalesce("title", F.lit("Онтология")), F.lit('" {')).alias("line"))
    foot = titles.select("ontology_id", F.lit(9).alias("section"), F.lit(0).cast("long").alias("seq"), F.lit("\n".join(FOOTER)).alias("line"))
    edges = function_edges(functions, bags, terms).withColumn("section", F.lit(3)).withColumn("line", F.concat("line", F.lit("\n")))
    edges = edges.withColumn("seq", F.col("seq").cast("long"))
    return _every([head, term_lines(terms), function_boxes(functions, args), edges, edge_lines(relationships), foot])


def puml(terms: DataFrame, functions: DataFrame, args: DataFrame, bags: DataFrame, relationships: DataFrame, titles: DataFrame) -> DataFrame:
    """ontology_id, puml: the text of all lines."""
    return joined(puml_lines(terms, functions, args, bags, relationships, titles), "ontology_id", "puml")


def dsl_term_lines(terms: DataFrame) -> DataFrame:
    c = F.col
    line = F.concat(c("name"), F.lit(": "), render.quoted(c("label")), F.lit(", "), render.literal(c("description")), render.dsl_attributes(color=c("color"), note=c("note")))
    return _lines(terms, 1, line)


def dsl_function_lines(functions: DataFrame, args: DataFrame) -> DataFrame:
    c = F.col
    one = F.concat(c("term"), F.lit(": "), render.literal(c("label")))
    a = args.groupBy("ontology_id", c("function").alias("name")).agg(in_order("t", "pos", one.alias("t")).alias("a"))
    f = functions.join(a, ["ontology_id", "name"], "left")
    inputs = F.array_join(F.coalesce("a", F.array().cast("array<string>")), ", ")
    line = F.concat(c("name"), F.lit(": "), render.quoted(c("label")), F.lit(" ("), inputs, F.lit(") -> "), c("output_term"), F.lit(": "), render.literal(c("output_label")), render.dsl_attributes(**_columns("function")))
    return _lines(f, 3, line)


def dsl_relationship_lines(relationships: DataFrame) -> DataFrame:
    c = F.col
    line = F.concat(c("parent"), F.lit(" "), c("relationship"), F.lit(" "), c("child"), render.dsl_attributes(**_columns("relationship")))
    return _lines(relationships, 5, line)


def dsl_meta_lines(meta: DataFrame) -> DataFrame:
    """A line for each tag with a value, of meta(ontology_id, a column per tag)."""
    lines = [F.struct(F.lit(i).cast("long").alias("seq"), F.concat(F.lit(f"{t}: "), render.literal(F.col(t))).alias("line")) for i, t in enumerate(META_TAGS)]
    rows = meta.select("ontology_id", F.explode(F.array(*lines)).alias("x")).where("x.line is not null")
    return rows.select("ontology_id", F.lit(0).alias("section"), "x.seq", "x.line")


_LAST = 1 << 60


def dsl_figure_lines(members: DataFrame) -> DataFrame:
    """A block for each figure of placed members: its name, then terms, functions and
    relationships, and an empty line."""
    kinds = F.create_map(*(F.lit(x) for i, k in enumerate(("term", "function", "relationship")) for x in (k, i)))
    # One exchange by figure gives every line its figure's place.
    first = Window.partitionBy("ontology_id", "figure")
    rows = members.withColumn("first", F.min("seq").over(first))
    known = rows.where("kind is not null").select("ontology_id", F.col("first").alias("seq"), (kinds[F.col("kind")] * F.lit(1 << 50) + F.col("seq")).alias("at"), F.col("member").alias("line"))
    ends = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.concat(F.lit("figure "), "figure", F.lit(":")).alias("line")), F.struct(F.lit(_LAST).alias("at"), F.lit("").alias("line")))
    frame = rows.select("ontology_id", "figure", "first").distinct().select("ontology_id", F.col("first").alias("seq"), F.explode(ends).alias("x"))
    return known.unionByName(frame.select("ontology_id", "seq", "x.at", "x.line")).withColumn("section", F.lit(7))


def dsl(meta: DataFrame, terms: DataFrame, functions: DataFrame, args: DataFrame, relationships: DataFrame, members: DataFrame) -> DataFrame:
    """ontology_id, dsl: meta, then the sections in order, empty ones omitted, then figures."""
    parts, ids = [dsl_meta_lines(meta), dsl_figure_lines(members)], meta.select("ontology_id")
    for section, name, lines in ((1, "types", dsl_term_lines(terms)), (3, "functions", dsl_function_lines(functions, args)), (5, "hierarchy", dsl_relationship_lines(relationships))):
        there = lines.select("ontology_id").distinct()
        ids = ids.unionByName(there)
        ends = F.array(F.struct(F.lit(-1).cast("long").alias("seq"), F.lit(f"{name}:").alias("line")), F.struct(F.lit(_LAST).alias("seq"), F.lit("").alias("line")))
        head = there.select("ontology_id", F.lit(section).alias("section"), F.explode(ends).alias("x"))
        parts += [lines, head.select("ontology_id", "section", "x.seq", "x.line")]
    every = ids.unionByName(members.select("ontology_id").distinct()).distinct()
    parts.append(every.select("ontology_id", F.lit(0).alias("section"), F.lit(_LAST).alias("seq"), F.lit("").alias("line")))
    return joined(_every(parts), "ontology_id", "dsl")


def json_rows(meta: DataFrame, terms: DataFrame, functions: DataFrame, args: DataFrame, relationships: DataFrame, members: DataFrame) -> DataFrame:
    """ontology_id, kind, seq, json for all five sections: null attributes are dropped, null
    names and meta values are kept; figures are those of placed members."""
    c, j = F.col, render.json_text
    named = lambda name, label: render.json_object(name=j(name), label=j(label))
    array = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))

    def row(df, kind, json):
        return df.select("ontology_id", F.lit(kind).alias("kind"), c("seq").cast("long").alias("seq"), json.alias("json"))

    t = render.json_object(name=j(c("name")), label=j(c("label")), description=j(c("description")), attributes=render.json_attributes(color=c("color"), note=c("note")))
    r = render.json_object(
        name=j(c("name")), parent=j(c("parent")), relationship=j(c("relationship")), children=F.concat(F.lit("["), j(c("child")), F.lit("]")), attributes=render.json_attributes(**_columns("relationship"))
    )
    a = args.groupBy("ontology_id", c("function").alias("name")).agg(F.array_sort(F.collect_list(F.struct("pos", named(c("term"), c("label")).alias("t")))).alias("a"))
    inputs = array(F.coalesce(F.transform("a", lambda x: x.t), F.array().cast("array<string>")))
    f = render.json_object(name=j(c("name")), label=j(c("label")), input_types=inputs, output_type=named(c("output_term"), c("output_label")), attributes=render.json_attributes(**_columns("function")))
    known = F.collect_list(F.when(c("kind").isNotNull(), F.struct("kind", "seq", "member")))
    figures = members.groupBy("ontology_id", "figure").agg(F.min("seq").alias("seq"), F.array_sort(known).alias("m"))
    of = lambda kind: array(F.transform(F.filter("m", lambda x: x.kind == kind), lambda x: j(x.member)))
    g = render.json_object(name=j(c("figure")), terms=of("term"), functions=of("function"), hierarchy=of("relationship"))
    parts = [
        row(meta.withColumn("seq", F.lit(0)), "meta", render.json_object(**{tag: j(c(tag)) for tag in META_TAGS})), row(terms, "terms", t),
        row(functions.join(a, ["ontology_id", "name"], "left"), "functions", f), row(relationships, "hierarchy", r), row(figures, "figures", g),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_KINDS = ("meta", "terms", "functions", "hierarchy", "figures")


def json_pieces(rows: DataFrame) -> DataFrame:
    """ontology_id, section, piece, text: the JSON rows of each section joined in pieces."""
    place = F.create_map(*(F.lit(x) for i, k in enumerate(_KINDS) for x in (k, i)))
    return pieces(rows.select("ontology_id", place[F.col("kind")].alias("section"), "seq", F.col("json").alias("line")), "ontology_id", ",")


def in_section(kind: str) -> Column:
    return F.col("section") == _KINDS.index(kind)


def texts(chosen: Column) -> Column:
    """Of a group's pieces (section, piece, text) the texts of the chosen ones, in order."""
    return F.sort_array(F.collect_list(F.when(chosen, F.struct("section", "piece", "text"))))["text"]


def json_of(chosen: Column | None = None) -> Column:
    """The document of a group's pieces (section, piece, text; only the chosen ones): meta as an object, the other
    sections as arrays in declaration order. It is made in the aggregation itself and in one step: every array of
    texts that is a column, and each more concatenation, is a copy of it all."""
    known = F.col("text").isNotNull() if chosen is None else chosen & F.col("text").isNotNull()

    def of(kind):
        found = texts(known & in_section(kind))
        return F.flatten(F.transform(found, lambda x, i: F.array(F.when(i > 0, F.lit(",")), x)))

    none = F.array(F.lit("{" + ",".join(f'"{t}":null' for t in META_TAGS) + "}"))
    parts = [F.lit('{"meta":'), F.when(F.size(of("meta")) > 0, of("meta")).otherwise(none), F.lit(",")]
    for k in _KINDS[1:]:
        parts += [F.lit(f'"{k}":['), of(k), F.lit("]}" if k == _KINDS[-1] else "],")]
    return F.concat_ws("", *parts)


def json_documents(rows: DataFrame) -> DataFrame:
    """ontology_id, json: the document of each model."""
    return json_pieces(rows).groupBy("ontology_id").agg(json_of().alias("json"))
