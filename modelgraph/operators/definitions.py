"""Definitions of concept models: terms, functions, relationships and figures.

Tables carry ontology_id and seq, the place of a declaration in its file. Names share one
namespace over the three kinds, looked up terms first, then functions, then relationships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The vocabulary of the language.
META_TAGS = ("version", "title", "author", "description", "type", "date")
RELATIONSHIP_TYPES = ("dependence", "association", "directAssociation", "inheritance", "implementation", "aggregation", "composition")
DIRECTIONS = ("forward", "backward", "bidirectional")
ATTRIBUTE_KEYS = {
    "term": ("color", "note"),
    "function": ("color", "colorArrow", "type", "inputTitle", "outputTitle"),
    "relationship": ("color", "direction", "title", "rightChar", "leftChar"),
}


def all_definitions(terms: DataFrame, functions: DataFrame, relationships: DataFrame) -> DataFrame:
    """kind, kind_order, ontology_id, seq, name of the three kinds; unnamed relationships keep a
    null name."""
    parts = [
        d.select(F.lit(kind).alias("kind"), F.lit(i).alias("kind_order"), "ontology_id", F.col("seq").cast("long").alias("seq"), "name")
        for i, (kind, d) in enumerate((("term", terms), ("function", functions), ("relationship", relationships)))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def find_definition(definitions: DataFrame) -> DataFrame:
    """The first definition of each name: by kind, then by place. min_by aggregates on the map
    side, so a name that very many files declare does not meet in one task."""
    first = F.min(F.struct("kind_order", "seq", "kind"))
    found = definitions.where("name is not null").groupBy("ontology_id", "name").agg(first.alias("d"))
    return found.select("ontology_id", "name", "d.kind", "d.seq")


def declaration_rank(definitions: DataFrame) -> DataFrame:
    """rn: the how-manieth declaration of its name in its ontology."""
    order = Window.partitionBy("ontology_id", "name").orderBy("seq", "kind_order")
    return definitions.where("name is not null").withColumn("rn", F.row_number().over(order))


def duplicate_declarations(definitions: DataFrame) -> DataFrame:
    return declaration_rank(definitions).where("rn > 1").select("ontology_id", "name", "kind", "seq", "rn")


def references(functions: DataFrame, args: DataFrame, relationships: DataFrame) -> DataFrame:
    """ontology_id, seq, role, term: every use of a term."""
    seq = F.col("seq").cast("long").alias("seq")
    return (
        args.select("ontology_id", seq, F.lit("input").alias("role"), "term")
        .unionByName(functions.select("ontology_id", seq, F.lit("output").alias("role"), F.col("output_term").alias("term")))
        .unionByName(
            relationships.select("ontology_id", seq, F.explode(F.create_map(F.lit("parent"), "parent", F.lit("child"), "child")).alias("role", "term"))
        )
    )


def undefined_references(refs: DataFrame, terms: DataFrame) -> DataFrame:
    """Uses of a term that no earlier line of the ontology declares. The earliest line per name
    is aggregated first, so the join is an equality and the comparison a filter."""
    first = terms.groupBy("ontology_id", F.col("name").alias("term")).agg(F.min("seq").alias("declared"))
    return refs.join(first, ["ontology_id", "term"], "left").where("declared is null or declared >= seq").drop("declared")


def count_edges(relationships: DataFrame, functions: DataFrame, args: DataFrame) -> DataFrame:
    """Relationships plus, for each function, its distinct input terms and its output."""
    inputs = args.select("ontology_id", "function", "term").distinct().groupBy("ontology_id").count()
    parts = (
        relationships.groupBy("ontology_id").count().unionByName(functions.groupBy("ontology_id").count()).unionByName(inputs)
    )
    return parts.groupBy("ontology_id").agg(F.sum("count").alias("edges"))


def too_many_edges(edges: DataFrame, limit: int | None) -> DataFrame:
    """Ontologies above the limit; none if the limit is null or 0."""
    return edges.where(F.col("edges") > limit) if limit else edges.limit(0)


def argument_bags(args: DataFrame) -> DataFrame:
    """Distinct input terms of each function with their number, in the order first seen."""
    return args.groupBy("ontology_id", "function", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def bad_meta_tags(statements: DataFrame) -> DataFrame:
    return statements.where(~F.col("tag").isin(*META_TAGS)).select("ontology_id", "seq", "tag")


def bad_attribute_keys(rows: DataFrame) -> DataFrame:
    allowed = F.lit(False)
    for kind, keys in ATTRIBUTE_KEYS.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("key").isin(*keys))
    return rows.where(~allowed).select("ontology_id", "seq", "kind", "key")


def bad_relationship_types(relationships: DataFrame, functions: DataFrame) -> DataFrame:
    """Types outside the enumeration, of relationships and in functions' attributes."""
    used = relationships.select("ontology_id", F.col("seq").cast("long").alias("seq"), F.col("relationship").alias("type")).unionByName(
        functions.where("type is not null").select("ontology_id", F.col("seq").cast("long").alias("seq"), "type")
    )
    return used.where(~F.col("type").isin(*RELATIONSHIP_TYPES))


def bad_directions(rows: DataFrame) -> DataFrame:
    """Direction attributes (rows: kind, key, value) outside the enumeration."""
    return rows.where((F.col("key") == "direction") & ~F.col("value").isin(*DIRECTIONS)).select("ontology_id", "seq", "value")


def empty_value_warnings(meta: DataFrame, terms: DataFrame, functions: DataFrame, args: DataFrame, attributes: DataFrame) -> DataFrame:
    """A row for each empty meta value, label, description and attribute value."""

    def empty(df, column, what):
        return df.where(F.col(column) == "").select("ontology_id", F.col("seq").cast("long").alias("seq"), F.lit(what).alias("what"))

    parts = [
        empty(meta, "value", "meta value"), empty(terms, "label", "term label"), empty(terms, "description", "term description"),
        empty(functions, "label", "function label"), empty(args, "label", "parameter label"), empty(attributes, "value", "attribute value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def meta_last_wins(statements: DataFrame) -> DataFrame:
    """One row per ontology with a column per tag: the last value of each."""
    last = statements.where(F.col("tag").isin(*META_TAGS)).groupBy("ontology_id", "tag").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("ontology_id").pivot("tag", list(META_TAGS)).agg(F.first("value"))


def date_default(meta: DataFrame, build_date: str) -> DataFrame:
    """A missing or empty date becomes the build's date."""
    return meta.withColumn("date", F.coalesce(F.nullif("date", F.lit("")), F.lit(build_date)))


def placed_members(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Figure lines with kind and place (declared) of the definition they name, nulls if no
    earlier line declares it."""
    d = found.select("ontology_id", F.col("name").alias("member"), F.col("kind").alias("k"), F.col("seq").alias("d"))
    joined = lines.join(d, ["ontology_id", "member"], "left").withColumn("known", F.col("d") < F.col("seq"))
    kind, declared = F.when(F.col("known"), F.col("k")).alias("kind"), F.when(F.col("known"), F.col("d")).alias("declared")
    return joined.select("ontology_id", "figure", F.col("seq").cast("long").alias("seq"), "member", kind, declared)


def figure_members(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Figure lines with the definition they name (declared earlier); unknown ones have none."""
    return placed_members(lines, found).drop("declared")


def _of_members(members: DataFrame, kind: str, definitions: DataFrame) -> DataFrame:
    """The definitions that members of a kind name, as often as they are listed, with figure."""
    m = members.where(F.col("kind") == kind).select("ontology_id", "figure", F.col("member").alias("name"), F.col("declared").alias("seq"))
    return m.join(definitions.withColumn("seq", F.col("seq").cast("long")), ["ontology_id", "name", "seq"])


def figure_projection(members: DataFrame, terms: DataFrame, functions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Sub-ontologies by figure, titled by it: the terms, functions and relationships that its
    placed members name (label of a relationship: its ends and type)."""
    ends = F.concat_ws(" ", "parent", "relationship", "child").alias("label")
    parts = (("term", terms, "label"), ("function", functions, "label"), ("relationship", relationships, ends))
    found = [_of_members(members, kind, d).select("ontology_id", F.col("figure").alias("title"), F.lit(kind).alias("kind"), "seq", "name", label) for kind, d, label in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def figure_meta(meta: DataFrame, lines: DataFrame) -> DataFrame:
    """Meta of the sub-ontologies: that of the whole under the figure's name as title."""
    figures = lines.select("ontology_id", F.col("figure").alias("name")).distinct()
    return figures.join(meta, "ontology_id", "left").withColumn("title", F.col("name")).drop("name")


#: What the part views add to the title of their model.
PARTS = {"rels": "Иерархия", "funcs": "Алгоритмы"}
_ENDS = "concat_ws(' ', parent, relationship, child)"


def _rows(df: DataFrame, kind: str, label: str = "label") -> DataFrame:
    """ontology_id, of (the model or figure), kind, seq, name, label."""
    return df.select("ontology_id", "of", F.lit(kind).alias("kind"), F.col("seq").cast("long").alias("seq"), "name", F.expr(label).alias("label"))


def _with_terms(rows: DataFrame, uses: DataFrame, terms: DataFrame) -> DataFrame:
    """rows and the terms of uses(ontology_id, of, seq, name), as often as they are used."""
    first = terms.groupBy("ontology_id", "name").agg(F.min_by("label", "seq").alias("label"))
    return _rows(uses.join(first, ["ontology_id", "name"]), "term").unionByName(rows)


def _relationship_part(relationships: DataFrame, terms: DataFrame) -> DataFrame:
    uses = relationships.select("ontology_id", "of", "seq", F.explode(F.array("parent", "child")).alias("name"))
    return _with_terms(_rows(relationships, "relationship", _ENDS), uses, terms)


def _function_part(functions: DataFrame, args: DataFrame, terms: DataFrame) -> DataFrame:
    inputs = args.select("ontology_id", F.col("function").alias("name"), "term")
    uses = functions.join(inputs, ["ontology_id", "name"]).select("ontology_id", "of", "seq", F.col("term").alias("name"))
    uses = uses.unionByName(functions.select("ontology_id", "of", "seq", F.col("output_term").alias("name")))
    return _with_terms(_rows(functions, "function"), uses, terms)


def _titled(rows: DataFrame, part: str, titles: DataFrame) -> DataFrame:
    """The part's title: that of the model (None without one) and the part's name."""
    known = titles.select("ontology_id", F.col("title").alias("t"))
    title = F.concat(F.coalesce("t", F.lit("None")), F.lit(f" | {PARTS[part]}"))
    return rows.join(known, "ontology_id", "left").select("ontology_id", title.alias("title"), "kind", "seq", "name", "label")


def hierarchy_only(relationships: DataFrame, terms: DataFrame, titles: DataFrame) -> DataFrame:
    """The relationships-only view under its title: relationships and both ends of each, repeated.
    titles(ontology_id, title)."""
    return _titled(_relationship_part(relationships.withColumn("of", F.lit("")), terms), "rels", titles)


def functions_only(functions: DataFrame, args: DataFrame, terms: DataFrame, titles: DataFrame) -> DataFrame:
    """The functions-only view under its title: functions, their inputs and outputs, repeated."""
    return _titled(_function_part(functions.withColumn("of", F.lit("")), args, terms), "funcs", titles)


def output_variants(terms: DataFrame, functions: DataFrame, args: DataFrame, relationships: DataFrame, members: DataFrame, titles: DataFrame) -> DataFrame:
    """All models that a split build writes, as definitions: ontology_id, figure (null: the whole), part
    ('', rels, funcs), title, kind, seq, name, label. The whole and each figure of placed members come
    complete and as their relationships and their functions alone; titles(ontology_id, title)."""
    none = F.lit(None).cast("string")
    figure = lambda kind, d: _of_members(members, kind, d).withColumnRenamed("figure", "of")
    every = {k: d.withColumn("of", none).unionByName(figure(k, d), allowMissingColumns=True) for k, d in (("term", terms), ("function", functions), ("relationship", relationships))}
    whole = _rows(every["term"], "term").unionByName(_rows(every["function"], "function")).unionByName(_rows(every["relationship"], "relationship", _ENDS))
    parts = {"": whole, "rels": _relationship_part(every["relationship"], terms), "funcs": _function_part(every["function"], args, terms)}
    out = None
    for part, rows in parts.items():
        rows = rows.withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    base = F.coalesce("of", "t")
    mark = F.create_map(*(F.lit(x) for k, v in PARTS.items() for x in (k, v)))[F.col("part")]
    title = F.when(F.col("part") == "", base).otherwise(F.concat(F.coalesce(base, F.lit("None")), F.lit(" | "), mark))
    out = out.join(titles.select("ontology_id", F.col("title").alias("t")), "ontology_id", "left")
    return out.select("ontology_id", F.col("of").alias("figure"), "part", title.alias("title"), "kind", "seq", "name", "label")
