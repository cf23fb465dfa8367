"""Column functions that write definitions as diagram source, DSL text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line, head at the start and head at the end of each relationship type.
ARROWS = {
    "dependence": ("...", "<", ">"),
    "association": ("---", "", ""),
    "directAssociation": ("---", "<", ">"),
    "inheritance": ("---", "<|", "|>"),
    "implementation": ("...", "<|", "|>"),
    "aggregation": ("---", "o", "o"),
    "composition": ("---", "*", "*"),
}
#: Colours of boxes and edges without one of their own.
BOX_COLOR, EDGE_COLOR = "#white", "#black"


def some(prefix: str, value: Column, suffix: str) -> Column:
    """prefix value suffix, '' for a null or empty value."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(prefix), value, F.lit(suffix)))


def puml_box(name: Column, label: Column, description: Column, color: Column) -> Column:
    return F.concat(F.lit('rectangle "'), label, some("\\n(", description, ")"), F.lit('" as '), name, F.lit(" "), F.coalesce(F.nullif(color, F.lit("")), F.lit(BOX_COLOR)))


def puml_note(name: Column, note: Column) -> Column:
    return F.when(F.coalesce(note, F.lit("")) == "", "").otherwise(F.concat(F.lit("note right of "), name, F.lit("\n"), F.replace(note, F.lit("\\n"), F.lit("\n")), F.lit("\n    end note")))


def arrow(type_: Column, direction: Column, color: Column) -> Column:
    """The arrow of a type and direction (null: forward) with its colour inserted."""
    line = F.create_map(*(F.lit(x) for k, v in ARROWS.items() for x in (k, v[0])))[type_]
    start = F.create_map(*(F.lit(x) for k, v in ARROWS.items() for x in (k, v[1])))[type_]
    end = F.create_map(*(F.lit(x) for k, v in ARROWS.items() for x in (k, v[2])))[type_]
    d = F.coalesce(direction, F.lit("forward"))
    whole = F.concat(F.when(d == "forward", "").otherwise(start), line, F.when(d == "backward", "").otherwise(end))
    cut = F.when(d == "bidirectional", 3).otherwise(2)
    return F.concat(F.substring(whole, F.lit(1), cut), F.lit("["), F.coalesce(F.nullif(color, F.lit("")), F.lit(EDGE_COLOR)), F.lit("]"), F.substring(whole, cut + 1, F.length(whole)))


def puml_edge(parent: Column, child: Column, type_: Column, direction: Column, color: Column, left: Column, right: Column, title: Column) -> Column:
    s = F.lit(" ")
    return F.concat(parent, s, some('"', left, '"'), s, arrow(type_, direction, color), s, some('"', right, '"'), s, child, s, some(': "', title, '"'))


def argument(term: Column, label: Column) -> Column:
    return F.concat(term, some(": ", label, ""))


def class_edge(parent: Column, type_: Column, child: Column) -> Column:
    """Connector of the class diagram style: one character less than the arrow."""
    mark = F.create_map(*(F.lit(x) for k, v in ARROWS.items() for x in (k, v[0][1:] + v[2])))[type_]
    return F.concat(parent, F.lit(" "), F.coalesce(mark, F.lit("-->")), F.lit(" "), child)


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def literal(text: Column) -> Column:
    """The text in quotes as a Python literal: double ones if it holds only single ones, with
    backslashes, line ends and tabs escaped."""
    t = text
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(raw), F.lit(written))
    double = F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(quoted(F.replace(t, F.lit("'"), F.lit("\\'"))))


def dsl_attributes(**values: Column) -> Column:
    """', { k: 'v' , … }' of the values that are not null, '' if all are."""
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{k}: "), literal(v), F.lit(" ")) for k, v in values.items())))
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit(", { "), F.array_join(parts, ", "), F.lit("}")))


def json_text(value: Column) -> Column:
    """A string as JSON, null as null."""
    t = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(t, F.lit(2), F.length(t) - 2)


def json_object(**values: Column) -> Column:
    """An object of ready JSON texts, in the order given."""
    parts = [F.concat(F.lit(("," if i else "") + f'"{k}":'), v) for i, (k, v) in enumerate(values.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_attributes(**values: Column) -> Column:
    """An object without the null values."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())))
