"""Column functions for class models: enumerations, multiplicities, defaults and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the language.
PRIMITIVES = ("String", "str", "Integer", "int", "Float", "float", "double", "Boolean", "bool")
VISIBILITY = {"+": "public", "-": "private", "#": "protected", "~": "package"}
TYPE_NAMES = {"Строка": "String", "строка": "String", "цел": "int", "целый": "int"}
DEPENDENCY_STEREOTYPES = {"use": "use", "использование": "use", "call": "call", "вызов": "call", "instanceof": "instanceOf", "экземпляр": "instanceOf"}


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a literal map, null for another key."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def map_type(name: Column) -> Column:
    return F.coalesce(lookup(name, TYPE_NAMES), name)


def map_dependency_stereotype(text: Column) -> Column:
    return lookup(F.lower(text), DEPENDENCY_STEREOTYPES)


def multiplicity(text: Column) -> Column:
    """struct<lower, upper> of longs: null, '' and '*' are 0..unbounded (null), 'n' is n..n; both
    ends null where the text is none of the forms or beyond 64 bits. Spaces may stand around ends."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.regexp_extract(t, r"^(-?\d+)\s*(\.\.\s*(-?\d+|\*))?$", 1).try_cast("long")
    high = F.regexp_extract(t, r"^(-?\d+)\s*\.\.\s*(-?\d+|\*)$", 2)
    open_, sound = t.isin("", "*"), (high.isin("", "*")) | high.try_cast("long").isNotNull()
    lower = F.when(open_, F.lit(0).cast("long")).when(sound, low)
    upper = F.when(open_, F.lit(None)).when(high == "", low).otherwise(high.try_cast("long"))
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def bad_multiplicity(text: Column) -> Column:
    m = multiplicity(text)
    return m["lower"].isNull() | (m["lower"] < 0) | F.coalesce((m["upper"] < 0) | (m["lower"] > m["upper"]), F.lit(False))


def multiplicity_text(m: Column) -> Column:
    return F.when(m["upper"].isNull(), F.concat(m["lower"], F.lit("..*"))).when(m["lower"] == m["upper"], m["lower"].cast("string")).otherwise(F.concat(m["lower"], F.lit(".."), m["upper"]))


def multiplicities(text: Column) -> Column:
    """The ranges of a list such as '1..3, 5, 7..10'; nothing is the one range 0..unbounded."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), ","), multiplicity)


def multiplicities_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, multiplicity_text), ", ")


def coerced(value: Column, type_: Column) -> Column:
    """The value as its primitive type would print it, null if it can't be; a non-empty text is
    true; values of other types stay as they are."""
    return (
        F.when(type_.isin("int", "Integer"), F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.coalesce(value.try_cast("decimal(38,0)").cast("string"), F.trim(value))))
        .when(type_.isin("float", "Float", "double"), F.when(value.rlike(r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"), value.try_cast("double").cast("string")))
        .when(type_.isin("bool", "Boolean"), F.when(value == "", "false").otherwise("true"))
        .otherwise(value)
    )


def some(prefix: str, value: Column, suffix: str = "") -> Column:
    """prefix value suffix, null (skipped by concat_ws) without a value."""
    return F.concat(F.lit(prefix), F.nullif(value, F.lit("")), F.lit(suffix))


def class_header(stereotype: Column, name: Column, abstract: Column, mult: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("«"), stereotype, F.lit("»")), name, F.when(abstract, "{abstract}"), mult)


def parameter_text(direction: Column, name: Column, type_: Column, default: Column) -> Column:
    return F.concat_ws(" ", F.when(direction != "in", direction), name, some(": ", type_), F.concat(F.lit(" = "), default))


def attribute_text(visibility: Column, name: Column, mult: Column, type_: Column, initial: Column, change: Column) -> Column:
    shown = F.when((mult["lower"] != 0) | mult["upper"].isNotNull(), F.concat(F.lit("["), multiplicity_text(mult), F.lit("]")))
    return F.concat_ws(" ", visibility, name, shown, some(": ", type_), some("= ", initial), some("{", change, "}"))


def operation_text(visibility: Column, name: Column, params: Column, returns: Column, query: Column, leaf: Column, concurrency: Column) -> Column:
    marks = F.array_compact(F.array(F.when(query, "isQuery"), F.when(leaf, "leaf"), F.when(concurrency != "sequential", concurrency)))
    return F.concat_ws(
        " ", visibility, F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")")), some(": ", returns),
        F.when(F.size(marks) > 0, F.concat(F.lit("{"), F.array_join(marks, ", "), F.lit("}"))),
    )


def generalization_set_label(complete: Column, disjoint: Column) -> Column:
    return F.concat(F.lit("{"), F.when(complete, "complete").otherwise("incomplete"), F.lit(", "), F.when(disjoint, "disjoint").otherwise("overlapping"), F.lit("}"))
