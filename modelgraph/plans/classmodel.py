"""Queries over class models."""

import re

from pyspark.sql import functions as F

from modelgraph.functions import classmodel as fn
from modelgraph.operators import classmodel as op
from modelgraph.operators import graph
from modelgraph.plans.views import query

_PRIM = "('String', 'str', 'Integer', 'int', 'Float', 'float', 'double', 'Boolean', 'bool')"
_ENDS = """ends AS (SELECT 'generalization' AS relation, specific AS source, general AS target FROM generalizations UNION ALL SELECT 'dependency', client, supplier FROM dependencies
  UNION ALL SELECT 'realization', implementer, interface FROM realizations)"""
_REL = "generalizations dependencies realizations"
_CLOSURE = "reach AS (SELECT specific AS a, general AS b FROM generalizations UNION SELECT r.a, g.general FROM reach r JOIN generalizations g ON r.b = g.specific)"


def _ends(v):
    return op.relation_ends(v("generalizations"), v("dependencies"), v("realizations"))


def _edges(v):
    return v("generalizations").select(F.col("specific").alias("a"), F.col("general").alias("b"))


@query("effective_classifiers", "classifiers", "WITH c AS (SELECT class % 300 AS class, kind, stereotype, seq FROM classifiers) SELECT class, max_by(kind, seq) AS kind, arg_max_null(stereotype, seq) AS stereotype, min(seq) AS seq FROM c GROUP BY 1")
def effective_classifiers(v):
    return op.effective_classifiers(v("classifiers").withColumn("class", F.col("class") % 300))


@query(
    "map_visibility_type", "operations",
    """SELECT class, op, CASE visibility WHEN '+' THEN 'public' WHEN '-' THEN 'private' WHEN '#' THEN 'protected' ELSE 'package' END AS visibility,
    CASE op % 4 WHEN 0 THEN 'String' WHEN 1 THEN 'int' ELSE return_type END AS type_ FROM operations""",
)
def map_visibility_type(v):
    o = v("operations").withColumn("t", F.expr("case op % 4 when 0 then 'строка' when 1 then 'целый' else return_type end"))
    return o.select("class", "op", fn.lookup(F.col("visibility"), fn.VISIBILITY).alias("visibility"), fn.map_type(F.col("t")).alias("type_"))


@query("map_dependency_stereotype", "dependencies", "SELECT client, supplier, CASE client % 6 WHEN 0 THEN 'use' WHEN 1 THEN 'call' WHEN 2 THEN 'call' WHEN 3 THEN 'use' WHEN 4 THEN 'instanceOf' END AS stereotype FROM dependencies")
def map_dependency_stereotype(v):
    return v("dependencies").withColumn("stereotype", fn.map_dependency_stereotype(F.col("stereotype")))


_MULT = "CASE multiplicity WHEN '1' THEN 1 WHEN '0..1' THEN 0 WHEN '1..*' THEN 1 WHEN '5..3' THEN 5 ELSE 0 END AS lower, CASE multiplicity WHEN '1' THEN 1 WHEN '0..1' THEN 1 WHEN '5..3' THEN 3 END AS upper"


@query("parse_multiplicity", "association_ends", f"SELECT assoc_id, end_no, CAST(lower AS BIGINT) AS lower, CAST(upper AS BIGINT) AS upper FROM (SELECT assoc_id, end_no, {_MULT} FROM association_ends)")
def parse_multiplicity(v):
    return v("association_ends").select("assoc_id", "end_no", fn.multiplicity(F.col("multiplicity")).alias("m")).select("assoc_id", "end_no", "m.lower", "m.upper")


@query("multiplicity_text", "association_ends", "SELECT assoc_id, end_no, CASE multiplicity WHEN '1' THEN '1' WHEN '0..1' THEN '0..1' WHEN '1..*' THEN '1..*' WHEN '5..3' THEN '5..3' ELSE '0..*' END || CASE WHEN end_no % 2 = 0 THEN ', ' || assoc_id || ', 7..10' ELSE '' END AS text FROM association_ends")
def multiplicity_text(v):
    text = F.expr("coalesce(multiplicity, '') || case when end_no % 2 = 0 then ', ' || assoc_id || ' , 7 .. 10' else '' end")
    return v("association_ends").select("assoc_id", "end_no", fn.multiplicities_text(fn.multiplicities(text)).alias("text"))


@query("bad_multiplicity", "association_ends", "SELECT assoc_id, end_no, multiplicity FROM association_ends WHERE multiplicity = '5..3'")
def bad_multiplicity(v):
    return op.bad_multiplicities(v("association_ends"))


@query(
    "coerce_defaults", "attributes parameters",
    """SELECT 'attribute' AS element, class AS owner, seq AS place, type_, 'n/a' AS value FROM attributes WHERE seq % 6 = 0 AND type_ IN ('int', 'double')
    UNION ALL SELECT 'parameter', op, pos, type_, 'n/a' FROM parameters WHERE pos % 3 = 0 AND type_ = 'int' AND default_value IS NOT NULL""",
)
def coerce_defaults(v):
    attributes = v("attributes").withColumn("initial_value", F.expr("case when seq % 6 = 0 then 'n/a' else initial_value end"))
    return op.bad_defaults(attributes, v("parameters").withColumn("default_value", F.expr("case when pos % 3 = 0 and default_value is not null then 'n/a' else default_value end")))


@query("self_references", _REL, f"WITH {_ENDS} SELECT * FROM ends WHERE source = target")
def self_references(v):
    return op.self_references(_ends(v))


@query(
    "stereotype_rules", "classifiers operations attributes",
    """SELECT o.class, 'operation' AS feature, op AS seq, stereotype FROM operations o JOIN classifiers c ON o.class = c.class WHERE stereotype = 'interface' AND NOT o.is_abstract OR stereotype = 'utility' AND scope <> 'classifier'
    OR stereotype IN ('dataType', 'enumeration') AND NOT (is_query AND scope = 'classifier')
    UNION ALL SELECT a.class, 'attribute', a.seq, stereotype FROM attributes a JOIN classifiers c ON a.class = c.class WHERE stereotype = 'utility' AND a.seq % 2 = 1""",
)
def stereotype_rules(v):
    scoped = v("attributes").select("class", "seq", F.expr("case when seq % 2 = 0 then 'classifier' else 'instance' end as scope"))
    return op.stereotype_rules(v("classifiers"), v("operations"), scoped)


@query("blank_names", "terms", "SELECT ontology_id, seq, label AS name FROM terms WHERE trim(label) = '' OR length(trim(label)) > 24")
def blank_names(v):
    return op.blank_names(v("terms").select("ontology_id", "seq", F.col("label").alias("name")), longest=24)


@query(
    "unknown_relation_ends", f"{_REL} association_ends classifiers",
    f"WITH {_ENDS} SELECT class, relation, count(*) AS n FROM (SELECT relation, unnest([source, target]) AS class FROM ends UNION ALL SELECT 'association', participant FROM association_ends) WHERE class NOT IN (SELECT class FROM classifiers) GROUP BY 1, 2",
)
def unknown_relation_ends(v):
    return op.unknown_ends(_ends(v), v("association_ends"), v("classifiers"))


@query("unknown_attribute_types", "attributes classifiers", f"SELECT class, seq, type_ FROM attributes WHERE type_ <> '' AND type_ NOT IN {_PRIM} AND type_ NOT IN (SELECT CAST(class AS VARCHAR) FROM classifiers WHERE class % 3 > 0)")
def unknown_attribute_types(v):
    return op.unknown_attribute_types(v("attributes"), v("classifiers").where("class % 3 > 0"))


_BAD = "CASE WHEN c.class IS NULL THEN 'unknown' WHEN kind NOT IN ('Class', 'Template') THEN 'not a class' END AS problem"


@query(
    "bad_parameter_types", "parameters operations classifiers",
    f"""SELECT * FROM (SELECT op, place, type_, {_BAD} FROM (SELECT op, CAST(pos AS INT) AS place, type_ FROM parameters UNION ALL SELECT op, 0, return_type FROM operations) p
    LEFT JOIN classifiers c ON p.type_ = CAST(c.class AS VARCHAR) WHERE type_ <> '' AND type_ NOT IN {_PRIM}) WHERE problem IS NOT NULL""",
)
def bad_parameter_types(v):
    used = v("parameters").select("op", F.col("pos").cast("int").alias("place"), "type_").unionByName(v("operations").select("op", F.lit(0).alias("place"), F.col("return_type").alias("type_")))
    return op.bad_parameter_types(used, v("classifiers"))


@query(
    "bad_template_types", "parameters classifiers",
    f"""SELECT * FROM (SELECT op, place, type_, {_BAD} FROM (SELECT op, 1 AS place, type_ FROM parameters UNION ALL SELECT op, 2, default_value FROM parameters) p
    LEFT JOIN classifiers c ON p.type_ = CAST(c.class AS VARCHAR) WHERE type_ <> '' AND type_ NOT IN {_PRIM}) WHERE problem IS NOT NULL""",
)
def bad_template_types(v):
    used = v("parameters").selectExpr("op", "stack(2, 1, type_, 2, default_value) as (place, type_)")
    return op.bad_parameter_types(used, v("classifiers"))


_REDEFINING = "CASE WHEN op % 9 = 0 THEN 'op' || CAST(op % 4 AS STRING) END AS redefines"


@query(
    "redefines_unknown", "generalizations attributes operations",
    f"""WITH RECURSIVE {_CLOSURE}, f AS (SELECT 'attribute' AS element, class, seq, name, redefines FROM attributes UNION ALL SELECT 'operation', class, op, name, {_REDEFINING} FROM operations)
    SELECT element, class, redefines, seq FROM f x WHERE redefines IS NOT NULL AND class IN (SELECT a FROM reach)
    AND NOT EXISTS (SELECT 1 FROM reach r JOIN f y ON r.b = y.class WHERE r.a = x.class AND y.name = x.redefines AND y.element = x.element)""",
)
def redefines_unknown(v):
    return op.redefines_unknown(op.features(v("attributes"), v("operations").selectExpr("*", _REDEFINING)), v("generalizations"))


@query("ancestors", "generalizations", f"WITH RECURSIVE {_CLOSURE} SELECT a AS class, b AS ancestor FROM reach")
def ancestors(v):
    return graph.closure(_edges(v)).select(F.col("a").alias("class"), F.col("b").alias("ancestor"))


@query("inheritance_cycles", "generalizations", f"WITH RECURSIVE {_CLOSURE} SELECT a AS node FROM reach WHERE a = b")
def inheritance_cycles(v):
    return graph.on_cycles(_edges(v))


@query(
    "composition_parts", "association_ends",
    """SELECT participant, count(*) AS compositions FROM association_ends WHERE aggregation <> 'composition' AND assoc_id IN (SELECT assoc_id FROM association_ends WHERE aggregation = 'composition')
    GROUP BY 1 HAVING count(*) > 1""",
)
def composition_parts(v):
    return op.composition_parts(v("association_ends"))


@query(
    "inheritance_conflicts", "generalizations attributes",
    """SELECT specific, name, count(*) AS sources FROM generalizations g JOIN attributes a ON g.general = a.class
    WHERE specific IN (SELECT specific FROM generalizations GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT coalesce(type_, '<null>')) > 1""",
)
def inheritance_conflicts(v):
    return op.inheritance_conflicts(v("generalizations"), v("attributes"))


@query(
    "duplicate_signatures", "operations parameters",
    """WITH p AS (SELECT op, string_agg(coalesce(type_, 'null'), ',' ORDER BY pos, coalesce(type_, 'null')) AS types FROM parameters WHERE direction <> 'return' GROUP BY 1)
    SELECT class, name, coalesce(types, '') AS types, count(*) AS n FROM operations o LEFT JOIN p ON o.op = p.op GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def duplicate_signatures(v):
    return op.duplicate_signatures(v("operations"), v("parameters"))


@query(
    "association_shape", "association_ends",
    """WITH k AS (SELECT assoc_id, count(*) AS n, count(*) FILTER (aggregation = 'composition') AS c, count(*) FILTER (aggregation <> 'none') AS a FROM association_ends GROUP BY 1)
    SELECT assoc_id, 'fewer than two ends' AS rule FROM k WHERE n < 2 UNION ALL SELECT assoc_id, 'several compositions' FROM k WHERE c > 1 UNION ALL SELECT assoc_id, 'several aggregations' FROM k WHERE a > 1
    UNION ALL SELECT assoc_id, 'aggregated but not binary' FROM k WHERE a > 0 AND n <> 2""",
)
def association_shape(v):
    return op.association_shape(v("association_ends"))


_SUBSETS = "CASE WHEN participant % 4 = 0 THEN 'role' || CAST(participant % 5 AS STRING) END AS role, CASE WHEN participant % 3 = 0 THEN 'role' || CAST(assoc_id % 5 AS STRING) END AS subsets"


@query(
    "subset_ends", "association_ends",
    f"""WITH e AS (SELECT *, {_SUBSETS} FROM association_ends) SELECT assoc_id, end_no, subsets FROM e WHERE subsets IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM e f WHERE f.assoc_id = e.assoc_id AND (f.role = e.subsets OR CAST(f.participant AS VARCHAR) = e.subsets))""",
)
def subset_ends(v):
    return op.subset_ends(v("association_ends").selectExpr("*", *_SUBSETS.split(", CASE")[:1], "CASE" + _SUBSETS.split(", CASE")[1]))


@query(
    "model_stats", f"{_REL} association_ends classifiers",
    f"""WITH {_ENDS}, k AS (SELECT class % 50 AS model, 'class' AS k FROM classifiers UNION ALL SELECT assoc_id % 50, 'association' FROM (SELECT DISTINCT assoc_id FROM association_ends)
    UNION ALL SELECT source % 50, relation FROM ends), n AS (SELECT model, count(*) FILTER (k = 'class') AS n_class, count(*) FILTER (k = 'association') AS n_association,
    count(*) FILTER (k = 'generalization') AS n_generalization, count(*) FILTER (k = 'dependency') AS n_dependency, count(*) FILTER (k = 'realization') AS n_realization FROM k GROUP BY 1)
    SELECT *, n_association + n_generalization + n_dependency + n_realization AS n_relations FROM n""",
)
def model_stats(v):
    def of(df, key):
        return df.withColumn("model", F.col(key) % 50)

    return op.model_stats(of(v("classifiers"), "class"), of(v("association_ends"), "assoc_id"), of(_ends(v), "source"))


def _local(c: str, n: int = 100) -> str:
    return f"'c' || CAST({c} % {n} AS STRING)"


def _type(c: str) -> str:
    return f"CASE WHEN substr({c}, 1, 1) BETWEEN '0' AND '9' THEN 'c' || {c} ELSE {c} END"


# A diagram is a hundred classes with what belongs to them, and names are local to it.
_OF_CLASS, _OF_OP = "CAST(floor({} / 100) AS BIGINT) AS diagram", "CAST(floor({} / 750) AS BIGINT) AS diagram"
_DIAGRAMS = {
    "classifiers": f"SELECT {_OF_CLASS.format('class')}, {_local('class')} AS class, kind, stereotype FROM classifiers",
    "generalizations": f"SELECT {_OF_CLASS.format('specific')}, {_local('specific')} AS specific, {_local('general')} AS general FROM generalizations WHERE specific % 7 > 0",
    "generalization_sets": f"SELECT {_OF_CLASS.format('specific')}, {_local('specific')} AS specific, {_local('general')} AS general FROM generalizations WHERE specific % 7 = 0",
    "dependencies": f"SELECT {_OF_CLASS.format('client')}, {_local('client')} AS client, {_local('supplier', 120)} AS supplier FROM dependencies",
    "realizations": f"SELECT {_OF_CLASS.format('implementer')}, {_local('implementer')} AS implementer, {_local('interface')} AS interface FROM realizations",
    "association_ends": f"SELECT {_OF_OP.format('assoc_id')}, assoc_id, end_no, {_local('participant', 101)} AS participant, aggregation, multiplicity, {_SUBSETS} FROM association_ends",
    "attributes": f"SELECT {_OF_CLASS.format('class')}, {_local('class')} AS class, seq, name, {_type('type_')} AS type_, CASE WHEN seq % 6 = 0 THEN 'n/a' ELSE initial_value END AS initial_value, CASE WHEN seq % 2 = 0 THEN 'classifier' ELSE 'instance' END AS scope, redefines FROM attributes",
    "operations": f"SELECT {_OF_OP.format('op')}, {_local('class')} AS class, op, name, {_type('return_type')} AS return_type, is_abstract, is_query, scope, {_REDEFINING} FROM operations",
    "parameters": f"SELECT {_OF_OP.format('op')}, op, pos, {_type('type_')} AS type_, direction, default_value FROM parameters",
    "template_parameters": f"SELECT {_OF_OP.format('op')}, {_local('op')} AS class, pos, {_type('type_')} AS type_, {_type('default_value')} AS default_value FROM parameters WHERE pos = 2",
}
_BASES = {**{n: n for n in _DIAGRAMS}, "generalization_sets": "generalizations", "template_parameters": "parameters"}
_PROBLEM = f"""FROM (%s) p LEFT JOIN d_classifiers c ON p.diagram = c.diagram AND type_ = c.class WHERE type_ <> '' AND type_ NOT IN {_PRIM} AND (c.class IS NULL OR kind NOT IN ('Class', 'Template'))"""
_VIOLATIONS = f"""{", ".join(f"d_{n} AS ({text})" for n, text in _DIAGRAMS.items())}, inh AS (FROM d_generalizations UNION ALL FROM d_generalization_sets),
  rel AS (SELECT diagram, 'generalization' AS relation, specific AS source, general AS target FROM inh UNION ALL SELECT diagram, 'dependency', client, supplier FROM d_dependencies UNION ALL SELECT diagram, 'realization', implementer, interface FROM d_realizations),
  reach AS (SELECT diagram, specific AS a, general AS b FROM inh UNION SELECT r.diagram, r.a, g.general FROM reach r JOIN inh g ON r.diagram = g.diagram AND r.b = g.specific),
  f AS (SELECT diagram, 'attribute' AS element, class, seq, name, redefines FROM d_attributes UNION ALL SELECT diagram, 'operation', class, op, name, redefines FROM d_operations),
  sig AS (SELECT diagram, op, string_agg(coalesce(type_, 'null'), ',' ORDER BY pos, coalesce(type_, 'null')) AS types FROM d_parameters WHERE direction <> 'return' GROUP BY 1, 2),
  shape AS (SELECT diagram, assoc_id, count(*) AS n, count(*) FILTER (aggregation = 'composition') AS c, count(*) FILTER (aggregation <> 'none') AS a FROM d_association_ends GROUP BY 1, 2),
  violations AS (SELECT diagram, 0 AS rule_order, 'multiplicity' AS rule, CAST(assoc_id AS VARCHAR) AS subject, end_no AS place, multiplicity AS detail FROM d_association_ends WHERE multiplicity = '5..3'
  UNION ALL SELECT diagram, 0, 'value', class, seq, 'n/a' FROM d_attributes WHERE initial_value = 'n/a' AND type_ IN ('int', 'double')
  UNION ALL SELECT diagram, 0, 'self', source, 0, relation FROM rel WHERE source = target
  UNION ALL SELECT o.diagram, 0, 'stereotype', o.class, op, stereotype FROM d_operations o JOIN d_classifiers c ON o.diagram = c.diagram AND o.class = c.class
    WHERE stereotype = 'interface' AND NOT is_abstract OR stereotype = 'utility' AND scope <> 'classifier' OR stereotype IN ('dataType', 'enumeration') AND NOT (is_query AND scope = 'classifier')
  UNION ALL SELECT a.diagram, 0, 'stereotype', a.class, a.seq, stereotype FROM d_attributes a JOIN d_classifiers c ON a.diagram = c.diagram AND a.class = c.class WHERE stereotype = 'utility' AND scope <> 'classifier'
  UNION ALL SELECT diagram, 0, 'signature', class, 0, name FROM (SELECT o.diagram, class, name, coalesce(types, '') FROM d_operations o LEFT JOIN sig s ON o.diagram = s.diagram AND o.op = s.op GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
  UNION ALL SELECT diagram, 0, 'association', CAST(assoc_id AS VARCHAR), 0, CASE WHEN n < 2 THEN 'fewer than two ends' WHEN a > 0 AND n <> 2 THEN 'aggregated but not binary' WHEN c > 1 THEN 'several compositions' ELSE 'several aggregations' END
    FROM shape WHERE n < 2 OR c > 1 OR a > 1 OR (a > 0 AND n <> 2)
  UNION ALL SELECT diagram, 0, 'subset', CAST(assoc_id AS VARCHAR), end_no, subsets FROM d_association_ends e WHERE subsets IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_association_ends f WHERE f.assoc_id = e.assoc_id AND (f.role = e.subsets OR f.participant = e.subsets))
  UNION ALL SELECT diagram, 1, 'cycle', a, 0, 'inheritance cycle' FROM reach WHERE a = b
  UNION ALL SELECT diagram, 2, 'composition', participant, 0, count(*) || ' compositions' FROM d_association_ends WHERE aggregation <> 'composition' AND assoc_id IN (SELECT assoc_id FROM d_association_ends WHERE aggregation = 'composition') GROUP BY diagram, participant HAVING count(*) > 1
  UNION ALL SELECT g.diagram, 3, 'conflict', specific, 0, name FROM d_generalizations g JOIN d_attributes a ON g.diagram = a.diagram AND g.general = a.class
    WHERE (g.diagram, specific) IN (SELECT (diagram, specific) FROM d_generalizations GROUP BY diagram, specific HAVING count(*) > 1) GROUP BY g.diagram, specific, name HAVING count(DISTINCT coalesce(type_, '<null>')) > 1
  UNION ALL SELECT diagram, 4, 'redefines', class, seq, redefines FROM f x WHERE redefines IS NOT NULL AND EXISTS (SELECT 1 FROM inh i WHERE i.diagram = x.diagram AND i.specific = x.class)
    AND NOT EXISTS (SELECT 1 FROM reach r JOIN f y ON r.diagram = y.diagram AND r.b = y.class WHERE r.diagram = x.diagram AND r.a = x.class AND y.name = x.redefines AND y.element = x.element)
  UNION ALL SELECT diagram, 5, 'attribute type', class, seq, type_ FROM d_attributes a WHERE type_ <> '' AND type_ NOT IN {_PRIM} AND NOT EXISTS (SELECT 1 FROM d_classifiers c WHERE c.diagram = a.diagram AND c.class = a.type_)
  UNION ALL SELECT p.diagram, 6, 'parameter type', CAST(op AS VARCHAR), place, CASE WHEN c.class IS NULL THEN 'unknown ' ELSE 'not a class ' END || type_ {_PROBLEM % "SELECT diagram, op, CAST(pos AS INT) AS place, type_ FROM d_parameters UNION ALL SELECT diagram, op, 0, return_type FROM d_operations"}
  UNION ALL SELECT p.diagram, 7, 'template type', p.class, place, CASE WHEN c.class IS NULL THEN 'unknown ' ELSE 'not a class ' END || type_ {_PROBLEM % "SELECT diagram, class, pos * 2 AS place, type_ FROM d_template_parameters UNION ALL SELECT diagram, class, pos * 2 + 1, default_value FROM d_template_parameters"}
  UNION ALL SELECT diagram, 8, 'end', class, 0, relation FROM (SELECT diagram, relation, unnest([source, target]) AS class FROM rel UNION ALL SELECT diagram, 'association', participant FROM d_association_ends) e
    WHERE NOT EXISTS (SELECT 1 FROM d_classifiers c WHERE c.diagram = e.diagram AND c.class = e.class))"""


def _diagrams(v):
    tables = {n: v.spark.sql(re.sub(r"FROM \w+", "FROM {t}", text), t=v(_BASES[n])) for n, text in _DIAGRAMS.items()}
    grouped = tables["generalization_sets"].groupBy("diagram", "general").agg(F.collect_list(F.struct("specific", "general")).alias("generalizations"))
    return {**tables, "generalization_sets": grouped}


@query(
    "first_error", "classifiers generalizations dependencies realizations association_ends attributes operations parameters",
    f"""WITH RECURSIVE {_VIOLATIONS} SELECT CAST(diagram AS VARCHAR) AS diagram, rule_order, rule, subject, detail, rule_order = min(rule_order) OVER (PARTITION BY diagram) AS raised
    FROM (SELECT *, row_number() OVER (PARTITION BY diagram, rule_order ORDER BY place, rule, subject, detail) AS r FROM violations) WHERE r = 1""",
)
def first_error(v):
    return op.first_by_step(op.diagram_violations(_diagrams(v)))


@query(
    "edge_list", f"{_REL} association_ends classifiers",
    f"""WITH {_ENDS}, two AS (SELECT assoc_id, first(participant ORDER BY end_no, participant) AS source, last(participant ORDER BY end_no, participant) AS target FROM association_ends GROUP BY 1 HAVING count(*) = 2)
    SELECT source, target, kind FROM (SELECT source, target, 'association' AS kind FROM two UNION ALL SELECT source, target, relation FROM ends)
    WHERE source IN (SELECT class FROM classifiers) AND target IN (SELECT class FROM classifiers)""",
)
def edge_list(v):
    return op.edge_list(v("association_ends"), _ends(v), v("classifiers"))


@query("inheritance_edges", "generalizations", "SELECT specific, general FROM generalizations")
def inheritance_edges(v):
    """Two sevenths of the generalizations are members of sets, one for each general class and label."""
    alone, members = v("generalizations").where("specific % 7 > 1"), v("generalizations").where("specific % 7 <= 1")
    sets = members.groupBy("general", F.expr("specific % 7 = 0 as complete")).agg(F.collect_list(F.struct("specific", "general")).alias("generalizations"))
    return op.inheritance_edges(alone, sets)


_PTEXT = "(CASE WHEN direction <> 'in' THEN direction || ' ' ELSE '' END || name || CASE WHEN type_ IS NOT NULL THEN ' : ' || type_ ELSE '' END || CASE WHEN default_value IS NOT NULL THEN '  = ' || default_value ELSE '' END)"


def _parameter_text(v):
    return v("parameters").select("op", "pos", fn.parameter_text(F.col("direction"), F.col("name"), F.col("type_"), F.col("default_value")).alias("text"))


@query("parameter_text", "parameters", f"SELECT op, pos, {_PTEXT} AS text FROM parameters")
def parameter_text(v):
    return _parameter_text(v)


_ATEXT = "('+ ' || name || CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN ' [1]' ELSE ' [1..*]' END || CASE WHEN type_ IS NOT NULL THEN ' : ' || type_ ELSE '' END || ' = ' || initial_value || CASE WHEN seq % 2 = 0 THEN ' {readOnly}' ELSE '' END)"


def _attribute_text(v):
    a = v("attributes").withColumn("m", fn.multiplicity(F.expr("case seq % 3 when 0 then '*' when 1 then '1' else '1..*' end")))
    change = F.expr("case when seq % 2 = 0 then 'readOnly' end")
    return a.select("class", "seq", fn.attribute_text(F.lit("+"), F.col("name"), F.col("m"), F.col("type_"), F.col("initial_value"), change).alias("text"))


@query("attribute_text", "attributes", f"SELECT class, seq, {_ATEXT} AS text FROM attributes")
def attribute_text(v):
    return _attribute_text(v)


_OTEXT = f"""o AS (SELECT class, o.op, visibility || ' ' || o.name || '(' || coalesce(ps, '') || ')' || CASE WHEN return_type IS NOT NULL THEN ' : ' || return_type ELSE '' END
  || CASE WHEN is_query OR is_leaf OR concurrency <> 'sequential' THEN ' {{' || concat_ws(', ', CASE WHEN is_query THEN 'isQuery' END, CASE WHEN is_leaf THEN 'leaf' END, nullif(concurrency, 'sequential')) || '}}' ELSE '' END AS text
  FROM operations o LEFT JOIN (SELECT op, string_agg({_PTEXT}, ', ' ORDER BY pos, {_PTEXT}) AS ps FROM parameters GROUP BY 1) p ON o.op = p.op)"""


def _operation_text(v):
    params = _parameter_text(v).groupBy("op").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ps"))
    o = v("operations").join(params, "op", "left").withColumn("ps", F.coalesce(F.transform("ps", lambda x: x.text), F.array().cast("array<string>")))
    return o.select("class", "op", fn.operation_text(*(F.col(c) for c in ("visibility", "name", "ps", "return_type", "is_query", "is_leaf", "concurrency"))).alias("text"))


@query("operation_text", "operations parameters", f"WITH {_OTEXT} SELECT * FROM o")
def operation_text(v):
    return _operation_text(v)


@query(
    "class_text", "classifiers attributes operations parameters",
    f"""WITH {_OTEXT}, oo AS (SELECT class, string_agg(text, chr(10) ORDER BY op, text) AS t FROM o GROUP BY 1), aa AS (SELECT class, string_agg({_ATEXT}, chr(10) ORDER BY seq, {_ATEXT}) AS t FROM attributes GROUP BY 1)
    SELECT c.class, CASE WHEN stereotype IS NOT NULL THEN '«' || stereotype || '» ' ELSE '' END || CAST(c.class AS VARCHAR) || CASE WHEN is_abstract THEN ' {{abstract}}' ELSE '' END || coalesce(' ' || multiplicity, '')
    || chr(10) || '---' || chr(10) || coalesce(aa.t || chr(10), '') || '---' || coalesce(chr(10) || oo.t, '') AS text FROM classifiers c LEFT JOIN aa ON c.class = aa.class LEFT JOIN oo ON c.class = oo.class""".replace("{{", "{").replace("}}", "}"),
)
def class_text(v):
    def lines(df, order):
        return df.groupBy("class").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("l")).select("class", F.transform("l", lambda x: x.text).alias("l"))

    none = F.array().cast("array<string>")
    c = v("classifiers").join(lines(_attribute_text(v), "seq").withColumnRenamed("l", "a"), "class", "left").join(lines(_operation_text(v), "op").withColumnRenamed("l", "o"), "class", "left")
    mult = F.when(F.col("multiplicity").isNotNull(), fn.multiplicity_text(fn.multiplicity(F.col("multiplicity"))))
    head = fn.class_header(F.col("stereotype"), F.col("class").cast("string"), F.col("is_abstract"), mult)
    return c.select("class", F.array_join(F.concat(F.array(head, F.lit("---")), F.coalesce("a", none), F.array(F.lit("---")), F.coalesce("o", none)), "\n").alias("text"))


@query(
    "generalization_set_label", "generalizations",
    "SELECT specific, general, '{' || CASE WHEN specific % 2 = 0 THEN 'complete' ELSE 'incomplete' END || ', ' || CASE WHEN general % 2 = 0 THEN 'disjoint' ELSE 'overlapping' END || '}' AS label FROM generalizations",
)
def generalization_set_label(v):
    return v("generalizations").withColumn("label", fn.generalization_set_label(F.col("specific") % 2 == 0, F.col("general") % 2 == 0))
