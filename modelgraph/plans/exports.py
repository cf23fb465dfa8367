"""Queries that write models out."""

from pyspark.sql import functions as F

from modelgraph.functions import render
from modelgraph.operators import definitions, exports
from modelgraph.plans.definitions import _ALL, _FOUND, _META, placed_members
from modelgraph.plans.views import query

_BOX = "'rectangle \"' || label || CASE WHEN description = '' THEN '' ELSE '\\n(' || description || ')' END || '\" as ' || name || ' ' || coalesce(color, '#white')"
_NOTE = "CASE WHEN note IS NULL THEN '' ELSE 'note right of ' || name || chr(10) || note || chr(10) || '    end note' END"
def _opt(before, c, after=""):
    return f"CASE WHEN coalesce({c}, '') = '' THEN '' ELSE '{before}' || {c} || '{after}' END"


_COLORED = "'[' || coalesce(color, '#black') || ']'"
_ARROW = (
    "CASE relationship "
    + " ".join(
        f"WHEN '{k}' THEN CASE coalesce(direction, 'forward') WHEN 'forward' THEN '{(a + c)[:2]}' || {_COLORED} || '{(a + c)[2:]}' WHEN 'backward' THEN '{(b + a)[:2]}' || {_COLORED} || '{(b + a)[2:]}' ELSE '{(b + a + c)[:3]}' || {_COLORED} || '{(b + a + c)[3:]}' END"
        for k, (a, b, c) in render.ARROWS.items()
    )
    + " END"
)
_EDGE = f"parent || ' ' || {_opt(chr(34), 'leftChar', chr(34))} || ' ' || {_ARROW} || ' ' || {_opt(chr(34), 'rightChar', chr(34))} || ' ' || child || ' ' || {_opt(': ' + chr(34), 'title', chr(34))}"
_KNOWN = "relationship <> 'Inherits'"


@query("puml_term_lines", "terms", f"SELECT ontology_id, 1 AS section, seq, {_BOX} || chr(10) || {_NOTE} AS line FROM terms")
def puml_term_lines(v):
    return exports.term_lines(v("terms"))


@query("puml_edge_lines", "relationships", f"SELECT ontology_id, 4 AS section, seq, {_EDGE} || chr(10) AS line FROM relationships WHERE {_KNOWN}")
def puml_edge_lines(v):
    return exports.edge_lines(v("relationships"))


_ARGS = "args AS (SELECT function AS name, string_agg(term || CASE WHEN label = '' THEN '' ELSE ': ' || label END, ', ' ORDER BY pos, term || CASE WHEN label = '' THEN '' ELSE ': ' || label END) AS inputs FROM function_args GROUP BY 1)"
_FTYPE = "coalesce(f.type, 'directAssociation')"


_OUT = f"output_term || {_opt(': ', 'output_label')}"
_FBOX = f"'rectangle \"' || f.label || '\\n(' || coalesce(inputs, '') || ' -> ' || {_OUT} || ')\" as ' || f.name || ' ' || coalesce(color, '#white')"


@query("puml_function_boxes", "functions function_args", f"WITH {_ARGS} SELECT ontology_id, 2 AS section, seq, {_FBOX} AS line FROM functions f LEFT JOIN args ON f.name = args.name")
def puml_function_boxes(v):
    return exports.function_boxes(v("functions"), v("function_args"))


_PLACED = "placed AS (SELECT l.ontology_id, figure, l.seq, member, CASE WHEN f.seq < l.seq THEN kind END AS kind, kind_order FROM figure_lines l LEFT JOIN (SELECT * FROM found JOIN (VALUES ('term', 0), ('function', 1), ('relationship', 2)) k(kind, kind_order) USING (kind)) f ON l.ontology_id = f.ontology_id AND l.member = f.name)"
_FARROW = "'--[' || coalesce(colorArrow, '#black') || ']' || CASE f.type WHEN 'inheritance' THEN '-|>' WHEN 'composition' THEN '-*' ELSE '->' END"


_FLINES = f"""SELECT a.ontology_id, f.name, f.seq, a.first_pos AS "at", term, term || ' ' || CASE WHEN n > 1 THEN '"' || n || '"' ELSE '' END || ' ' || {_FARROW} || '  ' || f.name || ' ' || {_opt(': ' + chr(34), 'inputTitle', chr(34))} AS line
    FROM (SELECT ontology_id, function, term, count(*) AS n, min(pos) AS first_pos FROM function_args GROUP BY 1, 2, 3) a JOIN functions f ON a.function = f.name
    WHERE EXISTS (SELECT 1 FROM terms t WHERE t.ontology_id = a.ontology_id AND t.name = a.term)
    UNION ALL SELECT ontology_id, name, seq, 1000000, output_term, name || '  ' || {_FARROW} || '  ' || output_term || ' ' || {_opt(': ' + chr(34), 'outputTitle', chr(34))} FROM functions f"""


@query("puml_function_lines", "functions function_args terms", _FLINES)
def puml_function_lines(v):
    return exports.function_edges(v("functions"), definitions.argument_bags(v("function_args")), v("terms"))


@query(
    "class_style_lines", "terms relationships functions function_args",
    f"""WITH {_ARGS} SELECT ontology_id, 3 AS section, seq, parent || ' ' || CASE relationship WHEN 'dependence' THEN '..>' WHEN 'association' THEN '--' WHEN 'directAssociation' THEN '-->' WHEN 'inheritance' THEN '--|>' WHEN 'implementation' THEN '..|>'
    WHEN 'aggregation' THEN '--o' WHEN 'composition' THEN '--*' ELSE '-->' END || ' ' || child AS line FROM relationships
    UNION ALL SELECT ontology_id, 1, seq, 'class ' || name || ' {{' || chr(10) || '  ' || description || chr(10) || '}}' FROM terms
    UNION ALL SELECT ontology_id, 2, seq, 'class ' || f.name || ' <<Function>>' || {_opt(" ", "color")} || ' {{' || chr(10) || '  +' || f.name || '(' || coalesce(inputs, '') || ') : (' || {_OUT} || ')' || chr(10) || '  ' || label || chr(10) || '}}' FROM functions f LEFT JOIN args ON f.name = args.name""",
)
def class_style_lines(v):
    return exports.class_lines(v("terms"), v("functions"), v("function_args"), v("relationships"))


_HEAD = "chr(10)".join([""]) + "'" + "' || chr(10) || '".join(exports.HEADER) + "' || chr(10) || 'package \"'"


@query(
    "puml_export", "terms functions function_args relationships meta_statements",
    f"""WITH {_ARGS}, t AS (SELECT ontology_id, max_by(value, seq) FILTER (tag = 'title') AS title FROM meta_statements GROUP BY 1),
    a AS (SELECT ontology_id, string_agg({_BOX} || chr(10) || {_NOTE}, chr(10) ORDER BY seq) AS x FROM terms GROUP BY 1),
    b AS (SELECT ontology_id, string_agg({_EDGE} || chr(10), chr(10) ORDER BY seq, {_EDGE}) AS x FROM relationships WHERE {_KNOWN} GROUP BY 1)
    ,fb AS (SELECT ontology_id, string_agg({_FBOX}, chr(10) ORDER BY seq) AS x FROM functions f LEFT JOIN args ON f.name = args.name GROUP BY 1),
    fl AS (SELECT ontology_id, string_agg(line || chr(10), chr(10) ORDER BY seq, "at", line) AS x FROM ({_FLINES}) GROUP BY 1)
    SELECT t.ontology_id, {_HEAD} || coalesce(title, 'Онтология') || '" {{' || chr(10) || coalesce(a.x || chr(10), '') || coalesce(fb.x || chr(10), '') || coalesce(fl.x || chr(10), '') || coalesce(b.x || chr(10), '') || '}}' || chr(10) || '@enduml' AS puml
    FROM t LEFT JOIN a ON a.ontology_id = t.ontology_id LEFT JOIN b ON b.ontology_id = t.ontology_id LEFT JOIN fb ON fb.ontology_id = t.ontology_id LEFT JOIN fl ON fl.ontology_id = t.ontology_id""".replace("{{", "{").replace("}}", "}"),
)
def puml_export(v):
    return exports.puml(*_puml_tables(v))


def _puml_tables(v):
    titles = v("meta_statements").groupBy("ontology_id").agg(F.max_by("value", F.when(F.col("tag") == "title", F.col("seq"))).alias("title"))
    return v("terms"), v("functions"), v("function_args"), definitions.argument_bags(v("function_args")), v("relationships"), titles


def puml_pieces(v):
    return exports.pieces(exports.puml_lines(*_puml_tables(v)), "ontology_id", "\n")


DSL_TERM_SQL = "name || ': ''' || label || ''', ''' || description || '''' || CASE WHEN color IS NULL AND note IS NULL THEN '' ELSE ', { ' || concat_ws(', ', 'color: ''' || color || ''' ', 'note: ''' || note || ''' ') || '}' END"
def _dsl_attributes(kind):
    """The attribute block in SQL."""
    keys, q = definitions.ATTRIBUTE_KEYS[kind], "''"
    return f"CASE WHEN coalesce({', '.join(keys)}) IS NULL THEN '' ELSE ', {{ ' || concat_ws(', ', {', '.join(f'{chr(39)}{k}: {q}{chr(39)} || {k} || {chr(39)}{q} {chr(39)}' for k in keys)}) || '}}' END"


DSL_RELATIONSHIP_SQL = f"parent || ' ' || relationship || ' ' || child || {_dsl_attributes('relationship')}"
_DARGS = "dargs AS (SELECT function AS name, string_agg(term || ': ''' || label || '''', ', ' ORDER BY pos, term || ': ''' || label || '''') AS inputs FROM function_args GROUP BY 1)"
_DFUN = "f.name || ': ''' || f.label || ''' (' || coalesce(inputs, '') || ') -> ' || output_term || ': ''' || output_label || '''' || " + _dsl_attributes("function")


_FIGLINE = "SELECT ontology_id, min(seq) AS seq, 'figure ' || figure || ':' || chr(10) || coalesce(string_agg(member || chr(10), '' ORDER BY kind_order, seq) FILTER (kind IS NOT NULL), '') AS line FROM placed GROUP BY ontology_id, figure"


@query(
    "dsl_lines", "terms functions function_args relationships",
    f"WITH {_DARGS} SELECT ontology_id, 1 AS section, seq, {DSL_TERM_SQL} AS line FROM terms UNION ALL SELECT ontology_id, 3, seq, {_DFUN} FROM functions f LEFT JOIN dargs ON dargs.name = f.name UNION ALL SELECT ontology_id, 5, seq, {DSL_RELATIONSHIP_SQL} FROM relationships",
)
def dsl_lines(v):
    lines = exports.dsl_term_lines(v("terms")).unionByName(exports.dsl_function_lines(v("functions"), v("function_args")))
    return lines.unionByName(exports.dsl_relationship_lines(v("relationships")))


_MLINE = " || ".join(f"coalesce('{t}: ''' || {t} || '''' || chr(10), '')" for t in definitions.META_TAGS)
_IDS = "ids AS (SELECT ontology_id FROM m UNION SELECT ontology_id FROM terms UNION SELECT ontology_id FROM functions UNION SELECT ontology_id FROM relationships UNION SELECT ontology_id FROM figure_lines)"


@query(
    "dsl_export", "terms functions function_args relationships meta_statements figure_lines",
    f"""WITH {_ALL}, {_FOUND}, {_PLACED}, {_DARGS}, m AS ({_META}), {_IDS}, mt AS (SELECT ontology_id, {_MLINE} AS x FROM m),
    a AS (SELECT ontology_id, 'types:' || chr(10) || string_agg({DSL_TERM_SQL}, chr(10) ORDER BY seq) || chr(10) AS x FROM terms GROUP BY 1),
    b AS (SELECT ontology_id, 'functions:' || chr(10) || string_agg({_DFUN}, chr(10) ORDER BY seq) || chr(10) AS x FROM functions f LEFT JOIN dargs ON dargs.name = f.name GROUP BY 1),
    c AS (SELECT ontology_id, 'hierarchy:' || chr(10) || string_agg({DSL_RELATIONSHIP_SQL}, chr(10) ORDER BY seq, {DSL_RELATIONSHIP_SQL}) || chr(10) AS x FROM relationships GROUP BY 1),
    g AS (SELECT ontology_id, string_agg(line, chr(10) ORDER BY seq) AS x FROM ({_FIGLINE}) GROUP BY 1)
    SELECT ids.ontology_id, concat_ws(chr(10), coalesce(mt.x, ''), a.x, b.x, c.x, g.x) AS dsl FROM ids LEFT JOIN mt ON mt.ontology_id = ids.ontology_id LEFT JOIN a ON a.ontology_id = ids.ontology_id
    LEFT JOIN b ON b.ontology_id = ids.ontology_id LEFT JOIN c ON c.ontology_id = ids.ontology_id LEFT JOIN g ON g.ontology_id = ids.ontology_id""",
)
def dsl_export(v):
    meta = definitions.meta_last_wins(v("meta_statements"))
    return exports.dsl(meta, v("terms"), v("functions"), v("function_args"), v("relationships"), placed_members(v))


_JT = """'{"name":' || to_json(name) || ',"label":' || to_json(label) || ',"description":' || to_json(description) || ',"attributes":{' || concat_ws(',', '"color":' || to_json(color), '"note":' || to_json(note)) || '}}'"""
def _json_attributes(kind):
    return "concat_ws(',', " + ", ".join(f"'\"{k}\":' || to_json({k})" for k in definitions.ATTRIBUTE_KEYS[kind]) + ")"


_JR = """'{"name":' || coalesce(to_json(name), 'null') || ',"parent":' || to_json(parent) || ',"relationship":' || to_json(relationship) || ',"children":[' || to_json(child) || '],"attributes":{' || """ + _json_attributes("relationship") + " || '}}'"
_JARG = """'{"name":' || to_json(term) || ',"label":' || to_json(label) || '}'"""
_JF = """'{"name":' || to_json(f.name) || ',"label":' || to_json(f.label) || ',"input_types":[' || coalesce(jargs.x, '') || '],"output_type":{"name":' || to_json(output_term) || ',"label":' || to_json(output_label) || '},"attributes":{' || """ + _json_attributes("function") + " || '}}'"
_JM = "'{' || " + " || ',' || ".join(f"""'"{t}":' || coalesce(CAST(to_json({t}) AS VARCHAR), 'null')""" for t in definitions.META_TAGS) + " || '}'"
_JOF = "coalesce(string_agg(CAST(to_json(member) AS VARCHAR), ',' ORDER BY seq) FILTER (kind = '{}'), '')"
_JG = "'{\"name\":' || to_json(figure) || ',\"terms\":[' || " + _JOF.format("term") + " || '],\"functions\":[' || " + _JOF.format("function") + " || '],\"hierarchy\":[' || " + _JOF.format("relationship") + " || ']}'"
_JROWS = f"""jargs AS (SELECT function AS name, string_agg(CAST({_JARG} AS VARCHAR), ',' ORDER BY pos, CAST({_JARG} AS VARCHAR)) AS x FROM function_args GROUP BY 1),
    jrows AS (SELECT ontology_id, 'meta' AS kind, 0 AS seq, CAST({_JM} AS VARCHAR) AS json FROM ({_META}) UNION ALL SELECT ontology_id, 'terms', seq, CAST({_JT} AS VARCHAR) FROM terms
    UNION ALL SELECT ontology_id, 'functions', seq, CAST({_JF} AS VARCHAR) FROM functions f LEFT JOIN jargs ON jargs.name = f.name UNION ALL SELECT ontology_id, 'hierarchy', seq, CAST({_JR} AS VARCHAR) FROM relationships
    UNION ALL SELECT ontology_id, 'figures', min(seq), CAST({_JG} AS VARCHAR) FROM placed GROUP BY ontology_id, figure)"""
_JVIEWS = "terms functions function_args relationships meta_statements figure_lines"


@query("json_rows", _JVIEWS, f"WITH {_ALL}, {_FOUND}, {_PLACED}, {_JROWS} SELECT * FROM jrows")
def json_rows(v):
    meta = definitions.meta_last_wins(v("meta_statements"))
    return exports.json_rows(meta, v("terms"), v("functions"), v("function_args"), v("relationships"), placed_members(v))


_JOBJECT = " || '],".join(f"""\"{k}\":[' || coalesce(string_agg(json, ',' ORDER BY seq, json) FILTER (kind = '{k}'), '')""" for k in ("terms", "functions", "hierarchy", "figures"))
_NOMETA = "{" + ",".join(f'"{t}":null' for t in definitions.META_TAGS) + "}"


@query(
    "json_export", _JVIEWS,
    f"""WITH {_ALL}, {_FOUND}, {_PLACED}, {_JROWS} SELECT ontology_id, '{{"meta":' || coalesce(max(json) FILTER (kind = 'meta'), '{_NOMETA}') || ',{_JOBJECT} || ']}}' AS json FROM jrows GROUP BY 1""",
)
def json_export(v):
    return exports.json_documents(json_rows(v))
