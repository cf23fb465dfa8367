"""Queries over definitions of concept models."""

from pyspark.sql import functions as F

from modelgraph.operators import definitions as op
from modelgraph.plans.views import query

_ALL = """alld AS (SELECT 'term' AS kind, 0 AS kind_order, ontology_id, CAST(seq AS BIGINT) AS seq, name FROM terms UNION ALL SELECT 'function', 1, ontology_id, seq, name FROM functions
  UNION ALL SELECT 'relationship', 2, ontology_id, seq, name FROM relationships)"""
_FOUND = """found AS (SELECT ontology_id, name, kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY ontology_id, name ORDER BY kind_order, seq) AS r FROM alld WHERE name IS NOT NULL) WHERE r = 1)"""
_REFS = """refs AS (SELECT ontology_id, seq, 'input' AS role, term FROM function_args UNION ALL SELECT ontology_id, seq, 'output', output_term FROM functions
  UNION ALL SELECT ontology_id, seq, 'parent', parent FROM relationships UNION ALL SELECT ontology_id, seq, 'child', child FROM relationships)"""


def _all(v):
    return op.all_definitions(v("terms"), v("functions"), v("relationships"))


@query("all_definitions", "terms functions relationships", f"WITH {_ALL} SELECT * FROM alld")
def all_definitions(v):
    return _all(v)


@query("find_definition", "terms functions relationships", f"WITH {_ALL}, {_FOUND} SELECT * FROM found")
def find_definition(v):
    return op.find_definition(_all(v))


_RANK = "SELECT kind, kind_order, ontology_id, seq, name, CAST(row_number() OVER (PARTITION BY ontology_id, name ORDER BY seq, kind_order) AS INT) AS rn FROM alld WHERE name IS NOT NULL"


@query("declaration_rank", "terms functions relationships", f"WITH {_ALL} {_RANK}")
def declaration_rank(v):
    return op.declaration_rank(_all(v))


@query("duplicate_declarations", "terms functions relationships", f"WITH {_ALL} SELECT ontology_id, name, kind, seq, rn FROM ({_RANK}) WHERE rn > 1")
def duplicate_declarations(v):
    return op.duplicate_declarations(_all(v))


@query(
    "undefined_references", "terms functions function_args relationships",
    f"WITH {_REFS}, firsts AS (SELECT ontology_id, name, min(seq) AS declared FROM terms GROUP BY ALL) SELECT r.ontology_id, r.term, r.seq, r.role FROM refs r LEFT JOIN firsts f ON r.ontology_id = f.ontology_id AND r.term = f.name WHERE declared IS NULL OR declared >= r.seq",
)
def undefined_references(v):
    return op.undefined_references(op.references(v("functions"), v("function_args"), v("relationships")), v("terms"))


_EDGES = """SELECT ontology_id, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT ontology_id, count(*) AS n FROM relationships GROUP BY 1 UNION ALL SELECT ontology_id, count(*) FROM functions GROUP BY 1
  UNION ALL SELECT ontology_id, count(DISTINCT function || ' ' || term) FROM function_args GROUP BY 1) GROUP BY 1"""


def _edges(v):
    return op.count_edges(v("relationships"), v("functions"), v("function_args"))


@query("count_edges", "relationships functions function_args", _EDGES)
def count_edges(v):
    return _edges(v)


@query("too_many_edges", "relationships functions function_args", f"SELECT * FROM ({_EDGES}) WHERE edges > 2700")
def too_many_edges(v):
    return op.too_many_edges(_edges(v), 2700)


@query("argument_bags", "function_args", "SELECT ontology_id, function, term, count(*) AS n, min(pos) AS first_pos FROM function_args GROUP BY 1, 2, 3")
def argument_bags(v):
    return op.argument_bags(v("function_args"))


@query("bad_meta_tags", "meta_statements", "SELECT ontology_id, seq, tag FROM meta_statements WHERE tag NOT IN ('version', 'title', 'author', 'description', 'type', 'date')")
def bad_meta_tags(v):
    return op.bad_meta_tags(v("meta_statements"))


@query(
    "bad_attribute_keys", "attribute_rows",
    """SELECT ontology_id, seq, kind, key FROM attribute_rows WHERE NOT (kind = 'term' AND key IN ('color', 'note') OR kind = 'function' AND key IN ('color', 'colorArrow', 'type', 'inputTitle', 'outputTitle')
    OR kind = 'relationship' AND key IN ('color', 'direction', 'title', 'rightChar', 'leftChar'))""",
)
def bad_attribute_keys(v):
    return op.bad_attribute_keys(v("attribute_rows"))


@query(
    "bad_relationship_types", "relationships functions",
    """SELECT * FROM (SELECT ontology_id, seq, relationship AS type FROM relationships UNION ALL SELECT ontology_id, seq, type FROM functions WHERE type IS NOT NULL)
    WHERE type NOT IN ('dependence', 'association', 'directAssociation', 'inheritance', 'implementation', 'aggregation', 'composition')""",
)
def bad_relationship_types(v):
    return op.bad_relationship_types(v("relationships"), v("functions"))


@query("bad_directions", "attribute_rows", "SELECT ontology_id, seq, value FROM attribute_rows WHERE key = 'direction' AND value NOT IN ('forward', 'backward', 'bidirectional')")
def bad_directions(v):
    return op.bad_directions(v("attribute_rows"))


@query(
    "empty_value_warnings", "meta_statements terms functions function_args attribute_rows",
    """SELECT ontology_id, CAST(seq AS BIGINT) AS seq, 'meta value' AS what FROM meta_statements WHERE value = '' UNION ALL SELECT ontology_id, seq, 'term label' FROM terms WHERE label = ''
    UNION ALL SELECT ontology_id, seq, 'term description' FROM terms WHERE description = '' UNION ALL SELECT ontology_id, seq, 'function label' FROM functions WHERE label = ''
    UNION ALL SELECT ontology_id, seq, 'parameter label' FROM function_args WHERE label = '' UNION ALL SELECT ontology_id, seq, 'attribute value' FROM attribute_rows WHERE value = ''""",
)
def empty_value_warnings(v):
    return op.empty_value_warnings(v("meta_statements"), v("terms"), v("functions"), v("function_args"), v("attribute_rows"))


_META = "SELECT ontology_id, " + ", ".join(f"max_by(value, seq) FILTER (tag = '{t}') AS {t}" for t in op.META_TAGS) + " FROM meta_statements WHERE tag IN ('version', 'title', 'author', 'description', 'type', 'date') GROUP BY 1"


@query("meta_last_wins", "meta_statements", _META)
def meta_last_wins(v):
    return op.meta_last_wins(v("meta_statements"))


@query("date_default", "meta_statements", f"SELECT * REPLACE (coalesce(nullif(date, ''), '2024-01-01') AS date) FROM ({_META})")
def date_default(v):
    return op.date_default(op.meta_last_wins(v("meta_statements")), "2024-01-01")


_MEMBERS = "members AS (SELECT l.ontology_id, figure, l.seq, member, CASE WHEN f.seq < l.seq THEN kind END AS kind FROM figure_lines l LEFT JOIN found f ON l.ontology_id = f.ontology_id AND l.member = f.name)"
_PLACED = "placed AS (SELECT l.ontology_id, figure, l.seq, member, kind, f.seq AS declared FROM figure_lines l JOIN found f ON l.ontology_id = f.ontology_id AND l.member = f.name WHERE f.seq < l.seq)"
_FIGURES = """figures AS (SELECT m.ontology_id, figure AS title, kind, declared AS seq, member AS name, label FROM placed m JOIN (SELECT ontology_id, 'term' AS kind, seq, name, label FROM terms
  UNION ALL SELECT ontology_id, 'function', seq, name, label FROM functions UNION ALL SELECT ontology_id, 'relationship', seq, name, parent || ' ' || relationship || ' ' || child FROM relationships) d
  USING (ontology_id, kind) WHERE d.seq = declared AND d.name = member)"""
_FIRST = "firsts AS (SELECT ontology_id, name, min_by(label, seq) AS label FROM terms GROUP BY 1, 2)"
_TITLES = "titles AS (SELECT ontology_id, max_by(value, seq) AS title FROM meta_statements WHERE tag = 'title' GROUP BY 1)"
_EACH = """rel AS (SELECT ontology_id, NULL AS of, seq, name, parent, relationship, child FROM relationships UNION ALL SELECT m.ontology_id, figure, r.seq, r.name, parent, relationship, child FROM placed m JOIN relationships r ON kind = 'relationship' AND r.ontology_id = m.ontology_id AND r.name = member AND r.seq = declared),
  fun AS (SELECT ontology_id, NULL AS of, seq, name, label, output_term FROM functions UNION ALL SELECT m.ontology_id, figure, f.seq, f.name, label, output_term FROM placed m JOIN functions f ON kind = 'function' AND f.ontology_id = m.ontology_id AND f.name = member AND f.seq = declared)"""
_ENDS_TEXT = "parent || ' ' || relationship || ' ' || child"
_PARTS = f"""parts AS (SELECT ontology_id, of, 'rels' AS part, 'relationship' AS kind, seq, name, {_ENDS_TEXT} AS label FROM rel
  UNION ALL SELECT u.ontology_id, of, 'rels', 'term', u.seq, u.name, label FROM (SELECT ontology_id, of, seq, unnest([parent, child]) AS name FROM rel) u JOIN firsts f ON u.ontology_id = f.ontology_id AND u.name = f.name
  UNION ALL SELECT ontology_id, of, 'funcs', 'function', seq, name, label FROM fun
  UNION ALL SELECT u.ontology_id, of, 'funcs', 'term', u.seq, u.name, f.label FROM (SELECT x.ontology_id, of, x.seq, term AS name FROM fun x JOIN function_args a ON a.ontology_id = x.ontology_id AND a.function = x.name UNION ALL SELECT ontology_id, of, seq, output_term FROM fun) u
    JOIN firsts f ON u.ontology_id = f.ontology_id AND u.name = f.name)"""
_PART_TITLE = "coalesce({}, 'None') || CASE part WHEN 'rels' THEN ' | Иерархия' ELSE ' | Алгоритмы' END"


def _titles(v):
    return v("meta_statements").where("tag = 'title'").groupBy("ontology_id").agg(F.max_by("value", "seq").alias("title"))


def placed_members(v):
    return op.placed_members(v("figure_lines"), op.find_definition(_all(v)))


def _members(v):
    return op.figure_members(v("figure_lines"), op.find_definition(_all(v)))


@query("figure_members", "terms functions relationships figure_lines", f"WITH {_ALL}, {_FOUND}, {_MEMBERS} SELECT * FROM members")
def figure_members(v):
    return _members(v)


@query("figure_projection", "terms functions relationships figure_lines", f"WITH {_ALL}, {_FOUND}, {_PLACED}, {_FIGURES} SELECT * FROM figures")
def figure_projection(v):
    return op.figure_projection(placed_members(v), v("terms"), v("functions"), v("relationships"))


_META_TITLED = _META.replace("AS title", "AS old_title")


@query("figure_meta", "meta_statements figure_lines", f"SELECT f.ontology_id, {', '.join(op.META_TAGS).replace('title', 'f.figure AS title')} FROM (SELECT DISTINCT ontology_id, figure FROM figure_lines) f LEFT JOIN ({_META_TITLED}) m ON m.ontology_id = f.ontology_id")
def figure_meta(v):
    return op.figure_meta(op.meta_last_wins(v("meta_statements")), v("figure_lines"))


_VIEW_TABLES = "terms functions function_args relationships figure_lines meta_statements"
_VIEW = f"WITH {_ALL}, {_FOUND}, {_PLACED}, {_FIGURES}, {_FIRST}, {_TITLES}, {_EACH}, {_PARTS}"


@query("hierarchy_only_view", _VIEW_TABLES, f"{_VIEW} SELECT p.ontology_id, {_PART_TITLE.format('title')} AS title, kind, seq, name, label FROM parts p LEFT JOIN titles t ON t.ontology_id = p.ontology_id WHERE part = 'rels' AND of IS NULL")
def hierarchy_only_view(v):
    return op.hierarchy_only(v("relationships"), v("terms"), _titles(v))


@query("functions_only_view", _VIEW_TABLES, f"{_VIEW} SELECT p.ontology_id, {_PART_TITLE.format('title')} AS title, kind, seq, name, label FROM parts p LEFT JOIN titles t ON t.ontology_id = p.ontology_id WHERE part = 'funcs' AND of IS NULL")
def functions_only_view(v):
    return op.functions_only(v("functions"), v("function_args"), v("terms"), _titles(v))


@query(
    "output_variants", _VIEW_TABLES,
    f"""{_VIEW}, whole AS (SELECT ontology_id, NULL AS of, '' AS part, 'term' AS kind, seq, name, label FROM terms UNION ALL SELECT ontology_id, NULL, '', 'function', seq, name, label FROM functions
    UNION ALL SELECT ontology_id, NULL, '', 'relationship', seq, name, {_ENDS_TEXT} FROM relationships UNION ALL SELECT ontology_id, title, '', kind, seq, name, label FROM figures)
    SELECT x.ontology_id, of AS figure, part, CASE WHEN part = '' THEN coalesce(of, title) ELSE {_PART_TITLE.format('coalesce(of, title)')} END AS title, kind, seq, name, label
    FROM (SELECT * FROM whole UNION ALL SELECT * FROM parts) x LEFT JOIN titles t ON t.ontology_id = x.ontology_id""",
)
def output_variants(v):
    return op.output_variants(v("terms"), v("functions"), v("function_args"), v("relationships"), placed_members(v), _titles(v))
