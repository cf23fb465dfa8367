"""Queries that read models from texts: views are written as text and must come back."""

import uuid

from pyspark.sql import functions as F

from modelgraph.functions import render
from modelgraph.operators import exports, extract
from modelgraph.operators.definitions import ATTRIBUTE_KEYS
from modelgraph.operators.graph import settled, shared_folder
from modelgraph.plans.exports import DSL_RELATIONSHIP_SQL, DSL_TERM_SQL
from modelgraph.plans.views import query
from modelgraph.sources.files import read_models


def _sources(v, *sections):
    """One source per ontology, with comments and line breaks inside braces, in pieces of whole lines."""
    parts = []
    for section, title, lines in sections:
        # A piece of its own, as pieces are equal stretches of seq and this one is far from all others.
        head = lines.select("ontology_id").distinct().select("ontology_id", F.lit(section - 1).alias("section"), F.lit(-1).cast("long").alias("seq"), F.lit(f"{title}: # '{title}'").alias("line"))
        broken = F.when(F.col("line").endswith("}"), F.concat(F.expr("left(line, length(line) - 1)"), F.lit("\n}  # end"))).otherwise(F.col("line"))
        parts += [lines.withColumn("line", broken), head]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _in_pieces(out)


def _in_pieces(lines):
    """Sources of lines(ontology_id, section, seq, line), in pieces of whole lines."""
    return exports.pieces(lines, "ontology_id", "\n").withColumnsRenamed({"ontology_id": "file", "section": "block", "text": "content"})


def _named(v):
    """Relationship lines with their names."""
    r = v("relationships")
    line = F.concat(F.coalesce(F.concat("name", F.lit(": ")), F.lit("")), "parent", F.lit(" "), "relationship", F.lit(" "), "child", render.dsl_attributes(**{k: F.col(k) for k in ATTRIBUTE_KEYS["relationship"]}))
    return r.select("ontology_id", F.lit(5).alias("section"), F.col("seq").cast("long").alias("seq"), line.alias("line"))


_VIEWS = "terms functions function_args relationships"

# Hard texts: both kinds of quotes in turn, and brackets, a comment mark and the other quote in
# strings. The same expressions make the texts in Spark and the expected lines in SQL.
_Q = "CASE WHEN seq % 2 = 0 THEN chr(39) ELSE chr(34) END"
_HARD = "' 1) } # {(' || CASE WHEN seq % 2 = 0 THEN chr(34) ELSE chr(39) END"
_TERM_LINE = (
    f"name || ': ' || {_Q} || label || {_Q} || ', ' || {_Q} || description || {_HARD} || {_Q} || CASE WHEN color IS NULL AND note IS NULL THEN '' "
    f"ELSE ', {{ ' || concat_ws(', ', 'color: ' || {_Q} || color || {_Q}, 'note: ' || {_Q} || note || {_Q}) || ' }}' END"
)
_FUNCTION_LINE = (
    f"name || ': ' || {_Q} || label || {_HARD} || {_Q} || ' (' || coalesce(inputs, '') || ') -> ' || output_term || ': ' || {_Q} || {_HARD} || {_Q} "
    f"|| CASE WHEN coalesce({', '.join(ATTRIBUTE_KEYS['function'])}) IS NULL THEN '' ELSE ', {{ ' || concat_ws(', ', {', '.join(f'{chr(39)}{k}: {chr(39)} || {_Q} || {k} || {_Q}' for k in ATTRIBUTE_KEYS['function'])}) || ' }}' END"
)
_ARG = "term || ': ' || chr(39) || label || ' (y) #' || chr(39)"
_FUNCTIONS = f"(SELECT f.*, i.inputs FROM functions f LEFT JOIN (SELECT ontology_id, function, string_agg({_ARG}, ', ' ORDER BY pos, {_ARG}) AS inputs FROM function_args GROUP BY 1, 2) i ON i.function = f.name AND i.ontology_id = f.ontology_id)"
_EDGE_LINE = f"CASE WHEN name IS NULL THEN '' ELSE name || ': ' END || {DSL_RELATIONSHIP_SQL}"


def _term_lines(v):
    return v("terms").select("ontology_id", F.lit(1).alias("section"), F.col("seq").cast("long").alias("seq"), F.expr(_TERM_LINE).alias("line"))


def _function_lines(v):
    a = v("function_args").groupBy("ontology_id", F.col("function").alias("name")).agg(exports.in_order("t", "pos", F.expr(_ARG).alias("t")).alias("a"))
    f = v("functions").join(a, ["ontology_id", "name"], "left").withColumn("inputs", F.array_join("a", ", "))
    return f.select("ontology_id", F.lit(3).alias("section"), F.col("seq").cast("long").alias("seq"), F.expr(_FUNCTION_LINE).alias("line"))


def _all_sources(v):
    return _sources(v, (1, "types", _term_lines(v)), (3, "functions", _function_lines(v)), (5, "hierarchy", _named(v)))


_ALL_LINES = f"""SELECT ontology_id AS file, 'types' AS section, {_TERM_LINE} AS text FROM terms UNION ALL SELECT ontology_id, 'functions', {_FUNCTION_LINE} FROM {_FUNCTIONS}
UNION ALL SELECT ontology_id, 'hierarchy', {_EDGE_LINE} FROM relationships"""


@query("logical_lines", _VIEWS, f"SELECT file, text FROM ({_ALL_LINES}) UNION ALL SELECT DISTINCT file, section || ':' FROM ({_ALL_LINES})")
def logical_lines(v):
    return extract.logical_lines(_all_sources(v)).select("file", "text")


@query("section_of_line", _VIEWS, _ALL_LINES)
def section_of_line(v):
    return extract.sections(_all_sources(v)).select("file", "section", "text")


@query("parse_meta", "meta_statements", "SELECT ontology_id AS file, tag, value FROM meta_statements")
def parse_meta(v):
    q = F.when(F.col("seq") % 2 == 0, "'").otherwise('"')
    m = v("meta_statements").select("ontology_id", F.lit(0).alias("section"), F.col("seq").cast("long").alias("seq"), F.concat("tag", F.lit(": "), q, "value", q, F.lit(" # 'x'")).alias("line"))
    return extract.meta(extract.sections(_in_pieces(m))).select("file", "tag", "value")


@query("parse_terms", "terms", f"SELECT ontology_id AS file, name, label, description || {_HARD} AS description, color, note FROM terms")
def parse_terms(v):
    return extract.terms(extract.sections(_sources(v, (1, "types", _term_lines(v))))).drop("block", "piece", "line")


def _functions(v):
    return extract.functions(extract.sections(_sources(v, (3, "functions", _function_lines(v)))))


@query("parse_functions", "functions function_args", f"SELECT ontology_id AS file, name, label || {_HARD} AS label, coalesce(inputs, '') AS inputs, output_term, {_HARD} AS output_label, type, color, colorArrow, inputTitle, outputTitle FROM {_FUNCTIONS}")
def parse_functions(v):
    inputs = F.array_join(F.transform("inputs", lambda i: F.concat(i.term, F.lit(": '"), i.label, F.lit("'"))), ", ")
    return _functions(v).select("file", "name", "label", inputs.alias("inputs"), "output_term", "output_label", "type", "color", "colorArrow", "inputTitle", "outputTitle")


@query("function_args", "functions function_args", "SELECT ontology_id AS file, function, term, label || ' (y) #' AS label, count(*) AS n FROM function_args GROUP BY 1, 2, 3, 4")
def function_args(v):
    return extract.function_args(_functions(v)).groupBy("file", "function", "term", "label").agg(F.count("*").alias("n"))


@query("parse_relationships", "relationships", "SELECT ontology_id AS file, name, parent, relationship, child, color, direction, title, rightChar, leftChar FROM relationships")
def parse_relationships(v):
    return extract.relationships(extract.sections(_sources(v, (5, "hierarchy", _named(v))))).drop("block", "piece", "line")


@query("parse_figures", "figure_lines", "SELECT ontology_id AS file, figure, member FROM figure_lines")
def parse_figures(v):
    f = v("figure_lines")
    block = f.groupBy("ontology_id", "figure").agg(F.array_join(F.array_sort(F.collect_list("member")), "\n").alias("m"))
    text = F.concat(F.lit("figure '"), "figure", F.lit("':\n"), "m")
    sources = block.groupBy(F.col("ontology_id").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n\n").alias("content"))
    return extract.figures(extract.section_of_line(extract.logical_lines(sources))).drop("line")


@query("parse_imports", "imports", "SELECT DISTINCT file_id AS file, 'f' || target_id || '.ontol' AS src, seq % 2 = 1 AS star, CASE WHEN seq % 2 = 0 THEN 'e' || target_id END AS name, CASE WHEN seq % 2 = 0 AND file_id % 5 = 0 THEN 'x' || target_id END AS alias FROM imports")
def parse_imports(v):
    t = F.col("target_id").cast("string")
    listed = F.concat(F.lit("{e"), t, F.when(F.col("file_id") % 5 == 0, F.concat(F.lit(" as x"), t)).otherwise(""), F.lit("}"))
    line = F.concat(F.lit("import "), F.when(F.col("seq") % 2 == 1, "*").otherwise(listed), F.lit(' from "f'), t, F.lit('.ontol"'))
    rows = v("imports").select(F.col("file_id").alias("ontology_id"), F.lit(0).alias("section"), F.col("seq").cast("long").alias("seq"), line.alias("line")).distinct()
    return extract.imports(extract.sections(_in_pieces(rows))).drop("block", "piece", "line").distinct()


@query("parse_attributes", "terms", "SELECT ontology_id AS file, key, value, count(*) AS n FROM (SELECT ontology_id, 'color' AS key, color AS value FROM terms UNION ALL SELECT ontology_id, 'note', note FROM terms) WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def parse_attributes(v):
    sources = _sources(v, (1, "types", _term_lines(v)))
    return extract.attributes(extract.logical_lines(sources)).groupBy("file", "key", "value").agg(F.count("*").alias("n"))


# Types and defaults as they stand in the sources: names of classes begin with a letter; every third
# default is a string with brackets, a quote and a keyword in it.
_TYPE = "CASE WHEN {0} BETWEEN '0' AND '99999999' THEN 'c' || {0} ELSE {0} END"
_DEFAULT = "CASE WHEN seq % 3 = 0 THEN initial_value || ' {x} \"y) КОНЕЦ' ELSE initial_value END"


def _tdl(v):
    """A class source for each diagram of ten classes."""
    initial = F.expr("case when seq % 3 = 0 then concat('\"', initial_value, ' {x} ', chr(92), '\"y) КОНЕЦ\"') else initial_value end")
    a = v("attributes").withColumn("type_", F.expr(_TYPE.format("type_"))).withColumn("line", F.concat(F.lit("    + "), "name", F.lit("_"), F.col("seq").cast("string"), F.lit(" [1..*]"), F.coalesce(F.concat(F.lit(" : "), "type_"), F.lit("")), F.lit(" = "), initial, F.when(F.col("seq") % 2 == 0, " { только_чтение }").otherwise("")))
    attrs = a.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("attrs"))
    p = v("parameters").withColumn("t", F.expr(f"name || coalesce(' : ' || {_TYPE.format('type_')}, '') || coalesce(' = ' || default_value, '')"))
    p = p.groupBy("op").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), ", ").alias("params"))
    o = v("operations").withColumn("return_type", F.expr(_TYPE.format("return_type"))).join(p, "op", "left")
    o = o.withColumn("line", F.concat(F.lit("    "), "visibility", F.lit(" "), "name", F.lit("_"), F.col("op").cast("string"), F.lit("("), F.coalesce("params", F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(" : "), "return_type"), F.lit("")), F.when(F.col("is_query"), " {запрос, лист}").otherwise("")))
    ops = o.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("ops"))
    c = v("classifiers").join(attrs, "class", "left").join(ops, "class", "left")
    word = F.when(F.col("class") % 2 == 0, "КЛАСС c").otherwise("класс c")
    block = F.concat(word, F.col("class").cast("string"), F.when(F.col("is_abstract"), " АБСТРАКТНЫЙ").otherwise(""), F.lit("\n-- note\n"), F.coalesce(F.concat(F.lit("  АТРИБУТЫ\n"), "attrs", F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("  ОПЕРАЦИИ\n"), "ops", F.lit("\n")), F.lit("")), F.lit("КОНЕЦ КЛАСС\n"))
    rel = v("generalizations").selectExpr("CAST(floor(specific / 10) AS BIGINT) as file", "'ОБОБЩЕНИЕ c' || specific || ' -> c' || general as t").unionByName(v("dependencies").selectExpr("CAST(floor(client / 10) AS BIGINT) as file", "'зависимость c' || client || ' -> c' || supplier || case when client % 2 = 0 then ' \"' || stereotype || '\"' else ' ' || stereotype end as t")).unionByName(v("realizations").selectExpr("CAST(floor(implementer / 10) AS BIGINT) as file", "'РЕАЛИЗАЦИЯ c' || implementer || ' -> c' || interface as t"))
    two = v("dependencies").selectExpr("CAST(floor(client / 10) AS BIGINT) as file", "case client % 3 when 0 then 'КОМПОЗИЦИЯ c' when 1 then 'АГРЕГАЦИЯ c' else 'Ассоциация\\n  c' end || client || case when client % 4 = 1 then ' 1' else ' [1]' end || ' : r\\n  --\\n  c' || supplier || case when client % 4 = 1 then ' *' else ' [0..*]' end || case when client % 5 = 0 then ' производная' else '' end || case client % 4 when 0 then ' ИМЯ n' || client when 2 then ' ИМЯ \"n (' || client || '\"' else '' end as t")
    enums = v("classifiers").where("class % 4 = 0").selectExpr("CAST(floor(class / 10) AS BIGINT) AS file", "'Перечисление e' || class || '\\n  one_' || class || ' имя\\nКОНЕЦ ПЕРЕЧИСЛЕНИЕ\\n' AS t")
    parts = c.select(F.floor(F.col("class") / 10).alias("file"), block.alias("t")).unionByName(rel).unionByName(two).unionByName(enums)
    return parts.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("content"))


@query("parse_tdl_classes", "classifiers", "SELECT CAST(floor(class / 10) AS BIGINT) AS file, 'c' || class AS class, is_abstract, CAST(NULL AS VARCHAR) AS stereotype FROM classifiers UNION ALL SELECT CAST(floor(class / 10) AS BIGINT), 'e' || class, false, 'enumeration' FROM classifiers WHERE class % 4 = 0")
def parse_tdl_classes(v):
    return extract.tdl_classes(_tdl(v)).select("file", "class", "is_abstract", "stereotype")


@query(
    "parse_tdl_features", "attributes operations parameters classifiers",
    f"""WITH p AS (SELECT op, string_agg(name || ':' || coalesce({_TYPE.format("type_")}, '-') || '=' || coalesce(default_value, '-'), ',' ORDER BY pos, name || coalesce(' : ' || {_TYPE.format("type_")}, '') || coalesce(' = ' || default_value, '')) AS params FROM parameters GROUP BY 1)
    SELECT CAST(floor(class / 10) AS BIGINT) AS file, 'c' || class AS class, '+' AS visibility, name || '_' || seq AS name, {_TYPE.format("type_")} AS type_, {_DEFAULT} || CASE WHEN seq % 2 = 0 THEN ' ro' ELSE '' END AS detail, count(*) AS n FROM attributes WHERE class IN (SELECT class FROM classifiers) GROUP BY ALL
    UNION ALL SELECT CAST(floor(class / 10) AS BIGINT), 'c' || class, visibility, name || '_' || o.op, {_TYPE.format("return_type")}, coalesce(params, '') || CASE WHEN is_query THEN ' query leaf' ELSE '' END, 1 FROM operations o LEFT JOIN p ON p.op = o.op WHERE class IN (SELECT class FROM classifiers)
    UNION ALL SELECT CAST(floor(class / 10) AS BIGINT), 'e' || class, NULL, unnest(['one_' || class, 'имя']), NULL, NULL, 1 FROM classifiers WHERE class % 4 = 0""",
)
def parse_tdl_features(v):
    classes = settled(extract.tdl_classes(_tdl(v)))
    a = extract.tdl_attributes(classes).withColumn("detail", F.concat("initial_value", F.when(F.col("read_only"), " ro").otherwise("")))
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type_"], F.lit("-")), F.lit("="), F.coalesce(p["default"], F.lit("-")))), ",")
    o = extract.tdl_operations(classes).withColumn("detail", F.concat(params, F.when(F.col("is_query"), " query").otherwise(""), F.when(F.col("is_leaf"), " leaf").otherwise(""))).withColumnRenamed("return_type", "type_")
    cols = ["file", "class", "visibility", "name", "type_", "detail"]
    return a.select(*cols).unionByName(o.select(*cols)).groupBy(*cols).agg(F.count("*").alias("n"))


@query(
    "parse_tdl_relations", "generalizations dependencies realizations",
    """SELECT CAST(floor(specific / 10) AS BIGINT) AS file, 'generalization' AS relation, 'c' || specific AS source, 'c' || general AS target, CAST(NULL AS VARCHAR) AS stereotype FROM generalizations
    UNION ALL SELECT CAST(floor(client / 10) AS BIGINT), 'dependency', 'c' || client, 'c' || supplier, stereotype FROM dependencies WHERE supplier >= 0 UNION ALL SELECT CAST(floor(implementer / 10) AS BIGINT), 'realization', 'c' || implementer, 'c' || interface, NULL FROM realizations
    UNION ALL SELECT CAST(floor(client / 10) AS BIGINT), CASE client % 3 WHEN 0 THEN 'composition' WHEN 1 THEN 'aggregation' ELSE 'none' END, 'c' || client, 'c' || supplier,
    '1 r ' || CASE WHEN client % 4 = 1 THEN '*' ELSE '0..*' END || CASE client % 4 WHEN 0 THEN ' n' || client WHEN 2 THEN ' n (' || client ELSE '' END || CASE WHEN client % 5 = 0 THEN ' derived' ELSE '' END FROM dependencies WHERE supplier >= 0""",
)
def parse_tdl_relations(v):
    s = settled(extract.tdl_statements(_tdl(v)))
    two = extract.tdl_associations(s).select("file", F.col("aggregation").alias("relation"), F.col("class1").alias("source"), F.col("class2").alias("target"), F.concat_ws(" ", "multiplicity1", "role1", "multiplicity2", "name", F.when(F.col("derived"), "derived")).alias("stereotype"))
    return extract.tdl_relations(s).drop("pos").unionByName(two)


# The relation of every class but each third, to a neighbour in its drawing, as facts that the texts
# are made of: k (the class), its kind, and the target's name (null: no such attribute).
_LINKS = """SELECT class AS k, floor(class / 10) AS doc, CASE class % 4 WHEN 0 THEN 'association' WHEN 1 THEN 'dependency' WHEN 2 THEN 'generalization' ELSE 'realization' END AS kind,
  CASE WHEN class % 11 = 0 THEN NULL WHEN class % 37 = 0 THEN 'ghost' ELSE 'a<' || CAST(CAST(floor(class / 10) AS BIGINT) * 10 + (class + 3) % 10 AS STRING) END AS target FROM classifiers WHERE class % 3 > 0"""


def _svg(v):
    """A drawing per diagram; every seventh is cut off, some have no class, some classes no id."""
    c = v("classifiers").where("floor(class / 10) % 13 <> 5").withColumn("t", F.expr("cast(class as string)"))
    tag = F.concat(F.lit('<g class="uml-class" transform="translate('), (F.col("class") % 100).cast("string"), F.lit(","), (F.col("class") % 7).cast("string"), F.lit(".5)\" data-type='class' data-id=\""), F.when(F.col("class") % 41 > 0, F.col("t")).otherwise(""), F.lit('" data-name="a&#60;'), "t", F.lit('" data-abstract="'), F.col("is_abstract").cast("string"), F.lit('"></g>'))
    links = v.spark.sql(_LINKS.replace("FROM classifiers", "FROM {c}"), c=v("classifiers"))
    new = F.col("k") % 2 == 0
    a = (F.col("kind") == "association") & new
    one, two = F.when(a, "data-end1-class").otherwise("data-src"), F.when(a, "data-end2-class").otherwise("data-tgt")
    line = F.concat(F.lit("<path data-note=\"data-src='x'\" data-type=\""), "kind", F.lit('" '), one, F.lit("='a&lt;"), F.col("k").cast("string"), F.lit("'"), F.coalesce(F.concat(F.lit("\n"), two, F.lit(' = "'), F.replace("target", F.lit("<"), F.lit("&lt;")), F.lit('"')), F.lit("")), F.when((F.col("kind") == "association") & (F.col("k") % 16 == 0), ' data-end2-multiplicity="5..3"').otherwise(" data-end2-multiplicity='0..*'"), F.lit("/>"))
    every = v("classifiers").select(F.floor(F.col("class") / 10).alias("doc"), F.lit("<!-- <g data-type='class'/> -->").alias("x")).distinct()
    rows = c.select(F.floor(F.col("class") / 10).alias("doc"), tag.alias("x")).unionByName(links.select("doc", line.alias("x"))).unionByName(every)
    docs = rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("t"))
    return docs.select("doc", F.concat(F.lit("<svg>"), "t", F.when(F.col("doc") % 7 == 0, "").otherwise("</svg>")).alias("svg"))


_SOUND = "floor(class / 10) % 7 <> 0 AND floor(class / 10) % 13 <> 5"


@query("svg_elements", "classifiers", f"SELECT CAST(floor(class / 10) AS BIGINT) AS doc, 'class' AS kind, 'a<' || class AS name FROM classifiers WHERE {_SOUND} UNION ALL SELECT CAST(doc AS BIGINT), kind, NULL FROM ({_LINKS}) WHERE doc % 7 <> 0 UNION ALL SELECT DISTINCT CAST(floor(class / 10) AS BIGINT), 'error', NULL FROM classifiers WHERE floor(class / 10) % 7 = 0")
def svg_elements(v):
    return extract.svg_elements(_svg(v)).select("doc", "kind", extract.svg_attribute(F.col("tag"), "data-name").alias("name"))


@query("svg_translate", "classifiers", f"SELECT 'a<' || class AS name, CAST(class % 100 AS DOUBLE) AS x, class % 7 + 0.5::DOUBLE AS y FROM classifiers WHERE {_SOUND}")
def svg_translate(v):
    e = extract.svg_elements(_svg(v)).where("kind = 'class'")
    return e.select(extract.svg_attribute(F.col("tag"), "data-name").alias("name"), extract.svg_translate(F.col("tag")).alias("p")).select("name", "p.x", "p.y")


_FOUND = f"""links AS ({_LINKS}), known AS (SELECT 'a<' || class AS name FROM classifiers WHERE class % 41 > 0 AND floor(class / 10) % 13 <> 5),
  docs AS (SELECT DISTINCT CAST(floor(class / 10) AS BIGINT) AS doc FROM classifiers),
  r AS (SELECT CAST(doc AS BIGINT) AS doc, CASE WHEN target IS NULL THEN 'without ends' WHEN 'a<' || k NOT IN (SELECT name FROM known) THEN 'unknown source' WHEN target NOT IN (SELECT name FROM known) THEN 'unknown target'
    WHEN kind = 'association' AND k % 16 = 0 THEN 'bad multiplicity' END AS rule, CAST('a<' || k AS VARCHAR) AS source, target FROM links WHERE doc % 7 <> 0 AND doc % 13 <> 5),
  found AS (SELECT doc, 'error' AS level, 'not well formed' AS rule, NULL AS subject FROM docs WHERE doc % 7 = 0 UNION ALL SELECT doc, 'error', 'no classes', NULL FROM docs WHERE doc % 7 <> 0 AND doc % 13 = 5
    UNION ALL SELECT CAST(floor(class / 10) AS BIGINT), 'error', 'class without id', 'a<' || class FROM classifiers WHERE {_SOUND} AND class % 41 = 0
    UNION ALL SELECT doc, CASE WHEN rule = 'without ends' THEN 'warning' ELSE 'error' END, rule, CASE rule WHEN 'unknown source' THEN source WHEN 'unknown target' THEN target WHEN 'bad multiplicity' THEN '5..3' END FROM r WHERE rule IS NOT NULL)"""


@query("svg_findings", "classifiers", f"WITH {_FOUND} SELECT * FROM found")
def svg_findings(v):
    return extract.svg_findings(_svg(v)).drop("pos")


@query(
    "svg_parse_status", "classifiers",
    f"""WITH {_FOUND}, n AS (SELECT doc, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w FROM found GROUP BY 1)
    SELECT docs.doc, coalesce(e, 0) = 0 AS ok, coalesce(e, 0) AS n_errors, CASE WHEN coalesce(e, 0) = 0 THEN coalesce(w, 0) ELSE 0 END AS n_warnings FROM docs LEFT JOIN n ON n.doc = docs.doc""",
)
def svg_parse_status(v):
    return extract.svg_status(_svg(v))


#: A file for each row, in one folder; each task moves its own files in the end (the driver would move them one by one).
#: On a local disk the default file system starts a process for each folder, file and checksum file, to set its mode;
#: the raw one has no checksum files, and other stores don't look at its options.
_MANY_FILES = {
    "maxRecordsPerFile": "1", "mapreduce.fileoutputcommitter.algorithm.version": "2",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
}


def _read_back(v, texts):
    """texts(file, content) written as one text file each by all tasks, with the file's number as first line, and
    read again as model files."""
    folder = f"{shared_folder(v.spark)}/texts-{uuid.uuid4().hex}"
    none = F.lit("")
    extract.spread(texts).select(F.concat(F.coalesce(F.col("file").cast("string"), none), F.lit("\n"), F.coalesce("content", none))).write.options(**_MANY_FILES).text(folder)
    # A task without rows may have left an empty file.
    found = read_models(v.spark, folder, "txt").where("content <> ''")
    return found.select(F.substring_index("content", "\n", 1).try_cast("long").alias("file"), F.length(F.regexp_replace("content", r"\A\d*\n|\n$", "")).alias("n"))


@query("read_sources", "terms", f"SELECT ontology_id AS file, CAST(sum(length({DSL_TERM_SQL})) + count(*) - 1 AS INT) AS n FROM terms GROUP BY 1")
def read_sources(v):
    return _read_back(v, exports.joined(exports.dsl_term_lines(v("terms")), "ontology_id", "content").withColumnRenamed("ontology_id", "file"))


@query("read_tdl", "classifiers", "SELECT CAST(floor(class / 10) AS BIGINT) AS file, CAST(sum(length('КЛАСС c' || class || chr(10) || 'КОНЕЦ КЛАСС')) + count(*) - 1 AS INT) AS n FROM classifiers GROUP BY 1")
def read_tdl(v):
    block = F.concat(F.lit("КЛАСС c"), F.col("class").cast("string"), F.lit("\nКОНЕЦ КЛАСС"))
    return _read_back(v, v("classifiers").groupBy(F.floor(F.col("class") / 10).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("content")))


@query("read_svg", "classifiers", """SELECT CAST(floor(class / 10) AS BIGINT) AS file, CAST(sum(length('<g data-type="class" data-name="' || class || '"></g>')) + 11 AS INT) AS n FROM classifiers GROUP BY 1""")
def read_svg(v):
    tag = F.concat(F.lit('<g data-type="class" data-name="'), F.col("class").cast("string"), F.lit('"></g>'))
    docs = v("classifiers").groupBy(F.floor(F.col("class") / 10).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(tag)), "").alias("t"))
    return _read_back(v, docs.select("file", F.concat(F.lit("<svg>"), "t", F.lit("</svg>")).alias("content")))
