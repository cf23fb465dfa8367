"""Queries over workspaces, imports and suggestions."""

from pyspark.sql import functions as F

from modelgraph.operators import graph, imports, resolution, suggestions, workspace
from modelgraph.plans.views import query


@query("flat_name_check", "files", "SELECT DISTINCT name FROM (SELECT CASE seq % 5 WHEN 0 THEN '../' || name WHEN 1 THEN '..' WHEN 2 THEN ' ' ELSE name END AS name FROM files) WHERE name LIKE '../%' OR name IN ('..', ' ')")
def flat_name_check(v):
    named = v("files").selectExpr("CASE seq % 5 WHEN 0 THEN '../' || name WHEN 1 THEN '..' WHEN 2 THEN ' ' ELSE name END AS name")
    return named.where(~workspace.flat_name_ok(F.col("name"))).distinct()


_EXT = "CASE WHEN name LIKE '%.ontol' OR name LIKE '%.tdl' THEN name ELSE name || '.ontol' END"


@query("with_extension", "files", f"SELECT project_id, seq, {_EXT} AS name FROM files")
def with_extension(v):
    return v("files").select("project_id", "seq", workspace.with_extension(F.col("name")).alias("name"))


@query("engine_dispatch", "files", "SELECT CASE WHEN name LIKE '%.tdl' THEN 'classes' ELSE 'ontology' END AS engine, count(*) AS n FROM files GROUP BY 1")
def engine_dispatch(v):
    return v("files").groupBy(workspace.engine(F.col("name")).alias("engine")).agg(F.count("*").alias("n"))


@query("username_check", "users", "SELECT id, regexp_full_match(username, '[A-Za-z0-9_-]{3,32}') AS ok FROM (SELECT id, CASE WHEN id % 3 = 0 THEN username || '!' ELSE username END AS username FROM users)")
def username_check(v):
    return v("users").select("id", workspace.username_ok(F.expr("case when id % 3 = 0 then username || '!' else username end")).alias("ok"))


@query("strip_ansi", "terms", "SELECT seq, label AS text FROM terms")
def strip_ansi(v):
    return v("terms").select("seq", workspace.strip_ansi(F.concat(F.lit("\x1b[1;31m"), "label", F.lit("\x1b[0m"))).alias("text"))


@query("figure_slug", "terms", "SELECT seq, 'shema_' || replace(lower(description), ' ', '_') || CASE WHEN description = '' THEN 'n' ELSE '_n' END AS slug FROM terms")
def figure_slug(v):
    return v("terms").select("seq", workspace.slug(F.concat(F.lit(" Схема: "), "description", F.lit(" Ñ "))).alias("slug"))


@query("owned_projects", "projects", "SELECT id, owner_id + id % 2 AS owner_id, id % 2 = 0 AS found FROM projects")
def owned_projects(v):
    return workspace.owned(v("projects"), v("projects").select("id", (F.col("owner_id") + F.col("id") % 2).alias("owner_id")))


@query("cascade_delete", "projects files users", "SELECT project_id, name, updated_at, content, seq FROM files WHERE project_id NOT IN (SELECT id FROM projects WHERE owner_id IN (SELECT id FROM users WHERE id % 4 = 1))")
def cascade_delete(v):
    return workspace.cascade_delete(v("users").where("id % 4 = 1"), v("projects"), v("files"))


@query(
    "choose_entry", "projects files",
    f"""WITH f AS (SELECT project_id AS id, {_EXT} AS name FROM files WHERE project_id % 5 > 0), h AS (SELECT id, bool_or(name = 'main.ontol') AS main, min(name) AS lowest FROM f GROUP BY 1),
    w AS (SELECT id, 'f' || CAST(id % 9 AS VARCHAR) || '.tdl' AS entry FROM projects WHERE id % 3 = 0),
    x AS (SELECT p.id, main, lowest, entry, entry IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = p.id AND f.name = entry) AS gone FROM projects p LEFT JOIN h ON p.id = h.id LEFT JOIN w ON p.id = w.id)
    SELECT id, CASE WHEN lowest IS NULL OR gone THEN NULL ELSE coalesce(entry, CASE WHEN main THEN 'main.ontol' END, lowest) END AS entry,
    CASE WHEN lowest IS NULL THEN 'Project has no files' WHEN gone THEN 'entry not found' END AS error FROM x""",
)
def choose_entry(v):
    files = v("files").where("project_id % 5 > 0").withColumn("name", workspace.with_extension(F.col("name")))
    wanted = v("projects").where("id % 3 = 0").selectExpr("id", "'f' || cast(id % 9 as string) || '.tdl' as entry")
    return workspace.choose_entry(v("projects"), files, wanted)


@query(
    "unique_key_violations", "projects files users",
    """SELECT 'project' AS kind, CAST(owner_id AS VARCHAR) || '/' || name AS key, count(*) AS n FROM projects GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'file', CAST(project_id AS VARCHAR) || '/' || name, count(*) FROM files GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'user', email, count(*) FROM users GROUP BY 2 HAVING count(*) > 1""",
)
def unique_key_violations(v):
    def bad(df, kind, *keys):
        return workspace.repeated_keys(df, *keys).select(F.lit(kind).alias("kind"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key"), "n")

    return bad(v("projects"), "project", "owner_id", "name").unionByName(bad(v("files"), "file", "project_id", "name")).unionByName(bad(v("users"), "user", "email"))


_LATEST = "SELECT project_id, name, updated_at, content FROM (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY updated_at DESC, seq DESC, content DESC) AS r FROM files) WHERE r = 1"


@query("latest_file_version", "files", _LATEST)
def latest_file_version(v):
    return workspace.latest_version(v("files"))


@query("read_project_files", "files", f"SELECT project_id, name, content FROM ({_LATEST})")
def read_project_files(v):
    return workspace.latest_version(v("files")).select("project_id", "name", "content")


@query("list_projects", "projects", "SELECT id, owner_id, name, created_at FROM projects")
def list_projects(v):
    return workspace.list_projects(v("projects"))


@query("list_files", "files", "SELECT DISTINCT project_id, name, updated_at FROM files")
def list_files(v):
    return workspace.list_files(v("files"))


@query("resolve_import_paths", "files", """SELECT project_id, seq, CASE seq % 4 WHEN 0 THEN '/m/p' || project_id || '/base.ontol' WHEN 1 THEN '/m/p' || project_id || '/base.ontol' WHEN 2 THEN '/m/shared/a.ontol' ELSE 'https://x.org/a/../b.ontol' END AS key FROM files""")
def resolve_import_paths(v):
    src = F.expr("case seq % 4 when 0 then 'base.ontol' when 1 then './sub/../base.ontol' when 2 then '../shared/./a.ontol' else 'https://x.org/a/../b.ontol' end")
    path = F.concat(F.lit("/m/p"), F.col("project_id").cast("string"), F.lit("/"), "name")
    return v("files").select("project_id", "seq", imports.import_key(path, src).alias("key"))


def _listed(v):
    """Even places list the target's own name, with an alias in every fifth file."""
    return v("imports").where("seq % 2 = 0").selectExpr("file_id", "target_id", "seq", "'e' || cast(target_id as string) as name", "case when file_id % 5 = 0 then 'x' || cast(target_id as string) end as alias")


_LISTED = "listed AS (SELECT DISTINCT file_id, target_id, 'e' || CAST(target_id AS VARCHAR) AS name, CASE WHEN file_id % 5 = 0 THEN 'x' || CAST(target_id AS VARCHAR) END AS alias FROM imports WHERE seq % 2 = 0)"
_SELECTED = "sel AS (SELECT l.file_id, l.target_id, coalesce(alias, l.name) AS name, d.label, d.description FROM listed l JOIN definitions d ON l.target_id = d.file_id AND l.name = d.name)"
_STARRED = "star AS (SELECT i.target_id, i.file_id, d.name, d.label, d.description FROM (SELECT DISTINCT file_id, target_id FROM imports WHERE seq % 2 = 1) i JOIN definitions d ON i.target_id = d.file_id)"


@query("missing_import_files", "imports definitions", "SELECT target_id, file_id, seq FROM imports WHERE target_id NOT IN (SELECT file_id FROM definitions)")
def missing_import_files(v):
    return imports.missing_files(v("imports"), v("definitions"))


@query("selective_import", "imports definitions", f"WITH {_LISTED}, {_SELECTED} SELECT * FROM sel")
def selective_import(v):
    return imports.selective(_listed(v), v("definitions"))


@query("star_import", "imports definitions", f"WITH {_STARRED} SELECT * FROM star")
def star_import(v):
    return imports.starred(v("imports").where("seq % 2 = 1"), v("definitions"))


@query("missing_imported_names", "imports definitions", f"WITH {_LISTED} SELECT file_id, target_id, name FROM listed l WHERE NOT EXISTS (SELECT 1 FROM definitions d WHERE d.file_id = l.target_id AND d.name = l.name)")
def missing_imported_names(v):
    return imports.missing_names(_listed(v), v("definitions"))


@query(
    "import_dependencies", "functions function_args terms relationships",
    """WITH i AS (SELECT (ontology_id + 1) % 50 AS ontology_id, ontology_id AS source_id, name FROM functions UNION SELECT (ontology_id + 1) % 50, ontology_id, name FROM relationships WHERE name IS NOT NULL),
    u AS (SELECT ontology_id, function AS name, term FROM function_args UNION ALL SELECT ontology_id, name, output_term FROM functions UNION ALL SELECT ontology_id, name, unnest([parent, child]) FROM relationships WHERE name IS NOT NULL)
    SELECT DISTINCT i.ontology_id, i.source_id, term FROM i JOIN u ON i.source_id = u.ontology_id AND i.name = u.name WHERE EXISTS (SELECT 1 FROM terms t WHERE t.ontology_id = i.source_id AND t.name = term)
    AND NOT EXISTS (SELECT 1 FROM (SELECT ontology_id, name FROM terms UNION ALL SELECT ontology_id, name FROM functions UNION ALL SELECT ontology_id, name FROM relationships) t WHERE t.ontology_id = i.ontology_id AND t.name = term)""",
)
def import_dependencies(v):
    picked = v("functions").select("ontology_id", "name").unionByName(v("relationships").where("name is not null").select("ontology_id", "name"))
    wanted = picked.select(((F.col("ontology_id") + 1) % 50).alias("ontology_id"), F.col("ontology_id").alias("source_id"), "name").distinct()
    return imports.dependencies(wanted, v("functions"), v("function_args"), v("terms"), v("relationships"))


@query("import_conflicts", "imports definitions", f"WITH {_LISTED}, {_SELECTED}, {_STARRED} SELECT file_id, name FROM (SELECT file_id, name, label, description FROM sel UNION SELECT file_id, name, label, description FROM star UNION SELECT file_id, name, label, description FROM definitions) GROUP BY 1, 2 HAVING count(*) > 1")
def import_conflicts(v):
    reached = imports.selective(_listed(v), v("definitions")).unionByName(imports.starred(v("imports").where("seq % 2 = 1"), v("definitions"))).drop("target_id")
    reached = reached.unionByName(v("definitions").drop("seq"))
    return imports.conflicts(reached.select("file_id", "name", imports.content(F.col("label"), F.col("description")).alias("content")))


_REACH = "reach AS (SELECT file_id AS a, target_id AS b FROM imports UNION SELECT r.a, i.target_id FROM reach r JOIN imports i ON r.b = i.file_id)"
_SOUND = "sound AS (SELECT * FROM imports WHERE file_id NOT IN (SELECT a FROM reach WHERE b IN (SELECT a FROM reach WHERE a = b)))"


@query(
    "import_cycles", "imports",
    f"""WITH RECURSIVE {_REACH}, e AS (SELECT DISTINCT file_id AS a, target_id AS b FROM imports WHERE file_id IN (SELECT a FROM reach WHERE a = b) AND target_id IN (SELECT a FROM reach WHERE a = b)),
    walk AS (SELECT a AS node, b AS tip, [a, b] AS chain FROM e UNION ALL SELECT node, e.b, list_append(chain, e.b) FROM walk JOIN e ON tip = e.a WHERE node <> tip AND (e.b = node OR NOT list_contains(chain, e.b)) AND len(chain) < 40)
    SELECT node, array_to_string(chain, ' -> ') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY len(chain), chain) AS r FROM walk WHERE node = tip) WHERE r = 1""",
)
def import_cycles(v):
    chains = graph.cycle_chains(v("imports").select(F.col("file_id").alias("a"), F.col("target_id").alias("b")))
    return chains.select("node", F.array_join(F.transform("chain", lambda x: x.cast("string")), " -> ").alias("chain"))


_LEVELS = "edges AS (SELECT DISTINCT file_id, target_id FROM model_imports), lv AS (SELECT DISTINCT file_id, 0 AS d FROM model_definitions UNION SELECT e.file_id, lv.d + 1 FROM lv JOIN edges e ON e.target_id = lv.file_id), level AS (SELECT file_id, max(d) AS d FROM lv GROUP BY 1)"

# The same resolution in SQL: iteration k adds the files of level k to all rows so far.
_FULL = f"""{_LEVELS}, list AS (SELECT file_id, target_id, seq, name, arg_min(alias, pos) AS alias FROM (SELECT DISTINCT * FROM model_imports) GROUP BY 1, 2, 3, 4),
r AS (SELECT -1 AS k, CAST(NULL AS BIGINT) AS file_id, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS body, CAST(NULL AS VARCHAR) AS n1, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS n2, CAST(NULL AS VARCHAR) AS b2
UNION ALL SELECT * FROM (
  WITH k AS (SELECT max(k) + 1 AS k FROM r), ready AS (SELECT file_id FROM level WHERE d = (SELECT k FROM k)), loc AS (SELECT * FROM model_definitions WHERE file_id IN (SELECT file_id FROM ready)),
  got AS (SELECT l.file_id, l.seq AS place, r.kind, l.alias, r.name, r.body, n1, b1, n2, b2, r.place AS spot FROM list l JOIN r ON r.file_id = l.target_id AND r.name IS NOT NULL AND (l.name IS NULL OR l.name = r.name) WHERE l.file_id IN (SELECT file_id FROM ready)),
  al AS (SELECT DISTINCT file_id, place, name, body, alias FROM got WHERE kind = 'term' AND alias IS NOT NULL),
  imp AS (SELECT g.file_id, g.place, g.kind, coalesce(g.alias, g.name) AS name, g.body, coalesce(x.alias, n1) AS n1, b1, coalesce(y.alias, n2) AS n2, b2, spot FROM got g
    LEFT JOIN al x ON x.file_id = g.file_id AND x.place = g.place AND x.name = n1 AND x.body = b1 LEFT JOIN al y ON y.file_id = g.file_id AND y.place = g.place AND y.name = n2 AND y.body = b2),
  taken AS (SELECT file_id, name, min(place) AS place FROM (SELECT file_id, name, place FROM imp UNION ALL SELECT file_id, name, seq FROM loc WHERE name IS NOT NULL) GROUP BY 1, 2),
  cand AS (SELECT file_id, place, kind, spot, 0 AS i, n1 AS name, b1 AS body FROM imp WHERE b1 IS NOT NULL UNION ALL SELECT file_id, place, kind, spot, 1, n2, b2 FROM imp WHERE b2 IS NOT NULL),
  brought AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY place, kind, spot, i, body) AS o FROM cand) c WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.file_id = c.file_id AND t.name = c.name AND t.place <= c.place)),
  terms AS (SELECT file_id, seq AS place, name, body FROM loc WHERE kind = 'term' UNION ALL SELECT file_id, place, name, body FROM imp WHERE kind = 'term' UNION ALL SELECT file_id, place, name, body FROM brought),
  firsts AS (SELECT file_id, name, place, body FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY place, body) AS o FROM terms) WHERE o = 1),
  own AS (SELECT l.file_id, l.seq AS place, l.kind, l.name, l.body, use1 AS n1, CASE WHEN x.place < l.seq THEN x.body END AS b1, use2 AS n2, CASE WHEN y.place < l.seq THEN y.body END AS b2
    FROM loc l LEFT JOIN firsts x ON x.file_id = l.file_id AND x.name = use1 LEFT JOIN firsts y ON y.file_id = l.file_id AND y.name = use2 WHERE l.kind <> 'term'),
  new AS (SELECT file_id, place, 'term' AS kind, name, body, NULL AS n1, NULL AS b1, NULL AS n2, NULL AS b2 FROM terms UNION ALL SELECT file_id, place, kind, name, body, n1, b1, n2, b2 FROM imp WHERE kind <> 'term' UNION ALL SELECT * FROM own)
  SELECT (SELECT k FROM k), file_id, min(place), kind, name, body, n1, b1, n2, b2 FROM new WHERE (SELECT k FROM k) <= (SELECT max(d) FROM level) GROUP BY ALL
  UNION ALL SELECT (SELECT k FROM k), file_id, place, kind, name, body, n1, b1, n2, b2 FROM r WHERE file_id IS NOT NULL AND (SELECT k FROM k) <= (SELECT max(d) FROM level))),
model AS (SELECT * FROM r WHERE k = (SELECT max(k) FROM r) AND file_id IS NOT NULL)"""


def _definitions(v):
    uses = F.when(F.col("kind") == "term", F.array().cast("array<string>")).otherwise(F.array("use1", "use2"))
    return v("model_definitions").select("file_id", "seq", "kind", "name", "body", uses.alias("uses"))


def _model(v):
    return resolution.resolved(v("model_imports"), _definitions(v))


_PARTS = "CASE WHEN kind <> 'term' THEN n1 || '=' || coalesce(b1, '?') || ';' || n2 || '=' || coalesce(b2, '?') ELSE '' END"


@query("resolved_definitions", "model_imports model_definitions", f"WITH RECURSIVE {_FULL} SELECT file_id, CAST(place AS BIGINT) AS place, kind, name, body, {_PARTS} AS parts FROM model")
def resolved_definitions(v):
    parts = F.array_join(F.transform("parts", lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["body"], F.lit("?")))), ";")
    return _model(v).withColumn("parts", parts)


@query(
    "undefined_references_imported", "model_imports model_definitions",
    f"""WITH RECURSIVE {_FULL}, refs AS (SELECT file_id, seq, unnest(['first', 'second']) AS role, unnest([use1, use2]) AS term FROM model_definitions WHERE kind <> 'term'),
    f AS (SELECT file_id, name, min(place) AS p FROM model WHERE kind = 'term' GROUP BY 1, 2) SELECT r.file_id, r.term, CAST(seq AS BIGINT) AS seq, role FROM refs r LEFT JOIN f ON f.file_id = r.file_id AND f.name = r.term WHERE p IS NULL OR p >= seq""",
)
def undefined_references_imported(v):
    refs = v("model_definitions").where("kind <> 'term'").select("file_id", F.col("seq").cast("long").alias("seq"), F.explode(F.create_map(F.lit("first"), "use1", F.lit("second"), "use2")).alias("role", "term"))
    return resolution.undefined_references(refs, _model(v))


@query(
    "collected_warnings", "model_imports model_definitions",
    f"""WITH RECURSIVE {_LEVELS.replace("edges AS", "st AS (SELECT DISTINCT file_id, target_id, seq FROM model_imports), edges AS")}, own AS (SELECT file_id, seq, kind || ' ' || name || ': ' || body AS text FROM model_definitions WHERE name IS NOT NULL AND length(body) % 3 = 0),
    walk AS (SELECT file_id, file_id AS at_file, CAST([] AS BIGINT[]) AS path FROM (SELECT DISTINCT file_id FROM st UNION SELECT file_id FROM own) UNION ALL SELECT w.file_id, s.target_id, list_append(path, s.seq) FROM walk w JOIN st s ON w.at_file = s.file_id)
    SELECT w.file_id, array_to_string(list_append(path, o.seq), '.') AS "at", text FROM walk w JOIN own o ON w.at_file = o.file_id""",
)
def collected_warnings(v):
    own = v("model_definitions").where("name is not null and length(body) % 3 = 0").select("file_id", "seq", F.concat("kind", F.lit(" "), "name", F.lit(": "), "body").alias("text"))
    return resolution.collected_warnings(v("model_imports"), own).withColumn("at", F.array_join(F.transform("at", lambda x: x.cast("string")), "."))


@query(
    "warning_counts", "imports definitions",
    f"""WITH RECURSIVE {_REACH}, {_SOUND}, own AS (SELECT file_id, file_id % 3 AS n FROM definitions WHERE seq = 1),
    walk AS (SELECT file_id, target_id AS at FROM sound UNION ALL SELECT w.file_id, s.target_id FROM walk w JOIN sound s ON w.at = s.file_id)
    SELECT file_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT file_id, n FROM own UNION ALL SELECT w.file_id, o.n FROM walk w JOIN own o ON w.at = o.file_id) GROUP BY 1""",
)
def warning_counts(v):
    own = v("definitions").where("seq = 1").select("file_id", (F.col("file_id") % 3).alias("n"))
    return imports.collected_warnings(imports.acyclic(v("imports")), own)


@query(
    "import_with_relationships", "terms relationships",
    """WITH n AS (SELECT DISTINCT (ontology_id + 1) % 50 AS ontology_id, ontology_id AS source_id, name, CASE WHEN seq % 5 = 0 THEN name || '_x' ELSE name END AS final FROM terms WHERE seq % 10 > 0)
    SELECT DISTINCT a.ontology_id, a.final AS parent, relationship, b.final AS child FROM relationships r JOIN n a ON a.source_id = r.ontology_id AND a.name = parent
    JOIN n b ON b.source_id = r.ontology_id AND b.name = child AND a.ontology_id = b.ontology_id WHERE r.name IS NULL""",
)
def import_with_relationships(v):
    names = v("terms").where("seq % 10 > 0").selectExpr("(ontology_id + 1) % 50 as ontology_id", "ontology_id as source_id", "name", "case when seq % 5 = 0 then name || '_x' else name end as final").distinct()
    return imports.relationships_of_imported(names, v("relationships"))


def _quoted(c):
    return f"chr(39) || lower(trim({c})) || chr(39)"


@query(
    "prompt_text", "terms functions function_args",
    f"""WITH c AS (SELECT ontology_id, string_agg({_quoted('name')} || ', ' || {_quoted('label')} || ', ' || {_quoted('description')}, chr(10) ORDER BY seq) AS classes FROM terms GROUP BY 1),
    a AS (SELECT ontology_id, function, string_agg({_quoted('term')} || ': ' || {_quoted('label')}, ', ' ORDER BY pos, {_quoted('term')} || ': ' || {_quoted('label')}) AS inputs FROM function_args GROUP BY 1, 2),
    f AS (SELECT f.ontology_id, string_agg({_quoted('name')} || ', ' || {_quoted('label')} || ', (' || coalesce(inputs, '') || ') -> ' || {_quoted('output_term')} || ': ' || {_quoted('output_label')}, chr(10) ORDER BY seq) AS functions
      FROM functions f LEFT JOIN a ON a.ontology_id = f.ontology_id AND a.function = f.name GROUP BY 1)
    SELECT coalesce(c.ontology_id, f.ontology_id) AS ontology_id, coalesce(classes, '') AS classes, coalesce(functions, '') AS functions FROM c FULL JOIN f ON c.ontology_id = f.ontology_id""",
)
def prompt_text(v):
    return suggestions.prompts(v("terms").withColumn("label", F.concat("label", F.lit("\n 	"))), v("functions"), v("function_args"))


@query("reply_json", "replies", "SELECT conv_id, turn, regexp_extract(reply, '(?s)(\\{.*\\})', 1) AS json FROM replies")
def reply_json(v):
    return v("replies").select("conv_id", "turn", suggestions.reply_json(F.col("reply")).alias("json"))


_SUGGESTED = """sug AS (SELECT ontology_id, conv_id, turn, conv_id % 5 = 0 AS bi, CASE WHEN conv_id % 3 = 0 THEN 'is a' END AS title, 't' || CAST(conv_id AS VARCHAR) AS p, 't' || CAST(conv_id + turn * 50 AS VARCHAR) AS c, CASE turn % 3 WHEN 0 THEN 'inheritance' ELSE 'composition' END AS relationship FROM replies WHERE turn % 3 < 2 AND conv_id % 7 > 0)"""
_RESOLVED = """res AS (SELECT ontology_id, conv_id, turn, 0 AS pos, CASE WHEN relationship = 'inheritance' THEN c ELSE p END AS parent, CASE WHEN relationship = 'inheritance' THEN p ELSE c END AS child, relationship, title, bi AS bidirectional, 'c' AS comment FROM sug
  WHERE EXISTS (SELECT 1 FROM terms t WHERE t.ontology_id = sug.ontology_id AND t.name = p) AND EXISTS (SELECT 1 FROM terms t WHERE t.ontology_id = sug.ontology_id AND t.name = c))"""
_KEPT = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY ontology_id, parent, child ORDER BY conv_id, turn) AS r FROM {}) WHERE r = 1"
_NEW = "new AS (" + _KEPT.format("(SELECT * FROM res WHERE NOT EXISTS (SELECT 1 FROM relationships x WHERE x.ontology_id = res.ontology_id AND x.parent = res.parent AND x.child = res.child))") + ")"


def _resolved(v):
    return suggestions.resolve(suggestions.reply_relationships(v("replies")), v("terms"))


def _new(v):
    return suggestions.new_only(_resolved(v), v("relationships"))


@query("reply_relationships", "replies", f"WITH {_SUGGESTED} SELECT ontology_id, conv_id, turn, 0 AS pos, p AS parent, c AS child, relationship, title, bi AS bidirectional, 'c' AS comment FROM sug")
def reply_relationships(v):
    return suggestions.reply_relationships(v("replies"))


@query("resolve_suggestions", "replies terms", f"WITH {_SUGGESTED}, {_RESOLVED} SELECT * FROM res")
def resolve_suggestions(v):
    return _resolved(v)


@query("suggestions_keep_first", "replies terms", f"WITH {_SUGGESTED}, {_RESOLVED} {_KEPT.format('res')}")
def suggestions_keep_first(v):
    return suggestions.keep_first(_resolved(v))


@query("new_edges_only", "replies terms relationships", f"WITH {_SUGGESTED}, {_RESOLVED}, {_NEW} SELECT * FROM new")
def new_edges_only(v):
    return _new(v)


@query("suggestion_snippet", "replies terms relationships", f"WITH {_SUGGESTED}, {_RESOLVED}, {_NEW} SELECT conv_id, 'hierarchy:' || chr(10) || string_agg('  # c' || chr(10) || '  ' || parent || ' ' || relationship || ' ' || child || CASE WHEN title IS NOT NULL OR bidirectional THEN ', {{ ' || concat_ws(', ', 'title: ''' || title || '''', CASE WHEN bidirectional THEN 'direction: ''bidirectional''' END) || ' }}' ELSE '' END, chr(10) ORDER BY turn) AS snippet FROM new GROUP BY 1")
def suggestion_snippet(v):
    return suggestions.snippets(_new(v))


@query("merged_hierarchy", "replies terms relationships", f"WITH {_SUGGESTED}, {_RESOLVED}, {_NEW} SELECT ontology_id, 0 AS part, seq, parent, relationship, child FROM relationships UNION ALL SELECT ontology_id, 1, conv_id * 1000 + turn, parent, relationship, child FROM new")
def merged_hierarchy(v):
    return suggestions.merged_hierarchy(v("relationships"), _new(v))
