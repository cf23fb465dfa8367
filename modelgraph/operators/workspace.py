"""Users, projects and files: names, access, entries, newest versions, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgraph.operators.exports import json_of, texts


def flat_name_ok(name: Column) -> Column:
    """A file or project name that is no path: not empty, not '.' or '..', without separators."""
    t = F.trim(name)
    return (t != "") & ~t.isin(".", "..") & ~t.rlike(r"[/\\]")


def with_extension(name: Column) -> Column:
    return F.when(name.endswith(".ontol") | name.endswith(".tdl"), name).otherwise(F.concat(name, F.lit(".ontol")))


def engine(name: Column) -> Column:
    return F.when(name.endswith(".tdl"), "classes").otherwise("ontology")


def username_ok(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_-]{3,32}$")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


#: Cyrillic letters and their Latin spelling; letters of one sign first.
CYRILLIC, LATIN = "абвгдезийклмнопрстуфхцыэё", "abvgdezijklmnoprstufhcyee"
CYRILLIC_LONG = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ъ": "", "ь": ""}
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by underscores; letters outside the tables are dropped."""
    t = F.translate(F.lower(F.trim(text)), CYRILLIC + ACCENTED, LATIN + PLAIN)
    for a, b in CYRILLIC_LONG.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), " ", "_")


def owned(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(id, owner_id) for projects: which are found, that is, the requester's own."""
    mine = projects.select("id", "owner_id", F.lit(True).alias("found"))
    return requests.join(mine, ["id", "owner_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def cascade_delete(deleted: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """Files that stay when the users deleted(id) go, with their projects."""
    gone = projects.join(deleted.select(F.col("id").alias("owner_id")), "owner_id", "left_semi").select(F.col("id").alias("project_id"))
    return files.join(gone, "project_id", "left_anti")


def choose_entry(projects: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The file to build for each project: the wanted(id, entry) one if it exists, else
    main.ontol, else the first by name; else an error."""
    have = files.groupBy(F.col("project_id").alias("id")).agg(F.max(F.col("name") == "main.ontol").alias("main"), F.min("name").alias("first"))
    asked = wanted.join(files.select(F.col("project_id").alias("id"), F.col("name").alias("entry")).distinct().withColumn("there", F.lit(True)), ["id", "entry"], "left")
    p = projects.select("id").join(have, "id", "left").join(asked, "id", "left")
    error = F.when(F.col("first").isNull(), "Project has no files").when(F.col("entry").isNotNull() & F.col("there").isNull(), "entry not found")
    entry = F.coalesce("entry", F.when(F.col("main"), "main.ontol"), "first")
    return p.select("id", F.when(error.isNull(), entry).alias("entry"), error.alias("error"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def latest_version(files: DataFrame) -> DataFrame:
    """Newest content of each (project, name); max_by aggregates before the shuffle."""
    last = F.struct("updated_at", "seq", "content")
    return files.groupBy("project_id", "name").agg(F.max(last).alias("l")).select("project_id", "name", "l.updated_at", "l.content")


def list_projects(projects: DataFrame, owner: int | None = None) -> DataFrame:
    """Projects by owner and name; of one owner if that is given."""
    mine = projects if owner is None else projects.where(F.col("owner_id") == owner)
    return mine.orderBy("owner_id", "name", "id")


def list_files(files: DataFrame, project: int | None = None) -> DataFrame:
    """Files by project and name, without their content; of one project if that is given."""
    mine = files if project is None else files.where(F.col("project_id") == project)
    return mine.select("project_id", "name", "updated_at").distinct().orderBy("project_id", "name", "updated_at")


def build_results(entries: DataFrame, json: DataFrame, puml: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row per entry(id): ok, json, puml, warnings, error. errors(id, seq, text): the first by place
    is the result's, as a build stops there, and such an entry has neither exports nor warnings; warnings(id, seq,
    text) come in order, without terminal codes. json(id, json) and puml(id, puml) are the exports, or their
    pieces (id, section, piece, text; see `exports`), which are put together here.

    All that belongs to an entry meets in one aggregation: a join would sort and copy whole exports again."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    piece = lambda df, of, section, place, text: df.select("id", F.lit(of).alias("of"), section.cast("long").alias("section"), place.cast("long").alias("piece"), text.alias("text"))
    export = lambda df, of: piece(df, of, F.col("section"), F.col("piece"), F.col("text")) if "piece" in df.columns else piece(df, of, zero, zero, F.col(of))
    first = errors.groupBy("id").agg(F.min(F.struct("seq", "text"))["text"].alias("text"))
    rows = piece(entries.select("id").distinct(), "entry", zero, zero, none)
    for part in (export(json, "json"), export(puml, "puml"), piece(first, "error", zero, zero, F.col("text")), piece(warnings, "warning", zero, F.col("seq"), F.col("text"))):
        rows = rows.unionByName(part)
    of = lambda kind: F.col("of") == kind
    ok = F.count_if(of("error")) == 0
    made = json_of(of("json")) if "piece" in json.columns else F.concat_ws("", texts(of("json")))
    there = lambda kind: ok & (F.count_if(of(kind) & F.col("text").isNotNull()) > 0)
    said = F.when(ok, F.transform(texts(of("warning")), strip_ansi)).otherwise(F.array().cast("array<string>"))
    found = rows.groupBy("id").agg(
        F.when(F.count_if(of("entry")) > 0, ok).alias("ok"), F.when(there("json"), made).alias("json"), F.when(there("puml"), F.concat_ws("\n", texts(of("puml")))).alias("puml"), said.alias("warnings"),
        F.try_element_at(texts(of("error")), F.lit(1)).alias("error"),
    )
    return found.where("ok is not null")
