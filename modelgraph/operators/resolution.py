"""Full models after imports, level by level: a file is resolved once, when all files that it
imports are. No join is by name alone; the file is always part of the key."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgraph.operators.graph import settled

#: Looked up in this order, as names share one namespace.
KIND_ORDER = "case kind when 'term' then 0 when 'function' then 1 else 2 end"


def by_level(files: DataFrame, edges: DataFrame, step: Callable[[DataFrame, DataFrame | None], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """The union of step(ready, done) over the levels of imports. files(file_id), acyclic
    edges(file_id, target_id); ready(file_id): the files all of whose targets are done; done: what
    the levels before gave (None at first). Each level is written, so none is computed again. A cycle,
    or more levels than most_rounds, is an error."""
    left = settled(files.select("file_id").distinct())
    waits = settled(edges.select("file_id", "target_id").distinct().join(left.withColumnRenamed("file_id", "target_id"), "target_id", "left_semi"))
    done = None
    for _ in range(most_rounds):
        ready = settled(left.join(waits.select("file_id").distinct(), "file_id", "left_anti"))
        if ready.isEmpty():
            if left.isEmpty():
                return done if done is not None else step(ready, None)
            raise RuntimeError("imports run in a circle")
        rows = settled(step(ready, done))
        done = rows if done is None else done.unionByName(rows)
        left = settled(left.join(ready, "file_id", "left_anti"))
        waits = settled(waits.join(ready.withColumnRenamed("file_id", "target_id"), "target_id", "left_anti"))
    raise RuntimeError(f"imports deeper than {most_rounds}")


#: What rows carry of their file: its level, and whether any file imports it.
_FILE = ("file_id", "imported")


def import_levels(files: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, int]:
    """file_id, level, imported of each file, and the number of levels. Found on the edges alone, so that
    everything else is told by level once and not joined with each level's files."""
    n = count()
    levels = by_level(files, edges, lambda ready, done: ready.withColumn("level", F.lit(next(n))), most_rounds)
    targets = edges.select(F.col("target_id").alias("file_id")).distinct().withColumn("imported", F.lit(True))
    return settled(levels.join(targets, "file_id", "left").withColumn("imported", F.coalesce("imported", F.lit(False)))), next(n)


def _part_key(name: Column, body: Column) -> Column:
    return F.concat_ws("\u0000", name, body)


def _imported(statements: DataFrame, done: DataFrame) -> DataFrame:
    """What import statements bring, under its new names: file_id, imported, level (of the importing file), place,
    kind, name, body, parts and at (place in the target). Of a name listed twice in a statement the first
    listing counts. A part that is itself an aliased term of the statement shows the alias."""
    who = [*_FILE, "level", "target_id", "seq"]
    listed = statements.where("name is not null").groupBy(*who, "name").agg(F.min_by("alias", "pos").alias("alias"))
    starred = statements.where("name is null").select(*who).distinct()
    rows = done.where("name is not null").select(F.col("file_id").alias("target_id"), F.col("place").alias("at"), "kind", "name", "body", "parts")
    found = starred.join(rows, "target_id").withColumn("alias", F.lit(None).cast("string"))
    found = found.unionByName(listed.join(rows, ["target_id", "name"]))
    # Aliases are in the statements; only the terms that have one are looked at for them.
    renamed = listed.where("alias is not null").join(rows.where("kind = 'term'").select("target_id", "name", "body"), ["target_id", "name"])
    new = renamed.groupBy("file_id", "seq").agg(F.map_from_entries(F.collect_set(F.struct(_part_key(F.col("name"), F.col("body")), "alias"))).alias("new"))
    found = found.join(new, ["file_id", "seq"], "left")
    part = lambda p: F.struct(F.coalesce(F.try_element_at("new", _part_key(p["name"], p["body"])), p["name"]).alias("name"), p["body"].alias("body"))
    return found.select(*_FILE, "level", F.col("seq").alias("place"), "kind", F.coalesce("alias", "name").alias("name"), "body", F.when(F.col("new").isNull(), F.col("parts")).otherwise(F.transform("parts", part)).alias("parts"), "at")


def _brought_along(imported: DataFrame, local: DataFrame) -> DataFrame:
    """Terms that imported functions and relationships use, where their names are still free: not
    declared or imported before or by the statement itself. Of several ones of a name the first
    comes: by statement, kind, place in the target and place in the list."""
    parts = imported.where("kind <> 'term'").withColumn("k", F.expr(KIND_ORDER)).select(*_FILE, "place", "k", "at", F.posexplode("parts").alias("i", "p")).where("p.body is not null")
    first = parts.groupBy(*_FILE, F.col("p.name").alias("name")).agg(F.min(F.struct("place", "k", "at", "i", F.col("p.body").alias("body"))).alias("f"))
    taken = imported.select("file_id", "name", "place").unionByName(local.where("name is not null").select("file_id", "name", F.col("seq").alias("place"))).groupBy("file_id", "name").agg(F.min("place").alias("taken"))
    free = first.join(taken, ["file_id", "name"], "left").where("taken is null or taken > f.place")
    return free.select(*_FILE, "f.place", F.lit("term").alias("kind"), "name", "f.body", F.array().cast("array<struct<name:string,body:string>>").alias("parts"))


def resolved(imports: DataFrame, definitions: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """The full model of each file.

    imports(file_id, target_id, seq, pos, name, alias): one row per name that the statement at
    seq lists (pos: its place in the list), one with a null name for all; acyclic (see
    `imports.acyclic`), targets without definitions bring nothing. definitions(file_id, seq, kind,
    name, body, uses): what files declare themselves; body is whatever counts for equality by
    value, uses the names of the terms a function or relationship refers to, in order.

    -> file_id, place, kind, name, body, parts (array of name, body): a row per file, kind, name
    and content (body and parts), at the first place that has it: that of the declaration or of
    the import statement. Names of parts are resolved where they are declared, against terms before them
    (body null: undefined), and travel with the row, so equality is deep. An imported
    function or relationship brings its terms along where their names are free. Two contents of a
    name are a conflict; both are kept. Unnamed relationships are not imported."""
    asked = settled(imports.select("file_id", "target_id", F.col("seq").cast("long").alias("seq"), "pos", "name", "alias").distinct())
    definitions = definitions.select("file_id", F.col("seq").cast("long").alias("seq"), "kind", "name", "body", "uses")
    levels, n = import_levels(definitions.select("file_id").unionByName(asked.select("file_id")), asked.select("file_id", "target_id"), most_rounds)
    # Each declaration and statement gets its level once; a level's rows are then told without a shuffle.
    declared = settled(definitions.join(levels, "file_id"))
    statements = settled(asked.join(levels, "file_id").join(levels.select(F.col("file_id").alias("target_id"), F.col("level").alias("from")), "target_id"))

    def step(local: DataFrame, found: DataFrame | None) -> DataFrame:
        no_parts = F.array().cast("array<struct<name:string,body:string>>").alias("parts")
        terms = local.where("kind = 'term'").select(*_FILE, F.col("seq").alias("place"), "kind", "name", "body", no_parts)
        rows = terms
        if found is not None:
            terms = terms.unionByName(found.where("kind = 'term'").drop("at")).unionByName(_brought_along(found, local))
            rows = terms.unionByName(found.where("kind <> 'term'").drop("at"))
        first = terms.groupBy("file_id", F.col("name").alias("use")).agg(F.min(F.struct("place", "body")).alias("t"))
        others = local.where("kind <> 'term'").select(*_FILE, "seq", "kind", "name", "body", F.posexplode_outer("uses").alias("i", "use")).join(first, ["file_id", "use"], "left")
        part = F.struct("i", F.struct(F.col("use").alias("name"), F.when(F.col("t.place") < F.col("seq"), F.col("t.body")).alias("body")).alias("p"))
        others = others.groupBy(*_FILE, F.col("seq").alias("place"), "kind", "name", "body").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), part))).alias("ps"))
        rows = rows.unionByName(others.select(*_FILE, "place", "kind", "name", "body", F.transform("ps", lambda p: p["p"]).alias("parts")))
        return rows.groupBy(*_FILE, "kind", "name", "body", "parts").agg(F.min("place").alias("place")).select(*_FILE, "place", "kind", "name", "body", "parts")

    # What a level gives is taken to the files that import it at once, whatever their levels, and only what is imported.
    done, brought = None, None
    for k in range(max(n, 1)):
        rows = settled(step(declared.where(F.col("level") == k), None if brought is None else brought.where(F.col("level") == k).drop("level")))
        done = rows if done is None else done.unionByName(rows)
        if k < n - 1:
            new = settled(_imported(statements.where(F.col("from") == k), rows.where("imported")))
            brought = new if brought is None else brought.unionByName(new)
    return done.drop("imported")


def collected_warnings(imports: DataFrame, warnings: DataFrame, most_rows: int = 1_000_000_000, most_rounds: int = 1000) -> DataFrame:
    """imports(file_id, target_id, seq) acyclic, warnings(file_id, seq, text) -> file_id, at, text:
    the warnings of each file in the order in which they arise. At an import statement all
    warnings of the imported file arise, its own imports' in their turn, once for each path; `at`
    holds the places along the path, so a file's list is sorted by it. Paths can multiply: more
    than most_rows rows in a level is an error, and `imports.collected_warnings` counts without listing."""
    statements = settled(imports.select("file_id", "target_id", F.col("seq").cast("long").alias("seq")).distinct())
    own = settled(warnings.select("file_id", F.array(F.col("seq").cast("long")).alias("at"), "text"))

    def step(ready: DataFrame, done: DataFrame | None) -> DataFrame:
        rows = own.join(ready, "file_id", "left_semi")
        if done is not None:
            brought = statements.join(ready, "file_id", "left_semi").join(done.withColumnRenamed("file_id", "target_id"), "target_id")
            if brought.count() > most_rows:
                raise RuntimeError(f"over {most_rows} warnings along import paths")
            rows = rows.unionByName(brought.select("file_id", F.concat(F.array("seq"), "at").alias("at"), "text"))
        return rows

    return by_level(own.select("file_id").unionByName(statements.select("file_id")), statements, step, most_rounds)


def undefined_references(refs: DataFrame, full: DataFrame) -> DataFrame:
    """refs(file_id, seq, role, term), full: the resolved models -> uses of a term that nothing
    before them declares, neither the file itself nor one of its imports."""
    first = full.where("kind = 'term'").groupBy("file_id", F.col("name").alias("term")).agg(F.min("place").alias("declared"))
    return refs.join(first, ["file_id", "term"], "left").where("declared is null or declared >= seq").drop("declared")
