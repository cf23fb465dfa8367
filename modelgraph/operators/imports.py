"""Imports between model files: paths, selected and starred names, conflicts, full resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgraph.operators.graph import into_cycles, settled


def import_key(file_path: Column, src: Column) -> Column:
    """What an import statement points to: a URL as it is, else an absolute normal path."""
    folder = F.regexp_extract(file_path, "^(.*/)?[^/]*$", 1)
    parts = F.split(F.when(src.startswith("/"), src).otherwise(F.concat(folder, src)), "/")

    def step(done, p):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(p.isin("", "."), done).when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    normal = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(src.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), src).otherwise(normal)


def missing_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    return imports.join(files.select(F.col("file_id").alias("target_id")).distinct(), "target_id", "left_anti")


def selective(listed: DataFrame, definitions: DataFrame) -> DataFrame:
    """listed(file_id, target_id, seq, name, alias) -> the definitions they bring, under the
    alias; of a name listed twice in a file from one target the first listing counts."""
    first = listed.groupBy("file_id", "target_id", "name").agg(F.min(F.struct("seq", "alias")).alias("l"))
    d = definitions.select(F.col("file_id").alias("target_id"), "name", "label", "description")
    return first.join(d, ["target_id", "name"]).select("file_id", "target_id", F.coalesce("l.alias", "name").alias("name"), "label", "description")


def starred(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """All named definitions of each target."""
    d = definitions.where("name is not null").select(F.col("file_id").alias("target_id"), "name", "label", "description")
    return imports.select("file_id", "target_id").distinct().join(d, "target_id")


def missing_names(listed: DataFrame, definitions: DataFrame) -> DataFrame:
    d = definitions.select(F.col("file_id").alias("target_id"), "name")
    return listed.join(d, ["target_id", "name"], "left_anti").select("file_id", "target_id", "name")


def dependencies(imported: DataFrame, functions: DataFrame, args: DataFrame, terms: DataFrame, relationships: DataFrame) -> DataFrame:
    """Terms that imported(ontology_id, source_id, name) functions and relationships bring along
    where their name is still free, whatever has it: inputs and output, parent and child."""
    uses = (
        args.select("ontology_id", F.col("function").alias("name"), "term")
        .unionByName(functions.select("ontology_id", "name", F.col("output_term").alias("term")))
        .unionByName(relationships.where("name is not null").select("ontology_id", "name", F.explode(F.array("parent", "child")).alias("term")))
        .withColumnRenamed("ontology_id", "source_id")
    )
    wanted = imported.join(uses, ["source_id", "name"]).select("ontology_id", "source_id", "term").distinct()
    there = terms.select(F.col("ontology_id").alias("source_id"), F.col("name").alias("term"))
    taken = terms.select("ontology_id", "name").unionByName(functions.select("ontology_id", "name")).unionByName(relationships.where("name is not null").select("ontology_id", "name"))
    taken = taken.withColumnRenamed("name", "term")
    return wanted.join(there, ["source_id", "term"], "left_semi").join(taken, ["ontology_id", "term"], "left_anti")


def conflicts(reached: DataFrame) -> DataFrame:
    """reached(file_id, name, content): names with more than one content."""
    found = reached.groupBy("file_id", "name").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    return found.where("lo <> hi").select("file_id", "name")


def content(label: Column, description: Column) -> Column:
    """A digest for equality by value."""
    return F.sha2(F.to_json(F.struct(label.alias("label"), description.alias("description"))), 256)


def acyclic(imports: DataFrame) -> DataFrame:
    """Imports of files from which no cycle is reached."""
    edges = imports.select(F.col("file_id").alias("a"), F.col("target_id").alias("b"))
    return imports.join(into_cycles(edges).withColumnRenamed("node", "file_id"), "file_id", "left_anti")


def summed_over_paths(imports: DataFrame, values: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """values(file_id, n), acyclic imports -> file_id, n: the sum over all import paths that
    leave the file. Sums move back level by level, one row a file: neither paths nor pairs of
    files are listed."""
    edges = settled(imports.select("file_id", F.col("target_id").alias("t")))
    level = values.groupBy("file_id").agg(F.sum("n").alias("n"))
    total = level.limit(0)
    for _ in range(most_rounds):
        level = settled(edges.join(level.withColumnRenamed("file_id", "t"), "t").groupBy("file_id").agg(F.sum("n").alias("n")))
        if level.isEmpty():
            return total.groupBy("file_id").agg(F.sum("n").alias("n"))
        total = total.unionByName(level)
    raise RuntimeError(f"import paths longer than {most_rounds}")


def collected_warnings(imports: DataFrame, warnings: DataFrame) -> DataFrame:
    """warnings(file_id, n) -> file_id, n: own ones and those of imported files, once for each
    import path."""
    brought = summed_over_paths(imports, warnings)
    return warnings.select("file_id", "n").unionByName(brought).groupBy("file_id").agg(F.sum("n").alias("n"))


def relationships_of_imported(names: DataFrame, relationships: DataFrame) -> DataFrame:
    """names(ontology_id, source_id, name, final): imported terms -> unnamed relationships of the
    source with both ends imported, under the final names, without repetition."""
    r = relationships.where("name is null").select(F.col("ontology_id").alias("source_id"), "parent", "relationship", "child")
    end = lambda e: names.select("ontology_id", "source_id", F.col("name").alias(e), F.col("final").alias(f"f_{e}"))
    both = r.join(end("parent"), ["source_id", "parent"]).join(end("child"), ["source_id", "child", "ontology_id"])
    return both.select("ontology_id", F.col("f_parent").alias("parent"), "relationship", F.col("f_child").alias("child")).distinct()
