"""Streams of edits and builds; each function works on a static DataFrame as well.

Edits are (project_id, name, ts, content). Watermarks bound the state and are ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch_sources(spark: SparkSession, path: str, suffix: str = "ontol") -> DataFrame:
    """A stream of new files below a folder (file, content). A file source reads a path once;
    changes of known files come from the stream of edits."""
    return (
        spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    )


def watched(files: DataFrame, edits: DataFrame, suffix: str = "ontol") -> DataFrame:
    """files(file, content) of watch_sources and edits(name, ts, content) -> file, ts (null for the first
    sight), content: every source once, and again whenever it changes; names of other suffixes are left out."""
    first = files.select("file", F.lit(None).cast("timestamp").alias("ts"), "content")
    changes = edits.where(F.col("name").endswith(f".{suffix}")).select(F.col("name").alias("file"), F.col("ts").cast("timestamp").alias("ts"), "content")
    return first.unionByName(changes)


def debounced(edits: DataFrame, gap: str = "800 milliseconds", late: str = "10 seconds") -> DataFrame:
    """project_id, name, saved_at, content, n: one save after each pause of `gap` in the edits
    of a file, with its last content. An edit exactly one gap later still joins."""
    rows = edits.withWatermark("ts", late) if edits.isStreaming else edits
    window = F.session_window("ts", gap)
    out = rows.groupBy(window.alias("w"), "project_id", "name").agg(F.max(F.struct("ts", "content")).alias("l"), F.count("*").alias("n"))
    return out.select("project_id", "name", F.col("w.end").alias("saved_at"), "l.content", "n")


def changed_only(saves: DataFrame, stored: DataFrame) -> DataFrame:
    """Saves whose content differs from the stored one."""
    s = stored.select("project_id", "name", F.col("content").alias("old"))
    return saves.join(s, ["project_id", "name"], "left").where("not (content <=> old)").drop("old")


def upsert(edits: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Latest content of each (project_id, name) over a batch of edits and what is stored."""
    rows = edits.select("project_id", "name", "ts", "content")
    rows = rows if stored is None else rows.unionByName(stored.select("project_id", "name", "ts", "content"))
    return rows.groupBy("project_id", "name").agg(F.max(F.struct("ts", "content")).alias("l")).select("project_id", "name", "l.ts", "l.content")


def _bucketed(df: DataFrame, buckets: int):
    return df.withColumn("bucket", F.pmod(F.xxhash64("project_id", "name"), F.lit(buckets)).cast("int"))


def stored_files(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The store at path: the latest content of every file, as of batch `before` (not included). Of each
    bucket only its newest version is read: the versions are told from the folders' names."""
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["bucket", "batch"], "left_semi")


def write_upserts(batch: DataFrame, number: int, path: str, buckets: int = 64) -> None:
    """Merge one batch of edits into the store. Files are dealt to buckets by a hash of their key; only
    buckets that the batch touches are read and written, as a version of their own named by the
    batch. Older versions stay until the next but one, so a batch that failed halfway, or comes
    again, is merged with what was there before it and replaces its own version alone."""
    spark = batch.sparkSession
    edits = _bucketed(batch.select("project_id", "name", "ts", "content"), buckets).persist()
    touched = sorted(r.bucket for r in edits.select("bucket").distinct().collect())
    if touched:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = None
        if number and fs.exists(target):
            old = stored_files(spark, path, number).where(F.col("bucket").isin(touched))
        new = _bucketed(upsert(edits, old), buckets).withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        for bucket in touched:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
            versions = sorted(int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(folder))
            for version in versions[: versions.index(number)][:-1]:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}/batch={version}"), True)
    edits.unpersist()


def start_upserts(edits: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keeps the store at path the latest version of every file; see write_upserts."""
    write = lambda batch, number: write_upserts(batch, number, path, buckets)
    return edits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed_out(requests: DataFrame, results: DataFrame, limit: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """requests(job, req_ts), results(job, res_ts) -> requests without a result within the limit."""
    if requests.isStreaming:
        requests, results = requests.withWatermark("req_ts", late), results.withWatermark("res_ts", late)
    r = results.withColumnRenamed("job", "res_job")
    on = F.expr(f"job = res_job and res_ts >= req_ts and res_ts <= req_ts + interval {limit}")
    return requests.join(r, on, "left_outer").where("res_ts is null").select("job", "req_ts")
