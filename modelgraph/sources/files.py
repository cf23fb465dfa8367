"""Model files as tables: one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_models(spark: SparkSession, path: str, suffix: str = "ontol") -> DataFrame:
    """file, content of all files of a suffix (ontol, tdl, svg) below a folder, or of a glob."""
    reader = spark.read
    if "*" not in path and not path.endswith(f".{suffix}"):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def write_texts(df: DataFrame, key: str, text: str, path: str) -> None:
    """One row per document, partitioned by nothing but the tasks; the key goes with its text."""
    df.select(key, text).write.mode("errorifexists").parquet(path)
