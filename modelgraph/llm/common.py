"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, the session's spark.checkpoint.dir. Only on one
    machine (tests) a folder of our own stands in for it; on a cluster its absence is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written to the shared folder in place of a growing lineage, and removed when they
    have been replaced. A lost executor's work is done again from them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made: list[tuple[DataFrame, str]] = []
        self.number = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.number}"
        self.number += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Remove all tables but these."""
        kept = [(df, path) for df, path in self.made if any(df is k for k in keep)]
        for _, path in self.made:
            if path not in {p for _, p in kept}:
                remove(self.spark, path)
        self.made = kept


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ours from the file system that it lies on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def chosen(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is (left_semi) or is not (left_anti) in ids; the key is all columns
    of ids. Rows with a null in it count as not in ids. Spark sends ids to all executors only
    up to spark.sql.autoBroadcastJoinThreshold bytes, else both sides are shuffled."""
    ids = checkpointed(ids.dropna().distinct())
    return df.join(ids, ids.columns, how).select(*df.columns)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: uniform bits from structured ones."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Base of the polynomial hashes (odd) and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


class Powers:
    """Powers of BASE and of its inverse, grown on demand (in a worker)."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE**i modulo 2**64, one longer than data."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of data[start:end], from prefix_hash(data)."""
    _, down = POWERS.upto(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


_STATE: dict = {}


def worker_state(key: str, make):
    """What make() returns, kept in a Python worker from one task of a job to the next."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def letters(col: str = "text"):
    """The text column, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def light(df: DataFrame, most_mb: float) -> bool:
    """Whether the rows of df, written as JSON, have at most most_mb megabytes: the bound behind a broadcast."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most_mb * 1e6
