"""Operator 10: quality classifier by nearest-neighbour voting in a latent semantic space.

A document is the bag of its hashed byte trigrams, damped (log), weighted by inverse document
frequency over all documents and projected on the leading right singular vectors of the
labelled sample. The labelled vectors (at most max_labelled of a fixed width: bounded) are
broadcast; every document's cosines with all of them are computed in blocks, exactly, and its
nearest neighbours vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import letters, table


def trigram_counts(text: str, dims: int) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dims, np.float32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(7)) % np.uint32(dims)
    return np.bincount(code, minlength=dims).astype(np.float32)


def _texts(batches: Iterator[pa.RecordBatch], at: int, rows: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, part.column(at).to_pylist()


def document_frequencies(docs: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Number of documents that hold each hashed trigram, and of all documents. Only sums of
    dims + 1 numbers reach the driver."""

    def run(batches):
        df, n = np.zeros(dims, np.int64), 0
        for _, texts in _texts(batches, 0, 512):
            for t in texts:
                df += trigram_counts(t, dims) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(range(dims + 1), pa.int32()), "n": pa.array([*df.tolist(), n], pa.int64())})

    sums = docs.select(letters().alias("text")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    out = np.zeros(dims + 1, np.int64)
    for r in sums.collect():
        out[r.bin] = r.n
    return out[:dims], int(out[dims])


class Space:
    """The latent semantic space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, label: np.ndarray, df: np.ndarray, n: int, width: int, seed: int = 7) -> None:
        self.idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
        self.prior = float(label.mean()) if len(label) else 0.5
        x = self.weighted(counts)
        width = min(width, *x.shape)
        rng = np.random.default_rng(seed)
        q = rng.standard_normal((x.shape[1], min(width + 16, *x.shape)), np.float32)
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        v = np.linalg.svd(x @ q, full_matrices=False)[2]
        self.axes = np.ascontiguousarray((q @ v.T)[:, :width], np.float32)
        z, there = self.projected(x)
        self.vectors, self.label = z[there], label[there].astype(np.float32)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        return x

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ self.axes
        n = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.maximum(n, 1e-12), n[:, 0] > 1e-9

    def placed(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.projected(self.weighted(counts))

    def scores(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the labels' mean where a
        document has no direction (fewer than three bytes) or no similar neighbour. Equal
        similarities at the border are decided by the labelled rows' order."""
        z, there = self.placed(counts)
        if not len(self.label):
            return np.full(len(counts), self.prior)
        cos = z @ self.vectors.T
        k = min(neighbours, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
        weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 8
        total = weight.sum(1)
        vote = (weight * self.label[near]).sum(1) / np.maximum(total, 1e-300)
        return np.clip(np.where(there & (total > 1e-12), vote, self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4096, dims: int = 2048, width: int = 64) -> Space:
    """docs(doc_id, text, ...): all documents. labels(doc_id, label 0/1): what to learn from; at
    most max_labelled of them are used, the first by a hash of doc_id, so the sample is spread
    evenly and stays the same from run to run. It is bounded, so it is broadcast to the scan of
    the texts. Null labels and labels without a document teach nothing."""
    sample = (
        labels.where("label is not null and doc_id is not null")
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_labelled)
    )
    sample = docs.select("doc_id", letters().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label")

    def run(batches):
        for part, texts in _texts(batches, 0, 256):
            blob = []
            for t in texts:
                c = trigram_counts(t, dims)
                at = np.flatnonzero(c)
                blob.append(at.astype("<u4").tobytes() + c[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({"counts": pa.array(blob, pa.binary()), "label": part.column(1)})

    rows = sample.mapInArrow(run, "counts binary, label int").toArrow()
    label = rows.column("label").to_numpy() if rows.num_rows else np.ones(1, np.int64)
    counts = np.zeros((len(label), dims), np.float32)
    for i, blob in enumerate(rows.column("counts")):
        at, c = np.split(np.frombuffer(blob.as_py(), "<u4"), 2)
        counts[i, at] = c.view("<f4")
    del rows
    df, n = document_frequencies(docs, dims)
    return Space(counts, label, df, n, width)


def score(docs: DataFrame, space: Space, neighbours: int = 15, block: int = 256, name: str = "quality_score") -> DataFrame:
    """docs(doc_id, text, ...) -> the same rows and columns with the score, a double, added under
    name; a column that is already called so gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    dims = len(space.idf)
    at = docs.columns.index("text")
    fields = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in fields]

    def run(batches):
        s = shared.value
        for part, texts in _texts(batches, at, block):
            counts = np.stack([trigram_counts(t or "", dims) for t in texts])
            got = pa.array(s.scores(counts, neighbours), pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), got], names=[*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{kinds}, `{name}` double")


#: A score of at least this is good quality.
THRESHOLD = 0.3


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Space:
    """Learn from the labels of the documents that are not held out."""
    return fit(docs, table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label")))


def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), fitted(spark, docs, sf_dir)).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
