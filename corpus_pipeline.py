"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Quality classifier, near-duplicates, benchmark decontamination, personal data, encoding.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm import bpe, decontaminate, minhash, pii, quality
from modelgraph.llm.common import checkpointed, chosen, shared_folder, table, unused


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier doesn't reject. Each row is judged by its text
    (null counts as empty); all columns stay as they are, and an empty table stays empty."""
    name = unused(docs, "quality_score")
    scored = quality.score(docs, quality.fitted(spark, docs, sf_dir), name=name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8). Of rows
    that repeat an id and its text one stays; rows without an id, and texts without words, all
    stay; rows of one id with different texts are judged each by its own."""
    found = minhash.grouped_texts(docs)
    key = unused(docs, "key")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = found.where("not kept").select("doc_id", F.col("tx").alias(key))
    rows = chosen(rows, gone, how="left_anti")
    # Of a row that is repeated, id and text alike, one stays.
    again = found.where("kept").groupBy("doc_id", F.col("tx").alias(key)).count().where("count > 1")
    again = checkpointed(again.select("doc_id", key).dropna())
    if not again.isEmpty():
        rows = chosen(rows, again, how="left_anti").unionByName(chosen(rows, again).dropDuplicates(["doc_id", key]))
    return rows.drop(key)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other parameters. Each row is judged
    by its own text: rows that share an id with a contaminated one stay, contaminated rows without
    an id go."""
    key = unused(docs, "key")
    rows = docs.withColumn(key, F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx")))
    found = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return chosen(rows, found.select(F.col("doc_id").alias(key)), how="left_anti").drop(key)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text (null of a null
    text). Ids are not looked at; all other columns stay as they are."""
    out = pii.redact(docs, *pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hashes of the ids and of the decoded bytes, a row for each row."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("personal data", redacted),
    ("encoding", encoded),
]

#: SQL can't express the classifier, the boosted trees and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
