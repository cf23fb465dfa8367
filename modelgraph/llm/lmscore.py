"""Operator 2: cross-entropy difference of two bigram models that share one vocabulary.

The background model is counted over all documents, the target model over the target documents.
The vocabulary of both are the words that occur at least min_count times in all documents; any
other word is the same unknown word to both and makes no difference. Bigrams that occur at
least min_count times are kept (their words then are in the vocabulary). Both models interpolate

    p(v | u) = bigram * c(u v) / c(u) + (1 - bigram) * p(v)

with p(v) = c(v) / N in the background and own * ct(v) / Nt + (1 - own) * c(v) / N in the target
(after an unknown, unseen or missing u just p(v)). A document's score is its mean loss per known
word under the target minus that under the background: low is like the target.

Words and bigrams are 64-bit hashes, of BLAKE2 digests of the words. They are not checked against
the words: of n distinct ones about n * n / 2**65 pairs share a hash and their counts, 3 of 10**10. Blocks of documents send their distinct ones with counts,
packed, to buckets; buckets add up and send back to each block what it asked for, so a word that
is in every document reaches its bucket once from each block. No model is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import U64, checkpointed, letters, mix64, table
from modelgraph.llm.minhash import digests, split

_PAIR = U64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in turn, number of its text)."""
    found = [split(t) for t in texts]
    word = np.concatenate([digests(x)[:, 0] for x in found])
    return word, np.repeat(np.arange(len(found)), [len(x) for x in found])


def pairs(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it in its text; 0 for first words."""
    out = np.zeros(len(word), U64)
    two = mix64(word[:-1] * U64(3) + (word[1:] ^ _PAIR))
    out[1:] = np.where(text[1:] == text[:-1], np.maximum(two, U64(1)), U64(0))
    return out


def chunks(texts: list[str], size: int = 1 << 20):
    """Runs of texts of about size letters (or one longer text)."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as single bytes, those of 255 and more behind them in full."""
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(blob, "<i8", offset=n)
    return c


_STEP = 2**48 - 1


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, six bytes each; those of larger ones in full behind."""
    step = np.diff(keys, prepend=U64(0))
    far = step >= U64(_STEP)
    near = np.where(far, U64(_STEP), step)
    return near.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + step[far].tobytes()


def unpack_keys(blob: bytes, n: int) -> np.ndarray:
    step = np.zeros((n, 8), np.uint8)
    step[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(-1, 6)
    step = step.view(U64).ravel()
    step[step == U64(_STEP)] = np.frombuffer(blob, U64, offset=6 * n)
    return np.cumsum(step, dtype=U64)


def _count_block(buckets: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, target = [], []
        for flag in (False, True):
            for part in chunks(pdf["text"][pdf["target"] == flag].tolist()):
                word, text = word_hashes(part)
                two = pairs(word, text)
                for keys in (word, two[two != 0]):
                    found.append(keys)
                    target.append(np.full(len(keys), flag))
        if not found:
            return pd.DataFrame({"bucket": [], "block": [], "m": [], "keys": [], "n": [], "t": []})
        keys, at, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        t = np.bincount(at, np.concatenate(target), len(keys)).astype(np.int64)
        # Ranges of hashes are buckets, so keys stay sorted in them.
        bucket = (keys >> U64(32)) * U64(buckets) >> U64(32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64)).tolist()
        parts = [(i, slice(cut[i], cut[i + 1])) for i in range(buckets) if cut[i] < cut[i + 1]]
        return pd.DataFrame(
            {
                "bucket": [i for i, _ in parts], "block": key[0], "m": [p.stop - p.start for _, p in parts],
                "keys": [pack_keys(keys[p]) for _, p in parts], "n": [pack_counts(n[p]) for _, p in parts], "t": [pack_counts(t[p]) for _, p in parts],
            }
        )

    return run


def _add_up(min_count: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Totals of a bucket's keys; to each block those of its keys that are frequent."""
        keys = [unpack_keys(x, m) for x, m in zip(pdf["keys"], pdf["m"])]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([unpack_counts(x, len(k)) for x, k in zip(pdf["n"], keys)])).astype(np.int64)
        t = np.bincount(at, np.concatenate([unpack_counts(x, len(k)) for x, k in zip(pdf["t"], keys)])).astype(np.int64)
        out, first = [], 0
        for block, k in zip(pdf["block"], keys):
            mine = at[first : first + len(k)]
            first += len(k)
            mine = mine[n[mine] >= min_count]
            if len(mine):
                out.append((block, len(mine), pack_keys(every[mine]), pack_counts(n[mine]), pack_counts(t[mine])))
        return pd.DataFrame(out, columns=["block", "m", "keys", "n", "t"])

    return run


def _score_block(total: int, total_target: int, bigram: float, own: float):
    def run(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(x, m) for x, m in zip(replies["keys"], replies["m"])] or [np.zeros(0, U64)]
        n = np.concatenate([unpack_counts(x, len(k)) for x, k in zip(replies["n"], keys)] or [np.zeros(0, np.int64)])
        t = np.concatenate([unpack_counts(x, len(k)) for x, k in zip(replies["t"], keys)] or [np.zeros(0, np.int64)])
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        keys, n, t = np.append(keys[order], U64(2**64 - 1)), np.append(n[order], 0), np.append(t[order], 0)

        def counts(wanted):
            at = np.searchsorted(keys, wanted)
            hit = keys[at] == wanted
            return np.where(hit, n[at], 0), np.where(hit, t[at], 0)

        words, known, score = [], [], []
        for part in chunks(docs["text"].tolist()):
            word, text = word_hashes(part)
            two = pairs(word, text)
            n1, t1 = counts(word)
            n2, t2 = counts(two)
            n2, t2 = np.where(two != 0, n2, 0), np.where(two != 0, t2, 0)
            before, before_t = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
            before[1:], before_t[1:] = np.where(two[1:] != 0, n1[:-1], 0), np.where(two[1:] != 0, t1[:-1], 0)
            one = n1 / max(total, 1)
            one_t = own * t1 / max(total_target, 1) + (1 - own) * one
            p = np.where(before > 0, bigram * n2 / np.maximum(before, 1) + (1 - bigram) * one, one)
            q = np.where(before_t > 0, bigram * t2 / np.maximum(before_t, 1) + (1 - bigram) * one_t, one_t)
            ok = n1 > 0
            gain = np.zeros(len(word))
            gain[ok] = np.log(p[ok]) - np.log(q[ok])
            size = np.bincount(text, minlength=len(part))
            seen = np.bincount(text, ok, minlength=len(part))
            words += size.tolist()
            known += seen.astype(np.int64).tolist()
            score += (np.bincount(text, gain, minlength=len(part)) / np.where(seen > 0, seen, np.nan)).tolist()
        return pd.DataFrame({"doc_id": docs["doc_id"], "n_words": words, "n_known": known, "score": score})

    return run


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, min_count: int = 3, bigram: float = 0.6, own: float = 0.9, block_mb: float = 8, most: int = 1_000_000
) -> DataFrame:
    """docs(doc_id, text, ...), target(doc_id): the documents of the target -> doc_id, n_words,
    n_known (words of the vocabulary), score double (null without a known word), one row per
    input row.

    Words are runs of other characters than space, tab and line ends, A-Z lower-cased. Null texts
    are empty. Repeated rows are counted as often as they come. Target ids that are null or of no
    document don't matter. Other columns are not read."""
    ids = checkpointed(target.where("doc_id is not null").select("doc_id").distinct().withColumn("_t", F.lit(True)))
    rows = docs.select("doc_id", letters().alias("text")).join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left")
    rows = rows.withColumn("target", F.col("_t").isNotNull()).drop("_t")
    n = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    sums = rows.agg(F.sum(n), F.sum(F.when(F.col("target"), n)), F.sum(F.octet_length("text"))).first()
    blocks = max(64, int((sums[2] or 0) / (block_mb * 1e6)))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    by_block = rows.select(block.alias("block"), "doc_id", "text", "target").groupBy("block")
    sent = by_block.applyInPandas(_count_block(blocks), "bucket int, block int, m int, keys binary, n binary, t binary")
    back = sent.groupBy("bucket").applyInPandas(_add_up(min_count), "block int, m int, keys binary, n binary, t binary")
    scored = by_block.cogroup(back.groupBy("block")).applyInPandas(
        _score_block(sums[0] or 0, sums[1] or 0, bigram, own), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_known long, score double"
    )
    return scored.withColumn("score", F.nullif("score", F.lit(float("nan"))))


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as of good quality."""
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = cross_entropy_difference(table(spark, sf_dir, "documents"), target)
    return scored.withColumn("score", F.round("score", 6))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target FROM documents),
w AS (SELECT doc_id, target, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS i, unnest(list_prepend(NULL, ws[:-2])) AS u FROM d),
uni AS (SELECT v, count(*) AS n, count(*) FILTER (target) AS t FROM w GROUP BY v HAVING count(*) >= 3),
bi AS (SELECT u, v, count(*) AS n, count(*) FILTER (target) AS t FROM w WHERE u IS NOT NULL GROUP BY u, v HAVING count(*) >= 3),
tot AS (SELECT count(*) AS n, count(*) FILTER (target) AS t FROM w),
x AS (SELECT w.doc_id, a.n AS n1, coalesce(b.n, 0) AS n2, coalesce(b.t, 0) AS t2, coalesce(c.n, 0) AS n0, coalesce(c.t, 0) AS t0,
    a.n / (SELECT n FROM tot) AS p1, 0.9::DOUBLE * a.t / (SELECT greatest(t, 1) FROM tot) + 0.1::DOUBLE * a.n / (SELECT n FROM tot) AS q1
  FROM w LEFT JOIN uni a ON w.v = a.v LEFT JOIN bi b ON w.u = b.u AND w.v = b.v LEFT JOIN uni c ON w.u = c.v),
y AS (SELECT doc_id, CASE WHEN n1 IS NOT NULL THEN
    ln(CASE WHEN n0 > 0 THEN 0.6::DOUBLE * n2 / n0 + 0.4::DOUBLE * p1 ELSE p1 END) - ln(CASE WHEN t0 > 0 THEN 0.6::DOUBLE * t2 / t0 + 0.4::DOUBLE * q1 ELSE q1 END) END AS gain FROM x),
s AS (SELECT doc_id, count(*) AS n_words, count(gain) AS n_known, avg(gain) AS score FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_known, 0) AS n_known, round(score, 6) AS score FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
