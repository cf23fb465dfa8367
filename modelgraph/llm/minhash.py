"""Operator 8: near-duplicate documents by fast similarity sketching, banding and exact checks.

The sketch has t coordinates. In round i < t every element of a document's shingle set falls by
a hash into a coordinate with the value i + a fraction; in round t + i every element falls into
coordinate i. A coordinate keeps its smallest value, so rounds stop once all are filled: about
t log t hashes for a small set and one pass for a large one, and each coordinate agrees between
two sets with their Jaccard similarity as probability, concentrated as for independent
coordinates.

Coordinates are grouped in bands; sets that agree in a whole band meet in a bucket. Equal
sequences of words (by a 128-bit BLAKE2 digest of all of them) are one class; everything else is
linked only after a comparison of full sets. Each bucket links its members to its smallest and its largest one (pairs linear
in the rows, however large a bucket is); candidates are compared on their full shingle sets.
Then only members of buckets that still hold several components are looked at again: an exact
prefix-filtered join finds every pair of theirs across components that can be similar enough, so
no pair that shares a bucket is given up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelgraph.llm.common import U64, Scratch, letters, mix64, table
from modelgraph.llm.graph import components


def split(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split parts at just space and \\t to \\r."""
    return text.encode().lower().split()


def shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The distinct k-word shingles of a text with A-Z lower-cased; with fewer words the whole
    sequence as one; of no word none."""
    words = split(text)
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)}


class _Digests(dict):
    """Word -> 128-bit digest, filled on demand; a worker keeps at most so many short words."""

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[word] = digest
        return digest


_DIGESTS = _Digests()


def digests(words: list[bytes]) -> np.ndarray:
    """The words' digests, two 64-bit numbers each."""
    return np.frombuffer(b"".join(map(_DIGESTS.__getitem__, words)), "<u8").reshape(-1, 2)


def shingle_hashes(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """Distinct 64-bit hashes of the k-word shingles of a sequence of words, and the number of
    distinct shingles. Two independent hashes are taken of each; where their numbers differ,
    the shingles themselves are counted."""
    if not words:
        return np.zeros(0, U64), 0
    word = digests(words)
    n = min(k, len(word))
    out = np.zeros((len(word) - n + 1, 2), U64)
    for i in range(n):
        out = mix64(out * U64(3) + word[i : len(word) - n + 1 + i])
    one, two = np.unique(out[:, 0]), np.unique(out[:, 1])
    return one, len(one) if len(one) == len(two) else len(set(zip(*(words[i:] for i in range(n)))))


_ROUND = mix64(np.arange(1, 1 << 12, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sketch(h: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes: t values, as
    round << 48 | fraction."""
    empty = U64(2**64 - 1)
    out = np.full(t, empty, U64)
    i = 0
    while i < 2 * t:
        rounds = min(max(1, 2048 // len(h)), (t if i < t else 2 * t) - i)
        x = mix64(h[None, :] ^ _ROUND[i : i + rounds, None])
        number = np.arange(i, i + rounds)
        where = ((x & U64(0xFFFFFF)) * U64(t)) >> U64(24) if i < t else np.broadcast_to((number - t)[:, None].astype(U64), x.shape)
        value = (number[:, None].astype(U64) << U64(48)) | (x >> U64(24)) & U64(2**40 - 1)
        np.minimum.at(out, where.ravel().astype(np.int64), value.ravel())
        if not (out == empty).any():
            break
        i += rounds
    return out


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tx (hash of the text: with doc_id the key of a text), n (size of the set), seq
    (digest of the sequence of words), bands array<long>."""

    def run(batches):
        salt = mix64(np.arange(1, bands + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
        for batch in batches:
            sizes, seqs, keys = [], [], []
            for text in batch.column(2):
                words = split(text.as_py())
                h, n = shingle_hashes(words, k)
                sizes.append(n)
                seqs.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                if n:
                    band = salt
                    for column in sketch(h, bands * rows).reshape(bands, rows).T:
                        band = mix64(band * U64(3) ^ column)
                    keys.append(band.astype(np.int64))
                else:
                    keys.append([])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "tx": batch.column(1),
                    "n": pa.array(sizes, pa.int64()),
                    "seq": pa.array(seqs, pa.binary()),
                    "bands": pa.array(keys, pa.list_(pa.int64())),
                }
            )

    kind = dict(docs.dtypes)["doc_id"]
    return keyed(docs).mapInArrow(run, f"doc_id {kind}, tx long, n long, seq binary, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tx, text: rows of one doc_id may hold different texts, so a text's key has both."""
    return docs.select("doc_id", F.xxhash64(letters()).alias("tx"), letters().alias("text"))


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of nodes(node), a struct of doc_id and tx each. Whole texts move here, so this
    is called once; later steps choose from its result. Nodes grow with the documents: this join
    and the others of this module are shuffles at every size."""
    ids = nodes.select(F.col("node.doc_id").alias("doc_id"), F.col("node.tx").alias("tx"))
    found = keyed(docs).join(ids.hint("merge"), ["doc_id", "tx"], "left_semi").dropDuplicates(["doc_id", "tx"])
    return found.select(F.struct("doc_id", "tx").alias("node"), "text")


def verified(pairs: DataFrame, texts: DataFrame, k: int, share: int, whole: int, tmp: Scratch) -> DataFrame:
    """Of pairs(a, b, ...) those whose full shingle sets have whole * intersection >= share *
    union; texts(node, text) holds their texts."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select(*pairs.columns, "ta", "tb")

    def run(batches):
        known: dict[str, set] = {}
        size = 0
        for batch in batches:
            keep = []
            for ta, tb in zip(*batch.columns[-2:]):
                sets = []
                for t in (ta.as_py(), tb.as_py()):
                    found = known.get(t)
                    if found is None:
                        found = shingles(t, k)
                        if size + len(found) > 300_000:
                            known.clear()
                            size = 0
                        known[t] = found
                        size += len(found)
                    sets.append(found)
                common = len(sets[0] & sets[1])
                keep.append(whole * common >= share * (len(sets[0]) + len(sets[1]) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    return tmp.write(both.mapInArrow(run, pairs.schema))


def across(left: DataFrame, texts: DataFrame, k: int, share: int, whole: int, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, ca, cb) of left(rep, c) of different c whose sets may be similar enough: a
    superset of those that are; and the texts (node, text) of left, chosen from texts.

    Shingles are ordered, rare ones first. Two sets of sizes n and m that are similar enough
    have at least share * (n + m) / (share + whole) shingles in common, so they share one among
    the first n - share * n / whole + 1 of each, and behind the first that they share enough
    places must be left in both. Heavily changed copies begin with shingles of their own and
    meet nothing, where comparing all members of a bucket would be quadratic."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sets = [shingle_hashes(split(t), k)[0].view(np.int64) for t in part.column(2).to_pylist()]
                n = np.array([len(x) for x in sets], np.int32)
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column(0).take(at), "cid": part.column(1).take(at), "n": pa.array(np.repeat(n, n)), "s": pa.array(np.concatenate(sets))}
                )

    # Short numbers (written, so they stay) stand for texts and components in the exploded rows.
    groups = tmp.write(left.select("c").distinct().withColumn("cid", F.monotonically_increasing_id()))
    left = tmp.write(left.join(groups.hint("merge"), "c").withColumn("id", F.monotonically_increasing_id()))
    found = texts.join(left.select(F.col("rep").alias("node"), "id", "cid").hint("merge"), "node")
    found = tmp.write(found)
    rows = tmp.write(found.select("id", "cid", "text").mapInArrow(run, "id long, cid long, n int, s long"))
    df = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    of = Window.partitionBy("id")
    rows = rows.join(df.hint("merge"), "s").withColumn("i", F.row_number().over(of.orderBy("df", "s")) + F.col("n") - F.count("*").over(of))
    rows = tmp.write(rows.where(F.col("i") <= F.col("n") - F.ceil(share * F.col("n") / F.lit(whole)) + 1).select("id", "cid", "n", "s", "i"))
    sizes = rows.groupBy("s", "cid").count()
    mixed = sizes.groupBy("s").agg(F.max_by("cid", F.struct("count", "cid")).alias("main"), F.count("*").alias("k")).where("k > 1")
    rest = tmp.write(rows.join(mixed.select("s", "main").hint("merge"), "s"))
    out = rest.where("cid <> main").select("s", *(F.col(x).alias(f"{x}2") for x in ("id", "n", "i", "cid")))
    need = F.ceil(share * (F.col("n") + F.col("n2")) / F.lit(share + whole))
    met = rest.join(out.hint("merge"), "s").where(
        (F.col("cid") != F.col("cid2"))
        & ((F.col("cid") == F.col("main")) | (F.col("id") < F.col("id2")))
        & (F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) + 1 >= need)
        & (whole * F.least("n", "n2") >= share * F.greatest("n", "n2"))
    )
    first = F.col("rep") < F.col("rep2")
    pairs = met.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2")).distinct()
    one, two = left, left.select(*(F.col(x).alias(f"{x}2") for x in ("rep", "c", "id")))
    pairs = pairs.join(one, "id").join(two, "id2")
    pairs = pairs.select(
        F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"), F.when(first, F.col("c")).otherwise(F.col("c2")).alias("ca"), F.when(first, F.col("c2")).otherwise(F.col("c")).alias("cb")
    )
    return pairs, found.select("node", "text")


def near_duplicates(docs: DataFrame, k: int = 5, **settings: int) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles long, component_id, kept boolean, one row
    per input row; as grouped_texts says."""
    return grouped_texts(docs, k, **settings).drop("tx")


def grouped_texts(
    docs: DataFrame, k: int = 5, share: int = 80, whole: int = 100, bands: int = 40, rows: int = 6
) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles long, component_id, kept boolean, tx long
    (the text's hash), one row per input row.

    Two documents are linked if whole * |intersection| >= share * |union| of their shingle sets;
    component_id is the smallest doc_id reachable by links, kept says doc_id = component_id.
    Null and wordless texts have no shingles and no links. A null doc_id is linked with nothing:
    its component_id is null and it is kept. Repeated rows get equal answers; rows of one doc_id
    with different texts are linked each by its own text. Other columns are not read. With the default 40 bands of 6 a pair of similarity 0.8 misses every bucket
    with probability 5e-6; similar sets of any size are then compared exactly."""
    tmp = Scratch(docs.sparkSession)
    sk = tmp.write(sketches(docs, k, bands, rows))
    sets = sk.where("n > 0 and doc_id is not null")
    classes = tmp.write(sets.groupBy("seq").agg(F.min(F.struct("doc_id", "tx")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))
    # Most buckets have one member: they go before anything but their keys is gathered. In the
    # cells, forty a class, short numbers (written, so they stay) stand for classes.
    cells = classes.select("id", F.explode("bands").alias("h"))
    shared = cells.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    met = cells.join(shared.hint("merge"), "h", "left_semi")
    met = tmp.write(met.join(classes.select("id", "rep", "n").hint("merge"), "id").drop("id"))
    tops = met.groupBy("h").agg(F.min(F.struct("rep", "n")).alias("lo"), F.max(F.struct("rep", "n")).alias("hi"))
    members = tmp.write(met.join(tops.hint("merge"), "h"))
    texts = tmp.write(texts_of(met.select(F.col("rep").alias("node")).distinct(), docs))

    def fits(x, y):
        return (whole * F.least(x, y) >= share * F.greatest(x, y))

    stars = members.select("rep", "n", F.explode(F.array("lo", "hi")).alias("top")).where(fits(F.col("n"), F.col("top.n")))
    stars = stars.select(F.least("rep", "top.rep").alias("a"), F.greatest("rep", "top.rep").alias("b")).where("a <> b")
    tried = tmp.write(stars.distinct())
    links = verified(tried, texts, k, share, whole, tmp)
    first = components(links)

    # Members of buckets that still hold several components: an exact join across these.
    placed = members.select("h", "rep").join(first.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    placed = placed.select("h", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    left = tmp.write(placed.join(mixed.hint("merge"), "h").select("rep", "c").distinct())
    tmp.drop(sk, classes, tried, left, texts)
    top = classes.select("seq", "rep").join(first.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    top = top.select("seq", F.coalesce("component", "rep").alias("c"))
    if not left.isEmpty():
        more, near = across(left, texts, k, share, whole, tmp)
        more = tmp.write(more.join(tried, ["a", "b"], "left_anti"))
        second = components(verified(more, near, k, share, whole, tmp), "ca", "cb").withColumnRenamed("node", "c")
        top = top.join(second, "c", "left").select("seq", F.coalesce("component", "c").alias("c"))
    top = tmp.write(top.select("seq", F.col("c.doc_id").alias("component_id")))
    tmp.drop(sk, top)
    linked = sets.select("doc_id", "n", "tx", "seq").join(top.hint("merge"), "seq")
    alone = sk.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "tx"]
    found = linked.select(*cols).unionByName(alone.select(*cols))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "tx")


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
