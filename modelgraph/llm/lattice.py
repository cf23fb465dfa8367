"""Operator 3: near-duplicate embeddings by lattice hashing.

In each table a vector's direction is projected at random to eight dimensions and decoded to the
nearest point of the lattice E8; it is entered in that cell and in the neighbouring cells that
are nearest to it, so two vectors meet if any of their cells agree. Equal vectors are one class.

Large groups are never expanded into pairs: each cell links its members to its smallest one,
checked by cosine; a vector belongs to the cluster of its smallest checked leader. Clusters that
meet in a cell (and whose leaders are near enough for a link to exist) are compared in blocks by
matrix products, which give each vector's number of links and the blocks' components.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import U64, checkpointed, mix64, table
from modelgraph.llm.graph import components


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if math.prod(s) == 1]
    return np.array(out)


ROOTS = _roots()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    at = np.abs(x[odd] - r[odd]).argmax(1)
    r[odd, at] += np.where(x[odd, at] >= r[odd, at], 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by a half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """64-bit cell keys [vector, tables * (probes + 1)] of unit vectors x: in each table the
    own cell and its probes neighbours that are nearest to the vector."""
    rng = np.random.default_rng([seed, x.shape[1]])
    out = []
    mult = mix64(np.arange(1, 9, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    for t in range(tables):
        y = x @ rng.standard_normal((x.shape[1], 8)) * scale
        home = nearest_e8(y)
        near = np.argsort(-((y - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + ROOTS[near]], axis=1)
        code = ((2 * points).astype(np.int64).astype(U64) * mult).sum(2, dtype=U64)
        out.append(mix64(code ^ mix64(np.array([t * 65536 + x.shape[1] + 1], U64))))
    return np.concatenate(out, axis=1)


def meeting(cosine: float, probes: int, scale: float, hits: int = 100) -> float:
    """Probability that two vectors of this cosine meet in one table, whatever their dimension:
    their projections are normal. Simulated until so many pairs have met."""
    rng = np.random.default_rng(5)
    met = tried = 0
    while met < hits:
        g, h = rng.standard_normal((2, 20_000, 8)) * scale
        sides = []
        for y in (g, cosine * g + math.sqrt(max(0.0, 1 - cosine**2)) * h):
            home = nearest_e8(y)
            near = np.argsort(-((y - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
            sides.append(np.concatenate([home[:, None, :], home[:, None, :] + ROOTS[near]], axis=1))
        met += int((sides[0][:, :, None, :] == sides[1][:, None, :, :]).all(3).any((1, 2)).sum())
        tried += len(g)
    return met / tried


def settings(n: int, least: float, probes: int, missed: float = 0.01) -> tuple[float, int]:
    """Scale and number of tables for n vectors, one rule for every n: the scale grows with the
    eighth root of n, so that cells of eight dimensions hold as many vectors by chance at every
    size; the tables are as many as leave the share missed of the pairs of cosine least unmet."""
    scale = 1.5 * (max(n, 1) / 50_000) ** 0.125
    p = meeting(least, probes, scale)
    return scale, 1 if p >= 1 - missed else math.ceil(math.log(missed) / math.log1p(-p))


def unit(blobs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in blobs])
    # Dividing by the largest component first keeps squares in range.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _read(vectors: DataFrame) -> DataFrame:
    """vec_id, x (components as doubles; null if the vector links with nothing), s1, s2."""

    def run(batches):
        for batch in batches:
            blob, one, two = [], [], []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    blob.append(None)
                    one.append(0)
                    two.append(0)
                    continue
                x = x + 0.0  # no negative zeros
                h = mix64(x.view(U64) ^ mix64(np.arange(1, len(x) + 1, dtype=U64)))
                blob.append(x.tobytes())
                one.append(int(h.sum(dtype=U64).astype(np.int64)))
                two.append(int(mix64(h ^ U64(0x2545F4914F6CDD1D)).sum(dtype=U64).astype(np.int64)))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "x": pa.array(blob, pa.binary()), "s1": pa.array(one, pa.int64()), "s2": pa.array(two, pa.int64())})

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, x binary, s1 long, s2 long")


def _near(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of classes whose cosine is at least least."""
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("x").alias("xa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("x").alias("xb")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cos = np.array([(unit([p]) * unit([q])).sum() if len(p) == len(q) else -2.0 for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])
                yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(cos >= least))

    kind = dict(pairs.dtypes)["a"]
    return checkpointed(both.select("a", "b", "xa", "xb").mapInArrow(run, f"a {kind}, b {kind}"))


def _blocks(both: DataFrame, least: float, kind: str) -> DataFrame:
    """rep, n (weight of the links found here), root: for each row of two blocks (p, q: arrays
    of rep, w, x; same: whether they are one block)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p, q = row["p"], row["q"]
                link = unit([v["x"] for v in p]) @ unit([v["x"] for v in q]).T >= least
                if row["same"]:
                    np.fill_diagonal(link, False)
                wp, wq = (np.array([v["w"] for v in side]) for side in (p, q))
                n = [(v["rep"], int(c)) for v, c in zip(p, link @ wq)]
                if not row["same"]:
                    n += [(v["rep"], int(c)) for v, c in zip(q, wp @ link)]
                ids = np.array([r for r, _ in n])
                # Components of the blocks' links: smallest ids spread until they rest.
                root = ids.copy()
                a, b = np.nonzero(link)
                b = b + (0 if row["same"] else len(p))
                while True:
                    was = root.copy()
                    np.minimum.at(root, a, was[b])
                    np.minimum.at(root, b, root[a])
                    if (root == was).all():
                        break
                got = [(r, c, int(t)) for (r, c), t in zip(n, root) if c]
                yield pa.RecordBatch.from_pydict({"rep": pa.array([g[0] for g in got], pa.int64()), "n": pa.array([g[1] for g in got], pa.int64()), "root": pa.array([g[2] for g in got], pa.int64())})

    return both.select("p", "q", "same").mapInArrow(run, "rep long, n long, root long")


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, tables: int | None = None, probes: int = 4, scale: float | None = None, block: int = 192, seed: int = 11
) -> DataFrame:
    """vectors(vec_id long, embedding array, ...) -> vec_id, n_links, component_id, kept, one
    row per input row.

    n_links counts the other rows linked directly (cosine >= least, in double precision),
    component_id is the smallest vec_id reachable, kept says vec_id = component_id. Null, empty
    and zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different lengths; a null vec_id keeps its row, without links. Equal rows link
    with each other. Other columns are not read. Every link reported is exact. Unless given,
    scale and number of tables (both or neither) come from the number of classes by settings, so pairs just at the
    limit are met with probability 0.99 at every size (14 tables for 50,000 classes, 49 for
    500,000, 243 for 5,000,000)."""
    rows = checkpointed(_read(vectors))
    good = rows.where("x is not null and vec_id is not null")
    classes = checkpointed(good.groupBy("s1", "s2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("x").alias("x")))
    if scale is None or tables is None:  # either is only of use with the other
        scale, tables = settings(classes.count(), least, probes)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                reps, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                size = np.array([len(b) for b in blobs])
                for s in np.unique(size):
                    at = np.flatnonzero(size == s)
                    keys = cells(unit([blobs[j] for j in at]), tables, probes, scale, seed).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"rep": pa.array(np.repeat(reps[at], keys.shape[1])), "cell": pa.array(keys.ravel())})

    where = classes.select("rep", "x").mapInArrow(run, "rep long, cell long")
    shared = where.groupBy("cell").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").drop("last")
    where = checkpointed(where.join(checkpointed(shared), "cell"))
    stars = where.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    led = _near(stars, classes, least).groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("label"))
    placed = classes.select("rep", "w", "x").join(led, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    count = checkpointed(placed.groupBy("label").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("size")))
    placed = placed.join(count, "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    content = placed.groupBy("label", "block").agg(F.collect_list(F.struct("rep", "w", "x")).alias("v"))
    content = checkpointed(content)

    # Clusters that meet in a cell; two of their members can be linked only if their leaders are
    # within three times the limit's angle.
    met = where.select("cell", "rep").join(led, "rep", "left").select("cell", F.coalesce("label", "rep").alias("a")).distinct()
    several = checkpointed(met.groupBy("cell").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("cell"))
    met = checkpointed(met.join(several, "cell"))
    pairs = met.join(met.withColumnRenamed("a", "b"), "cell").where("a < b").select("a", "b").distinct()
    pairs = _near(pairs, classes, math.cos(min(math.pi, 3 * math.acos(least))) - 1e-9)
    pairs = pairs.unionByName(count.where("size > 1").select(F.col("label").alias("a"), F.col("label").alias("b")))
    ids = content.select("label", "block")
    todo = pairs.join(ids.select(F.col("label").alias("a"), F.col("block").alias("i")), "a").join(ids.select(F.col("label").alias("b"), F.col("block").alias("j")), "b")
    todo = checkpointed(todo.where("a <> b or i <= j"))
    side = lambda a, i, v: content.select(F.col("label").alias(a), F.col("block").alias(i), F.col("v").alias(v))
    both = todo.join(side("a", "i", "p"), ["a", "i"]).join(side("b", "j", "q"), ["b", "j"])
    found = checkpointed(_blocks(both.withColumn("same", F.expr("a = b and i = j")), least, "long"))

    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    top = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    out = classes.select("s1", "s2", "rep", "w").join(links, "rep", "left").join(top, "rep", "left")
    out = checkpointed(out.select("s1", "s2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = good.select("vec_id", "s1", "s2").join(out, ["s1", "s2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
