import numpy as np
import pytest

from modelgraph.llm import lattice

SF = "/root/testdata/sf0.01"


def brute(ids, x, least=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= least
    np.fill_diagonal(link, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(link, low[None, :], max(ids)).min(1))
        if (new == low).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), low)}
        low = new


def test_decoding_is_nearest():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.nearest_e8(x)
    assert (((x - p) ** 2).sum(1) <= ((x[:, None] - p[:, None] - lattice.ROOTS[None]) ** 2).sum(2).min(1) + 1e-9).all()
    assert len(lattice.ROOTS) == 240 and (p.sum(1) % 2 == 0).all()


@pytest.mark.parametrize("n", [1_000, 50_000, 100_000, 500_000, 5_000_000])
def test_recall_at_the_limit(n):
    """Pairs of cosine 0.95 and the settings that so many vectors get."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    c = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    scale, tables = lattice.settings(n, 0.95, 4)
    one, two = (lattice.cells(v, tables, 4, scale, 11) for v in (a, c))
    recall = np.mean([len(np.intersect1d(u, v)) > 0 for u, v in zip(one, two)])
    print(n, round(scale, 2), tables, recall)
    assert recall > 0.97


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = lattice.op3_lattice_near_duplicates(spark, SF).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_groups_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 16))
    x = np.concatenate([np.repeat(base[:1], 40, 0), base[1] + rng.normal(size=(300, 16)) * 0.14, base[2] + rng.normal(size=(60, 16)) * 0.3])
    rows = [(i, [float(c) for c in v], "c") for i, v in enumerate(x)]
    odd = [(1000, None, "c"), (1001, [], "c"), (1002, [0.0] * 16, "c"), (1003, [1.0, None], "c"), (1004, [float("nan")] * 16, "c"), (1005, [float("inf"), 1.0], "c"), (None, rows[0][1], "c"), (1006, [1.0, 2.0], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links string")
    got = lattice.near_duplicates(df, block=64).collect()
    assert len(got) == len(rows) + len(odd)
    want = brute([r[0] for r in rows], x)
    found = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 1000}
    share = sum(n for n, _ in found.values()) / sum(n for n, _ in want.values())
    assert 0.95 < share <= 1 and all(found[i][0] <= want[i][0] for i in want)
    assert all(found[i] == (39, 0) for i in range(40))
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id is None or r.vec_id >= 1000)
    assert lattice.near_duplicates(df.limit(0)).count() == 0
