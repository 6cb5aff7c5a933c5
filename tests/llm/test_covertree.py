import numpy as np
import pytest

from millrace.llm import covertree


def brute(rows, cos_min):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [0] * len(fine)
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, first) in enumerate(fine):
        for b, (j, v) in enumerate(fine[:a]):
            u = first
            if len(u) != len(v):
                continue
            u, v = u / np.abs(u).max(), v / np.abs(v).max()
            if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= cos_min:
                links[a] += 1
                links[b] += 1
                x, y = root(i), root(j)
                comp[max(x, y)] = min(x, y)
    out = sorted((i, n, root(i)) for (i, _), n in zip(fine, links, strict=True))
    ok = {id(v) for _, v in fine}
    odd = len(rows) - len(fine)
    return out, odd, ok


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    rows = []
    for k in range(n):
        v = base[rng.integers(len(base))] if k % 3 else rng.normal(size=dim)
        v = v + rng.normal(size=dim) * rng.choice([0, 0.05, 0.15, 0.25, 0.3])
        rows.append((k, (v * rng.choice([1.0, 1.0, 3.5])).tolist()))
    centre = rng.normal(size=dim)
    rows += [(n + k, (centre + rng.normal(size=dim) * 0.01).tolist()) for k in range(60)]
    return rows + [(n + 60 + k, centre.tolist()) for k in range(40)]


ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] + [1.0] * 7), (905, [float("inf")] + [0.0] * 7), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (None, [1.0] * 8)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 40)])
def test_matches_brute_force(spark, seed, block):
    rows = vectors(seed, 300, 8) + ODD
    rows.append(rows[5])
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, h string, n int")
    got = [(r["id"], r["n_links"], r["component"]) for r in covertree.near_vectors(df, cos_min=0.95, block=block).collect()]
    want, _, _ = brute(rows, 0.95)
    want += [(i, 0, i) for i in (900, 901, 902, 903, 904, 905, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [4096, 40])
def test_tiny_and_huge_components(spark, block):
    """The square of such a vector's norm is zero or no number; its links and those of its neighbours count."""
    rows = vectors(5, 200, 8)
    rows += [(2000 + k, [x * s for x in rows[k][1]]) for k, s in ((3, 1e-200), (4, 1e200), (5, 1e-300), (6, 5e-324), (7, 1e300))]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["id"], r["n_links"], r["component"]) for r in covertree.near_vectors(df, block=block).collect())
    assert got == brute(rows, 0.95)[0]


def test_single_precision_column(spark):
    rows = vectors(6, 200, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["id"], r["n_links"], r["component"]) for r in covertree.near_vectors(df, block=60).collect())
    assert got == brute([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows], 0.95)[0]


@pytest.mark.parametrize("cos_min", [0.5, 0.95, 0.999])
def test_trees_without_spark(cos_min):
    rng = np.random.default_rng(7)
    v = np.array([x for _, x in vectors(3, 400, 5)])
    w = np.array([x for _, x in vectors(4, 300, 5)])
    w[:50] = v[:50] + rng.normal(size=(50, 5)) * 0.02
    reach = float(covertree.distance(np.float64(cos_min)))
    a, b = covertree.CoverTree(v, reach), covertree.CoverTree(w, reach)
    m, k = rng.integers(1, 5, len(v)), rng.integers(1, 5, len(w))
    got1, got2, forest = covertree.links_of(a, b, m, k, cos_min)
    hit = (a.unit @ b.unit.T) >= cos_min
    assert np.array_equal(got1, hit @ k) and np.array_equal(got2, m @ hit)
    self1, _, _ = covertree.links_of(a, a, m, m, cos_min)
    own = (a.unit @ a.unit.T) >= cos_min
    np.fill_diagonal(own, False)
    assert np.array_equal(self1, own @ m)


def test_empty(spark):
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = covertree.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1)]
