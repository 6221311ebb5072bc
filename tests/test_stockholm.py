"""Recursive bisection against a dense recursion in numpy."""

import numpy as np
from pyspark.sql import functions as F

from grainfold.operators import stockholm


def _blocks():
    r = np.random.default_rng(3)
    rate = np.full((48, 40), 0.3)
    rate[:24, :10] = rate[24:, 10:20] = 3
    for i in range(4):
        rate[12 * i : 12 * i + 12, 20 + 5 * i : 25 + 5 * i] = 4
    return r.poisson(rate)


def _dense(x, members, path, found, splits, n_genes, min_cells):
    """Paths of cells and modularity of splits, by singular values of dense matrices; modularity is not asked for."""
    n = len(members)
    y = x[members].astype(float)
    if n >= min_cells:
        mu = y.sum(1, keepdims=True) * y.sum(0) / y.sum()
        r = np.where(y > 0, np.clip(np.nan_to_num((y - mu) / np.sqrt(mu + mu**2 / 100)), 0, np.sqrt(n)), 0)
        b = r[:, np.argsort(-r.var(0), kind="stable")[:n_genes]]
        if (b.sum(1) > 0).all():
            b /= np.linalg.norm(b, axis=1, keepdims=True)
            up = np.linalg.svd(b / np.sqrt(b @ b.sum(0))[:, None])[0][:, 1] > 0
            side = (up != up[0]).astype(int)
            a = b @ b.T
            whole, q = a.sum() - n, 0.0
            for s in (0, 1):
                q += (a[side == s][:, side == s].sum() - n) / whole - ((a[side == s].sum() - n) / whole) ** 2
            splits[path] = (q, n)
            for s in (0, 1):
                _dense(x, members[side == s], path + str(s), found, splits, n_genes, min_cells)
            return
    found |= dict.fromkeys(members.tolist(), path)


def _run(spark, x, **parameters):
    rows = [(int(i), int(j), int(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    m = spark.createDataFrame(rows, "cell_id long, gene_id long, n long")
    cells, genes = (spark.range(k).select(F.col("id").alias(c)) for k, c in zip(x.shape, ("cell_id", "gene_id"), strict=True))
    out, tree = stockholm.stockholm(m, cells, genes, **parameters)
    return out.collect(), {r.path: r for r in tree.collect()}


def test_equals_dense_recursion(spark):
    x, found, splits = _blocks(), {}, {}
    _dense(x, np.arange(48), "", found, splits, 30, 20)
    assert len(splits) == 3 and len({found[i] for i in (0, 12, 24, 36)}) == 4
    got, tree = _run(spark, x, n_genes=30, min_cells=20, cut_at=splits["0"][0] + 1e-6)
    assert {r.cell_id: r.path for r in got} == found
    assert {p: r.n_cells for p, r in tree.items()} == {p: n for p, (_, n) in splits.items()}
    for p, (q, _) in splits.items():
        assert abs(tree[p].q - q) < 1e-6
    assert abs(tree[""].height - splits[""][0] - max(splits["0"][0], splits["1"][0])) < 1e-6
    order = sorted(set(found.values()))
    assert all(r.fine == order.index(r.path) for r in got)
    # the cut joins both leaves of side 0; those of side 1 only if that split is as low
    assert len({r.cluster for r in got if r.path[0] == "0"}) == 1
    assert len({r.cluster for r in got if r.path[0] == "1"}) == (1 if splits["1"][0] <= splits["0"][0] else 2)


def test_no_counts_all_zero_cells_and_no_cells(spark):
    x = _blocks()
    x[5] = 0
    got, tree = _run(spark, x, n_genes=30, min_cells=20)
    assert not tree and {(r.cluster, r.fine, r.path) for r in got} == {(0, 0, "")} and len(got) == 48
    got, tree = _run(spark, x[:0], n_genes=30, min_cells=20)
    assert not got and not tree
