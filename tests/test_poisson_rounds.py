"""Poisson factors: the matrix is made once, whatever the rounds, and rounds equal the dense ones."""

import numpy as np

from grainfold.operators import factor


def test_matrix_is_made_once_and_rounds_equal_dense(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(1.5, (12, 9)).astype(float)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for p in batches:
            made.add(len(p))
            yield p

    rows = [(i, j, int(x[i, j])) for i in range(12) for j in range(9) if x[i, j]]
    shape = "cell_id long, gene_id long, n long"
    m = spark.createDataFrame(rows, shape).mapInPandas(count, shape)
    theta, beta = factor.poisson_factors(m, 2, iterations=2)
    t = np.array([r.theta for r in theta.orderBy("cell_id").collect()])
    b = np.array([r.beta for r in beta.orderBy("gene_id").collect()])
    assert made.value == len(rows)

    def start(key, n, salt):
        d = spark.range(n).selectExpr(*[f"abs(xxhash64(id, {salt}, {j}) % 1000) / 1000.0 + 0.5 AS m{j}" for j in range(2)]).collect()
        return np.array([[float(v) for v in r] for r in d])

    one, two = start("cell_id", 12, 0), start("gene_id", 9, 1)
    l1, l2 = np.log(one), np.log(two)
    for _ in range(2):
        for side in range(2):
            w = np.exp(l1[:, None] + l2[None])
            w = x[:, :, None] * w / w.sum(2, keepdims=True)
            g = 0.3 + w.sum(1 - side)
            mine, other = (one, two) if side == 0 else (two, one)
            r = 0.6 / (1 + mine.sum(1))[:, None] + other.sum(0)
            mean, log = g / r, factor._digamma(g) - np.log(r)
            one, l1, two, l2 = (mean, log, two, l2) if side == 0 else (one, l1, mean, log)
    assert np.allclose(t, one, rtol=1e-9) and np.allclose(b, two, rtol=1e-9)
