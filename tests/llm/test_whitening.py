import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, v int, whitened double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in vectors], SCHEMA)


def brute(vectors):
    """Exact integers, then a dense covariance and its eigenvalues."""
    x = [[int(np.floor(64.0 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    e, w = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, e[::-1], w[:, ::-1]


def check(got, model, vectors, rows):
    n, deviation, centred, e, w = brute([v for _, v in vectors])
    k = len(model.values)
    assert model.n == n and np.allclose(model.explained, e[:k] / e.sum(), rtol=1e-9)
    assert model.identity_error < 1e-9
    want = centred @ w[:, :k] / np.sqrt(e[:k])
    assert len(rows) == len(vectors)
    mine = np.array([r.whitened for r in rows])
    assert sorted((r.id is None, r.id, r.deviation) for r in rows) == sorted((i is None, i, d) for (i, _), d in zip(vectors, deviation, strict=True))
    order, theirs = (sorted(range(len(vectors)), key=key) for key in (lambda j: (rows[j].id is None, rows[j].id, rows[j].deviation), lambda j: (vectors[j][0] is None, vectors[j][0], deviation[j])))
    mine, want = mine[order], want[theirs]
    sign = np.sign((mine * want).sum(0))
    assert np.abs(mine - want * sign).max() < 1e-6
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-9


def test_whitening_equals_dense_and_drops_bad_rows(spark):
    r = np.random.default_rng(0)
    mix = r.standard_normal((40, 40)) * np.logspace(0, -1, 40)
    good = [(i, (r.standard_normal(40) @ mix + 3).tolist()) for i in range(500)] + [(None, mix[0].tolist())]
    good += good[:4] + [(9000 + i, good[7][1]) for i in range(300)]  # repeated rows and a common vector
    bad = [(1, None), (2, [None] + [0.0] * 39), (3, [float("nan")] * 40), (4, [float("-inf")] + [0.0] * 39), (5, [1.0]), (6, [])]
    rows, model = whitening.whiten(frame(spark, good + bad).repartition(7))
    assert len(model.values) == 32
    check(None, model, good, rows.collect())


def test_query(spark, sf_dir):
    got = whitening.op13_two_pass_whitening(spark, sf_dir)
    assert [(c, t) for c, t in got.dtypes] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    source = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    p = got.toPandas()
    n, deviation, centred, e, w = brute([v for _, v in source])
    assert len(p) == n * 32 and (p.n == n).all() and p.identity_error.nunique() == 1 and p.identity_error[0] < 1e-4
    assert p.groupby("vec_id").deviation.first().to_dict() == {i: d for (i, _), d in zip(source, deviation, strict=True)}
    wide = p.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in source]].to_numpy()
    want = centred @ w[:, :32] / np.sqrt(e[:32])
    assert np.abs(np.abs(wide) - np.abs(want)).max() < 1e-8
    assert np.allclose(p.groupby("component").explained.first(), (e / e.sum())[:32], rtol=1e-4)


def test_few_rows_equal_rows_and_none(spark):
    r = np.random.default_rng(1)
    few = [(i, r.standard_normal(6).tolist()) for i in range(3)]
    rows, model = whitening.whiten(frame(spark, few))
    assert len(model.values) == 2 and all(len(x.whitened) == 2 for x in rows.collect())
    rows, model = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]))
    assert len(model.values) == 0 and [(x.deviation, x.whitened) for x in rows.collect()] == [(0, []), (0, [])]
    for none in ([], [(1, None)], [(1, [])]):
        rows, model = whitening.whiten(frame(spark, none))
        assert model is None and rows.where(F.size("whitened") > 0).count() == 0
    assert whitening.whiten(frame(spark, []))[0].count() == 0


def test_exact_sums_beyond_64_bits(spark):
    centre = whitening.Centre.of(3_000_000_000, [10**16, -(10**16) - 7])
    x = np.array([[3_333_334, -3_333_330], [3_333_333, -3_333_334]])
    want = [sum((3_000_000_000 * int(a) - s) ** 2 for a, s in zip(row, (10**16, -(10**16) - 7), strict=True)) for row in x]
    assert max(want) > 2**63
    with pytest.raises(OverflowError):
        centre.deviation(x)
    assert centre.deviation(x[1:]).tolist() == want[1:]
    with pytest.raises(Exception, match="in size"):
        whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])]))
