import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.functions import tails
from grainfold.operators import enrich


def quadrature(a, b, x, n=400_000):
    """I_x(a, b) by the midpoint rule, for a, b >= 1."""
    t = (np.arange(n) + 0.5) / n * x
    return float(np.mean(np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))) * x)


def test_incomplete_beta():
    r = np.random.default_rng(0)
    a, b, x = r.uniform(2, 60, 60), r.uniform(2, 60, 60), r.uniform(0.01, 0.99, 60)
    got = tails.incomplete_beta(a, b, x)
    assert np.abs(got - [quadrature(*v) for v in zip(a, b, x, strict=True)]).max() < 1e-7
    assert np.allclose(tails.incomplete_beta(b, a, 1 - x), 1 - got, atol=1e-13)
    whole = [sum(math.comb(n, j) * y**j * (1 - y) ** (n - j) for j in range(k, n + 1)) for k, n, y in ((3, 10, 0.2), (200, 500, 0.4), (1, 1, 0.7))]
    assert np.allclose(tails.incomplete_beta([3, 200, 1], [8, 301, 1], [0.2, 0.4, 0.7]), whole, rtol=1e-12)
    assert tails.incomplete_beta([2, 2, np.nan], [3, 3, 1], [0, 1, 0.5]).tolist()[:2] == [0, 1] and np.isnan(tails.incomplete_beta([np.nan], [1], [0.5])[0])
    # ten million cells: about the normal tail
    n, k = 10_000_000, 2_001_500
    z = (k - 0.2 * n - 0.5) / math.sqrt(n * 0.16)
    assert tails.incomplete_beta([k], [n - k + 1], [0.2])[0] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-3)
    assert np.allclose(tails.log_gamma([0.1, 1, 2.5, 1e7]), [math.lgamma(v) for v in (0.1, 1, 2.5, 1e7)], rtol=1e-14, atol=1e-14)


def test_student(spark):
    """Bounds of printed tables: two-sided 5 % and 1 %."""
    d = spark.createDataFrame([(12.706205, 1.0), (2.228139, 10.0), (-3.169273, 10.0), (1.959964, 1e9), (0.0, 5.0), (1.0, None), (1.0, 0.0)], "t double, df double")
    p = [r.p for r in d.select(tails.student_p(F.col("t"), F.col("df")).alias("p")).collect()]
    assert np.allclose(p[:5], [0.05, 0.05, 0.01, 0.05, 1.0], atol=1e-6) and p[5:] == [None, None]


def test_step_up_within_pairs(spark):
    r = np.random.default_rng(1)
    rows = [(g, g + 1, i, float(t), df) for g in range(3) for i, t in enumerate(np.round(r.standard_t(5, 150) * (1 + g), 1)) for df in (7.0,)]
    rows += [(9, 10, 0, 1.0, None), (9, 10, 1, 5.0, 4.0)]
    got = enrich.with_q(spark.createDataFrame(rows, "g1 long, g2 long, gene_id long, t double, df double").repartition(5)).collect()
    assert len(got) == len(rows)
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in got if x.g1 == g), key=lambda x: x.p)
        p = np.array([x.p for x in mine])
        q = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        assert np.allclose([x.q for x in mine], np.minimum(q, 1), rtol=1e-12)
    assert enrich.with_q(spark.createDataFrame([], "g1 long, g2 long, gene_id long, t double, df double")).count() == 0


def test_differential_df_and_binary_counts(spark):
    """Two groups, two genes: df and p by hand; only the gene that is on in one group counts."""
    r = np.random.default_rng(2)
    counts = {(c, g): int(n) for c in range(20) for g, n in enumerate((r.poisson(8 if c < 10 else 0.05), r.poisson(5))) if n}
    m = spark.createDataFrame([(c, g, n) for (c, g), n in counts.items()], "cell_id long, gene_id long, n long")
    groups = spark.createDataFrame([(c, int(c >= 10)) for c in range(20)], "cell_id long, group_id long")
    tests = enrich.differential(m, groups, spark.createDataFrame([(0,), (1,)], "gene_id long"))
    for x in tests.collect():
        a, b = (np.array([counts.get((c, x.gene_id), 0) for c in cs]) for cs in (range(10), range(10, 20)))
        e, f = a.var(ddof=1) / 10, b.var(ddof=1) / 10
        assert x.df == pytest.approx((e + f) ** 2 / (e**2 / 9 + f**2 / 9)) and x.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(e + f))
    assert [(x.g1, x.g2, x.n_genes) for x in enrich.binary_differential(enrich.with_q(tests), max_q=0.001).collect()] == [(0, 1, 1)]


def test_running_score_at_the_members_equals_the_whole_sum():
    from grainfold.operators import enrich

    r = np.random.default_rng(3)
    for e in (r.random(50), r.random(50) * (r.random(50) < 0.3), r.random(50) - 0.5, np.zeros(50)):
        for m in (0, 1, 7, 49, 50):
            at = r.choice(50, m, replace=False)
            hit = np.zeros(50, bool)
            hit[at] = True
            assert enrich.running_score(e, at) == enrich.running_scores(e, hit[None])[0]


def test_a_permutation_takes_a_few_numbers_a_gene(spark):
    """Before, 50 permutations at a time took over 1,000 bytes a gene."""
    import tracemalloc

    from grainfold.operators import enrich

    e, r = np.random.default_rng(1).random(100_000), np.random.default_rng(2)
    tracemalloc.start()
    for _ in range(5):
        enrich.running_score(e, r.choice(len(e), 20_000, replace=False, shuffle=False))
    assert tracemalloc.get_traced_memory()[1] < 40 * len(e)
    tracemalloc.stop()
