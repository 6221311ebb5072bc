"""Factorisations: principal components, topics, Poisson factors, batch correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import persist
from .grid import Grid


def cell_vectors(values: DataFrame, selected: DataFrame, cells: DataFrame, column: str = "value") -> DataFrame:
    """(cell_id, vector): the selected genes of every cell as a vector. selected: (gene_id, rank), rank from 1."""
    size = selected.count()
    per = values.join(F.broadcast(selected), "gene_id").groupBy("cell_id").agg(F.collect_list(F.struct((F.col("rank") - 1).cast("int").alias("i"), F.col(column).cast("double").alias("v"))).alias("e"))
    every = cells.select("cell_id").join(per, "cell_id", "left").select("cell_id", F.transform("e", lambda x: x["i"]).alias("i"), F.transform("e", lambda x: x["v"]).alias("v"))

    @F.pandas_udf("array<double>")
    def dense(i: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros((len(i), size))
        for row, (a, b) in enumerate(zip(i, v, strict=True)):
            if a is not None:
                out[row, np.asarray(a, int)] = b
        return pd.Series(list(out))

    return every.select("cell_id", array_to_vector(dense("i", "v")).alias("vector"))


def principal_components(vectors: DataFrame, k: int, standardise: bool = False, half: bool = True) -> tuple[DataFrame, list[float]]:
    """(cell_id, factors) and the explained share of each component.

    The components come from Spark ML; scores are centred with the column means,
    which its transform leaves out. If the components together explain over
    half, those up to the one that passes half are kept, one at least; all are
    without `half`. Vectors of no numbers have no components: every cell has empty factors.
    """
    vectors = persist(vectors)
    first = vectors.first()
    size = len(first["vector"].toArray()) if first else 0
    if not size:
        return vectors.select("cell_id", F.array().cast("array<double>").alias("factors")), []
    if standardise:
        from pyspark.ml.feature import StandardScaler

        vectors = persist(StandardScaler(withMean=False, withStd=True, inputCol="vector", outputCol="_s").fit(vectors).transform(vectors).select("cell_id", F.col("_s").alias("vector")))
    model = PCA(k=min(k, size), inputCol="vector", outputCol="_f").fit(vectors)
    mean = vectors.select(Summarizer.mean(F.col("vector")).alias("m")).first()["m"].toArray()
    shift = (model.pc.toArray().T @ mean).tolist()
    share = model.explainedVariance.toArray().tolist()
    keep = len(share)
    total = np.cumsum(share)
    if half and total[-1] > 0.5:
        keep = max(1, int(np.argmax(total > 0.5)) + 1)
    scores = model.transform(vectors).select("cell_id", vector_to_array("_f").alias("f"))
    centred = F.zip_with("f", F.array(*[F.lit(s) for s in shift]), lambda a, b: a - b)
    return scores.select("cell_id", F.slice(centred, 1, keep).alias("factors")), share


def topics(counts: DataFrame, k: int, *, vocabulary: int = 2_000, iterations: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Latent topics of a count table (cell_id, token, n): (cell_id, topics) and (topic, token, weight) of the top tokens."""
    top = counts.groupBy("token").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "token").limit(vocabulary)
    words = persist(top.select("token").orderBy("token").withColumn("gene_id", F.monotonically_increasing_id()).select("token", F.dense_rank().over(_order("token")).alias("rank")))
    size = words.count()
    sparse = F.udf(lambda e: SparseVector(size, [(x["i"], x["v"]) for x in e or []]), VectorUDT())
    per = counts.join(F.broadcast(words), "token").groupBy("cell_id").agg(F.collect_list(F.struct((F.col("rank") - 1).cast("int").alias("i"), F.col("n").cast("double").alias("v"))).alias("e"))
    v = persist(counts.select("cell_id").distinct().join(per, "cell_id", "left").select("cell_id", sparse("e").alias("vector")))
    model = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="vector", optimizer="online").fit(v)
    of = model.transform(v).select("cell_id", vector_to_array("topicDistribution").alias("topics"))
    named = model.describeTopics(10).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("p", "t"))
    named = named.select("topic", (F.col("t.termIndices") + 1).alias("rank"), F.col("t.termWeights").alias("weight")).join(words, "rank").select("topic", "token", "weight")
    return of, named


def _order(c):
    from pyspark.sql.window import Window

    return Window.orderBy(c)


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252))


def poisson_factors(matrix: DataFrame, k: int, *, iterations: int = 100, tolerance: float = 1e-3, a: float = 0.3, b: float = 1.0, c: float = 0.3, d: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Hierarchical Poisson factorisation by coordinate ascent over the non-zeros: (cell_id, theta), (gene_id, beta).

    Each half step sums the responsibilities of the non-zeros by one side; the
    other side's total rate is one small row. The non-zeros lie in packed blocks (see grid); state is 2 k numbers an item. Every tenth
    round, from the tenth on, the log likelihood of the non-zeros is taken; it ends
    when that changes by less than the share `tolerance`, or after `iterations`.
    """
    whole = Grid(matrix)
    widths = (2 * k, 2 * k)

    def start(key, salt):
        noise = [F.abs(F.xxhash64(key, F.lit(salt), F.lit(j)) % 1000) / 1000.0 + 0.5 for j in range(k)]
        return whole.start(key, [*noise, *[F.ln(x) for x in noise]])

    theta, beta = start("cell_id", seed), start("gene_id", seed + 1)

    def shares(i, j, n, one, two):
        w = np.exp(one[:, k:])[i] * np.exp(two[:, k:])[j]
        return (w * (n / (w.sum(1) + 1e-300))[:, None]).T

    def half(key, other, shape, rate):
        total = whole.total(other, 2 * k)[:k]

        def update(got, old):
            g = shape + got
            r = ((shape * k) / (rate + old[:, :k].sum(1)))[:, None] + total
            return np.hstack([g / r, _digamma(g) - np.log(r)])

        return whole.step(key, theta, beta, widths, shares, update)

    def likelihood() -> float:
        def add(_, rows, one, two):
            out = 0.0
            for i, j, n in rows:
                rate = (one[i, :k] * two[j, :k]).sum(1) + 1e-300
                out += float((n * np.log(rate) - rate).sum())
            return pd.DataFrame({"l": [out]})

        return whole.over(theta, beta, widths, add, "l double").agg(F.sum("l")).first()[0] or 0.0

    last = None
    for turn in range(iterations):
        theta = half("cell_id", beta, a, b)
        beta = half("gene_id", theta, c, d)
        if turn % 10 == 9:
            now = likelihood()
            if last is not None and abs(now - last) <= tolerance * abs(last):
                break
            last = now
    return tuple(whole.rows(key, state, 2 * k).select(key, F.slice("v", 1, k).alias(name)) for key, state, name in (("cell_id", theta, "theta"), ("gene_id", beta, "beta")))


def harmonise(factors: DataFrame, batches: DataFrame, *, clusters: int = 10, rounds: int = 5, sigma: float = 0.1, penalty: float = 1.0, ridge: float = 1.0, seed: int = 1) -> DataFrame:
    """Batch correction of factors(cell_id, vec) by soft clusters with a diversity penalty and a ridge for each cluster.

    Every round sums, over cells, weights and weighted vectors by cluster and
    batch (clusters x batches x dimensions numbers); the shifts follow from
    them and are subtracted from each cell by its own cluster weights. Without
    batches or with one the factors return as they are.
    """
    names = [r.batch for r in batches.select("batch").distinct().orderBy("batch").collect()]
    if len(names) < 2:
        return factors
    code = {b: i for i, b in enumerate(names)}
    d = persist(factors.join(batches, "cell_id").select("cell_id", "vec", F.col("vec").alias("now"), F.create_map(*[F.lit(x) for kv in code.items() for x in kv])[F.col("batch")].alias("b")))
    from pyspark.ml.clustering import KMeans

    unit = F.transform("now", lambda v: v / F.sqrt(F.aggregate("now", F.lit(1e-12), lambda t, x: t + x * x)))
    centres = np.array(KMeans(k=clusters, seed=seed, maxIter=5, featuresCol="v").fit(d.select(array_to_vector(unit).alias("v"))).clusterCenters())
    share = np.ones((len(names), clusters))
    n_b = np.array([r["count"] for r in d.groupBy("b").count().orderBy("b").collect()], float)
    for _ in range(rounds):

        def weights(vec: np.ndarray, b: np.ndarray, centres=centres, share=share) -> np.ndarray:
            x = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
            c = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
            e = -2 * (1 - x @ c.T) / sigma + penalty * np.log(share[b])
            r = np.exp(e - e.max(1, keepdims=True))
            return r / r.sum(1, keepdims=True)

        def sums(batches_):
            for p in batches_:
                if len(p):
                    now, vec, b = np.stack(p["now"]), np.stack(p["vec"]), p["b"].to_numpy()
                    r = weights(now, b)
                    x = now / np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-12)
                    rows = []
                    for i in np.unique(b):
                        on = b == i
                        for k in range(clusters):
                            rows.append((int(i), k, float(r[on, k].sum()), (r[on, k] @ vec[on]).tolist(), (r[on, k] @ x[on]).tolist()))
                    yield pd.DataFrame(rows, columns=["b", "k", "w", "s", "u"])

        dim = len(d.first()["vec"])
        got = d.mapInPandas(sums, "b int, k int, w double, s array<double>, u array<double>").groupBy("b", "k").agg(F.sum("w").alias("w"), *[F.sum(F.element_at(c, j + 1)).alias(f"{c}{j}") for c in "su" for j in range(dim)]).collect()
        w, s, u = np.zeros((len(names), clusters)), np.zeros((len(names), clusters, dim)), np.zeros((clusters, dim))
        for r in got:
            w[r.b, r.k] = r.w
            s[r.b, r.k] = [r[f"s{j}"] for j in range(dim)]
            u[r.k] += [r[f"u{j}"] for j in range(dim)]
        centres = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        expected = w.sum(0)[None] * (n_b / n_b.sum())[:, None]
        share = (expected + 1) / (w + 1)
        mean = s.sum(0) / np.maximum(w.sum(0), 1e-12)[:, None]
        shift = (s - w[:, :, None] * mean[None]) / (w + ridge)[:, :, None]

        def correct(batches_, shift=shift):
            for p in batches_:
                if len(p):
                    r = weights(np.stack(p["now"]), p["b"].to_numpy())
                    new = np.stack(p["vec"]) - np.einsum("nk,nkd->nd", r, shift[p["b"].to_numpy()])
                    yield p.assign(now=list(new))

        d = persist(d.mapInPandas(correct, d.schema))
    return d.select("cell_id", F.col("now").alias("vec"))
