"""Poisson factor model of counts: log mean = log total + gene offset + factors . loadings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import persist


def poisson_glm_factors(matrix: DataFrame, k: int, *, rounds: int = 200, tolerance: float = 1e-4, penalty: float = 1.0, genes: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(cell_id, factors), the genes' (offset, loadings) and the deviance after each round.

    genes limits the model to a selection, whose loadings (a few thousand rows of
    k + 1 numbers) go to every task. A round is one pass over the cells: each
    task takes a Fisher step for its cells and adds up gradient and curvature of
    the loadings, dense over the selected genes; their sums give the loadings' step.
    Ends when a round changes the deviance by less than the share `tolerance`, after `rounds` at most.
    Cells without counts of these genes are no rows of the model; without genes it has none.
    """
    m = matrix.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi") if genes is not None else matrix
    ids = [r.gene_id for r in m.select("gene_id").distinct().orderBy("gene_id").collect()]
    place = {g: i for i, g in enumerate(ids)}
    g = len(ids)
    if not g:
        kind = matrix.schema["cell_id"].dataType.simpleString()
        return matrix.sparkSession.createDataFrame([], f"cell_id {kind}, factors array<double>"), np.zeros((0, k + 1)), []
    per_gene = {r.gene_id: r.t for r in m.groupBy("gene_id").agg(F.sum("n").alias("t")).collect()}
    total = sum(per_gene.values())
    offset = np.log(np.array([per_gene[i] for i in ids], float) / total)
    load = np.random.default_rng(seed).normal(0, 0.1, (g, k))
    cells = persist(m.groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", "n")).alias("c"), F.sum("n").alias("t")).withColumn("f", F.array(*[((F.xxhash64("cell_id", F.lit(seed + j)) % 1000) / 5000.0) for j in range(k)])))
    history: list[float] = []
    for _ in range(rounds):

        def step(batches, offset=offset, load=load):
            grad, curve, dev, n_rows = np.zeros((g, k + 1)), np.zeros((g, k + 1)), 0.0, 0
            for p in batches:
                if not len(p):
                    continue
                y = np.zeros((len(p), g))
                for i, c in enumerate(p["c"]):
                    for e in c:
                        y[i, place[e["gene_id"]]] = e["n"]
                f, size = np.stack(p["f"]), np.log(p["t"].to_numpy(float))[:, None]
                mu = np.exp(np.clip(size + offset + f @ load.T, -30, 30))
                f = f + np.clip(((y - mu) @ load - penalty * f) / (mu @ load**2 + penalty), -1, 1)
                mu = np.exp(np.clip(size + offset + f @ load.T, -30, 30))
                r = y - mu
                grad[:, 1:] += r.T @ f
                curve[:, 1:] += mu.T @ f**2
                grad[:, 0] += r.sum(0)
                curve[:, 0] += mu.sum(0)
                dev += 2 * float((np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0) - r).sum())
                n_rows += len(p)
                yield pd.DataFrame({"cell_id": p["cell_id"], "f": list(f), "gene": -1, "grad": [None] * len(p), "curve": [None] * len(p), "dev": 0.0})
            if n_rows:
                yield pd.DataFrame({"cell_id": [None] * g, "f": [None] * g, "gene": range(g), "grad": list(grad), "curve": list(curve), "dev": [dev / g] * g})

        out = persist(cells.mapInPandas(step, "cell_id long, f array<double>, gene int, grad array<double>, curve array<double>, dev double"))
        sums = out.where("gene >= 0").groupBy("gene").agg(F.sum("dev").alias("dev"), *[F.sum(F.element_at(c, j + 1)).alias(f"{c}{j}") for c in ("grad", "curve") for j in range(k + 1)]).orderBy("gene").collect()
        grad = np.array([[r[f"grad{j}"] for j in range(k + 1)] for r in sums])
        curve = np.array([[r[f"curve{j}"] for j in range(k + 1)] for r in sums])
        history.append(sum(r.dev for r in sums))
        offset = offset + np.clip(grad[:, 0] / np.maximum(curve[:, 0], 1e-9), -1, 1)
        load = load + np.clip((grad[:, 1:] - penalty * load) / (curve[:, 1:] + penalty), -0.5, 0.5)
        cells = persist(cells.drop("f").join(out.where("gene < 0").select("cell_id", "f"), "cell_id"))
        if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance * abs(history[-2]):
            break
    # orthogonal factors in the order of their loadings' size
    _, s, rot = np.linalg.svd(load, full_matrices=False)
    turned = cells.select("cell_id", F.array(*[sum((F.element_at("f", i + 1) * float(rot[j, i]) for i in range(k)), F.lit(0.0)) for j in range(k)]).alias("factors"))
    return turned, np.column_stack([offset, load @ rot.T]), history
