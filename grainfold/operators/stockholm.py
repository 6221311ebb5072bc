"""Recursive bisection of cells by normalised cuts, all nodes of a level in the same Spark jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import div0
from ..plans.storage import persist
from .windows import positions

#: Modularity is not asked for while there are so few clusters.
FREE_CLUSTERS = 8


def stockholm(matrix: DataFrame, cells: DataFrame, genes: DataFrame, *, masked: DataFrame | None = None, n_genes: int = 500, cut_at: float = 0.1, min_q: float = 0.01, min_cells: int = 100) -> tuple[DataFrame, DataFrame]:
    """(cell_id, cluster, fine, path) and the tree (path, q, height, n_cells) of its splits.

    matrix(cell_id, gene_id, n), cells(cell_id), genes(gene_id) that count, masked(gene_id)
    those of them that are never chosen. A node of
    min_cells or more takes positive residuals within itself and its n_genes genes of greatest
    residual variance (ties: smaller gene_id), and is cut by the sign of the second left singular vector. It stays whole if a cell is all
    zero there, if one side is empty or, once a level begins with over FREE_CLUSTERS clusters, if the
    modularity of the cut is min_q or less. A path has a letter for each split, 0 for the side of
    the least cell_id; fine numbers the leaves in the order of their paths. A split's height is the greatest
    sum of q on the ways to its leaves; cluster numbers the highest nodes of height cut_at or less.
    Empty cells give no rows; without counts all cells are one cluster.
    """
    counts = persist(matrix.join(genes.select("gene_id").distinct(), "gene_id", "left_semi").where("n > 0").select("cell_id", "gene_id", "n"))
    at = persist(cells.select("cell_id").distinct().select("cell_id", F.lit("").alias("path"), F.lit(False).alias("leaf")))
    splits = None
    while True:
        size = at.where("not leaf").groupBy("path").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
        size = persist(size)
        if size.isEmpty():
            break
        n_clusters = at.select("path").distinct().count()
        b = persist(_rows(counts, at.where("not leaf").join(size, "path").select("cell_id", F.col("path").alias("node"), "n_cells"), masked, n_genes))
        # a cell without a row in b is all zero
        whole = b.groupBy("node").agg(F.count_distinct("cell_id").alias("met")).join(size.withColumnRenamed("path", "node"), "node").where("met = n_cells").select("node")
        b = persist(b.join(whole, "node", "left_semi"))
        if b.isEmpty():
            break
        sides = halves(b)
        cut = modularity(b, sides).where("n0 > 0 and n1 > 0")
        if n_clusters > FREE_CLUSTERS:
            cut = cut.where(F.col("q") > min_q)
        cut = persist(cut.select(F.col("node").alias("path"), "q", (F.col("n0") + F.col("n1")).alias("n_cells")))
        splits = cut if splits is None else splits.unionByName(cut)
        side = sides.join(cut.select(F.col("path").alias("node")), "node", "left_semi").select("cell_id", F.col("side").cast("string").alias("side"))
        at = persist(at.join(side, "cell_id", "left").select("cell_id", F.concat("path", F.coalesce("side", F.lit(""))).alias("path"), F.col("side").isNull().alias("leaf")))
    if splits is None:
        splits = at.select("path", F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("n_cells")).limit(0)
    return _numbered(at, splits, cut_at)


def _rows(counts: DataFrame, members: DataFrame, masked: DataFrame | None, n_genes: int) -> DataFrame:
    """(node, cell_id, gene_id, v): positive residuals within each node, its chosen genes, cells scaled to length 1."""
    d = counts.join(members, "cell_id")
    cell = counts.groupBy("cell_id").agg(F.sum("n").alias("cell_total"))
    gene = d.groupBy("node", "gene_id").agg(F.sum("n").alias("gene_total"))
    total = gene.groupBy("node").agg(F.sum("gene_total").cast("double").alias("total"))
    d = d.join(cell, "cell_id").join(gene, ["node", "gene_id"]).join(total, "node")
    mu = F.col("cell_total") * F.col("gene_total") / F.col("total")
    r = F.greatest(F.lit(0.0), F.least(div0(F.col("n") - mu, F.sqrt(mu + mu * mu / 100)), F.sqrt(F.col("n_cells").cast("double"))))
    d = persist(d.select("node", "cell_id", "gene_id", "n_cells", r.alias("r")))
    mean = F.sum("r") / F.first("n_cells")
    var = d.groupBy("node", "gene_id").agg((F.sum(F.col("r") * F.col("r")) / F.first("n_cells") - mean * mean).alias("var"))
    if masked is not None:
        var = var.join(masked.select("gene_id"), "gene_id", "left_anti")
    best = var.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("var"), "gene_id"))).where(F.col("k") <= n_genes)
    d = d.where("r > 0").join(best.select("node", "gene_id"), ["node", "gene_id"], "left_semi")
    length = d.groupBy("cell_id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("l"))
    return d.join(length, "cell_id").select("node", "cell_id", "gene_id", (F.col("r") / F.col("l")).alias("v"))


def halves(b: DataFrame, *, width: int = 6, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """(node, cell_id, side) from b(node, cell_id, gene_id, v), rows of length 1: the sign of the second left singular vector of each node.

    A block of `width` vectors is multiplied by the scaled similarity, as joins from cells to genes and back, and made
    orthogonal from its products alone, a matrix of width x width for each node. The first vector, the roots
    of the degrees, is taken out in every round. Ends when no node's value changes by more than the share `tolerance`, after `rounds` at most.
    """
    xs = [f"x{j}" for j in range(width)]
    total = b.groupBy("node", "gene_id").agg(F.sum("v").alias("g"))
    d = b.join(total, ["node", "gene_id"]).groupBy("node", "cell_id").agg(F.sqrt(F.sum(F.col("v") * F.col("g"))).alias("d"))
    start = [(F.pmod(F.xxhash64("cell_id", F.lit(j)), F.lit(100_003)) / 100_003.0 - 0.5).alias(c) for j, c in enumerate(xs)]
    x, before = persist(d.select("node", "cell_id", "d", *start)), None
    pairs = [(i, j) for i in range(width) for j in range(width)]

    @F.pandas_udf("array<double>")
    def turned(t: pd.Series, o: pd.Series, gram: pd.Series) -> pd.Series:
        off = np.stack(o.to_list()).reshape(-1, width)
        g = np.stack(gram.to_list()).reshape(-1, width, width) - off[:, :, None] * off[:, None, :] / t.to_numpy()[:, None, None]
        value, vector = np.linalg.eigh(g)
        value, vector = value[:, ::-1], vector[:, :, ::-1]
        keep = value > 1e-12 * np.maximum(value[:, :1], 1e-300)
        scaled = vector * np.where(keep, 1 / np.sqrt(np.where(keep, value, 1)), 0)[:, None, :]
        return pd.Series(list(np.hstack([scaled.reshape(len(g), -1), value[:, :1]])))

    for _ in range(rounds):
        y = x.select("node", "cell_id", *[(F.col(c) / F.col("d")).alias(c) for c in xs])
        g = b.join(y, ["node", "cell_id"]).groupBy("node", "gene_id").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in xs])
        n = b.join(g, ["node", "gene_id"]).groupBy("node", "cell_id").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in xs])
        n = persist(n.join(x.select("cell_id", "d"), "cell_id").select("node", "cell_id", "d", *[(F.col(c) / F.col("d")).alias(c) for c in xs]))
        sums = n.groupBy("node").agg(
            F.sum(F.col("d") * F.col("d")).alias("t"),
            F.array(*[F.sum(F.col(c) * F.col("d")) for c in xs]).alias("o"),
            F.array(*[F.sum(F.col(xs[i]) * F.col(xs[j])) for i, j in pairs]).alias("gram"),
        )
        turn = persist(sums.select("node", "t", "o", turned("t", "o", "gram").alias("w")))
        flat = [F.col(c) - F.element_at("o", i + 1) / F.col("t") * F.col("d") for i, c in enumerate(xs)]
        x = n.join(turn, "node").select("node", "cell_id", "d", *[sum((flat[i] * F.element_at("w", i * width + j + 1) for i in range(width)), F.lit(0.0)).alias(c) for j, c in enumerate(xs)])
        now = turn.select("node", F.element_at("w", -1).alias("value"))
        if before is not None:
            change = F.max(F.abs(F.col("value") - F.col("old")) - tolerance * F.col("value"))
            if (now.join(before.withColumnRenamed("value", "old"), "node").agg(change.alias("c")).first().c or 0.0) <= 0:
                break
        before = now
    x = persist(x.select("node", "cell_id", (F.col("x0") > 0).alias("up")))
    first = x.groupBy("node").agg(F.min_by("up", "cell_id").alias("first"))
    return persist(x.join(first, "node").select("node", "cell_id", (F.col("up") != F.col("first")).cast("int").alias("side")))


def modularity(b: DataFrame, sides: DataFrame) -> DataFrame:
    """(node, q, n0, n1): modularity of each node's two sides under the similarity of its rows."""
    part = b.join(sides.select("cell_id", "side"), "cell_id").groupBy("node", "gene_id").agg(*[F.sum(F.when(F.col("side") == s, F.col("v")).otherwise(0.0)).alias(f"s{s}") for s in (0, 1)])
    sums = part.groupBy("node").agg(F.sum(F.col("s0") * F.col("s0")).alias("a"), F.sum(F.col("s1") * F.col("s1")).alias("b"), F.sum(F.col("s0") * F.col("s1")).alias("c"))
    size = sides.groupBy("node").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    n = F.col("n0") + F.col("n1")
    whole = F.col("a") + F.col("b") + 2 * F.col("c") - n
    share = [div0(F.col(k) - n, whole) - div0(F.col(k) + F.col("c") - n, whole) ** 2 for k in ("a", "b")]
    return sums.join(size, "node").select("node", (share[0] + share[1]).alias("q"), "n0", "n1")


def _numbered(at: DataFrame, splits: DataFrame, cut_at: float) -> tuple[DataFrame, DataFrame]:
    """Heights from the leaves, numbers of leaves and of the nodes left after the cut."""
    leaves = persist(at.select("path").distinct())
    above = leaves.select(F.col("path").alias("leaf"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))).alias("path"))
    way = above.join(splits, "path", "left").select("leaf", "path", F.coalesce("q", F.lit(0.0)).alias("q"))
    below = F.sum("q").over(Window.partitionBy("leaf").orderBy(F.desc(F.length("path"))))
    height = way.withColumn("below", below).groupBy("path").agg(F.max("below").alias("height"))
    low = above.join(height, "path").where((F.col("height") <= cut_at) | (F.col("path") == F.col("leaf")))
    top = persist(low.groupBy("leaf").agg(F.min_by("path", F.length("path")).alias("top")))
    fine = positions(leaves, ["path"], "fine")
    cluster = positions(top.select("top").distinct(), ["top"], "cluster")
    found = at.join(fine, "path").join(top.withColumnRenamed("leaf", "path"), "path").join(cluster, "top")
    return found.select("cell_id", "cluster", "fine", "path"), splits.join(height, "path").select("path", "q", "height", "n_cells")
