"""Enrichment, trinarisation, annotation, set scores, differential expression."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import div0
from ..functions.tails import beta_tail, student_p
from ..plans.storage import persist
from .aggregate import aggregate_matrix


def enrichment(groups: DataFrame) -> DataFrame:
    """groups(group_id, gene_id, mean, nnz, count), dense, with `enrichment` against all other groups together.

    (f + 0.1) / (f_o + 0.1) * (m + 0.01) / (m_o + 0.01): f share of cells with
    the gene, m mean, _o over the cells of the other groups.
    """
    w = Window.partitionBy("gene_id")
    n, m, k = F.col("count"), F.col("mean"), F.col("nnz")
    rest = F.sum(n).over(w) - n
    m_o = div0(F.sum(n * m).over(w) - n * m, rest)
    f_o = div0(F.sum(k).over(w) - k, rest)
    return groups.withColumn("enrichment", (div0(k, n) + 0.1) / (f_o + 0.1) * (m + 0.01) / (m_o + 0.01))


def enrichment_by(matrix: DataFrame, groups: DataFrame, genes: DataFrame) -> DataFrame:
    """Enrichment for any labels: groups(cell_id, group_id)."""
    return enrichment(aggregate_matrix(matrix, groups, genes, ["mean", "nnz", "count"])).select("group_id", "gene_id", "enrichment")


def trinarize(groups: DataFrame, f: float = 0.2) -> DataFrame:
    """groups(group_id, gene_id, nnz, count) with the posterior probability that at least a share f of the group expresses the gene.

    The prior is Beta(1.5, 2), so the posterior tail is an incomplete beta
    function. Equal (nnz, count) are computed once.
    """
    keys = groups.select("nnz", "count").distinct()
    below = beta_tail(1.5 + F.col("nnz"), 2 + F.col("count") - F.col("nnz"), f)
    table = keys.withColumn("p", F.greatest(F.lit(0.0), 1.0 - below))
    return groups.join(table, ["nnz", "count"]).select("group_id", "gene_id", F.col("p").alias("probability"))


def annotate(trinaries: DataFrame, genes: DataFrame, terms: DataFrame) -> DataFrame:
    """(group_id, term, posterior): the product of p for genes a term wants (+) and of 1 - p for those it excludes (-).

    trinaries(group_id, gene_id, probability), terms(term, definition) such as
    "+G1 -G2". Genes that do not occur are left out of the product.
    """
    token = terms.select("term", F.explode(F.split(F.trim("definition"), r"\s+")).alias("t"))
    token = token.select("term", F.substring("t", 1, 1).alias("sign"), F.expr("substring(t, 2)").alias("gene"))
    wanted = token.join(genes.select("gene_id", "gene"), "gene")
    p = F.when(F.col("sign") == "-", 1 - F.col("probability")).otherwise(F.col("probability"))
    found = trinaries.join(F.broadcast(wanted), "gene_id").groupBy("group_id", "term").agg(F.product(p).alias("posterior"))
    every = trinaries.select("group_id").distinct().crossJoin(F.broadcast(terms.select("term")))
    return every.join(found, ["group_id", "term"], "left").select("group_id", "term", F.coalesce("posterior", F.lit(1.0)).alias("posterior"))


def gene_set_score(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Running-sum score of gene sets per group, in the order of gene_id: groups(group_id, gene_id, enrichment), members(set_name, gene_id).

    The largest difference between the share of the set's enrichment seen so far
    and the share of other genes seen so far.
    """
    every = groups.crossJoin(F.broadcast(members.select("set_name").distinct()))
    d = every.join(F.broadcast(members.withColumn("hit", F.lit(1.0))), ["set_name", "gene_id"], "left")
    hit = F.coalesce("hit", F.lit(0.0))
    d = d.select("group_id", "set_name", "gene_id", (F.col("enrichment") * hit).alias("e"), (1 - hit).alias("miss"))
    total = Window.partitionBy("group_id", "set_name")
    so_far = total.orderBy("gene_id").rowsBetween(Window.unboundedPreceding, 0)
    gap = div0(F.sum("e").over(so_far), F.sum("e").over(total)) - div0(F.sum("miss").over(so_far), F.sum("miss").over(total))
    return d.select("group_id", "set_name", gap.alias("gap")).groupBy("group_id", "set_name").agg(F.max("gap").alias("score"))


def gene_set_p(groups: DataFrame, members: DataFrame, *, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(group_id, set_name, score, p): gene_set_score and the share of permuted sets of the same size that reach it.

    A group and a set are one task's work: one number a gene, and one random set of them at a time.
    """
    every = groups.select("group_id", "gene_id", "enrichment").crossJoin(members.select("set_name").distinct())
    d = every.join(members.select("set_name", "gene_id", F.lit(True).alias("hit")).distinct(), ["set_name", "gene_id"], "left")
    d = d.select("group_id", "set_name", "gene_id", "enrichment", F.coalesce("hit", F.lit(False)).alias("hit"))

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf["gene_id"].to_numpy().argsort(kind="stable")
        e, hit = pdf["enrichment"].to_numpy(float)[order], pdf["hit"].to_numpy(bool)[order]
        group, name = key
        r = np.random.default_rng([seed, zlib.crc32(f"{group}:{name}".encode())])
        score = running_score(e, np.flatnonzero(hit))
        null = np.array([running_score(e, r.choice(len(e), int(hit.sum()), replace=False, shuffle=False)) for _ in range(permutations)])
        p = 1 - np.searchsorted(np.sort(null), score) / permutations
        return pd.DataFrame({"group_id": [group], "set_name": [name], "score": [score], "p": [p]})

    shape = f"group_id {groups.schema['group_id'].dataType.simpleString()}, set_name string, score double, p double"
    return d.groupBy("group_id", "set_name").applyInPandas(test, shape)


def running_score(enrichment: np.ndarray, members: np.ndarray) -> float:
    """The running-sum score of the set of the genes at these places.

    The sum falls from gene to gene outside the set and rises at its members, so only those are looked at, unless a number is below 0.
    """
    hit = np.zeros(len(enrichment), bool)
    hit[members] = True
    at = np.flatnonzero(hit)
    inside = np.cumsum(enrichment[at])
    if not len(at) or not inside[-1] > 0 or enrichment.min() < 0:
        return running_scores(enrichment, hit[None])[0]
    outside = (at - np.arange(len(at))).astype(float)
    if len(at) < len(hit):
        outside /= len(hit) - len(at)
    return (inside / inside[-1] - outside).max()


def running_scores(enrichment: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """The running-sum score of each row of sets, true where a gene belongs."""
    inside, outside = np.cumsum(enrichment * sets, axis=1), np.cumsum(~sets, axis=1, dtype=float)
    for x in (inside, outside):
        last = x[:, -1:]
        np.divide(x, last, out=x, where=last != 0)
    return (inside - outside).max(1)


def differential(matrix: DataFrame, groups: DataFrame, genes: DataFrame) -> DataFrame:
    """Welch's t for each pair of groups (g1 < g2) and gene, its degrees of freedom, and both means and shares of cells.

    Without spread, or with a group of one cell, t is 0 and df null.
    """
    s = aggregate_matrix(matrix, groups, genes, ["mean", "variance", "nnz", "count"])
    one = s.select("gene_id", F.col("group_id").alias("g1"), F.col("mean").alias("m1"), F.col("variance").alias("v1"), F.col("nnz").alias("k1"), F.col("count").alias("n1"))
    two = s.select("gene_id", F.col("group_id").alias("g2"), F.col("mean").alias("m2"), F.col("variance").alias("v2"), F.col("nnz").alias("k2"), F.col("count").alias("n2"))
    d = one.join(two, "gene_id").where("g1 < g2")
    # population to sample variance
    e1, e2 = div0(F.col("v1"), F.col("n1") - 1), div0(F.col("v2"), F.col("n2") - 1)
    se = F.sqrt(e1 + e2)
    df = F.try_divide((e1 + e2) * (e1 + e2), div0(e1 * e1, F.col("n1") - 1) + div0(e2 * e2, F.col("n2") - 1))
    return d.select("g1", "g2", "gene_id", "m1", "m2", div0(F.col("k1"), F.col("n1")).alias("f1"), div0(F.col("k2"), F.col("n2")).alias("f2"), div0(F.col("m1") - F.col("m2"), se).alias("t"), df.alias("df"))


def with_q(tests: DataFrame, keys: tuple[str, ...] = ("g1", "g2"), item: str = "gene_id") -> DataFrame:
    """tests(keys, item, t, df) with p (two-sided, 1 where df is null) and q, the step-up correction of p within keys.

    Tests are dealt into ranges of (keys, p): ranks and the least value from a
    test upwards are a range's own plus what one row for each key and range adds,
    so no task has more than a range.
    """
    ranges = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = tests.withColumn("p", F.coalesce(student_p(F.col("t"), F.col("df")), F.lit(1.0)))
    d = persist(d.repartitionByRange(ranges, *keys, "p", item).withColumn("_range", F.spark_partition_id()))
    size = d.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    of = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.select(*keys, "_range", earlier.alias("_skip"), F.sum("_n").over(of).alias("_all"))
    here = Window.partitionBy(*keys, "_range")
    d = d.join(size, [*keys, "_range"]).withColumn("_raw", F.col("p") * F.col("_all") / (F.col("_skip") + F.row_number().over(here.orderBy("p", item))))
    d = persist(d.withColumn("_up", F.min("_raw").over(here.orderBy(F.desc("p"), F.desc(item)).rowsBetween(Window.unboundedPreceding, 0))).drop("_raw", "_skip", "_all"))
    later = F.min("_least").over(of.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    least = d.groupBy(*keys, "_range").agg(F.min("_up").alias("_least")).select(*keys, "_range", later.alias("_later"))
    return d.join(least, [*keys, "_range"]).withColumn("q", F.least(F.lit(1.0), "_up", "_later")).drop("_range", "_up", "_later")


def binary_differential(tests: DataFrame, min_t: float = 3.29, min_fold: float = 2.0, min_share: float = 0.3, min_gap: float = 0.7, max_q: float | None = None) -> DataFrame:
    """Counts of genes that are on in one group of a pair and off in the other.

    Significant by q under max_q (tests of with_q) or, without max_q, by |t|
    (the normal bound of p = 0.001), at least min_fold apart,
    seen in min_share of the upper group, and the shares min_gap apart relative to the larger.
    """
    up = F.col("m1") >= F.col("m2")
    high, low = F.when(up, F.col("m1")).otherwise(F.col("m2")), F.when(up, F.col("m2")).otherwise(F.col("m1"))
    f_high, f_low = F.when(up, F.col("f1")).otherwise(F.col("f2")), F.when(up, F.col("f2")).otherwise(F.col("f1"))
    on = (F.abs("t") > min_t if max_q is None else F.col("q") < max_q) & (high >= min_fold * low) & (f_high > min_share) & (div0(f_high - f_low, F.greatest("f1", "f2")) > min_gap)
    return tests.groupBy("g1", "g2").agg(F.count_if(on).alias("n_genes"))


def signature_scores(matrix: DataFrame, cells: DataFrame, genes: DataFrame, members: DataFrame, *, n_bins: int = 30, n_controls: int = 100, per: float = 1000.0) -> DataFrame:
    """(cell_id, set_name, score): mean of the set's expression less that of control genes of similar abundance.

    Expression is per 1000 counts and centred for each gene. Genes are ranked by
    total and cut into n_bins of equal size (the rest, at the low end, has no
    bin); a gene's controls are the first n_controls of its bin by a hash, so
    results repeat. Both means are linear in the counts: they are sums over the
    non-zeros with one weight a gene and set.
    """
    total = matrix.groupBy("gene_id").agg(F.sum("n").alias("t"))
    ranked = genes.select("gene_id").join(total, "gene_id", "left").withColumn("rn", F.row_number().over(Window.orderBy(F.coalesce("t", F.lit(0)), "gene_id")))
    n = genes.count()
    size = n // n_bins
    skip = n - size * n_bins
    bins = ranked.where(F.col("rn") > skip).select("gene_id", F.floor((F.col("rn") - 1 - skip) / max(size, 1)).alias("bin"))
    control = bins.withColumn("c", F.row_number().over(Window.partitionBy("bin").orderBy(F.md5(F.col("gene_id").cast("string").cast("binary")), "gene_id"))).where(F.col("c") <= n_controls)
    length = members.groupBy("set_name").agg(F.count("*").alias("len"))
    plus = members.join(length, "set_name").select("set_name", "gene_id", (1.0 / F.col("len")).alias("w"))
    minus = members.join(bins, "gene_id").join(length, "set_name").join(control.select("bin", F.col("gene_id").alias("g")), "bin")
    minus = minus.select("set_name", F.col("g").alias("gene_id"), (-1.0 / (F.col("len") * n_controls)).alias("w"))
    weight = plus.union(minus).groupBy("set_name", "gene_id").agg(F.sum("w").alias("w"))
    cell_total = matrix.groupBy("cell_id").agg(F.sum("n").alias("cell_total"))
    x = matrix.join(cell_total, "cell_id").select("cell_id", "gene_id", (F.col("n") * per / F.col("cell_total")).alias("x"))
    raw = x.join(F.broadcast(weight), "gene_id").groupBy("cell_id", "set_name").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    every = cells.select("cell_id").crossJoin(F.broadcast(members.select("set_name").distinct())).join(raw, ["cell_id", "set_name"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    # centring each gene takes the mean of the weighted sum from every cell
    centre = every.groupBy("set_name").agg(F.avg("s").alias("c"))
    return every.join(F.broadcast(centre), "set_name").select("cell_id", "set_name", (F.col("s") - F.col("c")).alias("score"))


def signature_bootstrap(matrix: DataFrame, cells: DataFrame, genes: DataFrame, *, alpha: float = 0.01, n_sets: int = 100, set_size: int = 100, **how) -> DataFrame:
    """(cell_id, threshold): the 1 - alpha percentile of a cell's scores for random sets of genes, each the first set_size by a hash."""
    every = genes.select("gene_id").crossJoin(F.broadcast(genes.sparkSession.range(n_sets).withColumnRenamed("id", "set_name")))
    key = F.md5(F.concat(F.col("set_name").cast("string"), F.lit(":"), F.col("gene_id").cast("string")).cast("binary"))
    sets = every.withColumn("r", F.row_number().over(Window.partitionBy("set_name").orderBy(key, "gene_id"))).where(F.col("r") <= set_size)
    scores = signature_scores(matrix, cells, genes, sets.select("set_name", "gene_id"), **how)
    return scores.groupBy("cell_id").agg(F.percentile("score", F.lit(1 - alpha)).alias("threshold"))


def best_signature(scores: DataFrame) -> DataFrame:
    """(cell_id, set_name, score): the best set of each cell, the first name on ties."""
    m = scores.groupBy("cell_id").agg(F.max("score").alias("score"))
    return scores.join(m, ["cell_id", "score"]).groupBy("cell_id").agg(F.min("set_name").alias("set_name"), F.first("score").alias("score"))
