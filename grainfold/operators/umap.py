"""A layout of a neighbour graph by attraction along edges and repulsion from sampled cells (UMAP).

Distances become edge weights: each cell's bandwidth makes its weights add up to
the logarithm of their number, and the two directions of an edge are united as
fuzzy sets. The layout starts from two principal components. In a round every
part of the cells gets the places of its neighbours and of a fixed number of
cells drawn at random, and takes a few steps by them; then all places move on
together. A round moves each edge and each part's draw once, at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import persist
from .aggregate import require_aligned
from .graph import knn_approximate

#: Cells of a part, cells drawn for it in a round, negatives of an edge, steps of a round.
PART, DRAWN, NEGATIVES, STEPS = 2_000, 2_000, 5, 10
ROUNDS = 20


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), the nearest by least squares to 1 up to min_dist and a decay by spread beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([1.0, 1.0])
    damp = 1.0
    loss = lambda p: float(((1 / (1 + p[0] * d ** (2 * p[1])) - want) ** 2).sum())
    for _ in range(300):
        power = d ** (2 * p[1])
        value = 1 / (1 + p[0] * power)
        slope = np.stack([-power * value**2, -2 * p[0] * power * np.log(d) * value**2], 1)
        step = np.linalg.solve(slope.T @ slope + damp * np.eye(2), slope.T @ (want - value))
        better = p + step
        if (better > 0).all() and loss(better) < loss(p):
            p, damp = better, damp / 3
        else:
            damp *= 3
    return float(p[0]), float(p[1])


def bandwidths(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of neighbour distances (inf where there is none): the least positive one, and the bandwidth by bisection.

    The weights exp(-(d - least) / bandwidth) of a row add up to the base-2 logarithm of their number.
    """
    known = np.isfinite(d)
    least = np.where(known & (d > 0), d, np.inf).min(1, initial=np.inf)
    least = np.where(np.isfinite(least), least, 0.0)
    beyond = np.where(known, np.maximum(d - least[:, None], 0.0), np.inf)
    want = np.log2(np.maximum(known.sum(1), 2))
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    width = np.ones(len(d))
    for _ in range(64):
        total = np.exp(-beyond / width[:, None]).sum(1)
        over = total > want
        high, low = np.where(over, width, high), np.where(over, low, width)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
    mean = np.where(known, d, 0.0).sum(1) / np.maximum(known.sum(1), 1)
    return least, np.maximum(width, np.maximum(1e-3 * mean, 1e-12))


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """(src, dst, weight), both directions: the union of the directed weights of neighbours(src, dst, dist), k a cell."""

    def weigh(batches):
        for p in batches:
            size = p["d"].map(len).to_numpy()
            d = np.full((len(p), int(size.max(initial=1))), np.inf)
            for row, x in enumerate(p["d"]):
                d[row, : len(x)] = x
            least, width = bandwidths(d)
            w = np.exp(-np.maximum(d - least[:, None], 0.0) / width[:, None])
            yield pd.DataFrame({"src": p["src"], "dsts": p["dsts"], "w": [list(w[i, :n]) for i, n in enumerate(size)]})

    each = neighbours.where("src <> dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("e"))
    each = each.select("src", F.transform("e", lambda e: e["dist"]).alias("d"), F.transform("e", lambda e: e["dst"]).alias("dsts"))
    one = each.mapInPandas(weigh, "src long, dsts array<long>, w array<double>").select("src", F.explode(F.arrays_zip("dsts", "w")).alias("z")).select("src", F.col("z.dsts").alias("dst"), F.col("z.w").alias("w"))
    both = one.withColumn("back", F.lit(0.0)).unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.col("w").alias("back")))
    sums = both.groupBy("src", "dst").agg(F.sum("w").alias("w"), F.sum("back").alias("back"))
    return sums.select("src", "dst", (F.col("w") + F.col("back") - F.col("w") * F.col("back")).alias("weight"))


def _start(factors: DataFrame, scale: float = 10.0) -> DataFrame:
    """(cell_id, x, y): two principal components of vec, the wider one over `scale` on each side, with a little noise by hash."""

    def moments(batches):
        n, s, ss = 0, 0.0, 0.0
        for p in batches:
            if len(p):
                v = np.stack(p["vec"].to_numpy())
                n, s, ss = n + len(v), s + v.sum(0), ss + v.T @ v
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]) if a and b else a or b
    total = factors.select("vec").mapInPandas(moments, "n long, s array<double>, ss array<double>").rdd.map(lambda r: (r.n, np.array(r.s), np.array(r.ss))).treeAggregate(None, add, add)
    n, s, ss = total
    mean = s / n
    values, axes = np.linalg.eigh(ss.reshape(len(s), -1) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :2]
    axes = axes if axes.shape[1] == 2 else np.pad(axes, ((0, 0), (0, 2 - axes.shape[1])))
    by = scale / (3 * np.sqrt(max(values[-1], 1e-12)))

    def project(batches):
        for p in batches:
            if len(p):
                q = (np.stack(p["vec"].to_numpy()) - mean) @ axes * by
                yield pd.DataFrame({"cell_id": p["cell_id"], "x": q[:, 0], "y": q[:, 1]})

    noise = lambda axis: F.pmod(F.xxhash64("cell_id", F.lit(axis)), F.lit(10_007)) / 1e8
    placed = factors.select("cell_id", "vec").mapInPandas(project, "cell_id long, x double, y double")
    return placed.select("cell_id", (F.col("x") + noise("x")).alias("x"), (F.col("y") + noise("y")).alias("y"))


def _steps(a: float, b: float, rate: float, turn: int, rounds: int):
    """Steps of one part: own cells move, their neighbours' and the drawn cells' places stay those of the round's start."""

    def run(own: pd.DataFrame, edges: pd.DataFrame, drawn: np.ndarray) -> pd.DataFrame:
        place = own[["x", "y"]].to_numpy()
        row = pd.Series(np.arange(len(own)), index=own["cell_id"].to_numpy())
        at = row.loc[edges["src"].to_numpy()].to_numpy() if len(edges) else np.zeros(0, int)
        mine = row.reindex(edges["dst"].to_numpy()).to_numpy() if len(edges) else np.zeros(0)
        inner = ~np.isnan(mine)
        mine = np.where(inner, mine, 0).astype(int)
        fixed, w = edges[["dx", "dy"]].to_numpy(), edges["weight"].to_numpy()
        r = np.random.default_rng([turn, int(own["part"].iloc[0])])
        for step in range(STEPS):
            now = rate * (1 - (turn + step / STEPS) / rounds)
            on = np.flatnonzero(r.random(len(w)) < w)
            to = np.where(inner[on, None], place[mine[on]], fixed[on]) if len(on) else np.zeros((0, 2))
            gap = place[at[on]] - to
            square = np.maximum((gap**2).sum(1), 1e-12)
            pull = -2 * a * b * square ** (b - 1) / (1 + a * square**b)
            move = np.zeros_like(place)
            np.add.at(move, at[on], np.clip(pull[:, None] * gap, -4, 4))
            if len(drawn):
                rows = np.repeat(at[on], NEGATIVES)
                gap = place[rows] - drawn[r.integers(0, len(drawn), len(rows))]
                square = (gap**2).sum(1)
                push = 2 * b / ((0.001 + square) * (1 + a * square**b))
                np.add.at(move, rows, np.where(square[:, None] > 0, np.clip(push[:, None] * gap, -4, 4), 0.0))
            place = place + now * move
        return pd.DataFrame({"cell_id": own["cell_id"], "part": own["part"], "x": place[:, 0], "y": place[:, 1]})

    return run


def _moved(step):
    """step for the rows of a part: cells (kind 0), ends of their edges (1) and drawn cells (2), in an order of their own."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        own = p[p["kind"] == 0].sort_values("cell_id", ignore_index=True)
        if own.empty:
            return pd.DataFrame({"cell_id": [], "part": [], "x": [], "y": []})
        edges = p[p["kind"] == 1].sort_values(["cell_id", "dst"], ignore_index=True).rename(columns={"cell_id": "src", "x": "dx", "y": "dy"})
        drawn = p[p["kind"] == 2].sort_values(["x", "y"])[["x", "y"]].to_numpy()
        return step(own.astype({"cell_id": "int64"}), edges.astype({"src": "int64", "dst": "int64"}), drawn)

    return run


def layout(edges: DataFrame, start: DataFrame, *, min_dist: float = 0.1, rounds: int = ROUNDS, rate: float = 1.0) -> DataFrame:
    """(cell_id, x, y) of start(cell_id, x, y) after the rounds, along edges(src, dst, weight) of both directions."""
    a, b = curve(min_dist)
    n = start.count()
    parts = max(1, -(-n // PART))
    places = persist(start.select("cell_id", F.pmod(F.xxhash64("cell_id"), F.lit(parts)).alias("part"), "x", "y"))
    edges = persist(edges.select("src", "dst", "weight").withColumn("part", F.pmod(F.xxhash64("src"), F.lit(parts))))
    # of the cells a part hears of about DRAWN: each goes to as many parts as that takes, other ones in each round
    times = max(1, min(parts, -(-DRAWN * parts // max(n, 1))))
    shape = "cell_id long, part long, x double, y double"
    for turn in range(rounds):
        ends = edges.join(places.select(F.col("cell_id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy")), "dst")
        target = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
        heard = places.select("cell_id", "x", "y", target.alias("t")).select(F.pmod(F.xxhash64("cell_id", F.lit(turn)) + F.col("t"), F.lit(parts)).alias("part"), "x", "y")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = places.select("part", F.lit(0).alias("kind"), "cell_id", none("long", "dst"), "x", "y", none("double", "weight"))
        rows = rows.unionByName(ends.select("part", F.lit(1).alias("kind"), F.col("src").alias("cell_id"), "dst", F.col("dx").alias("x"), F.col("dy").alias("y"), "weight"))
        rows = rows.unionByName(heard.select("part", F.lit(2).alias("kind"), none("long", "cell_id"), none("long", "dst"), "x", "y", none("double", "weight")))
        places = persist(rows.groupBy("part").applyInPandas(_moved(_steps(a, b, rate, turn, rounds)), shape))
    return places.select("cell_id", "x", "y")


def umap(factors: DataFrame, *, k: int = 15, min_dist: float = 0.1, rounds: int = ROUNDS) -> DataFrame:
    """(cell_id, x, y) of factors(cell_id, vec). One path at every size; an empty table gives no rows, a single cell the origin."""
    factors = persist(factors.select("cell_id", "vec"))
    if factors.limit(2).count() < 2:
        return factors.select("cell_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    near = knn_approximate(factors, k)
    return layout(fuzzy_graph(near), _start(factors), min_dist=min_dist, rounds=rounds)


def pull_towards_levels(places: DataFrame, levels: DataFrame, *, least: float = 0.6, most: float = 0.95, force: Column | None = None) -> DataFrame:
    """(cell_id, x, y) of places moved along their rays towards a radius by level: the lowest to 0, the highest to a half.

    levels(cell_id, level) has each cell of places once. Each cell goes a share of
    the way, between least and most by a hash of its id, or by the column force.
    A cell at the origin stays; where all levels are equal the radius is 0.
    """
    require_aligned(places, levels, "cell_id")
    low, high = levels.agg(F.min("level"), F.max("level")).first()
    if force is None:
        force = least + (most - least) * F.pmod(F.xxhash64("cell_id"), F.lit(1 << 20)) / float(1 << 20)
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    target = 0.5 * (F.col("level") - F.lit(low)) / F.lit(float(high - low)) if low is not None and high > low else F.lit(0.0)
    factor = F.coalesce(F.try_divide(force * target + (1 - force) * radius, radius), F.lit(1.0))
    return places.select("cell_id", "x", "y").join(levels.select("cell_id", "level"), "cell_id").select("cell_id", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y"))
