"""Whitening of embeddings by a covariance in two passes.

Components become integers, so the first pass adds them exactly and the mean is
a quotient of two integers. The second pass centres every vector by it and adds
outer products, a batch at a time by one matrix product; a tree of tasks merges
the sums of the tasks. The symmetric eigenproblem of that one small matrix is
solved on the driver and its projection goes out as a broadcast. A third pass
measures what the projection leaves between the covariance of the whitened
vectors and the identity.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, materialise, table

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Integers over this are an error: sums of a batch could leave 64 bits.
LARGEST = 1 << 40
#: Bytes of a matrix of the vectors' dimension squared at most, as the driver and every task hold one.
MATRIX_BYTES = 256 << 20


class Whitening(NamedTuple):
    """n vectors with sums by dimension; eigenvalues, falling, with unit eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v (doubles) of the rows that take part: no null or non-finite entry, the most common length (of two the larger)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(sound)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def integers(column: pa.Array) -> np.ndarray:
    """A batch of vectors as the rows of a matrix of integers."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
    if x.size and np.abs(x).max() >= LARGEST:
        raise OverflowError(f"a component of {LARGEST / SCALE:g} or more in size")
    return x.astype(np.int64) + SHIFT


class Centre(NamedTuple):
    """The mean of integer vectors as whole + rest / n, with 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the whole part goes exactly, before anything is rounded."""
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sums of squares of n times the centred x, exactly."""
        near = x - self.whole
        most = float(self.n) * (float(np.abs(near).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**62:
            return ((self.n * near - self.rest) ** 2).sum(1)
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in near.tolist()]
        if max(exact) >= 2**63:
            raise OverflowError("a deviation that no long holds")
        return np.array(exact, np.int64)


def _one_row_a_task(vectors: DataFrame, start, add):
    """add(state, matrix of integers) over the batches of each task; the states, pickled by Spark, as an RDD."""

    def run(batches):
        import pickle

        state = start
        for b in batches:
            if b.num_rows:
                state = add(state, integers(b.column(0)))
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(state)], pa.binary())})

    def states(rows):
        import pickle

        for r in rows:
            state = pickle.loads(bytes(r.state))
            if state is not None:
                yield state

    return map_arrow(vectors.select("v"), run, "state binary").rdd.mapPartitions(states)


def _merged(states, merge):
    """One state from all, merged in a tree of tasks; None without rows."""
    pick = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return states.treeAggregate(None, pick, pick, depth=2)


def _sum_merge(a, b):
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]


def _spread_merge(a, b):
    """Counts, means and sums of centred outer products of two sets of vectors, as of their union."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit the whitening on all rows of vectors (v); None if there are none or they have no dimension.

    Components whose eigenvalue is zero up to rounding cannot be whitened and
    are left out, so constant vectors give none.
    """
    found = _merged(_one_row_a_task(vectors, None, lambda s, x: _sum_merge(s, (len(x), x.sum(0).tolist())) if s else (len(x), x.sum(0).tolist())), _sum_merge)
    if found is None or not found[1]:
        return None
    n, sums = found
    d = len(sums)
    if d * d * 8 > MATRIX_BYTES:
        raise ValueError(f"a covariance of {d} dimensions takes over {MATRIX_BYTES} bytes")
    spark = vectors.sparkSession
    centre = spark.sparkContext.broadcast(Centre.of(n, sums))

    def outer(state, x):
        c = centre.value.centred(x)
        return c.T @ c if state is None else state + c.T @ c

    covariance = _merged(_one_row_a_task(vectors, None, outer), np.add) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > d * np.finfo(float).eps * max(values[0], 0.0)).sum()))
    values, axes = values[:k], axes[:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])  # either sign will do; this one is stated: the largest entry is positive
    if not k:
        return Whitening(n, sums, float(np.trace(covariance)), values, axes, 0.0)
    onto = spark.sparkContext.broadcast(axes / np.sqrt(values))

    def spread(state, x):
        y = centre.value.centred(x) @ onto.value
        mean = y.mean(0)
        here = len(y), mean, (y - mean).T @ (y - mean)
        return here if state is None else _spread_merge(state, here)

    left = _merged(_one_row_a_task(vectors, None, spread), _spread_merge)
    return Whitening(n, sums, float(np.trace(covariance)), values, axes, float(np.abs(left[2] / n - np.eye(k)).max()))


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation and whitened (one double for each component) of every row of vectors (id, v)."""
    sent = vectors.sparkSession.sparkContext.broadcast((Centre.of(model.n, model.sums), model.vectors / np.sqrt(model.values)))

    def run(batches):
        for b in batches:
            centre, onto = sent.value
            x = integers(b.column(1)) if b.num_rows else np.zeros((0, len(centre.whole)), np.int64)
            y = centre.centred(x) @ onto
            flat = pa.array(y.ravel())
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(centre.deviation(x)), pa.ListArray.from_arrays(offsets, flat)], names=["id", "deviation", "whitened"])

    return map_arrow(vectors.select("id", "v"), run, f"id {vectors.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The whitened vectors (id, deviation, whitened) and the model they come from.

    Rows whose vector is null, holds null, NaN or infinite entries, or has
    another length than most rows take no part. Null ids stay; repeated rows
    each count and each get a row; other columns are not read. Without a usable
    row, or where all vectors are equal, no component exists: whitened is empty
    and the model is None or has no values. Components over 2**40 / 64 in size
    are an error, as are deviations over 63 bits.
    """
    rows = materialise(usable(vectors, id_col, vec_col))
    model = fit(rows, components)
    if model is None:
        return rows.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    return project(rows, model), model


def op13_two_pass_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(e) for e in model.explained]) if model and len(model.values) else F.array().cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
