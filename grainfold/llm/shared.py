"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, one temporary folder serves a session on one machine
    (tests, a laptop); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="grainfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, *, by: str | None = None) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    This cuts the lineage like checkpoint(), but columnar and compressed; lost
    executors do not lose it. The folder belongs to the session's checkpoints
    and goes with them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan, one number."""
    return docs.agg(F.sum(F.octet_length(text_or_empty(column)).cast("long"))).first()[0] or 0


def join_by_count(rows: DataFrame, values: DataFrame, key: str, *, share: float = 0.001, least: int = 500) -> DataFrame:
    """rows joined with values, which has one row for each key with n, the number of rows of that key.

    Keys of more than `share` of all rows (and more than `least`) are 1 / share at
    most, so they go to every task and their rows stay where they are; the rows
    of all other keys are shuffled, no key more than that share of them.
    """
    often = max(least, share * (values.agg(F.sum("n")).first()[0] or 0))
    hot, cold = values.where(F.col("n") > often).drop("n"), values.where(F.col("n") <= often).drop("n")
    kept = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(kept.join(cold.hint("shuffle_hash"), key))


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    """How many groups of about `each` bytes hold n_bytes."""
    return max(least, -(-int(n_bytes) // each))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now.

    Its cleaner removes them when the driver's garbage is collected, which may
    be long after; an operator of several large shuffles asks in between. Only
    the time of deletion depends on it: without a JVM at hand nothing happens.
    """
    gc.collect()
    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


#: Rows and bytes of an Arrow batch at most: whole texts make batches of megabytes. A batch has one row at least.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker shares its executor's limit with the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH, by settings of the session; tasks give their memory back."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        if not 0 < int(conf.get(key, None) or 0) <= most:
            conf.set(key, most)

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def pack_texts(docs: DataFrame) -> DataFrame:
    """docs with the text as compressed UTF-8: shuffled at two fifths of their size."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            texts = pa.array([zstandard.compress(t, 3) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=names)

    kinds = ["binary" if f.name == "text" else f.dataType.simpleString() for f in docs.schema]
    return map_arrow(docs, run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
