"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def persist(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back: the lineage is cut, and lost executors lose nothing.

    by: a column of few values; a reader of one value reads its files only.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:  # one machine, as in tests
        folder = tempfile.mkdtemp(prefix="grainfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
