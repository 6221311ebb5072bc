"""A bounded sample of labelled rows, by which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_ids(labels: DataFrame, most: int, label: str = "quality") -> DataFrame:
    """doc_id and label of at most `most` rows outside the held-out fold, the first by a hash of the id.

    A label counts once for each id (the least, if they differ); null ids and labels do not count.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
