"""Counts that arrive as a stream: running summaries of genes and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_counts(spark: SparkSession, path: str, schema: str = "cell_id bigint, gene_id bigint, n bigint, u bigint, ts timestamp", files: int = 16) -> DataFrame:
    """Parquet files of counts in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def gene_totals(counts: DataFrame) -> DataFrame:
    """Running total, sum of squares and non-zeros of each gene: what mean and variance need."""
    return counts.groupBy("gene_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count_if(F.col("n") > 0).alias("nonzeros"))


def windowed_totals(counts: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each cell by event-time window; rows later than the watermark are left out."""
    return counts.withWatermark("ts", late).groupBy(F.window("ts", window), "cell_id").agg(F.sum("n").alias("total_umis"), F.count("*").alias("n_rows"))


def start(table: DataFrame, target: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write each trigger's result as the new state of target."""
    return table.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).trigger(availableNow=True).start()
