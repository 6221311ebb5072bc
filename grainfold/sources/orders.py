"""Count matrix from sales tables: customers are cells, parts are genes, quantities are counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, gene_id, n, u): the non-zeros; u counts what was returned."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"))
        .agg(F.sum("l_quantity").cast("bigint").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("bigint").alias("u"))
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    c = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(
        F.col("c_custkey").alias("cell_id"),
        F.col("c_mktsegment").alias("chemistry"),
        F.col("c_nationkey").cast("bigint").alias("cluster_id"),
        (F.col("c_nationkey") % 15).cast("bigint").alias("age"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("sample_id"),
        ((F.col("c_custkey") * 7919 % 1000) / 1000.0).alias("doublet_score"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    chromosome = F.when(brand <= 22, F.concat(F.lit("chr"), brand.cast("string"))).when(brand == 23, "chrX").when(brand == 24, "chrY").otherwise("MT")
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gene_id"),
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"),
        F.concat(F.lit("ACC"), F.col("p_partkey").cast("string"), F.lit(".1")).alias("accession"),
        chromosome.alias("chromosome"),
        (F.col("p_partkey") * 1000).alias("start"),
        F.col("p_size").alias("size"),
        F.col("p_type").alias("type"),
        (brand == 25).alias("is_mt"),
        F.col("p_size").between(1, 9).alias("is_cc"),
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, vec, label) for the operators on dense factors."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("bigint").alias("label"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document-term counts as a matrix: (cell_id, token, n)."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("cell_id"), F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).where("token <> ''").groupBy("cell_id", "token").agg(F.count("*").alias("n"))


#: The same relations for an SQL engine: a WITH prefix.
SQL = """
matrix AS (SELECT o_custkey AS cell_id, l_partkey AS gene_id, SUM(l_quantity)::BIGINT AS n,
  SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS u
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS chemistry, c_nationkey::BIGINT AS cluster_id, (c_nationkey % 15)::BIGINT AS age,
  r_name AS region, n_name AS sample_id, (c_custkey * 7919 % 1000)::DOUBLE / 1000 AS doublet_score
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
genes AS (SELECT p_partkey AS gene_id, 'G' || p_partkey AS gene, 'ACC' || p_partkey || '.1' AS accession,
  CASE WHEN b <= 22 THEN 'chr' || b WHEN b = 23 THEN 'chrX' WHEN b = 24 THEN 'chrY' ELSE 'MT' END AS chromosome,
  p_partkey * 1000 AS start, p_size AS size, p_type AS type, b = 25 AS is_mt, p_size BETWEEN 1 AND 9 AS is_cc
  FROM (SELECT *, split_part(p_brand, '#', 2)::INT AS b FROM part))"""
