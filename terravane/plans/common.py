"""The given tables in the roles that the operators expect."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as venues, with their customer's segment, nation and region."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "o_totalprice", "o_orderdate", "c_name",
    )


LEADS_SQL = """
leads AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, n_name AS nation, r_name AS region, o_totalprice, o_orderdate, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def placed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with coordinates made from their key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", (F.lit(6.0) + (k * 7919 % 13000) / F.lit(1000.0)).alias("lon"), (F.lit(36.0) + (k * 104729 % 11000) / F.lit(1000.0)).alias("lat")
    )


PLACED_SQL = """
placed AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 6.0::DOUBLE + (c_custkey * 7919 % 13000) / 1000.0::DOUBLE AS lon, 36.0::DOUBLE + (c_custkey * 104729 % 11000) / 1000.0::DOUBLE AS lat FROM customer)
"""
