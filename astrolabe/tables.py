"""Loading the driver's tables, with the row keys every operator carries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The reference aligns arrays by position; Spark has no row position, so each
# table is addressed through an explicit unique key (checked on the fixtures).
ROW_KEYS = {
    "embeddings": ["vec_id"],
    "documents": ["doc_id"],
    "labels": ["doc_id"],
    "benchmark": ["item_id"],
    "pages": ["page_id"],
    "part": ["p_partkey"],
    "events": ["event_id"],
    "conversations": ["conv_id", "turn"],
    "orders": ["o_orderkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "nation": ["n_nationkey"],
    "region": ["r_regionkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector store with ``vec`` as ``array<double>`` (arithmetic type)."""
    return (load(spark, sf_dir, "embeddings")
            .select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"))


def inventory(vecs: DataFrame) -> DataFrame:
    """The observed rows of a vector table."""
    from astrolabe.constants import OBSERVED_KEYS
    return vecs.where(F.col("vec_id").isin(*OBSERVED_KEYS))


def learning_rows(vecs: DataFrame) -> DataFrame:
    """The rows that the kernel models learn from: every fiftieth key."""
    return vecs.where("vec_id % 50 = 0")
