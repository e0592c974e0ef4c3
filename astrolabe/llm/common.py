"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.session import scratch_path

#: ASCII white space, as the operators' contracts name it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage: the table survives lost executors, and later stages read it
    instead of computing it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch of texts; a worker and its JVM hold a few batches at a time.
TEXT_BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in batches of ``TEXT_BATCH_ROWS`` (Spark's own default is ten times that)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def uniform(*cols: Column) -> Column:
    """A repeatable draw from [0, 1) for the given values (53 bits of XXH64)."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))
