"""Sources and sinks (S1-S16) on Spark's own readers and writers.

Every reader takes an explicit schema or a fixed text layout (no inference
pass over the data); every writer is a distributed write of a DataFrame.
Scratch output goes under the shared checkpoint folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from astrolabe.session import scratch_path


# ---- readers ---------------------------------------------------------------------

def read_csv_column(spark: SparkSession, path: str, schema: StructType | str, column: str) -> DataFrame:
    """Header CSV (any codec Hadoop knows, e.g. .gz) → one column, nulls dropped."""
    df = (spark.read.schema(schema).option("header", True).option("escape", '"')
          .option("multiLine", False).csv(path))
    return df.select(column).na.drop(subset=[column])


def read_first_field(spark: SparkSession, path: str, sep: str = " ", first: str = "smiles") -> DataFrame:
    """Every file under ``path`` (recursively): skip the first line of each
    file, take the first ``sep``-delimited field.

    The CSV reader with ``header=True`` drops line 1 of *each* file, which is
    exactly the per-file skip; ``_metadata.file_path`` keeps the file of origin.
    """
    df = (spark.read.option("header", True).option("sep", sep).option("escape", '"')
          .option("recursiveFileLookup", True).csv(path))
    first_col = df.columns[0]
    return df.select(F.col(first_col).alias(first), F.col("_metadata.file_path").alias("file"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated token files (any amount of whitespace, many per line)."""
    lines = spark.read.text(path)
    toks = F.split(F.trim("value"), r"[ \t\r\n\f]+")
    return lines.select(F.explode(toks).alias("token")).where(F.col("token") != "")


def read_values(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One value per line (white space inside it is kept, around it dropped), blank lines skipped."""
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(value.alias(name)).where(F.col(name) != "")


def read_capped_valid(spark: SparkSession, path: str, valid_pattern: str, n_max: int | None = None,
                      id_col: str = "id", value_col: str = "value") -> DataFrame:
    """Two-column ``id<TAB>value`` scan; the distinct values of the *valid* rows.

    With ``n_max`` only the first ``n_max`` valid rows in id order count: that
    drops the rest of the file, so it is off unless asked for.
    """
    df = (spark.read.schema(f"{id_col} long, {value_col} string").option("sep", "\t")
          .option("escape", '"').csv(path))
    valid = df.where(F.col(value_col).rlike(valid_pattern))
    if n_max is not None:
        from astrolabe.operators import stats
        # positions by range partitions, so that a large cap isn't gathered in one task
        valid = stats.global_position(valid, [id_col], "__pos").where(F.col("__pos") <= n_max)
    return valid.select(value_col).distinct()


def read_series(spark: SparkSession, path: str, names: tuple[str, str] = ("t", "x")) -> DataFrame:
    """Whitespace-delimited series (any amount of blanks and tabs), first line of
    each file skipped; partition directories (``key=value``) become columns.

    The CSV reader's header option is the per-file skip; its separator is a
    character that no line holds, so each line arrives whole.
    """
    lines = (spark.read.option("header", True).option("sep", "\u0001").option("quote", "").option("enforceSchema", True)
             .schema("__line string").csv(path))
    cells = F.split(F.regexp_replace("__line", r"^\s+|\s+$", ""), r"\s+")
    rest = [c for c in lines.columns if c != "__line"]
    return (lines.where(F.trim(F.regexp_replace("__line", r"\s+", " ")) != "")
            .select(*[F.get(cells, i).try_cast("double").alias(n) for i, n in enumerate(names)], *rest))


def vector_column(df: DataFrame, preferred: str = "pca", fallback: str = "embedding") -> str:
    """Use the reduced array if the store has one, else the raw vectors."""
    return preferred if preferred in df.columns else fallback


# ---- writers ---------------------------------------------------------------------

def overwrite_partitions(df: DataFrame, path: str, partition_col: str) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with header, no index column."""
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_lines(df: DataFrame, col: str, path: str) -> None:
    """One value per line, empty strings skipped."""
    df.select(F.col(col).cast("string").alias("value")).where(
        F.col("value").isNotNull() & (F.col("value") != "")).write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON record per model."""
    df.write.mode("overwrite").json(path)


def roundtrip_text(df: DataFrame, name: str) -> DataFrame:
    """Write a ``value`` column as text under the shared scratch folder, scan it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.select("value").write.mode("overwrite").text(path)
    return spark.read.text(path)
