"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, an external sort places
equal texts next to each other, and each row is compared in full with its
neighbour.  Only DataFrame functions are used.

The sort key of a row is its first bytes, its digest and its identifier, so a
splitter is short whatever the texts are, and a splitter can fall inside a group
of copies: a group with a third of all rows spreads over as many ranges as its
share of the rows.  Runs that meet at the edge of two ranges are joined by a
full comparison of the two edge texts.

Defined results: a null text is an empty text; white space of any length is one
space; of rows that share text *and* identifier one stays; rows without an
identifier sort last and only stay where their whole group has none; an empty
table gives an empty result; other columns are carried untouched (their names
may be anything).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import SPACE, materialise, shuffle_partitions, table, text_of

PREFIX_BYTES = 24
#: Ranges per shuffle partition, and sampled rows per range.
RANGES_PER_PARTITION = 4
SAMPLES_PER_RANGE = 8


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def _sort_key(text: Column, digest: Column, row_id: Column) -> Column:
    lead = F.rpad(F.hex(F.substring(text.cast("binary"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
    return F.concat(lead, digest, F.lit("/"), F.coalesce(row_id.cast("string"), F.lit("~")))


def _splitters(keyed: DataFrame, rows: int, ranges: int, seed: int) -> list[str]:
    """At most ``ranges - 1`` keys of sampled rows, evenly spaced; each is the key of a real row."""
    share = min(1.0, SAMPLES_PER_RANGE * ranges / max(rows, 1))
    sample = sorted(r[0] for r in keyed.sample(share, seed).select("key").collect())
    picks = {sample[i * len(sample) // ranges] for i in range(1, ranges)} if sample else set()
    return sorted(picks)


def _range_of(key: str, splitters: list[str]) -> Column:
    """Number of splitters at or below the key: a binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    array = F.split(F.lit("\n".join(splitters)), "\n")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.get(array, low + step - 1) <= F.col(key), low + step).otherwise(low))


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 ranges: int | None = None, seed: int = 17, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256`` (and ``row``,
    the whole input row, with ``carry``).

    ``ranges`` bounds what reaches the driver (``SAMPLES_PER_RANGE`` keys of about
    130 bytes a range); by default it follows ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES_PER_PARTITION * shuffle_partitions(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"),
                       *([row.alias("row")] if carry else []))
    keyed = (base.withColumn("text_sha256", F.sha2(normalised("text"), 256))
             .withColumn("key", _sort_key(normalised("text"), F.col("text_sha256"), F.col("id"))))
    splitters = _splitters(keyed, docs.count(), ranges, seed)

    order = Window.partitionBy("range").orderBy("key")
    run = Window.partitionBy("range", "run")
    if carry:  # the row holds the text already
        keyed = keyed.drop("text")
        text = normalised(F.col("row").getField(text_col))
    else:
        text = normalised("text")
    placed = (keyed.withColumn("range", _range_of("key", splitters))
              .repartition("range")
              .withColumn("norm", text)
              .withColumn("before", F.lag("norm").over(order))
              .withColumn("more", F.lead(F.lit(1)).over(order))
              .withColumn("head", F.col("before").isNull() | (F.col("before") != F.col("norm")))
              .withColumn("run", F.sum(F.col("head").cast("long")).over(
                  order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("edge", F.when(F.col("before").isNull() | F.col("more").isNull(), F.col("norm")))
              .select("id", "text_sha256", "range", "run", "edge", *(["row"] if carry else []),
                      F.col("before").isNull().alias("first"), F.col("more").isNull().alias("last")))
    runs = (placed
            .withColumn("place", F.row_number().over(run.orderBy(F.col("id").asc_nulls_last())))
            .withColumn("run_min", F.min("id").over(run))
            .withColumn("run_size", F.count(F.lit(1)).over(run)))
    runs = materialise(runs, "content-sort")

    spans = F.broadcast(_spans(runs))  # at most two rows a range
    joined = runs.join(spans, ["range", "run"], "left")
    keep = F.when(F.col("span_size").isNull(), F.col("run_min")).otherwise(F.col("span_min"))
    here = F.col("span_size").isNull() | F.col("span_here")
    return joined.select(
        "id", keep.alias("keep_id"),
        F.coalesce("span_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & here).alias("kept"), "text_sha256", *(["row"] if carry else []))


def _spans(runs: DataFrame) -> DataFrame:
    """Groups that reach over the edge of a range: ``range, run, span_min, span_size, span_here``
    for each of their runs; ``span_here`` marks the run that holds the row that stays.

    Holds the first and the last run of each range, so its size is bounded by the number of ranges.
    """
    edges = runs.where("first or last")
    heads = edges.where("first").select("range", F.col("edge").alias("first_text"))
    tails = edges.where("last").select((F.col("range") + 1).alias("range"), F.col("edge").alias("last_text"))
    meets = (heads.join(tails, "range").where("first_text = last_text")
             .select("range", F.lit(1).cast("long").alias("run"), F.lit(True).alias("meets")))
    ends = edges.groupBy("range", "run").agg(F.first("run_min").alias("run_min"),
                                              F.first("run_size").alias("run_size"))
    line = Window.orderBy("range", "run")
    chain = (ends.join(meets, ["range", "run"], "left")
             .withColumn("span", F.sum(F.when(F.col("meets"), 0).otherwise(1)).over(line)))
    whole = Window.partitionBy("span")
    return (chain
            .withColumn("parts", F.count(F.lit(1)).over(whole))
            .withColumn("span_min", F.min("run_min").over(whole))
            .withColumn("span_size", F.sum("run_size").over(whole))
            .withColumn("span_here", F.row_number().over(
                whole.orderBy(F.col("run_min").asc_nulls_last(), "range")) == 1)
            .where("parts > 1")
            .select("range", "run", "span_min", "span_size", "span_here"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the same columns."""
    return (content_sort(docs, id_col, text_col, carry=True, **options)
            .where("kept").select("row.*"))


@register("op1_exact_dedup", """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the identifier that stays for its text."""
    return content_sort(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
