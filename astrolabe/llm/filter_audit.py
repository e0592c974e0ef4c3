"""Filter interaction audit by contraction of contingency tensors.

Every document passes or fails each of five filters, whatever the others do, so
all orders of the filters follow from one table per part: the number of documents
for each of the 2 x 2 x 2 x 2 x 2 outcomes.  The counting is a Spark job; a step
of an order is then a contraction of the tensor, an ``einsum`` that takes on each
axis *pass* (filters applied before), *fail* (this step's filter) or *all*.

Filter E asks for an equal text with a smaller identifier anywhere in the table.
Equal texts agree in the other four outcomes, so rows are counted by (digest,
part, labels) first and only the row with a text's smallest identifier passes: a
text that a third of all rows share is one row per part before anything is
compared.  Equal means equal SHA-256.

Defined results: a null text is empty; a null part is the empty string; a null
identifier is no smaller identifier of any text and has none, so it passes E;
rows with one identifier and text are no copies of each other; a document that
any of its label rows marks is marked; repeated label rows count once; labels
without a document don't matter; an empty table gives an empty result; other
columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import SPACE, table, text_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = r"[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: What a step takes of an axis that has index 0 for pass and 1 for fail.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
_MEASURES = ("rows", "good", "toxic")
_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def text_outcomes(text: Column) -> Column:
    """Bits of the filters that look at a text alone, set where it fails: A is bit 0, D bit 3."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
             100 * capitals > MOST_CAPITALS_PERCENT * F.length(text), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def contingency(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "source") -> DataFrame:
    """``part, cell, rows, good, toxic``: documents for each outcome (a bit set per failed filter) of each part."""
    text = text_of(F.col(f"`{text_col}`"))
    seen = (docs.select(F.col(f"`{id_col}`").alias("id"),
                        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text, 256)).alias("digest"), text_outcomes(text).alias("bits"))
            .groupBy("id", "digest", "part", "bits").agg(F.count(F.lit(1)).alias("n")))
    marks = (labels.where(f"`{id_col}` IS NOT NULL").groupBy(F.col(f"`{id_col}`").alias("id"))
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    marked = seen.join(marks, "id", "left").fillna(False, ["good", "toxic"])
    texts = (marked.groupBy("digest", "part", "bits", "good", "toxic")
             .agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
                  F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
             .withColumn("keep", F.min("least.id").over(Window.partitionBy("digest")))
             .withColumn("passes", F.col("nameless") + F.when(F.col("least.id") == F.col("keep"), F.col("least.n")).otherwise(0)))
    sides = F.explode(F.array(F.struct(F.col("bits").alias("cell"), F.col("passes").alias("rows")),
                              F.struct((F.col("bits") + 16).alias("cell"), (F.col("n") - F.col("passes")).alias("rows"))))
    return (texts.select("part", "good", "toxic", sides.alias("x")).select("part", "good", "toxic", "x.cell", "x.rows")
            .groupBy("part", "cell")
            .agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("toxic"), F.col("rows")).otherwise(0)).alias("toxic")))


def _selectors(kinds: list[list[tuple]]) -> list[np.ndarray]:
    """Per axis, a matrix of one row per wanted number and the two outcomes of that axis."""
    return list(np.array(kinds, dtype=np.int64).transpose(1, 0, 2))


def _steps() -> dict[str, list[np.ndarray]]:
    """Selectors of all steps of all orders, for each kind of count."""
    kinds: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique": []}
    for order in ORDERS:
        for k, name in enumerate(order):
            before = set(order[:k])
            kinds["kept"].append([PASS if f in before or f == name else ALL for f in FILTERS])
            kinds["removed"].append([FAIL if f == name else PASS if f in before else ALL for f in FILTERS])
            kinds["failing"].append([FAIL if f == name else ALL for f in FILTERS])
            kinds["unique"].append([FAIL if f == name else PASS for f in FILTERS])
    return {k: _selectors(v) for k, v in kinds.items()}


def contract(tensors: np.ndarray, selectors: list[np.ndarray]) -> np.ndarray:
    """``parts x 2 x 2 x 2 x 2 x 2`` counts to ``parts x wanted``."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *selectors, optimize=True)


def _tables(batches):
    """Arrow-sized frames of parts (``part`` and 32 counts of each measure) to the steps of all orders."""
    steps = _steps()
    letters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    for frame in batches:
        if not len(frame):
            continue
        # bit 0 (filter A) is the last axis of the reshaped counts, so the axes are turned round
        shape = (len(frame), *[2] * len(FILTERS))
        rows, good, toxic = (np.array(frame[m].tolist(), dtype=np.int64).reshape(shape).transpose(0, 5, 4, 3, 2, 1) for m in _MEASURES)
        removed, failing = contract(rows, steps["removed"]), contract(rows, steps["failing"])
        per_filter = np.stack([removed[:, letters == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
        wide = {"kept": contract(rows, steps["kept"]), "removed": removed, "redundant": failing - removed,
                "unique_fails": contract(rows, steps["unique"]), "good_lost": contract(good, steps["removed"]),
                "toxic_lost": contract(toxic, steps["removed"]), "shapley": per_filter[:, letters]}
        yield pd.DataFrame({"part": np.repeat(frame["part"].to_numpy(), len(letters)),
                            "filter_order": np.tile(np.repeat(ORDERS, len(FILTERS)), len(frame)),
                            "step": np.tile(np.arange(len(letters), dtype=np.int32) % len(FILTERS) + 1, len(frame)),
                            **{k: v.ravel() for k, v in wide.items()}})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step of it; every part has all 600."""
    counts = contingency(docs, labels, id_col, text_col, part_col)
    cells = range(1 << len(FILTERS))
    tensors = counts.groupBy("part").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("cell") == c, F.col(m))), F.lit(0)) for c in cells]).alias(m)
        for m in _MEASURES])
    return tensors.mapInPandas(_tables, _SCHEMA)


@register("op11_filter_audit", """
WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
p AS (SELECT l AS o FROM letters UNION ALL SELECT o || l FROM p, letters WHERE length(o) < 5 AND NOT contains(o, l)),
orders AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM p WHERE length(o) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM orders),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
      FROM t LEFT JOIN m USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
r AS (SELECT part, filter_order, step, f,
        sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over every document, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
