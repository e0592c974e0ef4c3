"""Predicates, projections, dedupe and set operators over tables (P*, U*, A3-A4, A18).

Every function is ``DataFrame -> DataFrame`` (or a Column builder) so Catalyst
sees one declarative plan and pushes filters / prunes columns into the scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolabe.operators.stats import exact_percentiles


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add derived columns that are evaluated exactly once per row.

    A filter on a plain derived column is pushed below its projection with the
    expression substituted, so an expensive expression (a regex over a whole
    text) would run again inside the filter for every reference.  Producing
    the columns through a one-element generator (``inline``) is an optimizer
    barrier: later filters on them stay above it.
    """
    row = F.struct(*[F.col(c) for c in df.columns], *[e.alias(n) for n, e in cols.items()])
    return df.select(F.inline(F.array(row)))


# ---- P2-P10 -------------------------------------------------------------------

def filter_eq(df: DataFrame, col: str, value, keep: bool = True) -> DataFrame:
    """Keep rows equal to ``value`` (or, with keep=False, exclude that one key)."""
    return df.where(_c(col) == value) if keep else df.where(~_c(col).eqNullSafe(F.lit(value)))


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    """Drop NULL and empty strings."""
    return df.where(_c(col).isNotNull() & (F.length(_c(col)) > 0))


def word_boundary_pattern(words: list[str]) -> str:
    """Whole-token match with an ASCII word boundary.

    Spelled out as ``(^|[^A-Za-z0-9_])`` rather than ``\\b`` because ``\\b``
    is Unicode-aware in some JVMs and ASCII-only in RE2, so accented text
    would split differently between engines.
    """
    alt = "|".join(re.escape(w) for w in words)
    return r"(^|[^A-Za-z0-9_])(?:" + alt + r")($|[^A-Za-z0-9_])"


def contains_word(col, words: list[str]) -> Column:
    return _c(col).rlike(word_boundary_pattern(words))


def exclude_words(df: DataFrame, col: str, words: list[str]) -> DataFrame:
    """P5: drop rows whose value contains any listed word as a whole token."""
    return df.where(~contains_word(col, words))


def contains_any(col, needles: list[str]) -> Column:
    """P6 predicate: plain substring test for any needle (over-matching kept)."""
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda x: F.contains(_c(col), x))


def exclude_substrings(df: DataFrame, col: str, needles: list[str]) -> DataFrame:
    return df.where(~contains_any(col, needles))


def letter_set(col) -> Column:
    """Distinct letters of a string, sorted (array<string>)."""
    letters = F.regexp_replace(_c(col), r"[^A-Za-z]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(letters, ""), lambda x: x != "")))


def only_letter(col, letter: str) -> Column:
    """The only letter in the string is ``letter`` (distinct-letter set == {letter}).

    Two regex passes over the letters, no per-character arrays (texts can be long).
    """
    letters = F.regexp_replace(_c(col), r"[^A-Za-z]", "")
    return (F.length(letters) > 0) & (F.length(F.regexp_replace(letters, re.escape(letter), "")) == 0)


def exclude_char(df: DataFrame, col: str, ch: str = ".") -> DataFrame:
    """Drop rows containing a forbidden character."""
    return df.where(~F.contains(_c(col), F.lit(ch)))


def in_open_box(arr, lo: float, hi: float) -> Column:
    """Every coordinate strictly inside (lo, hi)."""
    return F.forall(_c(arr), lambda x: (x > lo) & (x < hi))


# ---- P11-P19 -----------------------------------------------------------------

def ordered_category(rules: list[tuple[Column, int]], default: int = 0) -> Column:
    """Later matching rules overwrite earlier ones → ``when`` chain in reverse."""
    expr = None
    for cond, val in reversed(rules):
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(default))


def dict_map(col, mapping: dict) -> Column:
    """Dictionary lookup; unmapped keys → NULL."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _c(col))


def clean_nonfinite(col, fill: float = 0.0) -> Column:
    """NULL / NaN / ±inf → ``fill``."""
    c = _c(col)
    # NULL, NaN (greater than every double in Spark) and ±inf all fail this range test
    finite = (c >= F.lit(-1.7976931348623157e308)) & (c <= F.lit(1.7976931348623157e308))
    return F.when(finite, c).otherwise(F.lit(fill))


def clamp(col, lo: float, hi: float) -> Column:
    """Clamp into [lo, hi]."""
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


def percentile_floor(df: DataFrame, col: str, pct: float, out: str | None = None) -> DataFrame:
    """Values below the global ``pct`` percentile become 0 (exact, distributed)."""
    floor = exact_percentiles(df, col, [pct], ["__floor"]).collect()[0][0]  # one scalar
    out = out or col
    if floor is None:  # no non-null values
        return df.withColumn(out, F.col(col))
    return df.withColumn(out, F.when(F.col(col) < F.lit(floor), F.lit(0.0)).otherwise(F.col(col)))


def numeric_id_sort(df: DataFrame, col: str) -> DataFrame:
    """Distinct ids held as strings, ordered numerically."""
    return df.select(col).distinct().orderBy(_c(col).cast("long"))


# ---- A3 / A4 / U* / A18 ----------------------------------------------------------

def dedupe_first(df: DataFrame, key: list[str] | str, order: list[str] | str) -> DataFrame:
    """A4: one row per key, the first in ``order``.

    ``row_number`` over a key partition; Spark plans the ``== 1`` filter as a
    ``WindowGroupLimit`` so each task pre-reduces its rows before the final
    window.  (``dropDuplicates`` keeps an arbitrary row, so it is not used.)
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedupe_first_agg(df: DataFrame, key: str, order: str) -> DataFrame:
    """A4 (aggregate form): ``min_by(struct(*), order)`` — partial aggregation map-side,
    so a hot key is reduced in every task before the shuffle."""
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("__r"))
    return agg.select(key, "__r.*")


def pool_sources(frames: list[tuple[DataFrame, int]], col: str = "raw") -> DataFrame:
    """Concatenate sources, each tagged with its source id."""
    tagged = [f.select(F.col(col).alias("raw"), F.lit(sid).alias("source")) for f, sid in frames]
    return reduce(DataFrame.unionByName, tagged)


def curation_funnel(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Row counts after each curation step (one aggregate per step, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("step_no"),
                                                              F.lit(name).alias("step"),
                                                              "n_rows")
             for i, (name, df) in enumerate(steps)]
    return reduce(DataFrame.unionByName, parts)
