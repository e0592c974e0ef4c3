"""Text, log and string-list operators.

Logs are modelled as a lines table ``(file, line_no, line)``; every "look at
the next line" or "last block" rule of a line-by-line reader becomes a window
partitioned by file (bounded by one file's lines) or a grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def composition(s) -> Column:
    """Symbol counts in first-seen order, e.g. 'blue bolt' → 'b2l2u1e1o1t1'."""
    chars = F.filter(F.split(_c(s), ""), lambda x: x != "")
    uniq = F.array_distinct(chars)  # keeps first-seen order
    return F.array_join(F.transform(uniq, lambda c: F.concat(
        c, F.size(F.filter(chars, lambda x: x == c)).cast("string"))), "")


def list_fingerprint(df: DataFrame, group: str | None, key: str, value: str,
                     block: int = 1000, levels: int = 2) -> DataFrame:
    """Order-preserving MD5 fingerprint of each group's ``value`` list, as a Merkle tree.

    Rows are numbered in key order; level 1 hashes the newline-joined values of
    each run of ``block`` rows, each further of the ``levels`` hashes ``block``
    consecutive digests, and the fingerprint is the MD5 of the last level's
    digests in order.  The form is the same for any number of rows (and any kind
    of key), and no task gathers more than ``block`` values, or one digest per
    ``block ** levels`` rows.  ``n_blocks`` counts the runs of level 1.
    """
    from astrolabe.operators import stats
    g = [group] if group else []

    def digest(order, col):
        return F.md5(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("v")))),
            lambda r: r["v"]), "\n"))

    rows = df.select(*g, F.col(key).alias("__k"), F.col(value).cast("string").alias("__v"))
    pos = stats.global_position(rows, [*g, "__k"], "__pos")
    first = pos.groupBy(*g).agg(F.min("__pos").alias("__first"))
    pos = pos.join(first, g) if g else stats.with_scalars(pos, first)
    level = pos.select(*g, (F.col("__pos") - F.col("__first")).alias("at"), F.col("__v").alias("d"))
    sizes = None
    for _ in range(levels):
        level = (level.withColumn("up", F.floor(F.col("at") / F.lit(block)))
                 .groupBy(*g, "up").agg(digest("at", "d").alias("d")).withColumnRenamed("up", "at"))
        if sizes is None:
            sizes = level.groupBy(*g).agg(F.count(F.lit(1)).alias("n_blocks"))
    top = level.groupBy(*g).agg(digest("at", "d").alias("fingerprint"))
    return top.join(sizes, g) if g else stats.with_scalars(top, sizes)


def formula_mass(formula, masses: dict) -> Column:
    """Σ mass(symbol) × count over ``<Symbol><digits>`` tokens, per row (no shuffle).

    A formula with a symbol that ``masses`` lacks has no mass: NULL.
    """
    toks = F.regexp_extract_all(_c(formula), F.lit(r"[A-Z][a-z]?[0-9]*"), 0)
    m = F.create_map(*[F.lit(x) for kv in masses.items() for x in kv])

    def term(t):
        sym_mass = F.try_element_at(m, F.regexp_extract(t, r"^[A-Z][a-z]?", 0))
        n = F.coalesce(F.nullif(F.regexp_extract(t, r"[0-9]+", 0), F.lit("")).cast("int"), F.lit(1))
        return sym_mass * n

    return F.aggregate(toks, F.lit(0.0), lambda acc, t: acc + term(t))


# ---- lines tables ----------------------------------------------------------------

def lines_of(df: DataFrame, file_cols: list[str], text_col: str, order_cols: list[str] = ()) -> DataFrame:
    """Split each text into lines: ``(*file_cols, *order_cols, pos, line)``.

    A file's line order is ``(*order_cols, pos)``.  Lines are produced by a
    generator per row, so no shuffle is involved.
    """
    return df.select(*file_cols, *order_cols,
                     F.posexplode(F.split(_c(text_col), "\n")).alias("pos", "line"))


def tokens(line) -> Column:
    """Whitespace tokens of a line (like ``str.split()``: no empty tokens)."""
    return F.filter(F.split(F.trim(_c(line)), r"[ \t\r\n\f]+"), lambda t: t != "")


def tok(line, k: int) -> Column:
    """Token k (0-based; negative from the end) or NULL when the line is shorter."""
    t = tokens(line)
    return F.get(t, k) if k >= 0 else F.get(t, F.size(t) + k)


def last_match(lines: DataFrame, file_cols: list[str], order: list[str], marker: str,
               value: Column, name: str) -> DataFrame:
    """Value from the *last* line containing ``marker`` per file (last match wins).

    ``max_by`` is a partial aggregate: each task reduces its lines first.
    """
    hit = lines.where(F.col("line").contains(marker))
    return hit.groupBy(*file_cols).agg(F.max_by(value, F.struct(*order)).alias(name))


def harvest_digits(lines: DataFrame, file_cols: list[str], order: list[str], marker: str,
                   decimals: bool = False) -> DataFrame:
    """Per file, the last three tokens of every marker line that are all digits,
    appended in line order.  ``decimals=True`` also keeps decimal numbers."""
    pat = r"^[0-9]+(\.[0-9]+)?$" if decimals else r"^[0-9]+$"
    t = tokens("line")
    last3 = F.slice(t, F.greatest(F.size(t) - 2, F.lit(1)), 3)
    kept = F.filter(last3, lambda x: x.rlike(pat))
    hit = lines.where(F.col("line").contains(marker)).select(*file_cols, *order, kept.alias("vals"))
    agg = hit.groupBy(*file_cols).agg(F.array_sort(F.collect_list(F.struct(*order, "vals"))).alias("s"))
    return agg.select(*file_cols, F.flatten(F.transform("s", lambda r: r["vals"])).alias("values"))


def next_line_tokens(rows: DataFrame, file_cols: list[str], order_cols: list[str], text_col: str, marker: str,
                     positions: list[int], n_following: int = 1) -> DataFrame:
    """For marker lines, the following line(s) of the same file joined and tokenised.

    ``rows`` holds a file's text in one or more rows, in ``order_cols`` order.
    The following lines stand in the row's own line array, except at its end:
    only there the first lines of the next rows are looked up.  Those heads are
    numbered by a range-partitioned sort (one entry per row, not per line), so
    no file meets in one task, and are attached by equi-joins on unique keys.
    Output ``*file_cols, *order_cols, pos, t<k>..., __toks``.
    """
    from astrolabe.operators import stats
    key = [*file_cols, *order_cols]
    n = n_following
    arr = rows.select(*key, F.split(_c(text_col), "\n").alias("__a")).where("__a IS NOT NULL")
    heads = stats.global_position(arr.select(*key, F.slice("__a", 1, n).alias("__h")), key, "__g")
    after, parts = heads, []
    for i in range(1, n + 1):  # the next rows' heads, as many as short rows may need
        nxt = heads.select(*[F.col(c).alias(f"__f{i}_{c}") for c in file_cols], (F.col("__g") - i).alias(f"__g{i}"),
                           F.col("__h").alias(f"__h{i}"))
        cond = [after["__g"] == nxt[f"__g{i}"]] + [after[c].eqNullSafe(nxt[f"__f{i}_{c}"]) for c in file_cols]
        after = after.join(nxt, cond, "left").drop(f"__g{i}", *[f"__f{i}_{c}" for c in file_cols])
        parts.append(F.coalesce(f"__h{i}", F.array().cast("array<string>")))
    after = after.select(*[F.col(c).alias(f"__r_{c}") for c in key], F.slice(F.concat(*parts), 1, n).alias("__after"))

    spots = F.filter(F.transform("__a", lambda line, k: F.struct(
        k.alias("pos"), line.contains(marker).alias("hit"), F.slice("__a", k + 2, n).alias("own"))), lambda x: x["hit"])
    marks = arr.select(*key, F.explode(spots).alias("x")).select(*key, "x.pos", "x.own")
    inside = marks.where(F.size("own") == n)
    ends = (marks.where(F.size("own") < n)
            .join(after, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in key], "left")
            .select(*key, "pos", F.slice(F.concat("own", F.coalesce("__after", F.array().cast("array<string>"))), 1, n).alias("own")))
    # without any following line there is nothing to tokenise
    nxt = F.when(F.size("own") > 0, F.array_join("own", "\t"))
    res = inside.unionByName(ends).withColumn("__next", nxt)
    return res.select(*key, "pos", *[tok("__next", p).alias(f"t{p}") for p in positions], tokens("__next").alias("__toks"))


def ignore_list(files: DataFrame, name_col: str, text_col: str, markers: list[str]) -> DataFrame:
    """D3: ids of the files whose text holds a marker, distinct, in numeric order with their place.

    The id is the number that ends the file name (before its suffix); names with
    ``_`` are left out.  Output ``id long, place long``.
    """
    from astrolabe.operators import stats
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.col(text_col).contains(m)
    base = F.regexp_extract(name_col, r"([^/]*)$", 1)
    ids = (files.where(hit & ~base.contains("_"))
           .select(F.regexp_extract(base, r"(\d+)(?:\.[^.]*)?$", 1).try_cast("long").alias("id"))
           .where("id IS NOT NULL").distinct())
    return stats.global_position(ids, ["id"], "place")


def last_block(lines: DataFrame, file_cols: list[str], order_key: str, marker: str) -> DataFrame:
    """Lines strictly after the last marker line of each file."""
    last = (lines.where(F.col("line").contains(marker))
            .groupBy(*file_cols).agg(F.max(order_key).alias("__last")))
    return lines.join(last, file_cols).where(F.col(order_key) > F.col("__last")).drop("__last")


def any_marker(lines: DataFrame, file_cols: list[str], markers: list[str], name: str) -> DataFrame:
    """Per file, whether any line contains any marker (``bool_or``)."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.col("line").contains(m)
    return lines.groupBy(*file_cols).agg(F.bool_or(hit).alias(name))


# ---- M1: token corpus ---------------------------------------

def token_sentence(s, radius: int = 1) -> Column:
    """M1 (re-aimed): word tokens plus, for radius 1, each word joined with its
    neighbours (a centred trigram), interleaved per position like an
    alternating sentence.

    A lambda that indexes into an outer array expression would re-evaluate that
    expression per element (quadratic); a lambda's variable is only looked at.
    """
    words = F.filter(F.split(F.lower(_c(s)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if radius == 0:
        return words
    # the words are a lambda's variable, so that a text is split once
    def sentence(ws):
        return F.flatten(F.transform(ws, lambda w, i: F.array(w, centred(ws, w, i))))

    return F.coalesce(F.get(F.transform(F.array(words), sentence), 0), F.array().cast("array<string>"))


def centred(words: Column, word: Column, at: Column) -> Column:
    """A word joined with its neighbours; ``words`` is a lambda's variable, ``word`` its element ``at``."""
    return F.concat_ws("_", F.get(words, at - 1), word, F.get(words, at + 1))
