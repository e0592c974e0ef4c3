"""Substring dedup with a count-min prefilter.

A window is ``WINDOW`` consecutive words of a document.  A word goes if a window
that covers it also starts in a document with a smaller identifier.

1. Sketch.  A window's *anchor* is the smallest hash of the ``GRAM``-word grams in
   it; equal windows have equal anchors, and about ``WINDOW / 4`` neighbouring windows
   share one.  Every task counts its documents' anchors in a count-min sketch; the
   tasks' sketches are added up block by block, and the cells that reach two are
   kept as bits.  A cell holds at least what each of its windows occurs in, so a
   window that starts in two documents is never estimated below two.
2. Exact pass.  Windows whose cells all reach two are grouped exactly, by 128 bits
   of their words (anchor and window hash), and lose to the smallest identifier.
   Everything else never leaves its task.  Of the equal windows that a task sees,
   only those with its smallest identifier have to be compared with other tasks;
   the others are settled where they are, so a passage that a third of all
   documents share is one document a task in the grouping.  Anchors whose cells
   are very high are grouped by window, not by anchor, so a common passage shorter
   than a window does not bring its many different windows together.

Both passes hash on whole Arrow batches: words come as 64-bit hashes from the JVM,
gram and window hashes are shifted sums over the batch.

Size of what is broadcast: ``ROWS`` bit rows of at most ``MOST_CELLS`` bits
(128 MB), and fewer than ``HEAVY_SHARE / 2`` heavy cells a row.  The rows have a cell for 16 bytes of
text up to that size; a larger corpus fills the cells and sends more windows to
the exact pass, whose result stays the same.

Defined results: a null text has no words; a document below ``WINDOW`` words
loses none; repeated rows and rows with one identifier take nothing from each
other; a row without an identifier loses none and takes none; an empty table
gives an empty result; other columns may have any name.  Identifiers are integers.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import SPACE, table, text_of

WINDOW = 50
GRAM = 25
ROWS = 2
BLOCK_BITS = 20
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 29
#: Anchors are heavy from one occurrence for so many bytes of text, which leaves fewer than HEAVY_SHARE / 2 heavy cells a row.
HEAVY_SHARE, HEAVY_LEAST = 1 << 18, 1000
#: Windows that a task gathers before it settles what it can, and bytes of text for a group of the exact pass.
GATHER = 1 << 20
#: Words hashed at a time (a dozen arrays of 8 bytes each).
SLICE_WORDS = 1 << 20
GROUP_BYTES = 16 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_BASES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * _BASES[0]
    x = (x ^ (x >> np.uint64(27))) * _BASES[1]
    return x ^ (x >> np.uint64(31))


def _gram_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive words, by doubling; shorter than the input by ``size - 1``."""
    total, have = None, 0
    power, width = words, 1
    rest = size
    while rest:
        if rest & 1:
            if total is None:
                total, have = power, width
            else:
                n = len(words) - have - width + 1
                total = total[:n] * np.uint64(pow(base, width, 1 << 64)) + power[have:have + n]
                have += width
        rest >>= 1
        if rest:
            power = power[:len(power) - width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
            width *= 2
    return total


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (size - width)], x[size - width:]) if width < size else x


def window_hashes(words: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """``(at, doc, anchor, hash)`` of all windows inside the documents that ``ends`` marks in the flat ``words``."""
    if len(words) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    starts = np.r_[0, ends[:-1]]
    lens = np.maximum(ends - starts - window + 1, 0)
    doc = np.repeat(np.arange(len(ends)), lens)
    at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    place = at + starts[doc]
    anchors = _sliding_min(_mix(_gram_hashes(words, gram, int(_BASES[0]))), window - gram + 1)
    hashes = _gram_hashes(_mix(words ^ _ODD[0]), window, int(_BASES[1]))
    return at, doc, anchors[place], hashes[place]


def _cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch; ``cells`` is a power of two."""
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return [((anchors * odd) >> shift).astype(np.int64) for odd in _ODD]


def _flat(batch: pa.RecordBatch):
    """Flat word hashes of a batch and the end of each document in them."""
    column = batch.column("words")
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return flat.view(np.uint64), (offsets[1:] - offsets[0]).astype(np.int64)


def _slices(batch: pa.RecordBatch):
    """A batch in pieces of at most ``SLICE_WORDS`` words, but for single longer documents."""
    ends = batch.column("words").offsets.to_numpy().astype(np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_WORDS, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _runs(doc: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Where a new run of windows of one document with one anchor begins."""
    return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (anchors[1:] != anchors[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)


def _count_anchors(batches, cells: int, window: int, gram: int):
    """A task's sketch: ``line, block, cell, n`` of the cells it has counted, once per document and anchor."""
    gathered, held = [], 0

    def sketch():
        anchors = np.concatenate(gathered)
        for line, cell in enumerate(_cells(anchors, cells)):
            cell, n = np.unique(cell, return_counts=True)
            block = cell >> BLOCK_BITS
            for part in np.split(np.arange(len(cell)), np.flatnonzero(block[1:] != block[:-1]) + 1):
                yield pa.RecordBatch.from_pydict({
                    "line": pa.array([line], pa.int32()), "block": pa.array([int(block[part[0]])], pa.int32()),
                    "cell": pa.array([(cell[part] & ((1 << BLOCK_BITS) - 1)).astype(np.int32)], pa.list_(pa.int32())),
                    "n": pa.array([n[part].astype(np.int32)], pa.list_(pa.int32()))})

    for batch in (part for whole in batches for part in _slices(whole)):
        _, doc, anchors, _ = window_hashes(*_flat(batch), window, gram)
        runs = _runs(doc, anchors)
        doc, anchors = doc[runs], anchors[runs]
        order = np.lexsort((anchors, doc))
        once = anchors[order][_runs(doc[order], anchors[order])]
        gathered.append(once)
        held += len(once)
        if held >= GATHER:
            yield from sketch()
            gathered, held = [], 0
    if held:
        yield from sketch()


def _merge_block(part: pa.Table, heavy_from: int) -> pa.Table:
    """Adds up the tasks' counts of one block: the bits of its cells that reach two, and its heavy cells."""
    counts = np.bincount(part.column("cell").combine_chunks().flatten().to_numpy(),
                         part.column("n").combine_chunks().flatten().to_numpy(), minlength=1 << BLOCK_BITS)
    return pa.table({"line": part.column("line")[:1], "block": part.column("block")[:1],
                     "bits": pa.array([np.packbits(counts >= 2).tobytes()], pa.binary()),
                     "heavy": pa.array([np.flatnonzero(counts >= heavy_from).astype(np.int32)], pa.list_(pa.int32()))})


class Sketch:
    """The merged sketch as tasks use it: bits of the cells that reach two, and the heavy cells of each row."""

    def __init__(self, cells: int):
        self.cells = cells
        self.bits = np.zeros((ROWS, max(cells >> 3, 1)), dtype=np.uint8)
        self.heavy = [np.zeros(0, dtype=np.int64) for _ in range(ROWS)]

    def lookup(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors are estimated to repeat, and which to be heavy: by the smallest of their cells."""
        repeated, heavy = np.ones(len(anchors), dtype=bool), np.ones(len(anchors), dtype=bool)
        for line, cell in enumerate(_cells(anchors, self.cells)):
            repeated &= (self.bits[line][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            heavy &= np.isin(cell, self.heavy[line])
        return repeated, heavy


def sketch_anchors(hashed: DataFrame, cells: int, heavy_from: int, window: int, gram: int) -> Sketch:
    """Merges the tasks' sketches.  What reaches the driver has the size of the sketch, whatever the input."""
    merged = (hashed.select("words")
              .mapInArrow(partial(_count_anchors, cells=cells, window=window, gram=gram),
                          "line int, block int, cell array<int>, n array<int>")
              .groupBy("line", "block")
              .applyInArrow(lambda part: _merge_block(part, heavy_from), "line int, block int, bits binary, heavy array<int>"))
    out = Sketch(cells)
    width = min(cells, 1 << BLOCK_BITS) >> 3
    heavy: list[list] = [[] for _ in range(ROWS)]
    for r in merged.toArrow().to_pylist():
        out.bits[r["line"], r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint8)[:width]
        heavy[r["line"]] += [(r["block"] << BLOCK_BITS) + c for c in r["heavy"]]
    out.heavy = [np.array(sorted(h), dtype=np.int64) for h in heavy]
    return out


def _least(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For each row the smallest identifier among the rows with its keys."""
    order = np.lexsort((ids, *keys))
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    least = np.empty(len(ids), dtype=ids.dtype)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return least


_OPEN = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("print", pa.int64()), ("first", pa.int64()), ("anchor", pa.int64()),
                   ("hashes", pa.list_(pa.int64())), ("count", pa.int64())])


def _list_array(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values))


def _candidates(batches, sketch, buckets: int, window: int, gram: int):
    """Runs of windows that may repeat: those open to other tasks with their hashes, settled ones as ``count`` windows
    from ``first`` that go."""
    gathered, held = [], 0

    def settle():
        ids, prints, at, anchors, hashes, heavy = (np.concatenate(x) for x in zip(*gathered))
        goes = _least([hashes, anchors], ids) < ids
        new = np.r_[True, (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1]) | (at[1:] != at[:-1] + 1) | (goes[1:] != goes[:-1])
                    | (~goes[1:] & ((anchors[1:] != anchors[:-1]) | heavy[1:]))]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(ids)])
        gone = goes[begin]
        key = np.where(heavy[begin], _mix(anchors[begin] ^ hashes[begin]), anchors[begin])
        key = np.where(gone, _mix(ids[begin].view(np.uint64) ^ at[begin].view(np.uint64)), key)
        inside = np.where(gone, 0, size)
        values = hashes.view(np.int64)[np.repeat(~gone, size)]
        out = pa.RecordBatch.from_arrays([
            pa.array((key % np.uint64(buckets)).astype(np.int64)), pa.array(ids[begin]), pa.array(prints[begin]), pa.array(at[begin]),
            pa.array(anchors.view(np.int64)[begin]), _list_array(np.cumsum(inside) - inside, values), pa.array(size.astype(np.int64))],
            schema=_OPEN)
        for k in range(0, out.num_rows, 10_000):
            yield out.slice(k, 10_000)

    for batch in (part for whole in batches for part in _slices(whole)):
        at, doc, anchors, hashes = window_hashes(*_flat(batch), window, gram)
        repeated, heavy = sketch.value.lookup(anchors)
        pick = np.flatnonzero(repeated)
        ids = batch.column("id").to_numpy(zero_copy_only=False)[doc[pick]]
        prints = batch.column("print").to_numpy(zero_copy_only=False)[doc[pick]]
        gathered.append((ids, prints, at[pick], anchors[pick], hashes[pick], heavy[pick]))
        held += len(pick)
        if held >= GATHER:
            yield from settle()
            gathered, held = [], 0
    if held:
        yield from settle()


def _decide(part: pa.Table) -> pa.Table:
    """Exact grouping of one bucket: for each run the windows that start in a document with a smaller identifier."""
    part = part.combine_chunks()
    ids, prints, first, size = (part.column(c).to_numpy() for c in ("id", "print", "first", "count"))
    lists = part.column("hashes").combine_chunks()
    inside = np.diff(lists.offsets.to_numpy())
    settled = inside == 0
    run = np.repeat(np.arange(len(ids)), inside)
    hashes = lists.flatten().to_numpy()
    at = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(inside) - inside, inside)
    goes = _least([hashes, part.column("anchor").to_numpy()[run]], ids[run]) < ids[run] if len(run) else np.zeros(0, dtype=bool)
    run, at = run[goes], at[goes]
    new = np.r_[True, (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)] if len(run) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(new)
    found = run[begin]
    return pa.table({"id": np.r_[ids[settled], ids[found]], "print": np.r_[prints[settled], prints[found]],
                     "first": np.r_[first[settled], at[begin]],
                     "count": np.r_[size[settled], np.diff(np.r_[begin, len(run)])].astype(np.int64)})


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id, print, spans``: per document (identifier and text print) the word ranges that go, apart and in order."""
    spark = docs.sparkSession
    text = text_of(F.col(f"`{text_col}`"))
    size = docs.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // 16).bit_length()))
    hashed = (docs.where(F.col(f"`{id_col}`").isNotNull())
              .select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("print"),
                      F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("words")))
    heavy_from = max(HEAVY_LEAST, size // HEAVY_SHARE)
    sketch = spark.sparkContext.broadcast(sketch_anchors(hashed, cells, heavy_from, window, gram))
    buckets = max(1, size // GROUP_BYTES)
    runs = hashed.mapInArrow(partial(_candidates, sketch=sketch, buckets=buckets, window=window, gram=gram),
                             "bucket long, id long, print long, first long, anchor long, hashes array<long>, count long")
    gone = runs.groupBy("bucket").applyInArrow(_decide, "id long, print long, first long, count long")
    own = Window.partitionBy("id", "print").orderBy("a", "b")
    reach = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return (gone.select("id", "print", F.col("first").alias("a"), (F.col("first") + F.col("count") + window - 1).alias("b"))
            .withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("long"))
            .withColumn("span", F.sum("new").over(own))
            .groupBy("id", "print", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
            .groupBy("id", "print").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM) -> DataFrame:
    """``id, n_words, n_removed, kept`` (the words that stay, joined by one space) per row, and ``row``, the whole input row."""
    spans = repeated_spans(docs, id_col, text_col, window, gram).select(
        F.col("id").alias("s_id"), F.col("print").alias("s_print"), "spans")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = text_of(F.col("row").getField(text_col))
    named = base.withColumn("id", F.col("row").getField(id_col)).withColumn("print", F.xxhash64(text))
    joined = named.join(spans, (F.col("id").cast("long") == F.col("s_id")) & (F.col("print") == F.col("s_print")), "left")
    zero = F.lit(0).cast("long")
    parts = joined.withColumn("words", words_of(text)).withColumn("spans", F.coalesce(
        "spans", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    begins = F.concat(F.array(zero), F.col("spans.b"))
    ends = F.concat(F.col("spans.a"), F.array(F.size("words").cast("long")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.slice("words", (a + 1).cast("int"), (b - a).cast("int")))
    return parts.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.aggregate("spans", zero, lambda n, x: n + x["b"] - x["a"]).alias("n_removed"),
        F.array_join(F.when(F.size("spans") == 0, F.col("words")).otherwise(F.flatten(pieces)), " ").alias("kept"), "row")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the texts that are left, where any word goes; other texts stay as they are."""
    made = without_repeats(docs, id_col, text_col, **options)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row").getField(text_col).cast("string"))
    return made.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


@register("op13_substring_dedup", """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' '))) AS keys FROM d WHERE len(w) >= 50),
p AS (SELECT doc_id, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS i FROM k),
m AS (SELECT key, min(doc_id) AS least FROM p GROUP BY key),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS word FROM p JOIN m USING (key) WHERE doc_id > least),
r AS (SELECT doc_id, list(word) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(
         list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
""")
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that go and the digest of those that stay."""
    return without_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
