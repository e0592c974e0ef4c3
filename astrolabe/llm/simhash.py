"""SimHash near-dedup: fingerprints, BK-trees over shards of them, connected groups.

A fingerprint has a bit set if more than half of the document's shingle hashes
have it (XXH64, seed 42).  Two fingerprints within ``radius`` bits agree on at
least ``blocks - radius`` of ``blocks`` bit fields, so every choice of that many
fields is a table, and fingerprints that agree on a table's fields form a shard.
Each shard of at most ``SHARD_ROWS`` fingerprints gets a BK-tree (children keyed
by integer Hamming distance to the parent), and a query follows only the edges
within the radius of its own distance.  A larger shard is cut into parts, and
every pair of parts is a unit of its own: the tree of one part, queried by the
other, so a field value with a third of all rows is spread over many tasks and
no link is lost.  Trees travel by shuffle with their queries, not by broadcast:
all trees together are as large as the corpus.

Each unit emits links that connect what it finds connected (a spanning set, not
all pairs).  Groups are found by alternating large-star and small-star steps on
distinct fingerprints, each step a Spark job whose result is a written table.

Defined results: a null, empty or blank text has fingerprint 0 and is linked
like any other; fewer words than a shingle are one shingle; equal rows share a
fingerprint; a row without an identifier is grouped, and a group's identifier is
the smallest there is (null if there is none); an empty table gives an empty
result; other columns are carried by ``dedup`` and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import materialise, table, text_batches, text_of

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
SHARD_ROWS = 2048
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one whole text (unsigned)."""
    parts = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        stop = min(n, at + SLICE)
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:stop], ends[words - 1 + at:words - 1 + stop]
                                                                   if len(parts) >= words else ends[-1:])],
                          dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_digest(text_col: str) -> Column:
    """Rows of one identifier are told apart by it; a null text is an empty one."""
    return F.sha2(text_of(text_col).cast("binary"), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS, digest: bool = False) -> DataFrame:
    """``id, fp`` per row, on demand with ``digest``; ``fp`` holds the 64 bits as a long."""
    extra = ["digest"] if digest else []

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(t, words) for t in batch["text"]], dtype="u8")
            yield pd.DataFrame({"id": batch["id"], "fp": bits.view("i8"), **{c: batch[c] for c in extra}})

    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       *[text_digest(text_col).alias(c) for c in extra])
    id_type = base.schema["id"].dataType.simpleString()
    # identifiers pass through Python as text: a null stays a null, a long stays exact
    out = base.withColumn("id", F.col("id").cast("string")).mapInPandas(
        kernel, ", ".join(["id string", "fp long", *[f"{c} string" for c in extra]]))
    return out.select(F.col("id").cast(id_type).alias("id"), "fp", *extra)


class BKTree:
    """Burkhard-Keller tree over 64-bit integers."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        k = len(self.values)
        self.values.append(value)
        self.children.append({})
        if not k:
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = k
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def unit_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``left``, or between ``left`` and ``right``.

    ``left`` builds the tree; its own members (``right`` is None) or those of
    ``right`` query it.  A link is kept only if it joins two parts of the unit
    that earlier links had not joined.
    """
    links = []
    tree = BKTree()
    if right is None:
        parent = list(range(len(left)))
        for k, value in enumerate(left):
            for hit in tree.within(value, radius):
                a, b = _root(parent, hit), _root(parent, k)
                if a != b:
                    parent[b] = a
                    links.append((left[hit], value))
            tree.add(value)
        return links
    for value in left:
        tree.add(value)
    parent = list(range(len(left) + len(right)))
    for k, value in enumerate(right, len(left)):
        for hit in tree.within(value, radius):
            a, b = _root(parent, hit), _root(parent, k)
            if a != b:
                parent[b] = a
                links.append((left[hit], value))
    return links


def _fields(blocks: int) -> list[tuple[int, int]]:
    """``(shift, bits)`` of the bit fields."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def shard_keys(fp, radius: int, blocks: int):
    """Array of one key per table: the table's number and the masked fingerprint."""
    fields = _fields(blocks)
    keys = []
    for k, chosen in enumerate(combinations(fields, blocks - radius)):
        mask = sum(((1 << bits) - 1) << shift for shift, bits in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(k).cast("short").alias("tab"), fp.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*keys)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect every group.

    ``blocks`` only sets the number and width of the tables (more blocks: more
    tables, smaller shards); the links connect the same groups for any value.
    """
    blocks = blocks or radius + 2
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / SHARD_ROWS).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # every pair of parts of a shard is a unit; a fingerprint joins the units of its part
    units = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.least(F.col("part"), other).alias("lo"), F.greatest(F.col("part"), other).alias("hi")))
    spread = (keyed.join(sizes, ["tab", "key"]).withColumn("parts", parts).withColumn("part", part)
              .withColumn("unit", F.explode(units))
              .select("tab", "key", "unit.lo", "unit.hi", (F.col("part") == F.col("lo")).alias("left"), "fp")
              .repartition("tab", "key", "lo", "hi").sortWithinPartitions("tab", "key", "lo", "hi", "fp"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(unit, left, right):
            return unit_links(left, None if unit[2] == unit[3] else right, radius)

        unit, left, right, out = None, [], [], []
        for batch in batches:
            fp = batch["fp"].to_numpy().view("u8").tolist()
            for tab, key, lo, hi, is_left, value in zip(batch["tab"].tolist(), batch["key"].tolist(), batch["lo"].tolist(),
                                                        batch["hi"].tolist(), batch["left"].tolist(), fp):
                if (tab, key, lo, hi) != unit:
                    if unit:
                        out += done(unit, left, right)
                    unit, left, right = (tab, key, lo, hi), [], []
                (left if is_left else right).append(value)
            if len(out) > 1 << 16:
                yield _pairs(out)
                out = []
        if unit:
            out += done(unit, left, right)
        yield _pairs(out)

    return spread.mapInPandas(kernel, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pd.DataFrame:
    both = np.array(found, dtype="u8").reshape(-1, 2).view("i8")
    return pd.DataFrame({"a": both.min(axis=1), "b": both.max(axis=1)})


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a, b``, ``a <> b``): root is the smallest connected node.

    Large-star and small-star steps in turn until the edges stay the same; each
    step's edges are a written table, and only their number and checksum reach the driver.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))) if large else e  # small-star: b > a already
        pairs = both.toDF("n", "u") if large else e.select(F.col("b").alias("n"), F.col("a").alias("u"))
        least = pairs.groupBy("n").agg(F.least(F.min("u"), F.first("n")).alias("m"))
        moved = pairs.join(least, "n")
        if large:
            out = moved.where("u > n").select(F.col("m").alias("a"), F.col("u").alias("b"))
        else:
            out = moved.select(F.col("m").alias("a"), F.col("u").alias("b")).union(
                least.select(F.col("m").alias("a"), F.col("n").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), name)
    before = state(now)
    while before[0]:
        now = materialise(star(star(now, True), False), name)
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
           radius: int = RADIUS, blocks: int | None = None, digest: bool = False) -> DataFrame:
    """``id, fp, root, component_id`` per row, on demand with ``digest``; ``root`` names the group by a fingerprint."""
    prints = materialise(fingerprints(docs, id_col, text_col, words, digest), "simhash-fp")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected(links(distinct.select("fp"), radius, blocks), "simhash-links")
    # the group's smallest identifier, for the fingerprints that have a link at all
    linked = roots.union(roots.select(F.col("root"), F.col("root"))).distinct()
    member = distinct.join(linked, distinct["fp"] == linked["node"]).select("fp", "root", "least")
    least = member.groupBy("root").agg(F.min("least").alias("group_least"))
    named = (distinct.join(member.join(least, "root").select("fp", "root", "group_least"), "fp", "left")
             .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("group_least", "least").alias("component_id")))
    return prints.join(named, "fp").select("id", "fp", "root", "component_id", *(["digest"] if digest else []))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``id, fp, component_id`` per row."""
    return groups(docs, id_col, text_col, words, radius, blocks).select("id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
          radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose identifier is their own group's smallest (one document of each group).

    Rows of a group that share that identifier are copies of one document and stay
    together; of a group without any identifier one row stays, of the text with the
    smallest digest.  A row goes by its identifier and text, so what happens to it
    does not depend on rows of other groups with the same identifier or none.
    """
    near = materialise(groups(docs, id_col, text_col, words, radius, blocks, digest=True), "simhash-near")
    nameless = near.where("component_id IS NULL")
    chosen = nameless.groupBy("root").agg(F.min("digest").alias("chosen"))
    gone = (near.where("NOT (id <=> component_id)").select("id", "digest")
            .union(nameless.join(chosen, "root").where("digest <> chosen").select("id", "digest")).distinct()
            .select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"),
                        text_digest(text_col).alias("own_digest"))
    same = F.col("own_digest") == F.col("gone_digest")
    named = whole.where("own_id IS NOT NULL").join(gone, same & (F.col("own_id") == F.col("gone_id")), "left_anti")
    unnamed = (whole.where("own_id IS NULL").join(gone.where("gone_id IS NULL"), same, "left_anti")
               .groupBy("own_digest").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")))
    return named.select("row.*").union(unnamed.select("row.*"))


@register("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest identifier of its group."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
