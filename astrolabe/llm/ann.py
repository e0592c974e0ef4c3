"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed by ``floor((a . x + b) / w)`` with Gaussian ``a``, several
hashes to a table key, several tables.  A query visits, in each table, its own
bucket and then perturbed ones in the order of their estimated success: each
hash can step down or up, at a cost of the squared distance to that border, and
sets of steps are visited by rising expected cost.  The candidates of all tables
are merged, ranked by exact inner product, and the best are kept.  Buckets have
no cap: a bucket with a third of all vectors is ranked whole.

Largest inner product becomes nearest by Euclid with one more component that
brings all vectors to the length of the longest (the query's is 0).

The number of buckets to visit is fitted: for ``SAMPLE_QUERIES`` queries the true
neighbours are found by a scan, and the count that reaches ``TARGET`` of them is
taken for all.  Every row is indexed.  Where all ``3 ** HASHES`` step sets together miss
the target, buckets don't separate these vectors, and each query is held against all rows.

The work is a grid: vectors are dealt to shards of about ``SHARD_ROWS`` rows
whatever their buckets, queries to blocks of about ``BLOCK_ROWS``, and each cell
indexes its whole shard and probes it with its block.  A cell fits in memory for
any input, and each query gets at most ``k`` rows from a shard.

Defined results: vectors that are null, empty, of another length than the most
common one, zero, or that hold a null or non-finite component take no part;
a query without candidates has no row; ties go to the smaller identifier; rows
that share an identifier count as one, with its best score, and a query never
finds its own identifier; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import table

TABLES = 10
HASHES = 5
#: Queries whose true neighbours set the number of probes, and the share of them to reach.
SAMPLE_QUERIES = 48
TARGET = 0.96
#: In place of a number of probes: every row is a candidate.
EVERY_ROW = 0
#: Bucket width, as a part of the longest vector's length.
WIDTH = 1.2
SHARD_ROWS = 4096
BLOCK_ROWS = 4096
SEED = 11


def probe_sets(hashes: int = HASHES, probes: int = 3 ** HASHES) -> list[list[int]]:
    """The first ``probes`` perturbation sets, by rising expected cost.

    A set names ranks 0 .. 2 * hashes - 1 of a query's border distances in
    rising order; ranks r and 2 * hashes - 1 - r are the two borders of one hash,
    so no set holds both.  The expected squared distance of rank r is that of
    the r-th of uniform draws.  The empty set (the own bucket) comes first.
    """
    m = hashes
    cost = [(r + 1) * (r + 2) / (4.0 * (m + 1) * (m + 2)) if r < m else
            1.0 - (2 * m - r) / (m + 1.0) + (2 * m - r) * (2 * m + 1 - r) / (4.0 * (m + 1) * (m + 2)) for r in range(2 * m)]
    out, heap = [[]], []
    heappush(heap, (cost[0], [0]))
    while heap and len(out) < probes:
        total, ranks = heappop(heap)
        if all(2 * m - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:  # move the last rank on, or add the next one
            heappush(heap, (total - cost[last] + cost[last + 1], ranks[:-1] + [last + 1]))
            heappush(heap, (total + cost[last + 1], ranks + [last + 1]))
    return out


class Hashing:
    """The hash functions; equal for all shards."""

    def __init__(self, dimensions: int, longest: float, tables: int = TABLES, hashes: int = HASHES,
                 width: float | None = None) -> None:
        self.hashes, self.longest, self.width = hashes, longest, (WIDTH if width is None else width) * longest
        rng = np.random.default_rng(SEED)
        self.a = rng.standard_normal((dimensions + 1, tables * hashes)).astype(np.float32)
        self.b = (rng.random(tables * hashes) * self.width).astype(np.float32)
        self.mix = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64) * 2 + 1

    def _project(self, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        full = np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)
        return ((full @ self.a + self.b) / np.float32(self.width)).reshape(len(x), -1, self.hashes)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Bucket keys of stored vectors: rows x tables."""
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0.0))
        return (np.floor(self._project(x, rest)).astype(np.int64) * self.mix).sum(axis=2)

    def buckets(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Keys of the buckets to visit: queries x tables x probes, in visiting order."""
        m = self.hashes
        place = self._project(queries, np.zeros(len(queries)))
        cells = np.floor(place)
        down = place - cells
        border = np.concatenate([down, 1.0 - down], axis=2)  # 0 .. m-1 step down, m .. 2m-1 step up
        steps = np.concatenate([-self.mix, self.mix], axis=1)[None]
        ranked = np.argsort(border, axis=2, kind="stable")
        move = np.take_along_axis(np.broadcast_to(steps, ranked.shape), ranked, axis=2)
        own = (cells.astype(np.int64) * self.mix).sum(axis=2)
        out = np.repeat(own[:, :, None], probes, axis=2)
        for p, ranks in enumerate(probe_sets(m, probes)):
            if ranks:
                out[:, :, p] += move[:, :, ranks].sum(axis=2)
        return out


class Index:
    """The hash tables over one shard's vectors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, hashing: Hashing) -> None:
        self.x, self.ids, self.hashing = x, ids, hashing
        keys = hashing.keys(x)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=0)
        self.repeats = len(np.unique(ids)) < len(ids)

    def candidates(self, queries: np.ndarray, probes: int) -> Iterator[np.ndarray]:
        """Per query, the positions that any visited bucket holds (rising)."""
        if probes == EVERY_ROW:
            yield from [np.arange(len(self.x))] * len(queries)
            return
        keys = self.hashing.buckets(queries, probes)
        tables = keys.shape[1]
        low = np.stack([np.searchsorted(self.keys[:, t], keys[:, t], "left") for t in range(tables)], axis=1)
        high = np.stack([np.searchsorted(self.keys[:, t], keys[:, t], "right") for t in range(tables)], axis=1)
        seen = np.zeros(len(self.x), dtype=bool)
        for q in range(len(queries)):
            seen[:] = False
            for t in range(tables):
                a, b = low[q, t], high[q, t]
                for i, j in zip(a[b > a].tolist(), b[b > a].tolist()):
                    seen[self.order[i:j, t]] = True
            yield np.flatnonzero(seen)

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, k: int, probes: int):
        """Per query ``(ids, exact inner products)`` of the best ``k`` candidates."""
        for q, found in enumerate(self.candidates(queries, probes)):
            found = found[self.ids[found] != query_ids[q]]
            score = (self.x[found] * queries[q]).sum(axis=1)
            if self.repeats:  # an identifier's best row only
                best = np.lexsort((-score, self.ids[found]))
                best = best[np.unique(self.ids[found[best]], return_index=True)[1]]
                found, score = found[best], score[best]
            if len(found) > 4 * k:
                part = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[part], score[part]
            best = np.lexsort((self.ids[found], -score))[:k]
            yield self.ids[found[best]], score[best]


def fit_probes(base: DataFrame, asked: DataFrame, hashing: Hashing, k: int) -> int:
    """The number of probes that finds ``TARGET`` of the true neighbours of a bounded sample of queries, or ``EVERY_ROW``.

    The sample (smallest hashes) and its neighbours, at most ``SAMPLE_QUERIES * k``
    vectors, pass through the driver; the scan keeps ``k`` rows a query and batch.
    """
    rows = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()
    if not rows:
        return 1
    ids, q = np.array([r.id for r in rows]), np.array([r.v for r in rows])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, x = batch["id"].to_numpy(), np.stack(batch["v"].to_numpy())
            score = np.where(own[None, :] == ids[:, None], -np.inf, q @ x.T)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            at, where = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
            yield pd.DataFrame({"q": at, "id": own[where], "score": score[at, where], "v": list(x[where])})

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = (base.mapInPandas(kernel, "q int, id long, score double, v array<double>")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .where(F.col("score") > float("-inf")).select("q", "v").collect())
    if not near:
        return 1
    visits = hashing.buckets(q, 3 ** hashing.hashes)[[r.q for r in near]]
    stored = hashing.keys(np.array([r.v for r in near]))
    hit = visits == stored[:, :, None]
    first = np.where(hit.any(axis=2), hit.argmax(axis=2).astype(float), np.inf).min(axis=1)
    needed = float(np.sort(first)[int(np.ceil(TARGET * (len(first) - 1)))])
    return int(needed) + 1 if np.isfinite(needed) else EVERY_ROW


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           probes: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, nearest first."""
    def clean(df: DataFrame) -> DataFrame:
        v = F.col("v")
        finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        return (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
                .where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)))

    base, asked = clean(vectors), clean(queries)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    facts = (base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"))
             .orderBy(F.desc("n"), "d").first())
    schema = "query_id long, vec_id long, score double"
    if facts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, longest = facts
    base, asked = base.where(F.size("v") == d), asked.where(F.size("v") == d)
    hashing = Hashing(d, longest)
    probes = fit_probes(base, asked, hashing, k) if probes is None else probes
    shards, blocks = -(-n // SHARD_ROWS), max(1, -(-asked.count() // BLOCK_ROWS))

    def cells(df: DataFrame, own: int, other: int, names: tuple[str, str], is_query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(names[0])
        return df.select(mine, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]), "id", "v").select(
            (F.col("shard") * blocks + F.col("block")).alias("cell"), F.lit(is_query).alias("asks"), "id", "v")

    both = (cells(base, shards, blocks, ("shard", "block"), False)
            .union(cells(asked, blocks, shards, ("block", "shard"), True)))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one cell after the other, its vectors before its queries
        cell, parts = None, ([], [])
        for batch in batches:
            for (c, asks), group in batch.groupby(["cell", "asks"], sort=True):
                if c != cell:
                    if cell is not None:
                        yield answer(*parts)
                    cell, parts = c, ([], [])
                parts[int(asks)].append((group["id"].to_numpy(dtype=np.int64), np.stack(group["v"].to_numpy())))
        if cell is not None:
            yield answer(*parts)

    def answer(rows: list, asks: list) -> pd.DataFrame:
        if not rows or not asks:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "i8", "vec_id": "i8"})
        ids, x = (np.concatenate([p[i] for p in rows]) for i in (0, 1))
        query_ids, q = (np.concatenate([p[i] for p in asks]) for i in (0, 1))
        index, out = Index(x, ids, hashing), []
        for at in range(0, len(q), 512):
            part, part_ids = q[at:at + 512], query_ids[at:at + 512]
            out += [(np.full(len(i), qid), i, s) for qid, (i, s) in zip(part_ids, index.nearest(part, part_ids, k, probes))]
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    found = both.repartition("cell").sortWithinPartitions("cell", "asks").mapInPandas(kernel, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@register("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose identifier is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
