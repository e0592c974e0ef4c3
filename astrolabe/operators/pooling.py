"""M3 / M4: item vectors as sums of token vectors.

Hashed token vectors are a function of the token, so an item's sum needs its own tokens
only: a pass over Arrow batches without any join or shuffle (:func:`pool_hashed`).

Trained vectors come as a table (:func:`pool_trained`).  Few tokens make up most of a text:
the vocabulary is split by the number of occurrences.  The heaviest tokens' vectors, at
most ``HEAVY_BYTES`` of them, go to every task and are summed where the items lie; all other
tokens are joined by a shuffle, in which no token is hot, and summed with partial
aggregates.  An unknown token adds nothing.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolabe.operators.text import centred

#: Vectors of heavy tokens that every task holds.
HEAVY_BYTES = 16 << 20
#: Numbers of token vectors that a task makes at a time (2.4 MB, to stay in the cache).
CELLS = 300_000
#: Tokens whose 64-bit hashed vectors are made together, and those whose rows are summed at a time.
STEP, SPAN = 512, 500_000
#: Vectors of frequent tokens that a task keeps (20 MB at 300 dimensions), and from how many tokens at least it takes them.
COMMON, ENOUGH = 8192, 100_000


def _spans(ends: np.ndarray, most: int):
    """Ranges of rows that hold at most ``most`` tokens together, but for single longer rows."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _draws(token: str, dim: int, seed: int) -> list[float]:
    """A component is the draw of :func:`resample.uniform` for stream ``dim<c>``, less a half (what SQL can repeat)."""
    return [int.from_bytes(md5(f"{seed}_dim{c}_{token}".encode()).digest()[:4], "big") / 4294967296.0 - 0.5 for c in range(dim)]


def _mixed(hashes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Components from one 64-bit hash a token, scrambled with the component's number; uniform in +-0.5."""
    x = hashes.view(np.uint64)[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) - 0.5


def _sums(column: pa.ListArray, vectors, dim: int) -> np.ndarray:
    """Row sums of ``vectors(flat part)`` over the lists of an Arrow column."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat, out = column.values, np.zeros((len(column), dim))
    most = max(1, CELLS // dim)
    for a, b in _spans(ends, most):
        for s in range(ends[a], ends[b], most):         # a longer row comes in pieces
            e = min(s + most, ends[b])
            v = vectors(flat.slice(s, e - s))
            owner = np.searchsorted(ends[a:b + 1], np.arange(s, e), side="right") - 1 + a
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[heads]] += np.add.reduceat(v, heads, axis=0)
    return out


class _Mixer:
    """Sums of :func:`_mixed` vectors.  The most frequent tokens' are kept, any other's are made where they are added, in
    buffers that stay near the core.  Sums within a buffer are those of whole numbers, without rounding."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.step = dim, max(1, min(STEP, CELLS // dim))
        self.offsets = np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        self.x, self.y = (np.empty((self.step, dim), np.uint64) for _ in range(2))
        self.common = None

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The upper 53 bits of the scrambled hashes, in the buffer."""
        x, y = self.x[:len(hashes)], self.y[:len(hashes)]
        np.add(hashes[:, None], self.offsets, out=x)
        np.right_shift(x, np.uint64(30), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
        np.right_shift(x, np.uint64(27), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(0x94D049BB133111EB), out=x)
        return np.right_shift(x, np.uint64(11), out=x)

    def keep(self, hashes: np.ndarray) -> None:
        """Keeps the vectors of the tokens that come most often among these."""
        found, n = np.unique(hashes, return_counts=True)
        often = np.sort(np.argsort(-n, kind="stable")[:COMMON])
        self.common = found[often[n[often] > 1]]
        self.table = np.empty((len(self.common), self.dim), np.uint64)
        for s in range(0, len(self.common), self.step):
            self.table[s:s + self.step] = self.numbers(self.common[s:s + self.step])

    def add(self, out: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Adds each token's vector to its row of ``out``; ``rows`` ascend."""
        if self.common is None and len(hashes) >= ENOUGH:
            self.keep(hashes)
        if self.common is None or not len(self.common):
            return self._add(out, hashes, rows, self.numbers)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        kept = self.common[at] == hashes
        self._add(out, at[kept], rows[kept], lambda k: self.table.take(k, axis=0, out=self.x[:len(k)], mode="clip"))
        self._add(out, hashes[~kept], rows[~kept], self.numbers)

    def _add(self, out: np.ndarray, tokens: np.ndarray, rows: np.ndarray, numbers) -> None:
        blocks = np.arange(0, len(tokens), self.step)
        heads = np.union1d(blocks, np.flatnonzero(rows[1:] != rows[:-1]) + 1) if len(tokens) else blocks   # of a row's part in a block
        own, less = rows[heads], (np.diff(heads, append=len(tokens)) << 52)[:, None]
        first = np.searchsorted(heads, blocks).tolist() + [len(heads)]
        for s, i, j in zip(blocks.tolist(), first[:-1], first[1:]):
            x = numbers(tokens[s:s + self.step])
            if j - i == 1:
                out[own[i]] += (np.add.reduce(x, axis=0).view(np.int64) - less[i]) * (1 / (1 << 53))
                continue
            at = heads[i:j] - s
            if j - i <= len(x) // 16:
                total = np.array([np.add.reduce(x[a:b], axis=0) for a, b in zip(at, [*at[1:], len(x)])])
            else:
                total = np.add.reduceat(x, at, axis=0)
            out[own[i:j]] += (total.view(np.int64) - less[i:j]) * (1 / (1 << 53))


def pool_hashed(items: DataFrame, key: str, tokens: str, dim: int, seed: int = 7, draws: bool = True, radius: int = 0) -> DataFrame:
    """``<key>, vec`` per row with tokens: the sum of its tokens' hashed vectors, made where the row lies.

    With ``draws`` a component is an md5 draw that SQL can repeat; without, all components come from one 64-bit
    hash of the token (many dimensions).  With ``radius`` 1 the tokens are words, and the row's tokens are those of their
    sentence (:func:`text.token_sentence`).
    """
    known: dict[str, list[float]] = {}

    def drawn(flat: pa.Array) -> np.ndarray:
        coded = flat.dictionary_encode()
        if len(known) > 100_000:
            known.clear()
        words = coded.dictionary.to_pylist()
        table = np.array([known.get(w) or known.setdefault(w, _draws(w, dim, seed)) for w in words], dtype=np.float64).reshape(-1, dim)
        return table[coded.indices.to_numpy()]

    def mixed(column: pa.ListArray, mixer: _Mixer) -> np.ndarray:
        ends, out = column.offsets.to_numpy().astype(np.int64), np.zeros((len(column), dim))
        hashes = column.values.to_numpy()[ends[0]:ends[-1]].view(np.uint64)
        mixer.add(out, hashes, np.repeat(np.arange(len(column), dtype=np.int32), np.diff(ends)))
        return out

    def kernel(batches):
        mixer = _Mixer(dim, seed)
        for batch in batches:
            for a, b in _spans(batch.column("tokens").offsets.to_numpy().astype(np.int64), SPAN):
                part = batch.slice(a, b - a)
                part = part.filter(pc.fill_null(pc.greater(pc.list_value_length(part.column("tokens")), 0), False))
                sums = _sums(part.column("tokens"), drawn, dim) if draws else mixed(part.column("tokens"), mixer)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=[key, "vec"])

    def made(words):
        """A row's tokens or their hashes; the words are a lambda's variable, so that they are made once."""
        if draws:
            return F.flatten(F.transform(words, lambda w, i: F.array(w, centred(words, w, i)))) if radius else words
        own = F.transform(words, lambda w: F.xxhash64(w))
        return F.concat(own, F.transform(words, lambda w, i: F.xxhash64(centred(words, w, i)))) if radius else own

    listed = F.filter(F.col(tokens), lambda t: t.isNotNull())
    # rows without tokens go in the tasks: a condition on the tokens would make them twice
    rows = items.select(F.col(key).alias("key"), F.get(F.transform(F.array(listed), made), 0).alias("tokens"))
    return rows.mapInArrow(kernel, f"`{key}` {rows.schema['key'].dataType.simpleString()}, vec array<double>")


def pool_trained(items: DataFrame, key: str, tokens: str, vectors: DataFrame, token: str, vec: str, dim: int,
                 heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """``<key>, vec`` per key with tokens: the sum of its tokens' vectors from the table ``vectors``."""
    counts = (items.select(F.col(key).alias("key"), F.explode(tokens).alias("token")).where("token IS NOT NULL")
              .groupBy("key", "token").agg(F.count(F.lit(1)).cast("double").alias("c")))
    given = vectors.select(F.col(token).alias("token"), F.col(vec).alias("v"))
    # the size bound comes from the number of rows taken: 8 dim bytes each
    most = max(1, heavy_bytes // (8 * dim))
    top = (items.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "token").limit(most).select("token"))
    heavy = given.join(F.broadcast(top), "token", "left_semi").toPandas()
    names, table = heavy["token"].tolist(), np.array(heavy["v"].tolist(), dtype=np.float64).reshape(-1, dim)
    names_frame = items.sparkSession.createDataFrame(pd.DataFrame({"token": names}), "token string") if names else None

    def kernel(batches):
        known = pa.array(names, pa.string())
        zero = np.vstack([table, np.zeros((1, dim))])
        for batch in batches:
            def looked_up(flat):
                at = pc.fill_null(pc.index_in(flat, value_set=known), len(names)).to_numpy()
                return zero[at]
            sums = _sums(batch.column("tokens"), looked_up, dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "v"])

    rows = items.select(F.col(key).alias("key"), F.filter(F.col(tokens), lambda t: t.isNotNull()).alias("tokens")).where(F.size("tokens") > 0)
    kind = rows.schema["key"].dataType.simpleString()
    near = rows.mapInArrow(kernel, f"key {kind}, v array<double>")
    rare = counts if names_frame is None else counts.join(F.broadcast(names_frame), "token", "left_anti")
    far = rare.join(given, "token").select("key", array_to_vector("v").alias("v"), "c")
    far = far.groupBy("key").agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("c"))).alias("v"))
    both = near.unionByName(far).select("key", array_to_vector("v").alias("v"))
    return both.groupBy(F.col("key").alias(key)).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("vec"))
