"""Quality classifier: logistic regression on hashed word n-grams, follow-the-regularised-leader updates.

A text is a bag of hashed features: its words, its pairs of neighbouring words
(a word beside itself is one feature whatever the word), and the same for word
shapes, in which letters of one kind in a row become one character.  Counts
enter as ``1 + log(count)``, scaled to length 1.  The learner walks the labelled
documents in hash order, some passes, with per-coordinate FTRL-proximal steps;
scoring is a sparse dot product.

``TRAIN_ROWS`` bounds the labelled sample (smallest hashes of the identifier, so
it doesn't depend on partitions): features are made where the rows lie, and one
task learns from at most that many sparse rows.  Scoring covers all rows.

Defined results: a null text is an empty one and scores the model's bias; rows
without a label, or with a null identifier, are not learned from; an identifier
with several labels counts each; without learning rows, or with one class only,
the score is the smoothed share of good rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import table, text_batches

BITS = 18
TRAIN_ROWS = 8_000
PASSES = 2
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
MEMO_WORDS = 200_000


def held_out(doc_id: Column) -> Column:
    """Whether ``crc32(id as text) mod 4`` is 2; false for a null identifier."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def shape(word: str) -> str:
    """The word with each run of capitals as X, of other letters as x, of digits as 9; runs of a sign shortened to two."""
    out, before, run = [], "", 0
    for c in word:
        kind = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        run = run + 1 if kind == before else 1
        if run == 1 or (run == 2 and kind == c and not c.isalnum()):
            out.append(kind)
        before = kind
    return "".join(out)[:12]


class Hasher:
    """Feature indices and values of texts; the memo of word hashes is bounded and only saves work."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.memo: dict[str, tuple[int, int]] = {}

    def _hashes(self, word: str) -> tuple[int, int]:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        digest = xxhash.xxh64_intdigest
        known = (digest(word.lower().encode("utf-8"), 1), digest(shape(word).encode("utf-8"), 2))
        if len(word) <= 64:
            self.memo[word] = known
        return known

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indices in order, and their values (a vector of length 1, or none)."""
        memo, make = self.memo, self._hashes
        pairs = [memo.get(w) or make(w) for w in (text or "").split()]
        if not pairs:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        both = np.array(pairs, dtype=np.uint64)
        every = []
        for column in (0, 1):
            h = both[:, column]
            left, right = h[:-1], h[1:]
            pair = (left * np.uint64(0x9E3779B97F4A7C15) + right) ^ (right >> np.uint64(29))
            if not column:
                pair = np.where(left == right, np.uint64(0x5851F42D4C957F2D), pair)
            every += [h, pair * np.uint64(0xD6E8FEB86659FD93)]
        mixed = np.concatenate(every)
        mixed = (mixed ^ (mixed >> np.uint64(32))) & self.mask
        index, counts = np.unique(mixed.astype(np.int64), return_counts=True)
        value = 1.0 + np.log(counts)
        return index, value / np.sqrt((value * value).sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias after ``passes`` walks over ``(indices, values, label)`` in the given order."""
    size = (1 << bits) + 1  # the last coordinate is the bias, without a penalty
    z, n = np.zeros(size), np.zeros(size)
    good = sum(y for *_, y in rows)
    weight = {0: len(rows) / (2.0 * max(1, len(rows) - good)), 1: len(rows) / (2.0 * max(1, good))}
    for _ in range(passes):
        for index, value, y in rows:
            at = np.append(index, size - 1)
            x = np.append(value, 1.0)
            w = _weights(z[at], n[at])
            w[-1] = -z[size - 1] * ALPHA / (BETA + np.sqrt(n[size - 1]))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x * weight[y]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = _weights(z, n)
    bias = -z[-1] * ALPHA / (BETA + np.sqrt(n[-1]))
    return w[:-1], float(bias)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", limit: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights of the non-zero coordinates, and the bias."""
    text_batches(docs.sparkSession)
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id", "y").limit(limit))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    sample = F.broadcast(known).join(base, "id").select(F.xxhash64("id").alias("at"), tie.alias("tie"), "text", "y")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            found = [hasher.features(t) for t in batch["text"]]
            yield pd.DataFrame({"at": batch["at"], "tie": batch["tie"], "y": batch["y"],
                                "i": [i.astype("<i4").tobytes() for i, _ in found],
                                "v": [v.astype("<f4").tobytes() for _, v in found]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(at, tie, y, np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4"))
                for b in batches for at, tie, y, i, v in zip(b["at"], b["tie"], b["y"], b["i"], b["v"])]
        rows.sort(key=lambda r: r[:3])
        good = sum(r[2] for r in rows)
        if 0 < good < len(rows):
            w, bias = ftrl([(i, v, y) for *_, y, i, v in rows])
        else:
            w, bias = np.zeros(1), float(np.log((good + 1.0) / (len(rows) - good + 1.0)))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"i": [at.astype("<i4").tobytes()], "w": [w[at].tobytes()], "bias": [bias]})

    made = sample.mapInPandas(make, "at long, tie long, y int, i binary, v binary")
    # the bound holds for the rows, also where many share an identifier
    made = made.orderBy(F.xxhash64("at", "tie"), "at", "tie", "y").limit(limit)
    model = made.repartition(1).mapInPandas(learn, "i binary, w binary, bias double").first()
    if model is None:  # an empty sample has no partition to learn in
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    return np.frombuffer(model.i, "<i4").astype(np.int64), np.frombuffer(model.w, "<f8"), model.bias


def scorer(index: np.ndarray, weights: np.ndarray, bias: float):
    """Column function of a text: its score. The model holds at most ``2 ** BITS`` weights."""
    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        hasher, w = _HASHERS.setdefault(BITS, Hasher()), np.zeros(1 << BITS)
        w[index] = weights
        out = np.empty(len(text))
        for k, t in enumerate(text.tolist()):
            i, v = hasher.features(t if isinstance(t, str) else None)
            out[k] = w[i] @ v + bias
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return of.asNondeterministic()


_HASHERS: dict[int, Hasher] = {}


@register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it reaches the threshold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", scorer(*model)("text").alias("score"))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
