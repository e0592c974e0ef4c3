"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from the letter itself, so
no alphabet is fixed.  A letter n-gram is bound by multiplying its letters'
vectors, each permuted (rotated) by its place; a document bundles the vectors of
all its n-grams by adding them, and a language prototype bundles the documents
of that language.  A document gets the language whose prototype has the largest
cosine with it, and that cosine as its score.

Training adds one vector per language and task, so the tables that leave the
tasks hold languages x dimensions numbers, whatever the corpus holds.  All
labelled documents of the learning part are used, whole.

Defined results: text that is null or has no letter gets ``und`` and score 0;
ties go to the language that comes first by code point; documents without a
language are not learned from; with nothing to learn from everything is
``und``; a word shorter than an n-gram counts with its borders; equal rows are
equal votes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import table, text_batches

DIMENSIONS = 512
ORDER = 3
SEED = 7
FOLDS = 5
UNKNOWN = "und"
#: Letters bundled at once, which bounds a task's memory.
SLICE_CHARS = 1 << 19
#: Numbers of a slice's counts, and n-grams whose vectors are held at a time.
COUNT_CELLS, GRAM_BLOCK = 16_000_000, 4096


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether ``crc32(id as text) mod folds`` is 0; a null identifier is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


_LETTERS: dict[tuple[int, int], np.ndarray] = {}


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The letter's own +-1 vector (code 0: the border of a word)."""
    key = (code, dimensions)
    if key not in _LETTERS:
        rng = np.random.default_rng((SEED, code))
        _LETTERS[key] = rng.integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)
    return _LETTERS[key]


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Per distinct code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in codes.tolist()], dtype=bool)


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, every other stretch as one 0, with a 0 at both ends."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype="<u4")
    top = int(raw.max()) + 1
    if top <= 1 << 16:
        present = np.flatnonzero(np.bincount(raw, minlength=1))
    else:
        present = np.unique(raw)
    keep = np.zeros(top, dtype=bool)
    keep[present[_is_letter(present)]] = True
    codes = np.where(keep[raw], raw, 0)
    return codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))]


class Bundler:
    """Bundles the n-grams of a few documents at once.

    The distinct n-grams of the slice become rows of a matrix, so a document's
    bundle is its n-gram counts times that matrix.
    """

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER) -> None:
        self.dimensions, self.order = dimensions, order
        self.placed: dict[tuple[int, int], np.ndarray] = {}

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(counts, n-grams)``: documents x distinct n-grams, and the n-grams as rows of code points."""
        parts = [letter_codes(t or "") for t in texts]
        line = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        alphabet, small = np.unique(line, return_inverse=True)
        base, n = len(alphabet), self.order
        code = np.zeros(max(0, len(line) - n + 1), dtype=np.int64)
        for k in range(n):
            code = code * base + small[k:len(line) - n + 1 + k]
        starts = np.cumsum([0] + [len(p) for p in parts])
        space = base ** n
        if space <= 1 << 22:
            present = np.flatnonzero(np.bincount(code, minlength=space)) if len(code) else np.zeros(0, dtype=np.int64)
            place = np.zeros(space, dtype=np.int32)
            place[present] = np.arange(len(present), dtype=np.int32)
            code = place[code]
        else:
            present, code = np.unique(code, return_inverse=True)
        grams = np.empty((len(present), n), dtype=np.uint32)
        rest = present.copy()
        for k in reversed(range(n)):
            grams[:, k] = alphabet[rest % base]
            rest //= base
        counts = np.zeros((len(texts), len(present)), dtype=np.float32)
        for d in range(len(texts)):  # an n-gram belongs to the document that holds all of it
            own = code[starts[d]:max(starts[d], starts[d + 1] - n + 1)]
            if len(own):
                counts[d] = np.bincount(own, minlength=len(present))
        return counts, grams

    def _placed(self, code: int, shift: int) -> np.ndarray:
        """A letter's vector as it is permuted for its place in an n-gram."""
        if (code, shift) not in self.placed:
            self.placed[code, shift] = np.roll(letter_vector(code, self.dimensions), shift)
        return self.placed[code, shift]

    def matrix(self, grams: np.ndarray) -> np.ndarray:
        """One bound vector per n-gram."""
        out = np.ones((len(grams), self.dimensions), dtype=np.float32)
        for k in range(self.order):
            codes, where = np.unique(grams[:, k], return_inverse=True)
            place = np.stack([self._placed(c, self.order - 1 - k) for c in codes.tolist()]
                             ) if len(codes) else np.zeros((0, self.dimensions), dtype=np.int8)
            out *= place[where]
        return out


    def bundles(self, counts: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Rows of counts to bundled vectors, ``GRAM_BLOCK`` n-grams at a time."""
        out = np.zeros((len(counts), self.dimensions))
        for a in range(0, len(grams), GRAM_BLOCK):
            out += counts[:, a:a + GRAM_BLOCK] @ self.matrix(grams[a:a + GRAM_BLOCK])
        return out


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts whose counts (texts x characters at most) stay within ``COUNT_CELLS``, but for single long texts."""
    part, chars = [], 0
    for t in texts:
        size = len(t or "")
        if part and ((len(part) + 1) * (chars + size) > COUNT_CELLS or chars + size > SLICE_CHARS or len(part) >= 256):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += size
    if part:
        yield part


def prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               folds: int = FOLDS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one unit vector a row.

    What reaches the driver is one vector per language; languages are label
    values, and their number does not grow with the corpus.
    """
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler, sums = Bundler(dimensions), {}
        for batch in batches:
            for lang, group in batch.groupby("lang")["text"]:
                for part in _slices(group.tolist()):
                    counts, grams = bundler.counts(part)
                    vector = bundler.bundles(counts.sum(axis=0, dtype=np.float64)[None], grams)[0]
                    sums[lang] = sums.get(lang, 0) + vector
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]})

    text_batches(docs.sparkSession)
    known = (docs.where(~held_out(F.col(id_col), folds) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    part = known.mapInPandas(kernel, "lang string, sums array<double>")
    total = (part.select("lang", F.posexplode("sums").alias("at", "value"))
             .groupBy("lang", "at").agg(F.sum("value").alias("value"))
             .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("sums")))
    rows = sorted((r.lang, [x.value for x in r.sums]) for r in total.collect())
    matrix = np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), dimensions)
    norm = np.linalg.norm(matrix, axis=1)
    keep = norm > 0
    return [lang for (lang, _), ok in zip(rows, keep) if ok], matrix[keep] / norm[keep, None]


def guess(langs: list[str], matrix: np.ndarray):
    """Column function of a text: a struct of ``lang_pred`` and ``score``.

    A function of the text alone, so a table's other columns never leave the JVM.
    """
    def guesses(texts: list[str | None]) -> tuple[list[str], list[float]]:
        bundler, found, scores = Bundler(matrix.shape[1]), [], []
        for part in _slices(texts):
            counts, grams = bundler.counts(part)
            bundle = bundler.bundles(counts, grams)
            norm = np.linalg.norm(bundle, axis=1)
            cosine = bundle @ matrix.T / np.where(norm > 0, norm, 1.0)[:, None]
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(part)), best].clip(0.0, 1.0)
            has = counts.any(axis=1)
            found += [langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
            scores += np.where(has, top, 0.0).tolist()
        return found, scores

    @F.pandas_udf("lang_pred string, score double")
    def of(text: pd.Series) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else None for t in text.tolist()]
        found, scores = guesses(texts) if langs else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return pd.DataFrame({"lang_pred": found, "score": scores})

    return of.asNondeterministic()  # so that a filter on the result doesn't run it twice


def keep_recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_score: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` with a recognised language (not ``und``) and a score of at least ``min_score``."""
    langs, matrix = prototypes(docs, id_col, text_col, lang_col, **options)
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        guess(langs, matrix)(F.col(text_col).cast("string")).alias("guess"))
    return found.where((F.col("guess.lang_pred") != UNKNOWN) & (F.col("guess.score") >= min_score)).select("row.*")


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and cosine of every document."""
    docs = table(spark, sf_dir, "documents")
    langs, matrix = prototypes(docs)
    found = docs.select("doc_id", guess(langs, matrix)("text").alias("guess"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "guess.lang_pred", "guess.score")
