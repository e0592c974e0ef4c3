"""Language ID: binding and bundling against a plain loop, held-out accuracy, odd rows."""

import zlib

import numpy as np

from astrolabe.llm.language_id import Bundler, guess, keep_recognised, letter_vector, op6_language_id, prototypes
from tests.conftest import SF_SMALL


def plain_bundle(text, dimensions=512):
    letters = [0]
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
        elif letters[-1]:
            letters.append(0)
    if letters[-1]:
        letters.append(0)
    out = np.zeros(dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        out += (np.roll(letter_vector(a, dimensions), 2).astype(int) * np.roll(letter_vector(b, dimensions), 1)
                * letter_vector(c, dimensions))
    return out


def test_bundles_are_the_plain_ones():
    texts = ["The cat", "", None, "a", "Ça été! 12 ñandú", "漢字 кошка 😀x", "  -- ", "b " * 5000]
    bundler = Bundler()
    counts, grams = bundler.counts(texts)
    got = counts @ bundler.matrix(grams)
    for row, text in zip(got, texts):
        assert np.array_equal(row, plain_bundle(text or ""))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op6_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    print(right, len(held))
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat with the hat", "en", "x"), (2, "le chat est sur la table avec eux", "fr", "y"),
            (3, None, "en", None), (4, "", "en", "z"), (5, "123 -- !!", None, "w"), (None, "the mat", None, "v"),
            (None, "the mat", None, "v"), (8, "le chat " * 30000, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    langs, matrix = prototypes(docs)
    assert langs == ["en", "fr"] and matrix.shape == (2, 512)
    got = {r[0]: (r[1].lang_pred, r[1].score) for r in docs.select("doc_id", guess(langs, matrix)("text")).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[None][0] == "en" and got[8][0] == "fr"
    kept = keep_recognised(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "8", "None", "None"]
    assert keep_recognised(docs.limit(0)).count() == 0
    assert prototypes(docs.where("lang IS NULL"))[0] == []
    nothing = docs.where("lang IS NULL").select(guess(*prototypes(docs.where("lang IS NULL")))("text").alias("g"))
    assert {r.g.lang_pred for r in nothing.collect()} == {"und"}


def test_small_table_runs(spark):
    assert op6_language_id(spark, SF_SMALL).count() == 200


def test_memory_for_long_texts():
    """A text of very many different n-grams, and many texts of one alphabet each, in bounded memory."""
    import tracemalloc

    from astrolabe.llm import language_id
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 100_000)))
    many = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 2040))) for _ in range(20)]
    bundler = language_id.Bundler()
    tracemalloc.start()
    for part in language_id._slices([long, *many]):
        bundles = bundler.bundles(*bundler.counts(part))
        assert len(bundles) == len(part) and np.abs(bundles).max() > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_blocks_of_ngrams_change_nothing(monkeypatch):
    from astrolabe.llm import language_id
    texts = ["one text of words", "zwei deutsche W\u00f6rter und mehr", None, "trois mots"]
    bundler = language_id.Bundler()
    counts, grams = bundler.counts(texts)
    whole = (counts @ bundler.matrix(grams)).astype(np.float64)
    monkeypatch.setattr(language_id, "GRAM_BLOCK", 7)
    assert np.array_equal(bundler.bundles(counts, grams), whole)
    monkeypatch.setattr(language_id, "COUNT_CELLS", 40)
    assert [t for part in language_id._slices(texts) for t in part] == texts
