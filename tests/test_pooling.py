"""Summed token vectors: hashed ones against plain sums, trained ones with heavy and light tokens."""

from hashlib import md5

import numpy as np
import pytest

from astrolabe.operators import pooling

ITEMS = [(1, ["a", "b", "a", "c"]), (2, []), (3, None), (4, ["zz", None, "a"]), (5, ["hot"] * 700 + ["rare"]), (6, ["unknown"]), (7, ["hot", "b"])]


def items(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in ITEMS], "k long, tokens array<string>, vec string").repartition(3)


def plain(vector):
    return {k: sum((vector(t) for t in ts if t is not None), np.zeros(4)) for k, ts in ITEMS if ts and any(t is not None for t in ts)}


def test_hashed_draws(spark, monkeypatch):
    monkeypatch.setattr(pooling, "CELLS", 40)
    want = plain(lambda t: np.array([int(md5(f"7_dim{c}_{t}".encode()).hexdigest()[:8], 16) / 2 ** 32 - 0.5 for c in range(4)]))
    got = {r.k: r.vec for r in pooling.pool_hashed(items(spark), "k", "tokens", 4).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_hashed_in_many_dimensions(spark):
    """Components are spread evenly over +-0.5, and different tokens and components have nothing to do with each other."""
    df = spark.createDataFrame([(k, [f"t{k}"]) for k in range(400)], "k long, tokens array<string>")
    x = np.array([r.vec for r in pooling.pool_hashed(df, "k", "tokens", 300, draws=False).orderBy("k").collect()])
    assert x.shape == (400, 300) and abs(x.mean()) < 0.01 and abs(x.std() - 12 ** -0.5) < 0.01 and np.abs(x).max() <= 0.5
    assert np.abs(np.corrcoef(x) - np.eye(400)).max() < 0.35 and np.abs(np.corrcoef(x.T) - np.eye(300)).max() < 0.35
    both = pooling.pool_hashed(df.limit(0).unionByName(spark.createDataFrame([(1, ["t3", "t5", "t5"])], df.schema)), "k", "tokens", 300, draws=False).first()
    assert np.allclose(both.vec, x[3] + 2 * x[5])


@pytest.mark.parametrize("heavy_bytes", [32, 96, 1 << 20])
def test_trained_heavy_and_light(spark, heavy_bytes):
    rng = np.random.default_rng(2)
    table = {t: rng.normal(size=4) for t in ("a", "b", "c", "hot", "rare", "never")}
    want = plain(lambda t: table.get(t, np.zeros(4)))
    vectors = spark.createDataFrame([(t, v.tolist()) for t, v in table.items()], "token string, tvec array<double>")
    got = {r.k: r.vec for r in pooling.pool_trained(items(spark), "k", "tokens", vectors, "token", "tvec", 4, heavy_bytes=heavy_bytes).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_hashed_pooling_neither_joins_nor_shuffles(spark):
    plan = pooling.pool_hashed(items(spark), "k", "tokens", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_mixed_sums_with_kept_vectors_and_parts_of_rows(monkeypatch):
    """Rows that end within a buffer or are longer than one, frequent tokens and such that come once: plain sums of the vectors."""
    for name, value in {"STEP": 40, "COMMON": 5, "ENOUGH": 100}.items():
        monkeypatch.setattr(pooling, name, value)
    rng = np.random.default_rng(5)
    sizes = np.array([1, 3, 0, 250, 7, 1, 90, 39, 2])
    hashes = np.where(rng.random(sizes.sum()) < 0.5, rng.integers(0, 8, sizes.sum()), rng.integers(-2**63, 2**63 - 1, sizes.sum()))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    want = np.array([pooling._mixed(hashes[rows == r], 6, 42).sum(axis=0) for r in range(len(sizes))])
    mixer, out = pooling._Mixer(6, 42), np.zeros((len(sizes), 6))
    mixer.add(out, hashes.view(np.uint64), rows)
    assert len(mixer.common) == 5 and np.allclose(out, want, rtol=0, atol=1e-12)
    mixer.add(out, hashes[:0].view(np.uint64), rows[:0])
    mixer.add(out, hashes[:1].view(np.uint64), rows[:1])
    assert np.allclose(out[0], 2 * want[0], rtol=0, atol=1e-12) and np.allclose(out[1:], want[1:], rtol=0, atol=1e-12)


def test_hashed_sentences_are_split_once(spark):
    """The trigrams of words are hashed as those of the finished sentence, and the plan makes a text's words once."""
    from astrolabe.operators import text as X
    texts = ["One two, three", "", None, "...", "word", "a b a b a b", "Ünï cödé 12 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    words = df.select("k", X.token_sentence("text", radius=0).alias("tokens"))
    made = pooling.pool_hashed(words, "k", "tokens", 8, 42, draws=False, radius=1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert X.token_sentence("text", 1)._jc.toString().count("split(") == 1
    sentences = df.select("k", X.token_sentence("text", radius=1).alias("tokens"))
    for draws in (False, True):
        got, want = ({r.k: r.vec for r in pooling.pool_hashed(d, "k", "tokens", 8, 42, draws=draws, radius=r).collect()} for d, r in ((words, 1), (sentences, 0)))
        assert set(got) == set(want) == {0, 4, 5, 6} and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)
    assert [r.s for r in df.select("k", X.token_sentence("text", 1).alias("s")).orderBy("k").collect()][1:4] == [[], [], []]
