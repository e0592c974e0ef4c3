"""Quality classifier: features and updates against plain versions, held-out accuracy, odd rows."""

import zlib

import numpy as np

from astrolabe.llm import quality
from astrolabe.llm.quality import Hasher, ftrl, op7_quality_classifier, scorer, train


def test_shape():
    assert [quality.shape(w) for w in ("Word,", "ABC!!!", "a1b22", "%%%", "")] == ["Xx,", "X!!", "x9x9", "%%", ""]


def test_features_have_length_one_and_repeat():
    h = Hasher()
    index, value = h.features("the cat the cat THE dog!!")
    assert abs((value * value).sum() - 1) < 1e-12 and (np.diff(index) > 0).all()
    again, _ = Hasher().features("the cat the cat THE dog!!")
    assert np.array_equal(index, again)
    assert len(h.features(None)[0]) == len(h.features(" \n")[0]) == 0


def test_updates_are_the_plain_ones():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(16, 5, False)), rng.random(5), int(rng.random() < 0.6)) for _ in range(60)]
    good = sum(y for *_, y in rows)
    cw = {0: 60 / (2 * (60 - good)), 1: 60 / (2 * good)}
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == 16 else (quality.L1, quality.L2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + l2)
    for _ in range(quality.PASSES):
        for index, value, y in rows:
            x = {**dict(zip(index.tolist(), value.tolist())), 16: 1.0}
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            step = {i: (p - y) * v * cw[y] for i, v in x.items()}
            for i, g in step.items():
                w = weight(i)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w
                n[i] += g * g
    w, bias = ftrl(rows, bits=4)
    assert np.allclose(w, [weight(i) for i in range(16)]) and abs(bias - weight(16)) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7_quality_classifier(spark, sf).collect()
    assert len(rows) == 10_000 and {r.doc_id for r in rows if r.held_out} == {
        r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    right = np.mean([p == y for _, p, y in held])
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print(right, auc, len(held))
    assert right > 0.95 and auc > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(k, f"fine words number {k}" if k % 2 else "bad!! bad!! bad!!", "x") for k in range(40)]
    rows += [(100, None, "y"), (101, "", None), (None, "fine words", "z"), (None, "fine words", "z"), (102, "w " * 40000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(40)] + [(5, 1, None), (6, None, None), (None, 1, None)],
                                   "doc_id long, quality int, text string")
    model = train(docs, labels)
    got = docs.select("doc_id", scorer(*model)("text").alias("s")).collect()
    assert len(got) == 45 and all(0 <= r.s <= 1 for r in got)
    by = {r.doc_id: r.s for r in got}
    assert by[100] == by[101] and by[1] > by[0]
    for part in (labels.limit(0), labels.where("quality = 1")):
        index, weights, bias = train(docs, part)
        assert len(index) == len(weights) == 0 and bias >= 0
    assert docs.limit(0).select(scorer(*model)("text")).count() == 0


def test_bound_holds_for_the_rows(spark):
    """Two identifiers that most rows share: no more rows are learned from than the bound says, whatever the layout."""
    docs = spark.createDataFrame([(k % 2, f"words of text {k} and more {k * 7}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    few = [train(docs.repartition(n), labels, limit=10) for n in (1, 6)]
    assert np.array_equal(few[0][0], few[1][0]) and np.allclose(few[0][1], few[1][1])
    most = max(len(Hasher().features(f"words of text {k} and more {k * 7}")[0]) for k in range(200))
    assert 0 < len(few[0][0]) <= 10 * most
    assert len(train(docs, labels, limit=3000)[0]) > len(few[0][0])
