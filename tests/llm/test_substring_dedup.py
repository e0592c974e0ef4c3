"""Substring dedup against a plain loop over windows; the sketch never underestimates."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from astrolabe.llm import substring_dedup
from astrolabe.llm.substring_dedup import _count_anchors, _merge_block, dedup, op13_substring_dedup, window_hashes, without_repeats


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, window=50):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k:k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def planted(seed, n=60):
    rng = random.Random(seed)
    made = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    passages = [made(k) for k in (49, 50, 51, 60, 75, 120, 30, 26)]
    rows = []
    for i in range(n):
        text = made(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 4)):
            text += rng.choice(passages) + made(rng.randrange(0, 40))
        rows.append((rng.randrange(n), " ".join(text)))
    return rows + rng.sample(rows, 8)


def test_planted_passages(spark):
    for seed in (1, 2):
        rows = planted(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert result(without_repeats(docs)) == brute(rows)


def test_odd_rows_and_clashing_columns(spark):
    run = [f"p{k}" for k in range(60)]
    rows = [(5, None), (3, ""), (4, " \t\n"), (None, " ".join(run)), (7, "  ".join(run)), (7, "\n".join(run)), (9, "x " + " ".join(run)), (9, "x " + " ".join(run)),
            (11, " ".join(run[:49])), (12, " ".join(run[10:])), (-2, " ".join(run[20:])), (13, "same " * 400), (15, "same " * 60), (16, "same " * 49),
            (20, " ".join(f"u{k % 977}" for k in range(300_000))), (21, " ".join(f"u{k % 977}" for k in range(500, 2_000)) + " end")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, id int, spans string").repartition(3)
    assert result(without_repeats(docs)) == brute(rows)
    kept = dedup(docs)
    assert kept.columns == docs.columns
    assert {r.text for r in kept.collect() if r.doc_id in (5, 16)} == {None, "same " * 49}
    assert without_repeats(docs.limit(0)).count() == 0 and dedup(docs.limit(0)).count() == 0


def test_short_windows_and_heavy_anchors(spark, monkeypatch):
    """Other window sizes; every anchor heavy, several groups, and tasks that settle little by little."""
    monkeypatch.setattr(substring_dedup, "HEAVY_LEAST", 2)
    monkeypatch.setattr(substring_dedup, "HEAVY_SHARE", 1 << 40)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 2000)
    rows = planted(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window, gram in ((50, 25), (7, 3), (8, 8), (1, 1)):
        assert result(without_repeats(docs, window=window, gram=gram)) == brute(rows, window)


def test_one_passage_in_most_documents(spark):
    run = " ".join(f"hot{k}" for k in range(55))
    rows = [(k, f"a{k} {run} b{k} c{k % 7}" if k % 3 else f"own text {k}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(without_repeats(docs)) == brute(rows)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 1 << 62, 4000, dtype=np.int64)
    docs = [flat[a:a + 300] for a in rng.integers(0, 3700, 40)]
    batch = pa.RecordBatch.from_pydict({"words": pa.array([d.tolist() for d in docs], pa.list_(pa.int64()))})
    sketch = substring_dedup.Sketch(1 << 20)
    pieces = list(_count_anchors([batch.slice(0, 15), batch.slice(15)], cells=1 << 20, window=50, gram=25))
    for line in range(substring_dedup.ROWS):
        own = pa.Table.from_batches([p for p in pieces if p.column("line")[0].as_py() == line])
        sketch.bits[line] = np.frombuffer(_merge_block(own, 5).column("bits")[0].as_py(), dtype=np.uint8)
    ends = np.cumsum([len(d) for d in docs])
    _, doc, anchors, hashes = window_hashes(np.concatenate(docs).view(np.uint64), ends, 50, 25)
    seen = {}
    for d, h in zip(doc.tolist(), hashes.tolist()):
        seen.setdefault(h, set()).add(d)
    several = np.array([len(seen[h]) > 1 for h in hashes.tolist()])
    repeated, _ = sketch.lookup(anchors)
    assert several.any() and repeated[several].all() and not repeated.all()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op13_substring_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(want)
