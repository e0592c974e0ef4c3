"""Multiprobe hashing: visiting order, recall against brute force, exact scores, odd rows."""

from itertools import combinations

import duckdb
import numpy as np
import pytest

from astrolabe.llm import ann
from astrolabe.llm.ann import Hashing, Index, op5_nearest_neighbours, probe_sets, search


def test_probe_sets_rise_in_cost_and_are_valid():
    m = 4
    sets = probe_sets(m, 30)
    assert sets[0] == [] and len({tuple(s) for s in sets}) == 30
    cost = [(r + 1) * (r + 2) / (4 * (m + 1) * (m + 2)) if r < m else
            1 - (2 * m - r) / (m + 1) + (2 * m - r) * (2 * m + 1 - r) / (4 * (m + 1) * (m + 2)) for r in range(2 * m)]
    every = sorted((sum(cost[r] for r in c), c) for n in range(m + 1) for c in combinations(range(2 * m), n)
                   if all(2 * m - 1 - r not in c for r in c))
    got = [sum(cost[r] for r in s) for s in sets]
    assert np.allclose(got, [c for c, _ in every[:30]])


def test_buckets_are_neighbours_of_the_own_one():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    longest = float(np.linalg.norm(x, axis=1).max())
    index = Index(x, np.arange(300), Hashing(8, longest))
    found = list(index.candidates(x, 1))
    assert all(i in f or np.linalg.norm(x[i]) < longest - 1e-6 for i, f in enumerate(found))
    wide = list(index.candidates(x, 40))
    assert all(set(a) <= set(b) for a, b in zip(found, wide))


def brute(ids, x, k=20, step=20):
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = (x * x[i]).sum(axis=1)
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -s[others]))[:k]]
        out[ids[i]] = [(ids[j], s[j]) for j in best]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    r = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchnumpy()
    ids, x = np.array(r["vec_id"]), np.array(r["embedding"].tolist()).astype(np.float64)
    want = brute(ids, x)
    got = {}
    for row in op5_nearest_neighbours(spark, sf).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    assert set(got) == set(want)
    hits = 0
    at = {v: k for k, v in enumerate(ids.tolist())}
    for q, rows in got.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, 21))
        assert all(abs(s - x[at[v]] @ x[at[q]]) < 1e-12 for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    recall = hits / (20 * len(want))
    print(recall)
    assert recall >= 0.9


def test_odd_rows_and_several_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 2)
    good = [(k, [float(k % 5 + 1), float(k % 3), 1.0], "x") for k in range(0, 60)]
    bad = [(100, None, "a"), (120, [], "b"), (140, [0.0, 0.0, 0.0], "c"), (160, [1.0, None, 2.0], None), (180, [float("nan"), 1.0, 1.0], ""),
           (200, [float("inf"), 1.0, 1.0], ""), (220, [1.0, 2.0], ""), (None, [1.0, 2.0, 3.0], ""), (20, [1.0, 2.0, 3.0], "again")]
    docs = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, cell string")
    got = {}
    for r in search(docs, docs.where("vec_id % 20 = 0"), k=5, probes=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    for q in (0, 40):
        v = np.array(good[q][1])
        rest = [(k, float(np.dot(w, v))) for k, w, _ in good if k != q]
        rest = [(k, max(s, float(np.dot([1.0, 2.0, 3.0], v))) if k == 20 else s) for k, s in rest]
        rest.sort(key=lambda t: (-t[1], t[0]))
        assert [(k, s) for _, k, s in sorted(got[q])] == rest[:5]
    assert search(docs.limit(0), docs, k=5).count() == 0
    assert search(docs, docs.limit(0), k=5).count() == 0
    assert search(docs.where("vec_id = 0"), docs.where("vec_id = 0")).count() == 0


def test_vectors_that_buckets_do_not_separate(spark, monkeypatch):
    """Where even all step sets miss the target, every row is a candidate and the answer is exact."""
    monkeypatch.setattr(ann, "WIDTH", 0.02)      # far too narrow buckets
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)) * rng.uniform(0.1, 9, 300)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(np.arange(300), x)
    assert {q: [v for _, v in sorted(rows)] for q, rows in got.items()} == {q: [v for v, _ in rows] for q, rows in want.items()}
