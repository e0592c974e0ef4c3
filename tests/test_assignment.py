"""Greedy assignment against the plain walk; connected components."""

import numpy as np
import pytest

from astrolabe.operators import search
from astrolabe.operators.components import connected


def frames(spark, q, c):
    return (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, vec array<double>").repartition(3),
            spark.createDataFrame([(1000 + i, v.tolist(), int(o)) for i, (v, o) in enumerate(q)], "anchor_id long, vec array<double>, place int"))


def plain(q, c):
    taken, out = set(), {}
    for i in sorted(range(len(q)), key=lambda i: (q[i][1], i)):
        d = np.sqrt(((c - q[i][0]) ** 2).sum(axis=1))
        free = [k for k in np.lexsort((np.arange(len(c)), d)) if k not in taken]
        if free:
            taken.add(free[0])
            out[1000 + i] = free[0]
    return out


def result(df):
    rows = df.collect()
    assert sorted(r.step for r in rows) == list(range(1, len(rows) + 1))
    return {r.anchor_id: r.entry for r in rows}


@pytest.mark.parametrize("case", ["scattered", "many equal queries", "more queries than rows"])
def test_equals_the_walk(spark, case):
    rng = np.random.default_rng(len(case))
    c = rng.normal(size=(60 if case != "more queries than rows" else 9, 3))
    c[4] = c[3]
    q = [(rng.normal(size=3), rng.integers(0, 5)) for _ in range(14)]
    if case == "many equal queries":
        q = [(np.zeros(3), 40 - k) for k in range(40)] + q[:6] + [(np.full(3, 0.01), 7)] * 3
    cands, queries = frames(spark, q, c)
    got = result(search.greedy_assignment(cands, queries, query_order="place", first_k=2))
    assert got == plain(q, c)


def test_equal_queries_take_few_rounds_and_one_list(spark, monkeypatch):
    c = np.random.default_rng(1).normal(size=(700, 2))
    q = [(np.ones(2), 0)] * 500
    cands, queries = frames(spark, q, c)
    asked, real = [], search.knn_topk
    monkeypatch.setattr(search, "knn_topk", lambda a, b, k, **o: asked.append((b.count(), k)) or real(a, b, k, **o))
    got = result(search.greedy_assignment(cands, queries))
    assert got == plain(q, c) and asked == [(1, 512)]


def test_no_candidates_and_no_queries(spark):
    cands, queries = frames(spark, [(np.zeros(2), 0)] * 3, np.ones((4, 2)))
    assert search.greedy_assignment(cands.limit(0), queries).count() == 0
    assert search.greedy_assignment(cands, queries.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (201, 202), (203, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 0, **{k: 200 for k in (200, 201, 202, 203)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
