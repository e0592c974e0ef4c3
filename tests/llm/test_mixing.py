"""Mixing: targets, tree and pieces against plain versions; odd rows."""

import re
from collections import Counter, defaultdict

from astrolabe.llm.mixing import _split_tree, mix, mixed_documents, op9_mix_sources, shares

SF = "/root/testdata/sf0.01"
SIZE = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what exceeds ``most`` times a source is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        over = {s: most * sizes[s] for s in names if s not in capped and weight[s] * rest / w > most * sizes[s] + 1e-9}
        if not over:
            return {s: capped.get(s, weight[s] * rest / w if w else 0) for s in names}
        capped |= over


def check(docs_rows, rows, pieces):
    """``docs_rows``: (id, text, source)."""
    sizes = Counter()
    for _, t, s in docs_rows:
        sizes[s] += SIZE(t)
    target = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert len(rows) == len(docs_rows)
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and r.source_size == sizes[r.source]
    size = {(r.source, r.grp, r.place): r.size for r in rows}
    assert len(size) == len(rows)
    taken, by_row = Counter(), Counter()
    for p in pieces:
        taken[p.source] += p.words
        by_row[(p.source, p.grp, p.place)] += p.words
        assert 0 < p.words <= size[(p.source, p.grp, p.place)] and 0 <= p["pass"] < 3
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert all(n <= 3 * size[k] for k, n in by_row.items())
    return target


def test_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, pieces = mix(docs, shards=16)
    rows, pieces = rows.collect(), pieces.collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], rows, pieces)
    home = {}
    for p in pieces:  # a block has one shard; each shard's places are 1 .. n
        assert home.setdefault((p.source, p.block), p.shard) == p.shard
    place = defaultdict(list)
    for p in pieces:
        place[p.shard].append(p.position)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in place.values()) and len(place) == 16
    again = {(p.source, p.grp, p.place, p["pass"], p.words, p.shard) for p in mix(docs, shards=16)[1].collect()}
    assert again == {(p.source, p.grp, p.place, p["pass"], p.words, p.shard) for p in pieces}


def test_capped_sources(spark):
    rows = [(k, "w " * 10, "a") for k in range(2)] + [(100 + k, "w " * 10, "b") for k in range(50)] + [(300, "w", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r, p = mix(docs, shards=4)
    target = check(rows, r.collect(), p.collect())
    assert target["a"] == 60 and target["c"] == 3 and abs(sum(target.values()) - 521) < 1e-9


def test_tree_splits_quotas_exactly_and_evenly(spark):
    quotas = {1: 700, 2: 0, 3: 250, 4: 51}
    leaves = _split_tree(spark.createDataFrame(list(quotas.items()), "no int, blocks long"), 128, 9).collect()
    per_source, per_shard = Counter(), Counter()
    for x in leaves:
        assert x.blocks >= 0
        per_source[x.no] += x.blocks
        per_shard[x.shard] += x.blocks
    assert {k: per_source[k] for k in quotas} == quotas
    assert len(per_shard) == 128 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_tree_draws_like_a_hypergeometric(spark):
    import numpy as np
    counts = []
    for seed in range(150):  # the first split of 30 + 10 blocks: how many of the 10 go left
        leaves = _split_tree(spark.createDataFrame([(1, 30), (2, 10)], "no int, blocks long"), 2, seed)
        counts.append(leaves)
    whole = counts[0].withColumnRenamed("shard", "s")
    for c in counts[1:]:
        whole = whole.union(c.withColumnRenamed("shard", "s"))
    left = [x.blocks for x in whole.where("no = 2 AND s = 0").collect()]
    assert len(left) == 150
    mean, var = 5.0, 20 * (10 / 40) * (30 / 40) * (20 / 39)
    assert abs(np.mean(left) - mean) < 4 * (var / 150) ** 0.5 and 0.6 * var < np.var(left) < 1.5 * var


def test_odd_rows(spark):
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "x"), (2, None, "s", None), (None, "d e", None, "y"), (None, "d e", None, "y"), (3, "", None, "z"),
            (4, "long " * 30_000, "t", "w"), (5, " \t\n", "u", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words string")
    r, p = mix(docs, shards=4)
    check([(i, t, s) for i, t, s, _ in rows], r.collect(), p.collect())
    out = mixed_documents(docs, shards=4)
    assert out.columns == docs.columns
    got = Counter()
    for x in out.collect():
        got[x.source] += SIZE(x.text)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += SIZE(t)
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) <= 0.5 for s in want)
    empty = docs.limit(0)
    r, p = mix(empty, shards=4)
    assert r.count() == 0 and p.count() == 0 and mixed_documents(empty).count() == 0


def test_result_follows_the_tree(spark):
    """The shards of the result hold, source by source, as many blocks as the splitting tree's leaves give them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, pieces = mix(docs, shards=8)
    rows, pieces = rows.collect(), pieces.collect()
    block = -(-sum({r.source: r.source_size for r in rows}.values()) // (64 * 8))
    quota = {r.source: -(-round(r.target) // block) for r in rows}
    no = {s: k + 1 for k, s in enumerate(sorted(quota, key=lambda s: (s is None, s or "")))}
    leaves = {(x.no, x.shard): x.blocks for x in _split_tree(spark.createDataFrame([(no[s], q) for s, q in quota.items()], "no int, blocks long"), 8, 1).collect()}
    home = {(p.source, p.block): p.shard for p in pieces}
    held = Counter((no[s], shard) for (s, _), shard in home.items())
    assert all(held[k] <= leaves[k] for k in held)      # a block in which no document starts has no rows
    full = [s for s in quota if all((s, b) in home for b in range(quota[s]))]
    assert full and all(held[no[s], k] == leaves[no[s], k] for s in full for k in range(8))
    got = {r.doc_id: r for r in shares(docs, shards=8).collect()}
    went = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p["pass"]):
        went[p.id].append((p.shard, p.position))
    assert all(list(zip(r.shards, r.positions)) == went[i] for i, r in got.items())
    assert all((r.taken > 0) == bool(r.shards) for r in got.values())


def test_shards_are_written_in_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = mixed_documents(docs, shards=8, by_shard=True)
    assert made.columns == [*docs.columns, "mix_shard", "mix_position"]
    made.write.parquet(str(tmp_path / "mix"))
    rows = [r for part in spark.read.parquet(str(tmp_path / "mix")).select("mix_shard", "mix_position").rdd.glom().collect() for r in part]
    seen = defaultdict(list)
    for r in rows:
        seen[r.mix_shard].append(r.mix_position)
    assert len(seen) == 8 and all(v == list(range(1, len(v) + 1)) for v in seen.values())
    assert {r.shards[0] for r in op9_mix_sources(spark, "/root/testdata/sf0.001").collect() if r.shards} <= set(range(64))


def test_rows_without_identifier_are_spread(spark):
    rows = [(None, f"text {k} of its own", "s") for k in range(400)]
    r, _ = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=2)
    assert r.select("grp").distinct().count() > 300
