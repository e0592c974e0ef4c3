"""SimHash near-dedup against a brute-force version."""

import duckdb
import numpy as np
import xxhash

from astrolabe.llm import simhash
from astrolabe.llm.simhash import BKTree, fingerprint, near_duplicates

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, words=4):
    import re
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return {x: least[root(i)] for i, x in enumerate(ids) if x is not None}


def test_fingerprint_is_the_brute_force_one():
    for text in (None, "", " \t\n", "One", "A b C", "a b c d", "a  b\nc d e É Z", "x " * 70000, "Ñandú 你好 b c d"):
        assert fingerprint(text) == brute_fingerprint(text)


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64).tolist()
    values = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False)) for b in base for _ in range(10)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[::7]:
        assert sorted(tree.within(q, 4)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 4]


def test_documents_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    got = near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.id: r.fp & (2**64 - 1) for r in got} == {i: f for (i, _), f in zip(rows, fps)}
    assert {r.id: r.component_id for r in got} == want and len(got) == len(rows)


def test_edges_split_shards_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    rng = np.random.default_rng(1)
    center, far = 0x0F0F1234ABCD5678, 0x7123456789ABCDEF
    fps = [center ^ sum(1 << int(k) for k in rng.choice(64, 2, False)) for _ in range(200)]
    chain = [far ^ ((1 << k) - 1) for k in range(0, 64, 4)]  # each 4 bits from the next: one long chain
    lone = [int(x) for x in rng.integers(0, 2**63, 50)]
    all_fps = list(dict.fromkeys(fps + chain + lone))
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in all_fps], "fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(frame)).collect()}
    label = {f: roots.get(f - 2**64 if f >> 63 else f, f - 2**64 if f >> 63 else f) for f in all_fps}
    want = brute_components(list(range(len(all_fps))), all_fps)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups({i: label[f] for i, f in enumerate(all_fps)}) == groups(want)


def test_hostile_rows(spark):
    rows = [(3, None, "x"), (1, "", "y"), (None, "  ", "z"), (7, "alpha beta", None), (7, "alpha beta", None),
            (9, "word " * 50000, "q"), (None, "solo text of its own kind here", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((str(r.id), str(r.component_id)) for r in near_duplicates(docs).collect())
    assert got == sorted([("3", "1"), ("1", "1"), ("None", "1"), ("7", "7"), ("7", "7"), ("9", "9"), ("None", "None")])
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "7", "9", "None"]
    assert [r.component_id for r in kept.where("doc_id IS NULL").collect()] == ["w"]


def test_dedup_keeps_the_same_rows_on_any_layout(spark):
    rows = [(None, "one text without any number", f"src{k}") for k in range(40)] + [(3, "another text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {tuple(sorted(r.source for r in simhash.dedup(docs.repartition(n, *by)).collect())) for n, by in ((1, ()), (7, ()), (5, ("source",)))}
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_dedup_goes_by_row_not_by_identifier_alone(spark):
    one, two = "one text of many words " * 40, "quite another matter altogether in this place " * 40
    rows = [(5, one, "a"), (None, one, "b"), (None, "solo text of its own kind here", "c"), (2, two, "d"), (5, two, "e"),
            (None, "no number anywhere", "f"), (None, "No  number anywhere", "g"), (None, "no number anywhere", "f"), (8, "last of all the rows", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.dedup(docs)
    got = sorted(r.component_id for r in kept.collect())
    assert [x for x in got if x not in "fg"] == ["a", "c", "d", "h"] and len([x for x in got if x in "fg"]) == 1
    assert kept.columns == docs.columns
    # every group keeps a row, whatever identifiers its members share with other groups
    fps = {brute_fingerprint(r.text) for r in kept.collect()}
    assert fps == {brute_fingerprint(t) for _, t, _ in rows}
