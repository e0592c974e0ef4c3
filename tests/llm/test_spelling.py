"""Spelling variants against a plain search; the index against all pairs; odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from astrolabe.llm import spelling
from astrolabe.llm.spelling import LONGER, SAME, SHORTER, BidirectionalIndex, op12_spelling_variants, variants, vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(rows, noise=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(u, w):
    if len(u) == len(w):
        return sum(a != b for a, b in zip(u, w)) == 1
    u, w = sorted((u, w), key=len)
    return len(w) == len(u) + 1 and any(w[:k] + w[k + 1:] == u for k in range(len(w)))


def plain_variants(counts):
    """Near words share what is left after one deletion; each such pair is compared in full."""
    left = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            left[w[:k] + w[k + 1:]].add(w)
        left[w].add(w)
    near = {w: {u for k in range(len(w)) for u in left[w[:k] + w[k + 1:]] | left[w] if u != w and is_near(u, w)} for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_index_finds_exactly_the_near_words():
    rng = random.Random(5)
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "aé", "abcdefg"])
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(7, 11))) for _ in range(rng.randrange(1, 60))})
        index = BidirectionalIndex(words)
        asked = words + ["zzzzzzz", "aaaaaaaz", "azaaaaaa"]
        lens = np.array([len(w) for w in asked])
        for step, kind in ((0, SAME), (-1, SHORTER), (1, LONGER)):
            exact = np.maximum(lens, lens + step) // 2
            who, found = index.one_error(asked, np.full(len(asked), kind), exact)
            got = sorted((asked[q], index.words[f]) for q, f in zip(who, found))
            assert got == sorted((u, w) for u, e in zip(asked, exact) for w in words if is_near(u, w) and len(w) == len(u) + step and u[:e] == w[:e])


def made(seed, letters, n, lengths=(7, 12)):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(*lengths)))
        words.add(w)
        k = rng.randrange(len(w))
        words |= {x for x in (w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]) if len(x) >= 7}
    return {w: rng.choice([2, 2, 3, 20, 30, 200, 2500]) for w in words}


@pytest.mark.parametrize("letters,n", [("abcdefgh", 1500), ("ab", 600), ("àéîü", 500)])
def test_variants_of_made_words(spark, letters, n):
    counts = made(7, letters, n)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(variants(words)) == plain_variants(counts)


def test_crowded_places_and_small_groups(spark, monkeypatch):
    """A third of the words share a beginning; places are cut into parts and slices, groups are small."""
    monkeypatch.setattr(spelling, "MOST_WORDS", 3)
    monkeypatch.setattr(spelling, "GROUP_WORDS", 64)
    counts = made(3, "abcd", 200) | {f"pre{w}": n for w, n in made(4, "xy", 60, (4, 9)).items() if len(w) >= 4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(variants(words)) == plain_variants(counts)


def test_chain_of_forms(spark):
    counts = {"aaaaaaaab"[:k] + "x" * (9 - k): 10 ** (9 - k) * 2 for k in range(9, 0, -1)} | {"solitary": 5, "tiebreak": 2, "tiebreaka": 20, "tiebreaks": 20}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = result(variants(words))
    assert got == plain_variants(counts)
    assert got["tiebreak"][0] == "tiebreaka" and len({v[1] for w, v in got.items() if w.startswith("a")}) == 1


def test_odd_rows(spark):
    long_word = "ab" * 3000 + "c"
    rows = [(1, None), (2, ""), (3, "1 2 3 ---"), (None, "Nameless nameless NAMELESS"), (4, "ÀÉÎaÀÉÎ àÉÎaÀÉÎ ÀÉÎaÀÉÎ"), (4, "ÀÉÎaÀÉÎ"), (4, "ÀÉÎaÀÉÎ"),
            (5, f"{long_word} {long_word} x{long_word} x{long_word}"), (6, "recieve1recieve receive " * 40), (7, "receive " * 900), (8, "short word ×÷ ſabcdefg ſabcdefg")]
    rows += [(k, "frequent spelling variants of frequently written words " * 3) for k in range(100, 180)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    counts = plain_vocabulary(rows)
    assert {r.word: r.n for r in vocabulary(docs).collect()} == counts
    assert result(variants(vocabulary(docs))) == plain_variants(counts)
    assert variants(vocabulary(docs.limit(0))).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = result(op12_spelling_variants(spark, sf))
    assert got == plain_variants(plain_vocabulary(rows)) and any(v[0] for v in got.values())
