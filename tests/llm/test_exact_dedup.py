"""Content sort against brute force: all tables, groups over many ranges, odd rows."""

import hashlib
import re

from astrolabe.llm.exact_dedup import _spans, content_sort, dedup

SF = "/root/testdata/sf0.001"


def brute(rows):
    """``rows``: (id, text); one result per row: id, keep, size, kept, digest."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(((i is None, i or 0, k), i))
    out = []
    for text, members in groups.items():
        members.sort()
        out += [(i, members[0][1], len(members), n == 0, hashlib.sha256(text.encode()).hexdigest()) for n, (_, i) in enumerate(members)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(content_sort(docs)) == want
    assert sorted(r.doc_id for r in dedup(docs).collect()) == sorted(i for i, _, _, kept, _ in want if kept)


def test_groups_over_many_ranges(spark):
    """Two texts hold most rows; with 64 ranges each spans many, and its rows meet again."""
    rows = [(k, "hot  text" if k % 2 else "hot text") for k in range(600)] + [(k, "other hot") for k in range(600, 900)]
    rows += [(k, f"text {k % 150}") for k in range(900, 1200)] + [(k, "hot text" + "x" * (k % 3)) for k in range(1200, 1260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = content_sort(docs, ranges=64)
    assert result(got) == brute(rows)
    assert sorted(r.doc_id for r in dedup(docs, ranges=64).collect()) == sorted(i for i, _, _, kept, _ in brute(rows) if kept)


def test_same_prefix_differs_late(spark):
    rows = [(k, "same beginning of many words " * 20 + str(k // 2)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(content_sort(docs, ranges=16)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (4, " \t", "c"), (6, " ", "c"), (None, "solo", "d"), (None, "twin", "e"), (None, "twin", "f"), (9, "twin2", "g"),
            (None, "twin2", "h"), (1, "dup", None), (1, "dup", None), (-7, "neg", "i"), (8, "neg", "j"), (2, "z " * 200_000, "k"), (7, "z\n" * 200_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string")
    assert result(content_sort(docs)) == brute([(i, t) for i, t, _ in rows])
    kept = dedup(docs, ranges=8)
    assert kept.columns == docs.columns
    got = sorted(str((r.doc_id, (r.text or "")[:6])) for r in kept.collect())
    want = sorted(str(x) for x in [(3, ""), (4, " \t"), (None, "solo"), (None, "twin"), (9, "twin2"), (1, "dup"), (-7, "neg"), (2, "z z z ")])
    assert got == want
    for empty in (content_sort(docs.limit(0)), dedup(docs.limit(0))):
        assert empty.count() == 0


def test_string_identifiers(spark):
    rows = [("b", "x y"), ("a", "x  y"), ("c", "w")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.id: r.keep_id for r in content_sort(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_spans_need_equal_edge_texts(spark):
    """Neighbouring ranges whose edge texts differ don't join, even with equal digests."""
    rows = [(0, 1, "same", True, True, 3, 2), (1, 1, "same!", True, True, 1, 1), (2, 1, "same!", True, True, 9, 4)]
    runs = spark.createDataFrame(rows, "range int, run long, edge string, first boolean, last boolean, run_min long, run_size long")
    got = sorted((r.range, r.span_min, r.span_size, r.span_here) for r in _spans(runs).collect())
    assert got == [(1, 1, 5, True), (2, 1, 5, False)]
