"""Filter audit against a plain loop over documents and orders, on odd rows."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from astrolabe.llm.filter_audit import ALL, FAIL, PASS, audit, contract


def fails(i, text, least):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if i is not None and i > least[text]:
        out.add("E")
    return out


def brute(docs, labels):
    """``docs``: (id, text, source); ``labels``: (id, quality, toxic)."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    rows = [(s, fails(i, t, least), i in good, i in toxic) for i, t, s in docs]
    out, shapley = {}, defaultdict(int)
    for part in {s for s, *_ in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                out[part, order, k + 1] = [len(left), len(gone), sum(f in r[0] for r in own) - len(gone), sum(r[0] == {f} for r in own),
                                           sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


LONG = " ".join(f"w{k}" for k in range(250))
DOCS = [(5, None, "x"), (3, "", "y"), (None, "", "x"), (7, LONG, "x"), (9, LONG, None), (9, LONG, None), (2, LONG + "\n", ""),
        (11, "same " * 300, "x"), (12, "same " * 300, "x"), (None, "same " * 300, "x"), (13, LONG + " A" * 40, "z"), (14, LONG + " #", "z"),
        (15, "# A " * 150, "z"), (15, "# A " * 150, "z"), (16, "Ä\U0001f600 " * 250, "z"), (17, "x " * 1_000_000, "z"), (1, "  \t", "q")]
LABELS = [(5, 1, 0), (5, 0, 1), (9, 1, None), (11, None, 1), (12, 1, 1), (12, 1, 1), (None, 1, 1), (15, 1, 0), (99, 1, 1)]


def frames(spark, docs=DOCS, labels=LABELS):
    return (spark.createDataFrame([(*d, "k", 0) for d in docs], "doc_id long, text string, source string, part string, cell int").repartition(5),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_odd_rows_and_clashing_columns(spark):
    got, want = result(audit(*frames(spark))), brute(DOCS, LABELS)
    assert len(got) == 600 * 5 and got == want


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert audit(docs.limit(0), labels).count() == 0
    assert result(audit(docs, labels.limit(0))) == brute(DOCS, [])


def test_one_text_in_most_rows(spark):
    """A text that most documents share stays one row per part before identifiers are compared."""
    docs = [(k, "hot text of the table" if k % 3 else f"text {k} A", f"s{k % 4}") for k in range(2000, 0, -1)]
    assert result(audit(*frames(spark, docs, LABELS))) == brute(docs, LABELS)


def test_contraction_picks_axes():
    tensors = np.arange(64).reshape(2, 2, 2, 2, 2, 2)
    selectors = [np.array([k], dtype=np.int64) for k in (PASS, FAIL, ALL, ALL, PASS)]
    assert contract(tensors, selectors)[:, 0].tolist() == [t[0, 1, :, :, 0].sum() for t in tensors]
