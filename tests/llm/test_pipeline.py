"""The pipeline, stage by stage, against brute force."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from tests.conftest import SF_SMALL
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint

from astrolabe.llm.common import materialise
from astrolabe.llm.sentencepiece_bpe import default_model

SIZE = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialise(stage(spark, docs, SF_SMALL), "test-stage")
    return [[r.asDict() for r in d.collect()] for d in [*out, docs]]


def test_columns(spark, tables):
    for rows in tables[:5]:
        assert list(rows[0]) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage(tables):
    before, after = tables[0], tables[1]
    want = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(after, key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])


def test_exact_stage(tables):
    first = {}
    for r in sorted(tables[1], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    assert sorted(tables[2], key=lambda r: r["doc_id"]) == sorted(first.values(), key=lambda r: r["doc_id"])


def test_near_stage(tables):
    ids = [r["doc_id"] for r in tables[2]]
    groups = brute_components(ids, [brute_fingerprint(r["text"]) for r in tables[2]])
    assert sorted(r["doc_id"] for r in tables[3]) == sorted(set(groups.values()))


def test_mix_stage(tables):
    before, after = tables[3], tables[4]
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += SIZE(r["text"])
    target = plain_targets(sizes)
    taken, per_doc, text = Counter(), Counter(), {r["doc_id"]: r["text"] for r in before}
    for r in after:
        taken[r["source"]] += SIZE(r["text"])
        per_doc[r["doc_id"]] += SIZE(r["text"])
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert all(n <= 3 * SIZE(text[d]) for d, n in per_doc.items())


def test_token_stage(tables):
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = Counter()
    for r in tables[4]:
        ids = sp.encode(r["text"], add_eos=True)
        want[(r["doc_id"], r["lang"], r["source"], len(ids), tuple(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in tables[5])
    assert got == want


def test_run_is_the_stages_in_turn(spark, tables):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.count() == len(tables[5]) and sum(r.n_tokens for r in got.collect()) == sum(r["n_tokens"] for r in tables[5])


def test_hostile_rows_through_all_stages(spark):
    """Null and repeated identifiers, null, empty, letterless and very long texts, extra columns with clashing names; an empty table."""
    extra = ["id", "row", "range", "component_id", "shard", "position", "words", "fp", "size", "tie"]
    texts = [(1, "The quick brown fox runs over the lazy dog and sleeps in the sun all day. " * 4, "a"), (1, "Quite another text under the same number, with its own words in it. " * 3, "a"),
             (None, "A text without any number that stands alone in this table of documents. " * 3, "b"), (None, "Another text without any number, unlike the first in every word of it. " * 3, None),
             (2, None, "a"), (3, "", "b"), (4, " \t\n", None), (5, "1234 5678 %% --", "a"),
             (6, "The quick  brown fox runs over the lazy dog and sleeps in the sun all day. " * 4, "b"), (7, "w" * 30 + " long text of one word after the other " * 40_000, "c"),
             (8, "Das ist ein deutscher Satz mit einigen Wörtern darin und noch mehr davon. " * 3, "c"), (8, "Das ist ein deutscher Satz mit einigen Wörtern darin und noch mehr davon. " * 3, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    rows = [(i, t, "en", s, len(t or ""), *["x"] * len(extra)) for i, t, s in texts]
    for docs in (spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([], schema)):
        was = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            made = materialise(stage(spark, docs, SF_SMALL), "test-hostile")
            now = made.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == docs.columns
                assert all(r[c] == "x" for r in now for c in extra)
            if name in ("language ID", "exact dedup", "SimHash near-dedup"):
                assert len(now) <= was
                kept = {(r.doc_id, (r.text or "")[:9]) for r in now}
            if was and name == "SimHash near-dedup":
                assert kept == {(1, "The quick"), (1, "Quite ano"), (None, "A text wi"), (None, "Another t"), (7, "w" * 9), (8, "Das ist e")}
            docs, was = made, len(now)
        assert (was > 0) == bool(len(rows) and docs.count())
