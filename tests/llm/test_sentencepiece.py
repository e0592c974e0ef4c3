"""The prefix table against the sentencepiece library itself."""

import hashlib
import random

import duckdb
import pytest
import sentencepiece

from astrolabe.llm.sentencepiece_bpe import default_model, digest_documents, encode_documents, prefix_table

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "a", "  a ", " " * 11, " " * 28 + "x", "\n\n a\n", "a▁b", "\x00\x01", "Hello  world\n é 你好 😀", "<s></s><0x41>",
        "aaa" * 50, "the" * 99, "x" * 3000, "=" * 77, "\t \t", "ıİſ́", "­​﻿", "%%%&&&***###$$$", " " * 5000, "日本語日本語" * 20]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def table():
    return prefix_table(default_model())


def same(sp, table, text):
    ids = sp.encode(text, add_eos=True)
    assert table.encode(text) == ids
    assert table.decode(ids) == sp.decode(ids)
    n, ids_sha, decoded_sha = table.digest(text)
    assert n == len(ids) and ids_sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert decoded_sha == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_hard_texts(sp, table):
    for text in HARD:
        same(sp, table, text)
    for n in range(1, 70):
        same(sp, table, " " * n)
        same(sp, table, "a" + " " * n + "b\n" + " " * n)


def test_random_texts(sp, table):
    rng = random.Random(3)
    alphabets = ["ab", "aeinrst ", "abcdefghijklmnopqrstuvwxyz  ", "éèêçàñü eau", "01289.,;: ", "(){}[]=+-*/<>\n\t ", "你好世界的一是 a", "АБвгд е"]
    for k in range(4000):
        letters = alphabets[k % len(alphabets)]
        same(sp, table, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))


def test_concatenated_pieces(sp, table):
    rng = random.Random(4)
    pieces = [p.replace("▁", " ") for p in table.ids]
    for _ in range(4000):
        same(sp, table, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))))


def test_documents_table(spark, sp):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.id: r for r in digest_documents(docs).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = sp.encode(text or "", add_eos=True)
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_hostile_rows(spark, sp):
    rows = [(1, None, "a"), (None, "", "b"), (2, "tie", None), (2, "tie", None), (3, "y" * 200_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.id, list(r.ids), r.decoded) for r in encode_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, sp.encode(t or "", add_eos=True), t or "") for i, t, _ in rows), key=str)
    assert encode_documents(docs.limit(0)).count() == 0 and digest_documents(docs.limit(0)).count() == 0
