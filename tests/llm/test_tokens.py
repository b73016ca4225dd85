"""Token ids against the library and an exact round trip."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def table():
    return T.load()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(T.VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


TEXTS = [
    "", " ", "a", "\n\n  \n", "Hello  world's  \t end ", "naïve façade — “quoted”", "Καλημέρα κόσμε", "zażółć gęślą jaźń", "数字と漢字 123", "🙂🙃👨‍👩‍👧", "<|endoftext|> in a text", "a" * 5000, "ab" * 999 + " " * 300 + "x",
    "don't WE'LL they've 'S 's", "1234567890 3.14 1e-9", "\x00\x01\x7f", "x y z", "�​", "-" * 777, "http://www.example.com/?a=b&c=%20",
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_hand_made(table, library, k):
    ids, n = T.Words(table).encode([TEXTS[k]])
    assert ids.tolist() == library(TEXTS[k]) and n.tolist() == [len(ids)]


def test_random_texts_in_one_batch(table, library):
    rng = random.Random(7)
    alphabet = "aaaeeinstr  ETA.,'0159éßłżαωд字🙂\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [None]
    ids, n = T.Words(table).encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, x in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == (library(x) if x else [])


def test_forgetting_changes_nothing(table, library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBER", 3)
    w = T.Words(table)
    for x in ("one two three four five", "six seven one two", "one"):
        assert w.encode([x])[0].tolist() == library(x)


def bytes_of(t, token):
    stack, out = [int(token)], []
    while stack:
        x = stack.pop()
        if x < 256:
            out.append(x)
        else:
            stack += [int(t.right[x]), int(t.left[x])]
    return bytes(out)


def test_compatible_is_exact(table):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, table.size, 4000), rng.integers(0, table.size, 4000)
    a[:2000], b[:2000] = rng.integers(0, 900, 2000), rng.integers(0, 900, 2000)
    got = T.compatible(table, a, b)
    want = [T.merge(table, bytes_of(table, x) + bytes_of(table, y)) == [x, y] for x, y in zip(a, b)]
    assert got.tolist() == want and 0 < got.mean() < 1


def test_every_token_is_its_own_encoding(table):
    merged = np.arange(256, table.size)
    assert T.compatible(table, table.left[merged], table.right[merged], limit=merged).all()


def test_operator(spark, library):
    rows = [(1, "Hello there"), (2, None), (3, ""), (None, "x"), (1, "Hello there"), (4, "z" * 3000 + " long")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    out = sorted(((r["doc_id"], list(r["ids"])) for r in T.token_ids(df, F.col("doc_id"), F.col("text")).collect()), key=str)
    assert out == sorted(((i, library(x) if x else []) for i, x in rows), key=str)
    n = {r["doc_id"]: r["n_tokens"] for r in T.token_ids(df, F.col("doc_id"), F.col("text"), counts_only=True).collect()}
    assert n[2] == n[3] == 0 and n[1] == 2
    assert T.token_ids(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_slices_cover_everything(monkeypatch):
    monkeypatch.setattr(T, "SLICE_CHARS", 10)
    assert list(T._slices(["a" * 25, None, "", "b" * 4, "c" * 7, "d"])) == [(0, 1), (1, 5), (5, 6)]
