"""Nearest in time against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import nearest as N

L, R = "row_id bigint, e string, t bigint", "snap_id bigint, e string, t bigint, v double"


def match(spark, left, right, tol=50, **how):
    a, b = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    out = N.nearest_in_time(a, b, entity=(F.col("e"), F.col("e")), time=(F.col("t"), F.col("t")), ident=(F.col("row_id"), F.col("snap_id")), tolerance_ns=tol, values={"v": F.col("v")}, **how)
    return sorted((tuple(r) for r in out.select("left_id", "right_id", "distance_ns", "v").collect()), key=str)


def brute(left, right, tol=50):
    out = []
    for i, e, t in left:
        near = [(abs(t - u), u, s, v) for s, f, u, v in right if f == e and e is not None and t is not None and u is not None and abs(t - u) <= tol]
        if near:
            d, _, s, v = min(near, key=lambda x: x[:3])
            out.append((i, s, d, v))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_with_ties_nulls_and_shard_edges(spark, seed, monkeypatch):
    rng = random.Random(seed)
    entities = ["a", "a", "b", None]
    left = [(1000 + k, rng.choice(entities), rng.choice([None, *[rng.randint(-300, 2000)] * 9])) for k in range(500)]
    right = [(k, rng.choice(entities), rng.choice([None, *[rng.randint(-300, 2000)] * 9]), float(k)) for k in range(300)]
    right += [(400 + k, "a", 100 * k, 1.0) for k in range(10)] + [(500 + k, "a", 100 * k, 2.0) for k in range(10)]
    assert match(spark, left, right, shard_ns=128) == brute(left, right)
    monkeypatch.setattr(N, "HOT_ROWS", 5)
    monkeypatch.setattr(N, "HOT_SHARDS", 10)
    assert match(spark, left, right, shard_ns=400) == brute(left, right)


def test_bounds_and_ties(spark):
    assert match(spark, [(9, "a", 100)], [(1, "a", 50, 1.0), (2, "a", 150, 2.0)]) == [(9, 1, 50, 1.0)]
    assert match(spark, [(9, "a", 100)], [(1, "a", 49, 1.0), (2, "a", 151, 2.0)]) == []
    assert match(spark, [(9, "a", 100), (9, "a", 100)], [(3, "a", 100, 1.0), (2, "a", 100, 2.0)]) == [(9, 2, 0, 2.0)] * 2


def test_times_that_need_all_bits(spark):
    t = 1_515_418_147_000_000_001
    assert match(spark, [(9, "a", t)], [(1, "a", t - 3, 1.0), (2, "a", t + 2, 2.0)]) == [(9, 2, 2, 2.0)]


def test_empty_unmatched_and_clashing_columns(spark):
    assert match(spark, [], [(1, "a", 1, 1.0)]) == [] and match(spark, [(1, "a", 1)], []) == []
    got = match(spark, [(1, "a", 1), (2, "a", None), (3, "z", 5)], [(7, "a", 2, None)], keep_unmatched=True)
    assert got == [(1, 7, 1, None), (2, None, None, None), (3, None, None, None)]
    a = spark.createDataFrame([(1, "a", 5, 1, 2)], "row_id bigint, e string, t bigint, b int, asks int")
    b = spark.createDataFrame([(2, "a", 6, 1.0, 3)], "snap_id bigint, e string, t bigint, v0 double, r int")
    out = N.nearest_in_time(a, b, entity=(a.e, b.e), time=(a.t, b.t), ident=(a.row_id, b.snap_id), tolerance_ns=9, values={"v0": b.v0})
    assert [tuple(r) for r in out.select("left_id", "right_id", "v0").collect()] == [(1, 2, 1.0)]


@pytest.mark.parametrize("kind", ["even", "bursts", "one", "two", "powers"])
def test_index_bound(kind):
    rng = np.random.default_rng(1)
    keys = {"even": np.arange(0, 10_000, 7), "bursts": np.unique(np.concatenate([rng.integers(b, b + 50, 400) for b in (0, 10**12, 10**15)])), "one": np.array([5]), "two": np.array([5, 10**17]), "powers": 2 ** np.arange(0, 60)}[kind].astype(np.int64)
    index = N.LearnedIndex(keys)
    q = np.unique(np.concatenate([keys, keys - 1, keys + 1, rng.integers(-5, keys.max() + 9, 500)]))
    assert (index.below(q) == np.searchsorted(keys, q, side="right")).all()


def test_crowded_times_get_narrow_shards(spark, monkeypatch):
    rng = random.Random(8)
    left = [(1000 + k, "a", rng.randint(0, 5000)) for k in range(300)]
    right = [(k, "a", rng.randint(0, 5000), float(k)) for k in range(300)]
    monkeypatch.setattr(N, "INDEX_ROWS", 20)
    assert match(spark, left, right, tol=20, shard_ns=1 << 20) == brute(left, right, tol=20)
