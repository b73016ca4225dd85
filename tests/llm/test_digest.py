"""Digests: stated bounds, merging in any order, ties and missing values."""

import datetime

import numpy as np
import pytest

from tickloom.llm import digest as D

DAY = datetime.date(2024, 1, 2)
QS = (0.01, 0.05, 0.5, 0.95, 0.99)


def rank_error(values, estimate, q):
    lo, hi = (values < estimate).mean(), (values <= estimate).mean()
    return max(0.0, lo - q, q - hi)


SHAPES = {
    "normal": lambda r: r.normal(size=200_000), "heavy tail": lambda r: r.standard_cauchy(200_000), "ties": lambda r: r.integers(0, 7, 200_000) / 2, "few": lambda r: r.normal(size=7),
    "half tied": lambda r: np.where(r.random(200_000) < 0.5, 3.0, r.normal(size=200_000)), "orders of magnitude": lambda r: np.exp(r.normal(0, 8, 200_000)) * r.choice([-1, 1], 200_000), "one": lambda r: np.array([4.0]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("parts", [1, 17])
def test_bound_after_merging(shape, parts):
    rng = np.random.default_rng(5)
    values = SHAPES[shape](rng)
    made = [D.cluster(np.zeros(len(p), np.int64), p, np.ones(len(p), np.int64)) for p in np.array_split(rng.permutation(values), parts) if len(p)]
    _, mean, weight = D.cluster(*(np.concatenate(x) for x in zip(*made)))
    assert weight.sum() == len(values) and len(mean) <= D.SIZE * 2
    for q, e in zip(QS, D.quantile(mean, weight, QS)):
        assert rank_error(values, e, q) <= D.bound(q)


def test_groups_are_apart():
    code, mean, weight = D.cluster(np.array([1, 0, 1, 0]), np.array([5.0, 1.0, 5.0, 2.0]), np.ones(4, np.int64))
    assert code.tolist() == [0, 0, 1] and mean.tolist() == [1.0, 2.0, 5.0] and weight.tolist() == [1, 1, 2]


def test_percentiles_end_to_end(spark):
    rng = np.random.default_rng(2)
    rows = [("m", 1, DAY + datetime.timedelta(d), float(v)) for d in range(3) for v in rng.normal(d, 1, 2000)]
    rows += [("m", None, DAY, 1.0), ("m", 2, None, 4.0), ("m", 3, DAY, None), ("m", 3, DAY, float("nan")), ("k", 1, DAY, 9.0)]
    df = spark.createDataFrame(rows, "metric string, grp bigint, day date, value double")
    out = D.percentiles(df.selectExpr("*", "1 as n", "2 as q", "3 as means")).collect()
    assert all(r["rank_error"] <= r["bound"] for r in out)
    n = {(r["metric"], r["grp"], r["day"], r["over_days"]): r["n"] for r in out}
    assert n[("m", 1, None, True)] == 6000 and n[("m", 1, DAY, False)] == 2000 and n[("m", None, DAY, False)] == 1 and n[("m", 2, None, False)] == 1
    assert not any(k[1] == 3 for k in n)
    assert D.percentiles(df.limit(0)).count() == 0


def test_estimates_too_many_to_broadcast(spark, monkeypatch):
    rows = [("m", g, DAY, float(v)) for g in range(30) for v in range(20)]
    df = spark.createDataFrame(rows, "metric string, grp bigint, day date, value double")
    want = sorted(tuple(r) for r in D.percentiles(df).select("grp", "over_days", "p", "n", "below", "upto").collect())
    monkeypatch.setattr(D, "broadcast_checked", lambda x: x)
    assert sorted(tuple(r) for r in D.percentiles(df).select("grp", "over_days", "p", "n", "below", "upto").collect()) == want


def test_memory_does_not_grow_with_groups(spark):
    rng = np.random.default_rng(4)
    rows = [("m", g, DAY if g % 3 else None, float(v)) for g in range(200) for v in rng.normal(g, 1, 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame([("m", int(g), d, float(v)) for _, g, d, v in rows], "metric string, grp bigint, day date, value double")
    read = lambda d: sorted((r["grp"], r["n"], list(r["means"]), list(r["weights"])) for r in d.collect())
    assert read(D.digests(df, most=100)) == read(D.digests(df))
    assert read(D.digests(D.digests(df), most=100)) == read(D.digests(df))
