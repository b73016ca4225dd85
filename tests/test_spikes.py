"""Spikes, stuck values and impossible readings against a row-by-row check, with series split anywhere."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered, spikes

FIELDS = {"x": 5}


def plain(series, run_of=5, factor=12):
    """Positions flagged in one series of readings."""
    n, bad = len(series), set()
    lim = factor * median([abs(b - a) for a, b in zip(series, series[1:])]) if n > 1 else 0
    for size in (1, 2, 3):
        for a in range(1, n - size):
            before, after = series[a - 1], series[a + size]
            if all(abs(v - before) > lim and abs(v - after) > lim for v in series[a : a + size]):
                bad |= set(range(a, a + size))
    k = 0
    while k < n:
        j = k
        while j + 1 < n and series[j + 1] == series[k]:
            j += 1
        if j - k + 1 >= run_of:
            bad |= set(range(k + 1, j + 1))
        k = j + 1
    return bad | {k for k, v in enumerate(series) if v < 0}


def frame(spark, rows):
    return spark.createDataFrame(rows, "src string, t bigint, row_id bigint, x double")


def found(df):
    rows = spikes.readings(df, "tab", F.col("src"), F.col("t"), F.col("row_id"), ["x"])
    return sorted(r["row_id"] for r in spikes.judge(rows, FIELDS).collect())


def walk(rng, n):
    v, out = 100.0, []
    for _ in range(n):
        v += rng.choice([-0.5, -0.25, 0.25, 0.5])
        out.append(v)
    for _ in range(n // 25):
        a, size, jump = rng.randrange(1, n - 4), rng.randint(1, 3), rng.choice([-40, 30, 25.5])
        for k in range(a, a + size):
            out[k] += jump
    a = rng.randrange(0, n - 9)
    out[a : a + 8] = [out[a]] * 8
    out[n // 2 :] = [x + 50 for x in out[n // 2 :]]  # a move that stays
    out[rng.randrange(n)] = -1.0
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_check_in_many_partitions(spark, seed):
    rng, rows, want, rid = random.Random(seed), [], [], 0
    for src, n in (("hot", 400), ("b", 60), ("c", 45)):
        series = walk(rng, n)
        bad = plain(series)
        for k, v in enumerate(series):
            for _ in range(rng.choice([1, 1, 1, 3])):  # repeated rows are one reading
                rid += 1
                rows.append((src, k * 10, rid, v))
                if k in bad:
                    want.append(rid)
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert found(frame(spark, rows)) == sorted(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_tail_chooses_candidates(spark):
    rng, rows = random.Random(7), []
    for src in ("a", "b"):
        level = 1000.0
        for k in range(1500):
            level += rng.choice([-1, 1]) * rng.expovariate(1) ** 2  # heavy tails
            rows.append((src, k * 10, len(rows) + 1, level + (60 if k % 50 == 7 else 0)))
    series = spikes.readings(frame(spark, rows), "tab", F.col("src"), F.col("t"), F.col("row_id"), ["x"])
    got = {risk: spikes.candidates(series, FIELDS, risk).collect()[0] for risk in (0.05, spikes.RISK, 1e-12)}
    assert got[0.05]["n_candidates"] > got[spikes.RISK]["n_candidates"] > got[1e-12]["n_candidates"]
    assert got[0.05]["n_confirmed"] == got[spikes.RISK]["n_confirmed"] == got[spikes.RISK]["n_rule"] > got[1e-12]["n_confirmed"]
    kept = {risk: spikes.judge(series, FIELDS, risk).where("reason = 'spike'").count() for risk in (0.05, spikes.RISK, 1e-12)}
    assert kept[0.05] == kept[spikes.RISK] > kept[1e-12]


@pytest.mark.parametrize("chunk", [1, 50, 300])
def test_chunks_of_a_key(spark, monkeypatch, chunk):
    rng, rows = random.Random(chunk), []
    for src in ("a", "b"):
        for k, v in enumerate(walk(rng, 300)):
            rows += [(src, k * 10, len(rows) + j, v) for j in range(rng.choice([1, 1, 4]))]
    placed = spikes.readings(frame(spark, rows), "tab", F.col("src"), F.col("t"), F.col("row_id"), ["x"])

    def per(times, values, key):
        return {"away": spikes.departure(values), "is_stuck": spikes.stuck(values, 5)}

    spread = ordered.spread(placed)
    want, got = (sorted(tuple(r) for r in ordered.look(spread, 7, per, "away double, is_stuck boolean", size).collect()) for size in (ordered.CHUNK, chunk))
    assert got == want and len(got) == len(rows)


def test_missing_values_are_no_readings(spark):
    base = [("s", k, k, 10.0 + 0.25 * (k % 2)) for k in range(20)]
    extra = [("s", 100, 100, None), ("s", 101, 101, float("nan")), ("s", 102, 102, 0.0), (None, 5, 103, 10.0), ("s", None, 104, 10.0), (None, 5, 105, -3.0), ("s", None, 106, -3.0)]
    assert found(frame(spark, base + extra)) == [105, 106]


def test_extra_columns_do_not_clash(spark):
    rows = [("s", k, k, 10.0 + 0.25 * (k % 2) + (50 if k == 9 else 0)) for k in range(20)]
    assert found(frame(spark, rows).selectExpr("*", "1 as key", "2 as value", "3 as away", "4 as field", "5 as _sourced")) == [9]


def test_empty_short_and_constant(spark):
    assert found(frame(spark, [("s", 1, 1, 1.0)]).limit(0)) == []
    assert found(frame(spark, [("s", 1, 1, 1.0), ("s", 2, 2, 9.0)])) == []
    assert found(frame(spark, [("s", k, k, 7.0) for k in range(6)])) == [1, 2, 3, 4, 5]


def test_one_reading_held_by_many_rows(spark):
    rows = [("s", k, k, 10.0 + 0.25 * (k % 3)) for k in range(30)] + [("s", 30, 1000 + k, 99.0) for k in range(500)] + [("s", 31 + k, 2000 + k, 10.0 + 0.25 * (k % 3)) for k in range(30)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert found(frame(spark, rows)) == [1000 + k for k in range(500)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_percentiles(spark, seed):
    rng = np.random.default_rng(seed)
    data = {"a": rng.normal(size=3001), "big": rng.normal(size=20_001), "tied": rng.integers(0, 9, 20_000) / 2, "half": np.where(rng.random(20_000) < 0.5, 1.0, rng.normal(size=20_000)), "b": rng.integers(0, 5, 777).astype(float), "c": np.array([3.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    ps = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
    got = {r["k"]: r["q"] for r in ordered.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", ps).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert np.allclose(got[k], np.quantile(vs, ps))
