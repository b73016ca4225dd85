"""Windows, look-ups and weighted statistics against plain recounts on tie-heavy rows."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ewm as W
from tickloom.operators import models as ML
from tickloom.operators import simulator as SM
from tickloom.operators import temporal as T


def rows(spark, seed=1, n=300):
    rng = random.Random(seed)
    pdf = pd.DataFrame({"g": [rng.choice("ab") for _ in range(n)], "t": [rng.randint(0, 120) for _ in range(n)], "p": range(n), "x": [float(rng.randint(0, 9)) for _ in range(n)]})
    return spark.createDataFrame(pdf), pdf


def test_window_deltas(spark):
    df, pdf = rows(spark)
    df = T.positioned(df, ["g"], "t", "p")
    from pyspark.sql import Window

    df = df.withColumn("cum", F.sum("x").over(Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    got = T.as_of_window_start(df, ["g"], "t", "r", ["cum"], [7]).select("p", T.delta("cum", 7).alias("s"), T.delta("r", 7).alias("n")).toPandas().set_index("p")
    for _, g in pdf.groupby("g"):
        g = g.sort_values(["t", "p"])
        ts, xs = g.t.to_numpy(), g.x.to_numpy()
        lb = np.searchsorted(ts, ts - 7)
        want = [xs[lo : k + 1].sum() for k, lo in enumerate(lb)]
        assert got.loc[g.p].s.tolist() == want and got.loc[g.p].n.tolist() == (np.arange(len(g)) + 1 - lb).tolist()


@pytest.mark.parametrize("shard", [7, 40, T.SHARD_NS])
def test_forward_backward_excursion(spark, shard):
    df, pdf = rows(spark, 2)
    df = T.positioned(df, ["g"], "t", "p")
    f = T.forward(df, ["g"], "t", "r", ["x"], 5, "f").select("p", F.col("f.x").alias("f")).toPandas().set_index("p")
    e = T.excursion(df, ["g"], "t", "r", "x", 5).select("p", "fwd_max", "fwd_min").toPandas().set_index("p")
    b = T.backward(df.select("g", "t", "p"), df.where("p % 3 = 0").select("g", "t", "p", "x"), ["g"], "t", "p", ["x"], shard_ns=shard).toPandas().set_index("p")
    a = T.first_after(df.select("g", "t", "p"), df.select("g", "t", "p", "x"), ["g"], "t", "p", ["x"], 5, shard_ns=shard).toPandas().set_index("p")
    nan = lambda v: None if v != v else v
    for _, g in pdf.groupby("g"):
        g = g.sort_values(["t", "p"])
        ts, xs, ps = g.t.to_numpy(), g.x.to_numpy(), g.p.to_numpy()
        for k in range(len(g)):
            at = np.searchsorted(ts, ts[k] + 5)
            assert nan(f.f[ps[k]]) == (xs[at] if at < len(ts) else None)
            assert nan(a.x[ps[k]]) == (xs[at] if at < len(ts) else None)
            later = xs[k + 1 : at]
            assert nan(e.fwd_max[ps[k]]) == (later.max() if len(later) else None) and nan(e.fwd_min[ps[k]]) == (later.min() if len(later) else None)
            back = [(ts[j], ps[j], xs[j]) for j in range(len(g)) if ps[j] % 3 == 0 and ts[j] <= ts[k]]
            assert nan(b.x[ps[k]]) == (max(back)[2] if back else None)


@pytest.mark.parametrize("complete", [True, False])
def test_weighted_statistics_over_blocks(spark, complete):
    df, pdf = rows(spark, 3, 500)
    got = W.ewm(df, ["g"], ["p"], {"x": 20.0}, block=32, complete=complete).withColumn("z", W.zscore("x")).toPandas().set_index("p")
    for _, g in pdf.groupby("g"):
        e = g.x.ewm(halflife=20)
        assert np.allclose(got.loc[g.p].x_mean, e.mean())
        assert np.allclose(got.loc[g.p].x_var, e.var(), equal_nan=True)
        z = (g.x - e.mean()) / np.sqrt(np.fmax(e.var().to_numpy(), 1e-12))
        assert np.allclose(got.loc[g.p].z, np.where(np.isnan(z), 0, z))


def test_numbered_is_the_global_order(spark):
    df, pdf = rows(spark, 4, 200)
    got = ML.numbered(df, ["t", "p"]).toPandas().sort_values("rn")
    assert got.rn.tolist() == list(range(200)) and got.p.tolist() == pdf.sort_values(["t", "p"]).p.tolist()


def test_numbered_in_groups(spark):
    from tickloom.operators.ordered import numbered

    df, pdf = rows(spark, 5, 200)
    got = numbered(df.repartition(9), ["t", "p"], "k", ["g"]).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("k")
        assert part.k.tolist() == list(range(len(part))) and part.p.tolist() == pdf[pdf.g == g].sort_values(["t", "p"]).p.tolist()
    assert numbered(df.limit(0), ["t"], "k", ["g"]).count() == 0


def test_look_up_with_missing_times_and_groups(spark):
    a = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3)], "g string, t bigint, p bigint")
    b = spark.createDataFrame([("a", 4, 1, 7.0), (None, 4, 2, 8.0), ("a", None, 3, 9.0), ("a", 5, 4, None)], "g string, t bigint, p bigint, x double")
    got = {r["p"]: r["x"] for r in T.backward(a, b, ["g"], "t", "p", ["x"]).collect()}
    assert got == {1: None, 2: 8.0, 3: None}
    assert T.backward(a, b.limit(0), ["g"], "t", "p", ["x"]).count() == 3 and T.backward(a.limit(0), b, ["g"], "t", "p", ["x"]).count() == 0


def test_ridge_recovers_weights_and_purges(spark):
    rng = np.random.default_rng(1)
    n = 4000
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(ts=np.arange(n) * 1_000_000, y=2 + x @ [1.0, -0.5, 0.0] + rng.normal(0, 0.1, n))
    pdf.loc[5, "a"] = np.nan
    m = ML.ridge_cv(spark.createDataFrame(pdf), ["a", "b", "c"], "y", ["ts"], 10, 5)
    assert np.allclose(m.weights / [1, pdf.a.std(), pdf.b.std(), pdf.c.std()], [2 + 0, 1, -0.5, 0], atol=0.05)
    assert m.stats["r2"] > 0.98 and len(m.stats["folds"]) == 5
    scored = spark.createDataFrame(pdf).select((m.score(spark.createDataFrame(pdf)) - F.col("y")).alias("e")).agg(F.stddev("e")).first()[0]
    assert scored < 0.2
    f = ML.folds(ML.numbered(spark.createDataFrame(pdf), ["ts"]), n)
    kept = ML.training_rows(f, ML.fold_bounds(f, "ts"), "ts", 10_000_000, 5_000_000).where("test = 2").agg(F.count("*"), F.max(F.when(F.col("fold") < 2, F.col("ts"))), F.min(F.when(F.col("fold") > 2, F.col("ts")))).first()
    assert kept[1] == (1600 - 11) * 1_000_000 and kept[2] == (2399 + 6) * 1_000_000


def test_ridge_fits_four_horizons_over_shared_folds(spark):
    rng = np.random.default_rng(5)
    n, hs = 3000, [50, 500, 1000, 5000]
    pdf = pd.DataFrame(rng.normal(size=(n, 2)), columns=["a", "b"]).assign(ts=(np.arange(n) // 2) * 100_000_000, row_id=range(n))
    for k, h in enumerate(hs):
        pdf[f"fwd_return_{h}ms"] = (k + 1) * pdf.a - pdf.b + rng.normal(0, 0.5, n)
        pdf.loc[rng.random(n) < 0.2, f"fwd_return_{h}ms"] = np.nan
    got = ML.ridge_horizons(spark.createDataFrame(pdf), ["a", "b"], ["ts", "row_id"])
    assert list(got) == list(ML.HORIZONS)
    x, ts, size = pdf[["a", "b"]].to_numpy(), pdf.ts.to_numpy(), n // 5
    for h, (label, (_, purge, embargo)) in zip(hs, ML.HORIZONS.items()):
        y = pdf[f"fwd_return_{h}ms"].to_numpy()
        has, err = ~np.isnan(y), {a: [] for a in ML.ALPHAS}
        tested = []
        for f in range(5):
            lo, hi = f * size, (f + 1) * size
            test = has & (np.arange(n) >= lo) & (np.arange(n) < hi)
            train = has & ((np.arange(n) < lo) & (ts < ts[lo] - purge * 1_000_000) | (np.arange(n) >= hi) & (ts > ts[hi - 1] + embargo * 1_000_000))
            mean, sd = x[train].mean(0), x[train].std(0) + 1e-8
            z, tested = (x[train] - mean) / sd, [*tested, *y[test]]
            for a in ML.ALPHAS:
                w = np.linalg.solve(z.T @ z + a * np.eye(2), z.T @ (y[train] - y[train].mean()))
                err[a] += [*(y[test] - y[train].mean() - (x[test] - mean) / sd @ w)]
        r2 = {a: 1 - np.square(e).sum() / np.square(tested - np.mean(tested)).sum() for a, e in err.items()}
        best = max(r2, key=r2.get)
        assert got[label].stats["alpha"] == best and abs(got[label].stats["r2"] - r2[best]) < 1e-9
        assert got[label].target == f"fwd_return_{h}ms" and got[label].stats["n"] == has.sum()


def test_isotonic_rises_and_interpolates(spark):
    rng = np.random.default_rng(2)
    s = rng.random(3000)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": (rng.random(3000) < s).astype(int)}))
    xs, ys = ML.isotonic(df, "s", "y")
    assert xs == sorted(xs) and ys == sorted(ys) and abs(np.interp(0.5, xs, ys) - 0.5) < 0.08
    got = df.limit(50).select("s", ML.interpolate(F.col("s"), xs, ys).alias("p")).toPandas()
    assert np.allclose(got.p, np.interp(got.s, xs, ys))


def test_isotonic_is_exact_above_4096_scores(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    s = rng.random(n)
    s[:2000] = s[2000:4000]  # equal scores, too
    y = (rng.random(n) < s**2).astype(int)
    pdf = pd.DataFrame({"s": s, "y": y})
    gone = pd.DataFrame({"s": [np.nan], "y": [1]})
    xs, ys = ML.isotonic(spark.createDataFrame(pd.concat([pdf, gone])), "s", "y")
    g = pdf.groupby("s").y.agg(["sum", "count"])
    # the fit by its min-max formula: the steepest mean from a row on, over all starts up to it
    at, cs, cn = g.index.to_numpy(), np.r_[0, g["sum"].cumsum()], np.r_[0, g["count"].cumsum()]
    assert len(at) > 4096 and xs[0] == at[0] and xs[-1] == at[-1]
    for i in range(0, len(at), 500):
        means = (cs[None, i + 1 :] - cs[: i + 1, None]) / (cn[None, i + 1 :] - cn[: i + 1, None])
        assert abs(np.interp(at[i], xs, ys) - means.min(axis=1).max()) < 1e-12


def test_online_model_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(500), "x": x, "y": 3 * x + 1}))
    err = ML.online_errors(df, ["k"], ["t"], ["x"], "y").orderBy("t").toPandas().err.abs()
    assert err[:3].max() > 0.1 and err[400:].max() < 0.01


def test_simulator_rules(spark):
    s = 1_000_000_000
    quotes = [(1, "X", s, 100.0, 100.5, 2.0, 2.0, 0.0, 0.0), (2, "X", 2 * s, 100.0, 100.5, 2.0, 2.0, 100.0, 2.0), (3, "X", 3 * s, 100.0, 100.5, 2.0, 2.0, 100.0, 1.0), (4, "X", 20 * s, 100.0, 100.5, 2.0, 2.0, None, None), (5, None, 20 * s, 1.0, 2.0, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(quotes, "row_id bigint, symbol string, timestamp_ns bigint, bid_px_00 double, ask_px_00 double, bid_sz_00 double, ask_sz_00 double, trade_price double, trade_size double")
    out = [r.asDict() for r in SM.simulate(df).collect()]
    # two lots trade ahead in the queue, the third fills the order; it times out at the bid less a tenth of the spread
    assert [(o["kind"], o["side"], o["price"], o["exit_price"]) for o in out] == [("trade", 1, 100.0, 100.0 - 0.2 * 0.25)]
    assert SM.simulate(df.limit(0)).count() == 0


def desk_rows(spark, rows):
    names = ("symbol", "timestamp_ns", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "trade_price", "trade_size")
    pdf = pd.DataFrame([("X", *r) for r in rows], columns=names).astype({c: float for c in names[2:]})
    return spark.createDataFrame(pdf.assign(row_id=range(len(pdf))))


def test_simulator_slippage_first_tick_and_open(spark):
    s = 1_000_000_000
    mids = [100.25, 100.25, 100.25, 100.5, 100.75, 100.0, 100.25, 100.5, 100.25, 100.0, 100.25, 100.75]
    # a trade through the bid fills at once; rows 0.5 s apart, the last one after the timeout
    at = [s + k * s // 2 for k in range(len(mids) - 1)] + [20 * s]
    rows = [(t, m - 0.25, m + 0.25, 9, 9, 99.75 if k == 1 else 0, 1 if k == 1 else 0) for k, (t, m) in enumerate(zip(at, mids))]
    out = [r.asDict() for r in SM.simulate(desk_rows(spark, rows)).where("kind = 'trade' and side = 1").collect()]
    vol = np.std(mids[-10:]) / 0.25
    assert len(out) == 1 and abs(out[0]["exit_price"] - (100.5 - (0.2 + 0.05 * vol) * 0.25)) < 1e-12
    # bought at 100.0: the mid is a tick above from the first row on
    assert (out[0]["first_tick_row"], out[0]["first_tick_mae"]) == (1, 0.0)
    short = SM.simulate(desk_rows(spark, rows[:-1]))
    assert [(r["side"], r["price"], r["exit_price"], r["rows_held"]) for r in short.where("kind = 'open'").collect()] == [(1, 100.0, None, 10)]
    assert [(r["side"], r["n"], r["n_open"]) for r in SM.kpis(short).collect()] == [(1, 0, 1)]


def test_simulator_cancels_near_and_toxic(spark):
    s, ms = 1_000_000_000, 1_000_000
    # the bid steps up under a short quote of an empty queue, which no move of the mid may cancel
    rows = [(s, 100.0, 101.0, 9, 0, 0, 0), (s + 10 * ms, 100.25, 101.0, 9, 0, 0, 0)]
    out = SM.simulate(desk_rows(spark, rows)).collect()
    assert [(r["kind"], r["side"], r["price"], r["reason"]) for r in out] == [("cancel", -1, 101.0, "near")]
    late = [rows[0], (s + 60 * ms, *rows[1][1:])]
    assert SM.simulate(desk_rows(spark, late)).count() == 0
    # after twelve rows of an unmoved mid the spread jumps: the model's spread term alone makes both sides toxic
    calm = [(k * s, 100.0, 100.5, 9, 9, 0, 0) for k in range(1, 13)]
    wide = [*calm, (13 * s, 97.0, 103.5, 9, 9, 0, 0)]
    got = {(r["side"], r["reason"]) for r in SM.simulate(desk_rows(spark, wide)).collect()}
    p = 1 / (1 + np.exp(-(0.45 + 0.15 * (6.5 - 0.5) / 0.3 - 0.12 * 0.5)))
    assert p < 0.99 and ("toxic" in {r for _, r in got}) is False
    wider = [*calm, (13 * s, 92.0, 108.5, 9, 9, 0, 0)]
    got = {(r["side"], r["price"], r["reason"]) for r in SM.simulate(desk_rows(spark, wider)).collect()}
    assert got == {(1, 100.0, "toxic"), (-1, 100.5, "toxic")}


def test_toxicity_scales_by_its_last_500_rows():
    rng, r = np.random.default_rng(6), SM.Readings(SM.Toxicity())
    mids = 100 + rng.integers(-4, 5, 1300).cumsum() * 0.125 % 9
    sizes, spreads, seen = rng.integers(1, 30, (1300, 2)), rng.integers(1, 5, 1300) * 0.25, []
    for k, (m, (b, a), w) in enumerate(zip(mids, sizes.astype(float), spreads)):
        r.add(m - w / 2, m + w / 2, b, a)
        if k >= 9:
            last = mids[max(0, k - 99) : k + 1]
            momentum = (mids[k - 4 : k + 1].mean() - mids[k - 19 : k + 1].mean()) / 0.25 if k >= 19 else 0.0
            seen.append((w, (b - a) / (b + a), momentum, np.sqrt(np.mean((np.diff(last) / last[:-1]) ** 2))))
        if k in (1, 40, 200, 700, 1299):
            if k < 9:
                assert r.toxic() == (0.5, 0.5)
                continue
            n = len(seen)
            x = np.array(seen[-500:] if n >= 500 else seen[: n // 50 * 50])
            mean, sd = (x.mean(0), x.std(0)) if n >= 50 else np.array(SM.Toxicity().scales).T
            z = (np.array(seen[-1]) - mean) / sd
            for got, sign in zip(r.toxic(), (-1, 1)):
                p = 1 / (1 + np.exp(-(0.45 + z @ (np.array([0.15, 0.25 * sign, 0.2 * sign, 0.12])))))
                p = min(1, p * 1.15) if -p * np.log(p) - (1 - p) * np.log(1 - p) > 0.65 else p
                assert abs(got - p) < 1e-9


def test_live_book_equals_batch(spark, sf_dir, tmp_path):
    from tickloom.operators import book
    from tickloom.sources import messages as M
    from tickloom.streaming.live_book import live_book

    m = spark.read.parquet(f"{sf_dir}/mbo_messages.parquet").where("sequence is not null")
    for part in ("seq % 3 > 0", "seq % 3 = 0"):  # a third of the messages come after all their successors
        m.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    for k, f in enumerate(files):
        import os

        os.utime(f, (1_600_000_000 + k, 1_600_000_000 + k))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_book(stream, keep=100_000, idle_s=None).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = "row_number() over (partition by trade_date, instrument_id, sequence order by revision desc)"
    got = spark.sql(f"select trade_date, instrument_id, sequence, coalesce(bid, 0), coalesce(ask, 0), bid_size, ask_size, {last} as k from live").where("k = 1").drop("k")
    got = sorted(tuple(r) for r in got.collect())
    assert spark.sql("select max(revision) from live").first()[0] > 0
    t = book.replay(M.in_order(m)).where("act = 3").selectExpr("trade_date", "instrument_id", "sequence", "coalesce(bid, 0)", "coalesce(ask, 0)", "bid_sz[0]", "ask_sz[0]")
    assert got == sorted(tuple(r) for r in t.collect())


def test_messages_in_any_order_give_one_book():
    from tickloom.streaming.live_book import Replay

    rng = np.random.default_rng(3)
    feed = [(k, int(rng.choice([1, 1, 1, 2, 3, 9])), int(rng.integers(0, 12)), int(rng.integers(90, 110)), int(rng.integers(1, 9)), int(rng.integers(0, 2)), 3 if rng.random() < 0.4 else 0) for k in range(300)]
    straight, mixed, end = Replay(), Replay(), {}
    want = {r[0]: r[1:-1] for r in straight.take(feed)}
    order = np.argsort(np.arange(300) + rng.integers(0, 30, 300))
    for part in np.array_split(order, 25):
        for r in mixed.take([feed[k] for k in part] + [feed[part[0]]]):
            end[r[0]] = r[1:-1]
        if len(mixed.order) > 120:
            mixed.settle(60)
    assert end == want
    assert mixed.take([feed[0]]) == []


def test_files_and_sinks(spark, tmp_path):
    from tickloom.sources import files

    for name, n in (("es-20240102.parquet", 500), ("es-20240103.parquet", 3)):
        pd.DataFrame({"seq": range(n)}).to_parquet(tmp_path / name)
    big = (tmp_path / "es-20240103.parquet").stat().st_size
    assert [r["session"] for r in files.daily_files(spark, str(tmp_path), "*.parquet", big).collect()] == ["20240102"]
    assert {r["session"] for r in files.messages(spark, str(tmp_path), "*.parquet").select("session").distinct().collect()} == {"20240102", "20240103"}
    row = [""] * 73
    row[5], row[7], row[8], row[72] = "B", "6500", "1", "ESU5"
    row[12:16] = ["6500", "6500.25", "3", "4"]
    other = [*row[:72], "ESZ5"]
    (tmp_path / "d.csv").write_text("\n".join([",".join(f"h{k}" for k in range(73)), ",".join(row), ",".join(other), "short,row"]))
    got = files.depth_csv(spark, str(tmp_path / "d.csv"), "ESU5").collect()
    assert len(got) == 1 and got[0]["ask_sz_00"] == 4.0
    df = spark.createDataFrame([(2, 1 / 3), (1, 2.0)], "t bigint, x double")
    files.enriched_csv(df, str(tmp_path / "out"), ["t"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).orderBy("t").collect()[1]["x"] == "0.3333333333"
    q = spark.createDataFrame([("SPX   250829C06500000", 1.0, 3.0), ("bad", 1.0, 3.0)], "symbol string, bid_px_00 double, ask_px_00 double")
    r = files.option_quotes(q).collect()
    assert (r[0]["opt_root"], r[0]["opt_expiry"], r[0]["opt_type"], r[0]["opt_strike"], r[0]["opt_mid"]) == ("SPX", datetime.date(2025, 8, 29), "C", 6500.0, 2.0)
    assert r[1]["opt_expiry"] is None and r[1]["opt_strike"] is None


def test_conversion(spark, tmp_path):
    from tickloom.sources import files

    def decode(path):
        yield pd.DataFrame({"seq": [len(path)]})

    files.convert(spark, ["a", "bcd"], decode, "seq bigint", str(tmp_path / "out"))
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_option_prices_invert():
    from tickloom.operators import options as O

    k, t = np.array([90.0, 100, 110, 100]), np.array([0.5, 0.1, 1.0, 0.2])
    call, v = np.array([True, True, False, False]), np.array([0.2, 0.5, 0.3, 1.2])
    p = O.price(100.0, k, t, 0.03, v, call)
    assert np.allclose(O.implied_volatility(p, np.full(4, 100.0), k, t, 0.03, call), v, atol=1e-5)
    assert np.isnan(O.implied_volatility([1.0, 5.0, -1.0], [100.0] * 3, [90.0, 100, 100], [0.5, 0.0, 1.0], 0.0, [True] * 3)).all()
    parity = O.price(100.0, k, t, 0.03, v, True) - O.price(100.0, k, t, 0.03, v, False)
    assert np.allclose(parity, 100 - k * np.exp(-0.03 * t))


def test_models_go_out_and_come_back(spark, tmp_path):
    from tickloom.sources import models as S

    folder = str(tmp_path / "models")
    m = ML.Linear(["a", "b"], np.array([0.5, 1.0, -2.0]), np.array([1.0, 2.0]), np.array([4.0, 9.0]), None, "fwd_return_50ms", {"r2": 0.2})
    probs = np.full((3, 9, 11), 1 / 11)
    made = S.save(spark, folder, S.Models({"fast": m}, {"fast": ([0.0, 1.0], [0.1, 0.9])}, probs, [float(k) for k in range(-5, 6)], (0.1, 0.2), {"0_1_0": 1.5}, {"0_1_0": -0.5}, {"intercept": 1.0}))
    assert made == ["calibration_fast", "markov_model", "spread_optimizer", "toxicity_fast"]
    S.write_json(spark, f"{folder}/{S.OLD_MODEL}", m.to_json("old"))
    S.write_json(spark, f"{folder}/{S.OLD_CALIBRATION}", {"X_thresholds": [0.0, 2.0], "y_thresholds": [0.0, 1.0]})
    got = S.load(spark, folder)
    assert set(got.linear) == set(S.LABELS) and got.calibration["slow"] == ([0.0, 2.0], [0.0, 1.0]) and got.calibration["fast"] == ([0.0, 1.0], [0.1, 0.9])
    assert got.vol_thresholds == (0.1, 0.2) and got.linear["fast"].summary()["r2"] == 0.2
    df = spark.createDataFrame([(3.0, 5.0, 0, 1, 0), (None, float("nan"), 1, 1, 0)], "a double, b double, v int, t int, g int")
    r = got.scored(df).withColumns(got.quoted(F.col("v"), F.col("t"), F.col("g")) | got.expected(F.col("v"), F.col("t"))).collect()
    assert abs(r[0]["toxicity_fast"] - m.predict({"a": 3.0, "b": 5.0})) < 1e-9 and abs(r[0]["toxicity_fast"] + 0.5) < 1e-6 and r[1]["toxicity_fast"] == 0.5 == m.predict({})
    assert abs(r[0]["p_toxic_fast"] - 0.5) < 1e-6 and (r[0]["table_half_spread"], r[0]["table_skew"], r[1]["table_half_spread"]) == (1.5, -0.5, 1.0)
    assert abs(r[0]["markov_expected"]) < 1e-12 and abs(r[0]["markov_uncertainty"] - 10**0.5) < 1e-9
    assert not S.load(spark, str(tmp_path / "none")).linear


def test_online_model_over_running_moments(spark):
    rng = np.random.default_rng(8)
    x, k = rng.normal(5, 3, (80, 2)), list(range(80))
    y = x @ [1.0, -0.5] + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([("a", i, float(p), float(q), float(t)) for i, (p, q), t in zip(k, x, y)], "k string, t bigint, p double, q double, y double")
    got = ML.online_errors(df, ["k"], ["t"], ["p", "q"], "y", standardise=1.0).orderBy("t").toPandas().err
    model, want = ML.RecursiveLeastSquares(np.zeros(3), np.eye(3) * 100.0), []
    for i in k:
        seen = x[: i + 1]
        want.append(model.update((x[i] - seen.mean(0)) / np.sqrt(seen.var(0) + 1e-8), y[i]))
    assert np.allclose(got, want)
    m = ML.RunningMoments(0.9)
    for v in (1.0, 3.0, 2.0):
        m.update(v)
    assert abs(m.mean - (1.2 * 0.9 + 0.2)) < 1e-12
    r = ML.online_rmse(spark.createDataFrame([("a", 3.0), ("a", None), ("a", 4.0), ("b", None)], "k string, err double"), ["k"]).orderBy("k").collect()
    assert (r[0]["n_updates"], round(r[0]["rmse"] ** 2, 6), r[1]["rmse"]) == (2, 12.5, 0.0)


def test_sinks_write_what_they_say(spark, tmp_path):
    import json

    from tickloom.sources import files

    df = spark.createDataFrame([(k, float(k)) for k in range(30)], "t bigint, x double")
    files.parquet_sample(df, str(tmp_path / "s"), "t", 7)
    assert [r["t"] for r in spark.read.parquet(str(tmp_path / "s")).orderBy("t").collect()] == list(range(7))
    cell = spark.createDataFrame([(0, 1, 0, 1.5, -0.5)], "vol int, tox int, gex int, half_spread double, skew double")
    assert json.loads(files.spread_json(cell)) == {"table": {"0_1_0": 1.5}, "skew_table": {"0_1_0": -0.5}}
    counts = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 1, 3)], "regime int, state int, outcome int, n bigint")
    j = json.loads(files.transition_json(counts, counts.selectExpr("*", "n / 5 as prob").drop("n"), (0.1, 0.2)))
    assert j == {"counts": [[[2, 3]]], "probs": [[[0.4, 0.6]]], "vol_thresholds": [0.1, 0.2]}
    done = spark.createDataFrame([("trade", 1), ("cancel", 2)], "kind string, a int")
    files.execution_csv(done, str(tmp_path / "e"))
    assert [r["a"] for r in spark.read.csv(str(tmp_path / "e" / "closed_trades"), header=True).collect()] == ["1"]
    assert [r["a"] for r in spark.read.csv(str(tmp_path / "e" / "cancelled_orders"), header=True).collect()] == ["2"]


def test_every_model_input_has_one_definition():
    from tickloom.operators import regressors as R

    made = set(R._plain()) | set(R.PRODUCTS) | {"z_kyle_lambda", "spread_ticks"}
    assert made == set(R.NAMES) and len(R.NAMES) == len(set(R.NAMES)) == 60
    assert R.inputs_like(["ts_ns", "z_a", "mid", "ofi_L1_x_vol"]) == ["z_a", "ofi_L1_x_vol"]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_previous_row_across_blocks(spark, block):
    from tickloom.operators.ordered import previous

    rng = np.random.default_rng(block)
    rows = [(None if g == 2 else int(g), int(t) if t % 5 else None, k, None if k % 7 == 0 else float(k)) for k, (g, t) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(0, 40, 90)))]
    df = spark.createDataFrame(rows, "g int, t int, k int, v double")
    got = {r["k"]: r["b"] for r in previous(df, ["g"], ["t", "k"], "v", "b", block).collect()}
    want, last = {}, {}
    for g, t, k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[k], last[g] = last.get(g), v
    assert got == want
