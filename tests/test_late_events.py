"""Late and out-of-order events against a plain recount."""

import random

import numpy as np
import pandas as pd

from tickloom.streaming import late_events as L

NS = 1_000_000_000
SCHEMA = "row_id bigint, trade_date date, instrument_id bigint, ts bigint, trade_ts_recv bigint, trade_ts_in_delta int, trade_price double, trade_size bigint, trade_sequence bigint"
DAY = __import__("datetime").date(2024, 1, 2)


def frame(spark, rows):
    return spark.createDataFrame([(k + 1, DAY, *r) for k, r in enumerate(rows)], SCHEMA)


def test_edges_of_lateness(spark):
    end = 60 * NS
    rows = [(1, 10 * NS, end + 5 * NS - 1, 0, 10.0, 1, 1), (1, 11 * NS, end + 5 * NS, 0, 10.0, 1, 2), (1, 12 * NS, end + 900 * NS - 1, 0, 10.0, 1, 3), (1, 13 * NS, end + 900 * NS, 0, 10.0, 1, 4)]
    p = L.trade_periods(frame(spark, rows)).collect()
    assert len(p) == 1
    assert (p[0]["n"], p[0]["first_n"], p[0]["n_late"], p[0]["n_cut_off"], p[0]["revisions"]) == (3, 1, 2, 1, 2)
    assert sorted(r["outcome"] for r in L.outcomes(L.trade_periods(frame(spark, rows))).collect()) == ["corrected", "cut_off"]


def test_first_arrival_counts_and_fallbacks(spark):
    end = 60 * NS
    rows = [
        (1, 10 * NS, end + 950 * NS, 0, 10.0, 1, 7),  # a copy that came too late
        (1, 10 * NS, end + NS, 0, 10.0, 1, 7),  # the first to arrive
        (1, None, 30 * NS + 5, 5, 10.0, 2, 8),  # event from arrival
        (1, 40 * NS, 0, 3, float("nan"), None, 9),  # arrival from event; no price, no size
        (1, None, None, 3, 10.0, 1, 10),  # nowhere in time
        (None, 40 * NS, 41 * NS, 3, 10.0, 1, 11),  # no key
        (1, 50 * NS, 51 * NS, 3, 10.0, 1, None), (1, 50 * NS, 51 * NS, 3, 10.0, 1, None),  # no identity: two records
    ]
    p = L.trade_periods(frame(spark, rows)).collect()
    assert [(r["n"], r["volume"], r["n_cut_off"]) for r in p] == [(5, 5, 0)]


def test_only_too_late_and_empty(spark):
    p = L.trade_periods(frame(spark, [(1, 10 * NS, 5000 * NS, 0, 10.0, 1, 1)])).collect()
    assert (p[0]["n"], p[0]["n_cut_off"], p[0]["low"]) == (0, 1, None)
    assert L.trade_periods(frame(spark, [(1, 1, 1, 0, 1.0, 1, 1)]).limit(0)).count() == 0


def test_times_before_1970(spark):
    p = L.trade_periods(frame(spark, [(1, -1, 5, 0, 1.0, 1, 1)])).collect()
    assert p[0]["period_start_s"] == -60


def test_extra_columns_do_not_clash(spark):
    df = frame(spark, [(1, 10 * NS, 11 * NS, 0, 10.0, 1, 1)]).selectExpr("*", "1 as key", "2 as event", "3 as r", "4 as period")
    assert L.trade_periods(df).count() == 1


def arrivals(rng, size=300):
    """Random cells of one key and day in order of arrival, as a frame."""
    cells = {}
    for _ in range(rng.randint(1, size)):
        c = cells.setdefault((rng.randint(0, 200), rng.choice([0, 0, 0, 1, 5, 179, 180])), [0, 0, 0.0, np.inf, -np.inf])
        c[0] += 1
        c[1] += rng.randint(1, 9)
    pdf = pd.DataFrame([(p, s, (p + 1) * 12 + s, *c) for (p, s), c in cells.items()], columns=["period", "step", "tick", "n", "volume", "notional", "low", "high"])
    return pdf.sort_values(["tick", "period"])


def day(pdf, every=7):
    return pd.DataFrame(L.replay_day({c: pdf[c].to_numpy() for c in pdf}, 180, every)).set_index("period")


def test_replay_in_any_order_equals_recount():
    rng = random.Random(4)
    for _ in range(30):
        pdf = arrivals(rng)
        out = day(pdf)
        by = lambda rows: rows.groupby("period").n.sum().reindex(sorted(pdf.period.unique()), fill_value=0)
        want = by(pdf[pdf.step < 180])
        assert out.n.tolist() == want.tolist()
        assert out.day_n.tolist() == want.cumsum().tolist()
        assert out.first_n.tolist() == by(pdf[pdf.step == 0]).tolist()
        assert out.n_late.tolist() == by(pdf[(pdf.step > 0) & (pdf.step < 180)]).tolist()
        assert out.n_cut_off.tolist() == by(pdf[pdf.step == 180]).tolist()
        late = pdf[(pdf.step > 0) & (pdf.step < 180)].groupby("period").step.nunique().reindex(want.index, fill_value=0)
        assert out.revisions.tolist() == late.tolist()


def test_days_that_cross_batches():
    rng, frames = random.Random(5), []
    for key, d in ((1, 0), (1, 1), (2, 0)):
        frames.append(arrivals(rng).assign(key=key, day=d))
    whole = pd.concat(frames, ignore_index=True)
    import pyarrow as pa

    want = [day(f) for f in frames]
    for size in (1, 7, 50, len(whole)):
        batches = [pa.RecordBatch.from_pandas(whole.iloc[k : k + size], preserve_index=False) for k in range(0, len(whole), size)]
        got = pd.concat([b.to_pandas() for b in L._replayed(iter(batches), 60, 180, 7)])
        assert got.n.tolist() == [x for w in want for x in w.n] and got.day_n.tolist() == [x for w in want for x in w.day_n]


def test_outcomes_come_from_the_replay(spark, monkeypatch):
    end = 60 * NS
    df = frame(spark, [(1, 10 * NS, 11 * NS, 0, 10.0, 1, 1), (1, 11 * NS, end + 7 * NS, 0, 10.0, 1, 2), (1, 13 * NS, end + 901 * NS, 0, 10.0, 1, 4)])
    said = lambda: sorted(r["outcome"] for r in L.outcomes(L.trade_periods(df)).collect())
    assert said() == ["corrected", "cut_off"]
    pdf = pd.DataFrame({"period": [0, 0, 0], "step": [0, 1, 180], "tick": [12, 13, 192], "n": [1, 1, 1], "volume": [1, 1, 1], "notional": 10.0, "low": 10.0, "high": 10.0})
    assert (day(pdf).revisions > 0).tolist() == [True]
    monkeypatch.setattr(L.Ledger, "_replay", lambda self, first, stop: (first, np.zeros(stop - first, bool)))
    assert (day(pdf).revisions > 0).tolist() == [False]


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(1, 2), t := rng.randint(0, 600) * NS, t + rng.choice([1, 1, 100, 2000]) * NS, 0, 10.0, rng.randint(1, 5), k) for k in range(120)]
    df = frame(spark, rows)
    first = L.first_arrivals(df, ident=[df.trade_sequence], key=df.instrument_id, event_ns=df.ts, arrival_ns=df.trade_ts_recv, row_id=df.row_id, value=df.trade_price, weight=df.trade_size)
    for k, part in enumerate(first.randomSplit([0.5, 0.5], seed=3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[(r["key"], r["period_start_s"])] = (r["n"], r["volume"], r["revision"] > 0)

    q = L.stream_periods(stream, idle_s=None).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r["key"], r["period_start_s"]): (r["n"], r["volume"], r["revisions"] > 0) for r in L.trade_periods(df).collect()}
    assert seen == batch
    q = L.stream_periods(stream, idle_s=1).writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "d")).start()
    for _ in range(60):
        q.awaitTermination(1)
        held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        if held and max(held) > 0 and held[-1] == 0:
            break
    q.stop()
    assert max(held) > 0 and held[-1] == 0
