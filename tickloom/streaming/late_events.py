"""Per-period aggregates by event time, corrected as late records arrive, with a cut-off for lateness.

Records are first reduced to cells: one a key, period and arrival step (the number of whole steps between the end of the
period and the arrival). Cells are built with map-side combining, so a hot key or period costs no more than its cells:
``cutoff / step + 2`` a period, whatever the number of records.

The cells of one key and UTC day are then replayed in order of arrival. The state is the day's periods in event order
with running totals; every ``every`` periods a checkpoint of the totals is kept. A late cell restores the checkpoint
before its period, replays the sorted suffix from there, and replaces the outputs it changes; a cell that comes
``cutoff`` or later after its period is refused. Which periods were corrected or cut off is read from these replays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import codes as C

NS = 1_000_000_000
PERIOD_S, STEP_S, CUTOFF_S = 60, 5, 900

OUT = (
    "key bigint, period_start_s bigint, n bigint, volume bigint, notional double, low double, high double, day_n bigint, day_volume bigint, "
    "first_n bigint, revisions bigint, n_late bigint, n_cut_off bigint"
)


def first_arrivals(records: DataFrame, *, ident: list[Column], key: Column, event_ns: Column, arrival_ns: Column, row_id: Column, value: Column, weight: Column) -> DataFrame:
    """One row a record identity, the first to arrive (then the smallest row id): ``key, event, arrival, value, weight``.

    A row without key, event time or arrival can't be placed in time and is left out. A null in ``ident`` identifies
    nothing: such a row is a record of its own. Null or NaN values and null weights count as 0.
    """
    whole = F.lit(True)
    for c in ident:
        whole = whole & c.isNotNull()
    rows = records.select(
        *[c.alias(f"_i{k}") for k, c in enumerate(ident)], F.when(~whole, row_id).alias("_own"), key.cast("bigint").alias("key"),
        F.struct(arrival_ns.alias("arrival"), row_id.alias("row_id"), event_ns.alias("event"), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("value"), F.coalesce(weight.cast("bigint"), F.lit(0)).alias("weight")).alias("r"),
    )
    rows = rows.where(F.col("key").isNotNull() & F.col("r.arrival").isNotNull() & F.col("r.event").isNotNull())
    best = rows.groupBy(*[f"_i{k}" for k in range(len(ident))], "_own", "key").agg(F.min("r").alias("r"))
    return best.select("key", "r.event", "r.arrival", "r.value", "r.weight")


def cells(first: DataFrame, period_s: int = PERIOD_S, step_s: int = STEP_S, cutoff_s: int = CUTOFF_S) -> DataFrame:
    """Records by key, period and arrival step: step 0 is in time, ``cutoff_s / step_s`` is too late."""
    start = C.floor_to(F.col("event"), period_s * NS)
    late = F.col("arrival") - (start + F.lit(period_s * NS))
    step = F.least(F.greatest(C.floor_div(late, step_s * NS), F.lit(0)), F.lit(cutoff_s // step_s))
    return (
        first.select("key", C.floor_div(F.col("event"), period_s * NS).alias("period"), step.cast("int").alias("step"), "value", "weight")
        .groupBy("key", "period", "step")
        .agg(F.count("*").alias("n"), F.sum("weight").alias("volume"), F.sum(F.col("value") * F.col("weight")).alias("notional"), F.min("value").alias("low"), F.max("value").alias("high"))
    )


class Ledger:
    """The outputs of one key's periods in event order, with running totals and a checkpoint of these every so many periods.

    ``out_n`` and ``out_volume`` are what was given out last. Cells in time open their periods at the end; a late cell
    restores the checkpoint before its period and replays the sorted suffix from there, which replaces the outputs that it
    changes; a cell of a closed period is refused. Only these three calls change outputs and their tallies.
    """

    FIELDS = ("n", "volume", "out_n", "out_volume", "run_n", "run_volume", "first_n", "revisions", "corrected", "refused")

    def __init__(self, size: int, every: int):
        self.every, self.head = every, -1
        for f in self.FIELDS:
            setattr(self, f, np.zeros(size, np.int64))
        self.notional, self.low, self.high = np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
        self.mark_n, self.mark_volume = np.zeros(size // every + 1, np.int64), np.zeros(size // every + 1, np.int64)

    def _take(self, at: np.ndarray, cell: tuple) -> None:
        n, volume, notional, low, high = cell
        self.n[at] += n
        self.volume[at] += volume
        self.notional[at] += notional
        self.low[at], self.high[at] = np.minimum(self.low[at], low), np.maximum(self.high[at], high)

    def _replay(self, first: int, stop: int) -> tuple[int, np.ndarray]:
        """Restore the checkpoint at or before ``first`` and replay up to ``stop``; from where, and which outputs it replaced."""
        every, mark = self.every, first // self.every
        start = mark * every
        span = slice(start, stop)
        self.run_n[span] = self.mark_n[mark] + np.cumsum(self.n[span])
        self.run_volume[span] = self.mark_volume[mark] + np.cumsum(self.volume[span])
        ends = np.arange(start + every - 1, stop, every)
        self.mark_n[mark + 1 : mark + 1 + len(ends)], self.mark_volume[mark + 1 : mark + 1 + len(ends)] = self.run_n[ends], self.run_volume[ends]
        replaced = (self.out_n[span] != self.n[span]) | (self.out_volume[span] != self.volume[span])
        self.out_n[span], self.out_volume[span] = self.n[span], self.volume[span]
        self.head = stop - 1
        return start, replaced

    def open(self, at: np.ndarray, cell: tuple) -> None:
        """Records in time of periods at increasing positions; giving these out is no correction."""
        self._take(at, cell)
        self._replay(min(int(at[0]), self.head + 1), max(self.head, int(at[-1])) + 1)
        self.first_n[at] = self.out_n[at]

    def correct(self, at: np.ndarray, cell: tuple) -> None:
        """Late cells at distinct positions: what the replay replaced counts as revised, and its late records as corrections."""
        self._take(at, cell)
        start, replaced = self._replay(min(int(at.min()), self.head + 1), max(self.head, int(at.max())) + 1)
        self.revisions[start : start + len(replaced)] += replaced
        self.corrected[at] += np.where(replaced[at - start], cell[0], 0)

    def refuse(self, at: np.ndarray, n: np.ndarray) -> None:
        """Cells whose period is closed leave all outputs as they are."""
        np.add.at(self.refused, at, n)


def replay_span(ledger: Ledger, at: np.ndarray, tick: np.ndarray, step: np.ndarray, last: int, cell: list[np.ndarray]) -> None:
    """Cells in order of arrival (``tick``, then position ``at``) into the ledger.

    Cells in time arrive as their periods end, thus in event order, and all between two late ones are opened at once.
    """
    kind = np.where(step == 0, 0, np.where(step < last, 1, 2))
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) | ((kind[1:] == 1) & (tick[1:] != tick[:-1]))) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        where = at[lo:hi]
        if kind[lo] == 2:
            ledger.refuse(where, cell[0][lo:hi])
        else:
            (ledger.open if kind[lo] == 0 else ledger.correct)(where, tuple(v[lo:hi] for v in cell))


CELL = ["n", "volume", "notional", "low", "high"]


def replay_day(c: dict[str, np.ndarray], last: int, every: int) -> dict[str, np.ndarray]:
    """The outputs of one key and day, from its cells in order of arrival."""
    periods, at = np.unique(c["period"], return_inverse=True)
    state = Ledger(len(periods), every)
    replay_span(state, at, c["tick"], c["step"], last, [c[f] for f in CELL])
    behind = slice(state.head + 1, None)  # periods of refused cells only
    state.run_n[behind], state.run_volume[behind] = (state.run_n[state.head], state.run_volume[state.head]) if state.head >= 0 else (0, 0)
    none = state.out_n == 0
    return {
        "period": periods, "n": state.out_n, "volume": state.out_volume, "notional": state.notional, "low": np.where(none, np.nan, state.low), "high": np.where(none, np.nan, state.high),
        "day_n": state.run_n, "day_volume": state.run_volume, "first_n": state.first_n, "revisions": state.revisions, "n_late": state.corrected, "n_cut_off": state.refused,
    }


def _replayed(batches: Iterator[pa.RecordBatch], period_s: int, last: int, every: int) -> Iterator[pa.RecordBatch]:
    """Days of keys out of Arrow batches sorted by key, day and arrival; only the open day's cells are held over."""
    names = ["key", "day", "period", "step", "tick", *CELL]
    held: dict[str, np.ndarray] | None = None

    def out(days: list[tuple[int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        cols = {f: np.concatenate([d[f] for _, d in days]) for f in days[0][1]}
        cols = {"key": np.repeat([k for k, _ in days], [len(d["n"]) for _, d in days]), "period_start_s": cols.pop("period") * period_s} | cols
        return pa.RecordBatch.from_arrays([pa.array(v, mask=np.isnan(v)) if k in ("low", "high") else pa.array(v) for k, v in cols.items()], names=list(cols))

    for b in batches:
        now = {f: b.column(f).to_numpy(zero_copy_only=False) for f in names}
        if held is not None:
            now = {f: np.concatenate([held[f], now[f]]) for f in names}
        key, day = now["key"], now["day"]
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (day[1:] != day[:-1])) + 1).tolist()] if len(key) else [0]
        days = [(int(key[lo]), replay_day({f: v[lo:hi] for f, v in now.items()}, last, every)) for lo, hi in zip(starts[:-1], starts[1:])]
        held = {f: v[starts[-1] :] for f, v in now.items()}
        if days:
            yield out(days)
    if held is not None and len(held["key"]):
        yield out([(int(held["key"][0]), replay_day(held, last, every))])


def replay(cell: DataFrame, period_s: int = PERIOD_S, step_s: int = STEP_S, cutoff_s: int = CUTOFF_S, every: int = 64) -> DataFrame:
    """The final aggregates of each key and period, after replaying the cells in order of arrival.

    ``n, volume, notional, low, high`` hold all records that arrived before the cut-off; ``day_n, day_volume`` run over
    the key's UTC day in event order; ``first_n`` is what was known when the period closed, ``revisions`` how often a
    replay replaced its output since, ``n_late`` and ``n_cut_off`` the records that corrected it and those that were refused. A period
    of which all records came too late is kept, with n = 0 and null prices.
    """
    if period_s % step_s or cutoff_s % step_s or 86_400 % period_s:
        raise ValueError("the step must divide the period and the cut-off, and the period the day")
    last = cutoff_s // step_s
    day = C.floor_div(F.col("period"), 86_400 // period_s)
    tick = (F.col("period") + 1) * (period_s // step_s) + F.col("step")
    by_day = cell.select("key", day.alias("day"), "period", F.col("step").cast("bigint").alias("step"), tick.alias("tick"), *CELL).repartition("key", "day")

    def run(batches):
        return _replayed(batches, period_s, last, every)

    return by_day.sortWithinPartitions("key", "day", "tick", "period").mapInArrow(run, OUT)


def trade_periods(trades: DataFrame, **how) -> DataFrame:
    """``trades`` per instrument and minute. Event time is ``ts``, or arrival less the delta; arrival is ``trade_ts_recv``, or event plus the delta."""
    return replay(trade_cells(trades, **how), **how)


def trade_cells(trades: DataFrame, **how) -> DataFrame:
    recv = F.when(F.col("trade_ts_recv") != 0, F.col("trade_ts_recv"))
    delta = F.col("trade_ts_in_delta").cast("bigint")
    first = first_arrivals(
        trades, ident=[F.col("trade_date"), F.col("trade_sequence")], key=F.col("instrument_id"), event_ns=F.coalesce(F.col("ts"), recv - delta),
        arrival_ns=F.coalesce(recv, F.col("ts") + delta), row_id=F.col("row_id"), value=F.col("trade_price"), weight=F.col("trade_size"),
    )
    return cells(first, **{k: v for k, v in how.items() if k != "every"})


def outcomes(periods: DataFrame) -> DataFrame:
    """A row for each period whose output a replay replaced, and one for each that had records refused."""
    said = F.array_compact(F.array(F.when(F.col("revisions") > 0, F.lit("corrected")), F.when(F.col("n_cut_off") > 0, F.lit("cut_off"))))
    return periods.select(F.col("key").alias("instrument_id"), "period_start_s", F.explode(said).alias("outcome"))


# ---- the same over an unbounded stream ---------------------------------------------------------------------------

STATE = "ledger binary"
STREAM_OUT = "key bigint, period_start_s bigint, n bigint, volume bigint, hour_n bigint, revision bigint, outcome string"
#: A key's hour is let go after so long without a record, in processing time. It must be above the cut-off.
IDLE_S = 86_400


def stream_periods(records: DataFrame, period_s: int = PERIOD_S, step_s: int = STEP_S, cutoff_s: int = CUTOFF_S, every: int = 16, idle_s: int | None = IDLE_S) -> DataFrame:
    """Structured Streaming form, for update mode: each batch gives the new state of every period it touched, and the latest kind of arrival in it.

    ``records``: streaming rows ``key, event, arrival, value, weight`` (nanoseconds), already one a record. State is the
    ledger of a key and UTC hour of event time, so a hot key is spread over hours: running totals, checkpoints of these and
    the outputs given out. A late record restores the checkpoint before its period and replays the hour's suffix. One
    that arrives ``cutoff_s`` or more after its period's end is refused and reported ``cut_off``. An hour without records
    for ``idle_s`` is let go; what then still comes for it can only be too late, and is reported with totals of 0.
    Spark runs batches without data for such time-outs, so a query that should end by itself (``availableNow``) takes ``idle_s=None``.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    hour_s, last = 3600, cutoff_s // step_s
    if period_s % step_s or cutoff_s % step_s or hour_s % period_s:
        raise ValueError("the step must divide the period and the cut-off, and the period the hour")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ledger: Ledger = pickle.loads(state.get[0]) if state.exists else Ledger(hour_s // period_s, every)
        pdf = pd.concat(list(batches))
        period = pdf["event"].to_numpy(np.int64) // (period_s * NS)
        late = np.clip((pdf["arrival"].to_numpy(np.int64) - (period + 1) * period_s * NS) // (step_s * NS), 0, last)
        value, weight = pdf["value"].to_numpy(float), pdf["weight"].to_numpy(np.int64)
        tick = (period + 1) * (period_s // step_s) + late
        cells = pd.DataFrame({"tick": tick, "period": period, "step": late, "n": 1, "volume": weight, "notional": value * weight, "low": value, "high": value})
        cells = cells.groupby(["tick", "period", "step"]).agg({"n": "sum", "volume": "sum", "notional": "sum", "low": "min", "high": "max"}).reset_index()
        base = key[1] * (hour_s // period_s)
        at, steps = cells["period"].to_numpy() - base, cells["step"].to_numpy()
        replay_span(ledger, at, cells["tick"].to_numpy(), steps, last, [cells[f].to_numpy() for f in CELL])
        state.update((pickle.dumps(ledger),))
        if idle_s is not None:
            state.setTimeoutDuration(idle_s * 1000)
        kind = np.zeros(hour_s // period_s, np.int64)
        np.maximum.at(kind, at, np.where(steps == 0, 0, np.where(steps < last, 1, 2)))
        touched = np.unique(at)
        yield pd.DataFrame(
            {
                "key": key[0], "period_start_s": (base + touched) * period_s, "n": ledger.out_n[touched], "volume": ledger.out_volume[touched],
                "hour_n": ledger.run_n[touched], "revision": ledger.revisions[touched], "outcome": np.array(["in_time", "corrected", "cut_off"])[kind[touched]],
            }
        )

    keyed = records.withColumn("hour", C.floor_div(F.col("event"), hour_s * NS))
    return keyed.groupBy("key", "hour").applyInPandasWithState(step, STREAM_OUT, STATE, "update", GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout)
