"""Event-driven execution of resting quotes on level-0 rows, and the window measures around it.

One symbol and day is a state machine: quotes join the back of the queue at the best prices, trades at or through a
price work the queue off, a move of the mid, a toxic quote or a bid that comes near a short one cancels, positions
close after a number of rows or seconds. State passes from batch to batch of an ordered stream, so a task holds its open
orders and positions and the last 1,000 rows' readings at most.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import codes as C

TICK = 0.25
NS = 1_000_000_000


@dataclass(frozen=True)
class Toxicity:
    """Logistic model of an adverse move from level-0 readings: weights, then ``(mean, scale)`` until enough rows are seen.

    The defaults are those the reference falls back on without model files.
    """

    bias: float = 0.45
    weights: tuple[float, ...] = (0.15, 0.25, 0.20, 0.12)  # spread, imbalance, momentum, volatility
    scales: tuple[tuple[float, float], ...] = ((0.5, 0.3), (0.0, 0.3), (0.0, 0.5), (0.001, 0.002))
    ask_share: tuple[float, float, float] = (0.0, 0.5, 0.3)  # weight, mean, scale
    boost: float = 1.15
    above: float = 0.65  # nats


@dataclass(frozen=True)
class Rules:
    """Parameters of the state machine."""

    size: int = 1
    max_orders: int = 2
    hold_rows: int = 50
    hold_ns: int = 10 * NS
    cancel_ticks: float = 0.1
    safe_queue: float = 5.0
    max_spread_ticks: float = 20.0
    gap_ticks: float = 5.0
    toxic: float = 0.99
    toxicity: Toxicity = Toxicity()
    near_ns: int = 50_000_000  # in which rising bids cancel a short quote
    compat: bool = False  # count a full fill twice in the queue, and sell timed-out longs at the ask


OUT = "symbol string, day bigint, kind string, side int, opened_ns bigint, closed_ns bigint, price double, exit_price double, pnl_ticks double, mae double, mfe double, rows_held bigint, first_tick_row bigint, first_tick_mae double, reason string"
_TYPES = pa.schema(
    [("symbol", pa.string()), ("day", pa.int64()), ("kind", pa.string()), ("side", pa.int32()), ("opened_ns", pa.int64()), ("closed_ns", pa.int64()), ("price", pa.float64()), ("exit_price", pa.float64()), ("pnl_ticks", pa.float64()), ("mae", pa.float64()), ("mfe", pa.float64()), ("rows_held", pa.int64()), ("first_tick_row", pa.int64()), ("first_tick_mae", pa.float64()), ("reason", pa.string())]
)


class Readings:
    """Spread, imbalance, momentum and volatility of the rows so far of one symbol and day, standardised by their last 500 values."""

    WINDOW, EVERY = 500, 50

    def __init__(self, model: Toxicity):
        self.model = model
        self.mids: deque[float] = deque(maxlen=20)
        self.squares: deque[float] = deque(maxlen=99)  # of the mid's returns
        self.kept, self.at, self.n = np.zeros((4, 2 * self.WINDOW)), 0, 0
        self.mean, self.scale = [0.0] * 4, [1.0] * 4
        self.now: tuple[float, ...] = ()
        self.ask_share = 0.0

    def add(self, bid: float, ask: float, bid_sz: float, ask_sz: float) -> None:
        mid = (bid + ask) / 2
        if self.mids:
            self.squares.append(((mid - self.mids[-1]) / self.mids[-1]) ** 2)
        self.mids.append(mid)
        if len(self.mids) < 10:
            return
        m, depth = list(self.mids), bid_sz + ask_sz
        momentum = (sum(m[-5:]) / 5 - sum(m) / 20) / TICK if len(m) == 20 else 0.0
        self.ask_share = ask_sz / depth if depth > 0 else 0.0
        self.now = (ask - bid, (bid_sz - ask_sz) / depth if depth > 0 else 0.0, momentum, math.sqrt(sum(self.squares) / len(self.squares)))
        if self.at == self.kept.shape[1]:
            self.kept[:, : self.WINDOW] = self.kept[:, self.WINDOW :]
            self.at = self.WINDOW
        self.kept[:, self.at] = self.now
        self.at, self.n = self.at + 1, min(self.n + 1, self.WINDOW)
        if self.n < self.WINDOW and self.n % self.EVERY == 0:
            self.measure()

    def measure(self) -> None:
        x = self.kept[:, self.at - self.n : self.at]
        mean = np.add.reduce(x, axis=1) / self.n
        x = x - mean[:, None]
        sd = [math.sqrt(v / self.n) for v in np.einsum("ij,ij->i", x, x).tolist()]
        self.mean, self.scale = mean.tolist(), [1.0 if v < 1e-6 else v for v in sd]

    def toxic(self) -> tuple[float, float]:
        """The probabilities for a quote on the bid and on the ask."""
        if not self.now:
            return 0.5, 0.5
        m = self.model
        if self.n == self.WINDOW:  # from here on the reference measures at every row
            self.measure()
        by = zip(self.mean, self.scale) if self.n >= self.EVERY else m.scales
        spread, imb, momentum, vol = (w * (x - mean) / sd for x, w, (mean, sd) in zip(self.now, m.weights, by))
        w, mean, sd = m.ask_share
        rest = m.bias + spread + vol + w * (self.ask_share - mean) / sd
        return self.probability(rest - imb - momentum), self.probability(rest + imb + momentum)

    def probability(self, logit: float) -> float:
        p = 1 / (1 + math.exp(-max(min(logit, 700.0), -700.0)))
        if 0.001 < p < 0.999 and -p * math.log(p) - (1 - p) * math.log(1 - p) > self.model.above:
            p = min(p * self.model.boost, 1.0)
        return p

    def deviation(self) -> float:
        """Of the last ten mids, in ticks; 0 before there are ten."""
        if len(self.mids) < 10:
            return 0.0
        m = list(self.mids)[-10:]
        mean = sum(m) / 10
        return math.sqrt(sum((x - mean) ** 2 for x in m) / 10) / TICK


class Desk:
    """Orders and positions of one symbol and day."""

    def __init__(self, symbol: str, day: int, rules: Rules):
        self.symbol, self.day, self.rules = symbol, day, rules
        self.orders: list[list] = []  # side, price, queue ahead, left, placed
        self.positions: list[list] = []  # side, price, opened, mae, mfe, rows, row and mae at the first gain of a tick
        self.readings = Readings(rules.toxicity)
        self.bids: deque[tuple[int, float]] = deque()
        self.mid: float | None = None
        self.last_trade: float | None = None

    def row(self, kind, side, opened, closed, price, exit_price, pnl=None, mae=None, mfe=None, rows=None, first=None, first_mae=None, reason=None) -> tuple:
        return (self.symbol, self.day, kind, side, opened, closed, price, exit_price, pnl, mae, mfe, rows, first, first_mae, reason)

    def near(self, placed: int) -> bool:
        """Whether the bids since a short quote was placed, of the last 50 ms, all rise, or end two ticks above the first."""
        b = [x for t, x in self.bids if t >= placed]
        return len(b) > 1 and (all(y > x + 0.01 for x, y in zip(b, b[1:])) or (b[-1] - b[0]) / TICK >= 2)

    def step(self, ts: int, bid: float, ask: float, bid_sz: float, ask_sz: float, trade: float, size: float) -> list[tuple]:
        out, r = [], self.rules
        if not (bid > 0 and ask > bid):
            return out
        mid, spread = (bid + ask) / 2, (ask - bid) / TICK
        move = 0.0 if self.mid is None else (mid - self.mid) / TICK
        self.mid = mid
        self.readings.add(bid, ask, max(bid_sz, 0.0), max(ask_sz, 0.0))
        self.bids.append((ts, bid))
        while ts - self.bids[0][0] > r.near_ns:
            self.bids.popleft()
        if spread <= r.max_spread_ticks:
            for side, price, depth in ((0, bid, bid_sz), (1, ask, ask_sz)):
                mine = [o for o in self.orders if o[0] == side]
                if len(mine) < r.max_orders and all(o[1] != price for o in mine):
                    self.orders.append([side, price, max(depth, 0.0), float(r.size), ts])
        if trade > 0 and size > 0:
            jump = self.last_trade is not None and abs(trade - self.last_trade) > r.gap_ticks * TICK
            self.last_trade = trade
            if not jump:
                for o in self.orders:
                    through = trade < o[1] if o[0] == 0 else trade > o[1]
                    if not through and trade != o[1]:
                        continue
                    done = o[3] if through else max(0.0, min(o[3], size - o[2]))
                    o[2] = max(0.0, o[2] - size * (2 if r.compat else 1))
                    o[3] -= done
                    if done > 0:
                        self.positions.append([1 - 2 * o[0], o[1], ts, 0.0, 0.0, 0, None, None])
                self.orders = [o for o in self.orders if o[3] > 0]
        kept, toxic = [], None
        for o in self.orders:
            against, reason = -move if o[0] == 0 else move, None
            if o[0] == 1 and self.near(o[4]):
                reason = "near"
            elif o[2] > r.safe_queue:
                if against >= r.cancel_ticks:
                    reason = "move"
                else:
                    toxic = toxic or self.readings.toxic()
                    reason = "toxic" if toxic[o[0]] >= r.toxic else None
            if reason:
                out.append(self.row("cancel", 1 - 2 * o[0], o[4], ts, o[1], mid, reason=reason))
            else:
                kept.append(o)
        self.orders = kept
        held = []
        for p in self.positions:
            gain = p[0] * (mid - p[1]) / TICK
            p[3], p[4], p[5] = min(p[3], gain), max(p[4], gain), p[5] + 1
            if p[6] is None and gain >= 1:
                p[6], p[7] = p[5], p[3]
            if p[5] >= r.hold_rows or ts - p[2] >= r.hold_ns:
                out.append(self.close(p, ts, bid, ask, spread))
            else:
                held.append(p)
        self.positions = held
        return out

    def close(self, p: list, ts: int, bid: float, ask: float, spread: float) -> tuple:
        slip = min(2.0, 0.1 * spread + 0.05 * self.readings.deviation()) * TICK
        long = p[0] > 0
        exit_price = ((ask + slip) if long else (bid - slip)) if self.rules.compat else ((bid - slip) if long else (ask + slip))
        return self.row("trade", p[0], p[2], ts, p[1], exit_price, p[0] * (exit_price - p[1]) / TICK, p[3], p[4], p[5], *((p[5], p[3]) if p[6] is None else p[6:]))

    def left(self) -> list[tuple]:
        """Positions still open, with what they went through so far."""
        return [self.row("open", p[0], p[2], None, p[1], None, None, *p[3:]) for p in self.positions]


def simulate(market: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Closed trades, cancelled orders and positions left open (``kind``: trade, cancel, open) of every symbol and UTC day.

    Rows without a two-sided, uncrossed quote change nothing; of rows of one symbol and time the first counts; missing
    trades, sizes and NaN count as 0; rows without symbol or time are left out. Orders that rest at the end of a day lapse unlisted.

    ``reason`` of a cancel is move, toxic or near; the last one asks not where in the queue the order is. Its cooldown in
    the reference is kept by order, and a cancelled order never comes back, so there is nothing for it to hold up.
    ``first_tick_row`` counts the rows held up to the first gain of a tick, with the adverse excursion by then; a trade
    without such a gain has its own length and excursion there, an open position null. Gains are measured at the mid.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
    day = C.floor_div(F.col("timestamp_ns"), 86_400 * NS).alias("day")
    cols = ["bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "trade_price", "trade_size"]
    rows = market.where(F.col("symbol").isNotNull() & F.col("timestamp_ns").isNotNull()).select("symbol", day, "timestamp_ns", "row_id", *[zero(c) for c in cols])
    rows = rows.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "timestamp_ns", "row_id")

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TYPES)], schema=_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        desk, last = None, None
        for b in batches:
            out: list[tuple] = []
            for symbol, d, ts, *x in zip(*[b.column(c).to_pylist() for c in ("symbol", "day", "timestamp_ns", *cols)]):
                if desk is None or (desk.symbol, desk.day) != (symbol, d):
                    out += desk.left() if desk else []
                    desk, last = Desk(symbol, d, rules), None
                if ts != last:
                    out += desk.step(ts, *x)
                last = ts
            if out:
                yield batch(out)
        if desk and desk.positions:
            yield batch(desk.left())

    return rows.mapInArrow(run, OUT)


def kpis(closed: DataFrame) -> DataFrame:
    """Per side: trades, win rate, mean and Sharpe (per trade, sample deviation, times the root of 252), excursions, positions left open."""
    trade = F.col("kind") == "trade"
    p = F.when(trade, F.col("pnl_ticks"))
    sd = F.stddev_samp(p)
    t = closed.where(F.col("kind").isin("trade", "open")).groupBy("side")
    return t.agg(F.count_if(trade).alias("n"), F.avg((p > 0).cast("double")).alias("win_rate"), F.sum(p).alias("pnl_ticks"), F.when(sd > 0, F.avg(p) / sd * np.sqrt(252)).alias("sharpe"), *[F.avg(F.when(trade, F.col(c))).alias(f"mean_{c}") for c in ("mae", "mfe")], F.count_if(~trade).alias("n_open"))


def streaks(df: DataFrame, group: list[str], order: list[str], value: Column, name: str = "streak") -> DataFrame:
    """Adds the length so far of the run of equal values that a row ends."""
    at = Window.partitionBy(*group).orderBy(*order)
    new = F.coalesce((F.lag("_v").over(at) != F.col("_v")), F.lit(True)).cast("int")
    df = df.withColumn("_v", value).withColumn("_new", new)
    df = df.withColumn("_run", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group, "_run").orderBy(*order))).drop("_v", "_new", "_run")


def hindsight(df: DataFrame, group: list[str], order: list[str], value: str, after: tuple[int, ...] = (10, 20, 40)) -> DataFrame:
    """Adds the greatest rise and fall of ``value`` over each number of rows that follow."""
    at = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"{k}_{n}": fn(value).over(at.rowsBetween(1, n)) - F.col(value) for n in after for k, fn in (("rise", F.max), ("fall", F.min))})


def cancel_hindsight(result: DataFrame, marked: DataFrame, symbol: str, time: str, columns: list[str]) -> DataFrame:
    """Cancelled orders of ``simulate`` with what the mid did after: ``columns`` of the row of the cancel (see ``hindsight``)."""
    m = marked.select(F.col(symbol).alias("_symbol"), F.col(time).alias("_t"), *columns)
    c = result.where(F.col("kind") == "cancel").select("symbol", "day", "side", "opened_ns", F.col("closed_ns").alias("cancelled_ns"), "price", "reason")
    return c.join(m, (F.col("symbol") == F.col("_symbol")) & (F.col("cancelled_ns") == F.col("_t"))).drop("_symbol", "_t")


def entry_means(df: DataFrame, group: list[str], order: list[str], side: str, columns: list[str], every: int = 20) -> DataFrame:
    """``side, n`` and the mean of each column over every so many entries of a side in each group."""
    s = systematic_sample(df.where(F.col(side).isNotNull()), [*group, side], order, every)
    return s.groupBy(side).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def systematic_sample(df: DataFrame, group: list[str], order: list[str], every: int = 20) -> DataFrame:
    """Every so many rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") % every == 0).drop("_k")


def rolling_share(df: DataFrame, group: list[str], order: list[str], cond: Column, rows: int = 1000, name: str = "share") -> DataFrame:
    """Adds the share of the last so many rows for which the condition holds, from the running count now and as many rows ago."""
    at = Window.partitionBy(*group).orderBy(*order)
    upto = F.count_if(F.coalesce(cond, F.lit(False))).over(at.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_upto": upto, "_rn": F.row_number().over(at)})
    return df.withColumn(name, (F.col("_upto") - F.coalesce(F.lag("_upto", rows).over(at), F.lit(0))) / F.least("_rn", F.lit(rows))).drop("_upto", "_rn")


def rebuilt_quotes(mid: Column, spread_ticks: Column, levels: int = 10) -> dict[str, Column]:
    """Bid and ask prices of ten levels about a mid, one tick apart."""
    return {f"{s}_px_{k:02d}": mid + (d * (spread_ticks * TICK / 2 + k * TICK)) for s, d in (("bid", -1), ("ask", 1)) for k in range(levels)}
