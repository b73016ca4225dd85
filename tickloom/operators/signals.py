"""Short row-window signals over depth rows: accelerations, order-flow trend, price impact, a scaler that is refreshed at intervals, depth ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICK = 0.25


def depth_balance(bids: Column, asks: Column, near: int = 3) -> dict[str, Column]:
    """Share of each side in all depth (0 if there is none), and bid over ask depth of the first levels (1 without asks)."""
    total = lambda c: F.aggregate(F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    b, a = total(bids), total(asks)
    nb, na = total(F.slice(bids, 1, near)), total(F.slice(asks, 1, near))
    return {"qi_bid": F.when(b + a > 0, b / (b + a)).otherwise(0.0), "qi_ask": F.when(b + a > 0, a / (b + a)).otherwise(0.0), "depth_ratio": F.when(na > 0.001, nb / na).otherwise(1.0)}


def row_lookbacks(df: DataFrame, group: list[str], order: list[str], value: str, backs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Adds ``{value}_back{n}``: the value so many rows ago, null before there are as many."""
    at = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"{value}_back{n}": F.lag(value, n).over(at) for n in backs})


def predictor(df: DataFrame, group: list[str], order: list[str], mid: str, volume: str, flow: str) -> DataFrame:
    """Adds momentum and its acceleration, volume acceleration, the trend of the flow, and the move they predict up and down, in ticks.

    A signal is 0 until it has its rows: 11 for the acceleration, 10 for the volume, 5 for momentum and trend; nothing is
    predicted before the tenth row.
    """
    at = Window.partitionBy(*group).orderBy(*order)
    span = lambda first, last: at.rowsBetween(-first, -last)
    rn = F.row_number().over(at)
    m = F.col(mid)
    df = df.withColumns(
        {
            "_rn": rn,
            "momentum": F.coalesce((m - F.lag(mid, 4).over(at)) / TICK, F.lit(0.0)),
            "momentum_acc": F.coalesce((F.lag(mid, 10).over(at) - F.lag(mid, 5).over(at)) / TICK, F.lit(0.0)),
            "volume_acc": F.when(rn >= 10, (F.sum(volume).over(span(4, 0)) - F.sum(volume).over(span(9, 5))) / 5).otherwise(0.0),
            "flow_trend": F.when(rn >= 5, F.avg(flow).over(span(2, 0)) - F.avg(flow).over(span(4, 3))).otherwise(0.0),
        }
    )
    out = {}
    for name, s in (("up", 1), ("down", -1)):
        mom, acc, trend = s * F.col("momentum"), s * F.col("momentum_acc"), s * F.col("flow_trend")
        part = lambda cond, w: F.when(cond, w).otherwise(0.0)
        strength = part(mom > 0.2, 0.3) + part(acc > 0.1, 0.3) + part(F.col("volume_acc") > 5.0, 0.2) + part(trend > 0.1, 0.2)
        move = F.least(strength * (F.greatest(mom, F.lit(0.0)) + F.greatest(acc, F.lit(0.0))), F.lit(5.0))
        out[f"move_{name}"] = F.when(F.col("_rn") >= 10, move).otherwise(0.0)
    return df.withColumns(out).drop("_rn")


def impact_ratio(df: DataFrame, group: list[str], order: list[str], mid: str, flow: str, pairs: int = 4, history: int = 50) -> DataFrame:
    """Adds ``impact``: ticks moved per change of flow over the last changes, from 0.001 to 0.05, null where the flow stood still; and ``avg_impact``, its mean over the last 50 known ones (0.01 before)."""
    at = Window.partitionBy(*group).orderBy(*order)
    dm, df_ = F.abs(F.col(mid) - F.lag(mid).over(at)) / TICK, F.abs(F.col(flow) - F.lag(flow).over(at))
    last = at.rowsBetween(-(pairs - 1), 0)
    df = df.withColumns({"_dm": dm, "_df": df_, "_rn": F.row_number().over(at)})
    moved = F.col("_df") > 0.001
    up, down = F.sum(F.when(moved, F.col("_dm")).otherwise(0.0)).over(last), F.sum(F.when(moved, F.col("_df")).otherwise(0.0)).over(last)
    df = df.withColumn("impact", F.when((F.col("_rn") > pairs) & (down > 0.001), F.least(F.greatest(up / down, F.lit(0.001)), F.lit(0.05))))
    known = Window.partitionBy(*group, F.col("impact").isNull()).orderBy(*order).rowsBetween(-(history - 1), 0)
    df = df.withColumn("_avg", F.when(F.col("impact").isNotNull(), F.avg("impact").over(known)))
    carried = F.last("_avg", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("avg_impact", F.coalesce(carried, F.lit(0.01))).drop("_dm", "_df", "_rn", "_avg")


def stale_scaler(df: DataFrame, group: list[str], order: list[str], value: str, rows: int = 500, every: int = 50) -> DataFrame:
    """Adds ``{value}_scaled``: deviation from the mean of the last rows in their population deviations (1 below 1e-6), both refreshed at every 50th row until the window is full, then at each; before the first refresh mean 0 and deviation 1."""
    at = Window.partitionBy(*group).orderBy(*order)
    last = at.rowsBetween(-(rows - 1), 0)
    rn = F.row_number().over(at)
    fresh = (rn % every == 0) | (rn >= rows)
    df = df.withColumns({"_m": F.when(fresh, F.avg(value).over(last)), "_s": F.when(fresh, F.stddev_pop(value).over(last))})
    keep = at.rowsBetween(Window.unboundedPreceding, 0)
    m, s = F.coalesce(F.last("_m", ignorenulls=True).over(keep), F.lit(0.0)), F.coalesce(F.last("_s", ignorenulls=True).over(keep), F.lit(1.0))
    return df.withColumn(f"{value}_scaled", (F.col(value) - m) / F.when(s < 1e-6, 1.0).otherwise(s)).drop("_m", "_s")


def level_imbalance(bids: Column, asks: Column, k: int) -> Column:
    b, a = F.coalesce(F.get(bids, F.lit(k)).cast("double"), F.lit(0.0)), F.coalesce(F.get(asks, F.lit(k)).cast("double"), F.lit(0.0))
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0)


def snapshot_inputs(names: list[str], bids: Column, asks: Column, spread_ticks: Column, micro_less_mid: Column, volatility: Column, streak: Column) -> dict[str, Column]:
    """Stand-ins for the inputs of a model where only a depth snapshot is at hand; an input that a snapshot says nothing about is 0.

    ``bids`` and ``asks`` are sizes of five levels, ``volatility`` the root mean square return of the last rows, ``streak``
    the length of the run of buys less that of sells. The values are raw, while a model's weights belong to scores.
    """
    imb = [level_imbalance(bids, asks, k) for k in range(3)]

    def sizes(side: Column) -> list[Column]:
        return [F.coalesce(F.get(side, F.lit(k)).cast("double"), F.lit(0.0)) for k in range(5)]

    def slope(side: Column) -> Column:
        log = [F.log(F.greatest(x, F.lit(1.0))) for x in sizes(side)]
        return sum(((k - 2) * log[k] for k in range(1, 5)), -2 * log[0]) / 10

    def concentration(side: Column) -> Column:
        x = sizes(side)
        whole = sum(x[1:], x[0])
        return F.when(whole < 1, 1.0).otherwise(sum((v * v for v in x[1:]), x[0] * x[0]) / (whole * whole))

    sign = lambda c: F.when(c < 0, -1.0).otherwise(1.0)
    known = {
        "z_imb_L1": imb[0], "z_imb_L2": imb[1], "z_imb_L3": imb[2], "z_L1_L2_disagree": -sign(imb[0]) * sign(imb[1]), "z_microprice_delta": micro_less_mid,
        "spread_ticks": spread_ticks, "z_spread": spread_ticks, "z_slope_bid": slope(bids), "z_slope_ask": slope(asks), "z_hhi_bid": concentration(bids), "z_hhi_ask": concentration(asks),
        "z_realized_vol": volatility, "ofi_L1_x_vol": imb[0] * volatility, "ofi_L1_x_spread": imb[0] * spread_ticks, "imb_L2_x_vol": imb[1] * volatility,
    }
    like = {"z_ofi_L1": imb[0], "z_signed_vol": streak, "z_twas": spread_ticks}
    part = lambda n: next((c for stem, c in like.items() if n.startswith(stem)), F.lit(0.0))
    return {n: (known[n] if n in known else part(n)).cast("double") for n in names}


def percentile_regime(df: DataFrame, group: list[str], order: list[str], vol: str, spread: str, rows: int = 100, least: int = 50, share: float = 0.7, name: str = "regime") -> DataFrame:
    """Adds a regime from where volatility and spread stand among the last rows: 0 balanced, 1 volatile, 2 wide, 3 both; balanced before ``least`` rows."""
    last = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(rows - 1), 0)
    high = lambda c: F.col(c) > F.get(F.array_sort(F.collect_list(c).over(last)), F.floor(F.count(c).over(last) * F.lit(share)).cast("int"))
    regime = high(vol).cast("int") + 2 * high(spread).cast("int")
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(last) < least, 0).otherwise(regime))


def inventory_control(inventory: Column, bid: Column, size: Column, aversion: float = 0.15, per_tick: int = 10, most_ticks: int = 3, heavy: int = 50) -> dict[str, Column]:
    """Penalty on a signal's strength, the bid moved down a tick for every ten contracts held (three at most), and the size, halved above fifty."""
    down = F.when(inventory > 0, F.least(F.floor(inventory / per_tick), F.lit(most_ticks))).otherwise(0)
    return {
        "penalty": aversion * F.abs(inventory), "skewed_bid": bid - down * TICK,
        "size": F.when(F.abs(inventory) > heavy, F.greatest(F.floor(size / 2), F.lit(1))).otherwise(size).cast("int"),
    }
