"""Option quotes: symbols, tumbling snapshots, implied volatility, greeks and the surface measures of each snapshot.

Spark has no error function, so volatilities and greeks come from Arrow functions over whole batches; everything else is
windows and aggregates over a snapshot's own quotes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions import codes as C
from tickloom.operators import temporal

NS = 1_000_000_000
#: Basis of the future over the index in points, seconds of a trading year, least quotes and prices.
BASIS, YEAR_S, LEAST_QUOTES, LEAST_VALID, LEAST_MID = 24.0, 252 * 23_400, 10, 5, 0.05
LOW_VOL, HIGH_VOL = 0.01, 5.0

#: Hart's rational approximation of the normal distribution, to double precision below the bound.
HART_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_BOUND = 7.07106781186547


def normal_cdf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    size = np.minimum(np.abs(x), 37.0)
    tail = np.polyval(HART_UP, size) / np.polyval(HART_DOWN, size)
    far = size >= HART_BOUND
    if far.any():  # a continued fraction beyond the bound
        a = size[far] if size.ndim else size
        tail = np.where(far, 0.0, tail)
        tail[far] = 1 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / math.sqrt(2 * math.pi)
    tail = np.exp(-0.5 * size * size) * tail
    return np.where(x > 0, 1 - tail, tail)


def normal_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def d1_d2(s, k, t, r, v) -> tuple[np.ndarray, np.ndarray]:
    root = v * np.sqrt(t)
    d1 = (np.log(s / k) + (r + 0.5 * v * v) * t) / (root + 1e-12)
    return d1, d1 - root


def price(s, k, t, r, v, call) -> np.ndarray:
    d1, d2 = d1_d2(s, k, t, r, v)
    sign = np.where(call, 1.0, -1.0)
    return sign * (s * normal_cdf(sign * d1) - k * np.exp(-r * t) * normal_cdf(sign * d2))


def implied_volatility(p, s, k, t, r, call, steps: int = 24) -> np.ndarray:
    """Volatility between 0.01 and 5 by halving the bracket for all rows at once, to 3e-7; NaN for bad inputs, prices below the intrinsic value plus 1e-6, or without a root."""
    p, s, k, t = (np.asarray(x, float) for x in (p, s, k, t))
    call = np.asarray(call, bool)
    out = np.full(len(p), np.nan)
    floor = np.where(call, np.maximum(s - k, 0), np.maximum(k - s, 0))
    with np.errstate(invalid="ignore"):
        ok = np.flatnonzero((t > 0) & (p > 0) & (s > 0) & (k > 0) & (p >= floor + 1e-6))
    p, s, k, t, call = p[ok], s[ok], k[ok], t[ok], call[ok]
    lo, hi = np.full(len(ok), LOW_VOL), np.full(len(ok), HIGH_VOL)
    root = (price(s, k, t, r, lo, call) - p) * (price(s, k, t, r, hi, call) - p) <= 0
    for _ in range(steps):
        mid = (lo + hi) / 2
        above = price(s, k, t, r, mid, call) > p
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    out[ok[root]] = ((lo + hi) / 2)[root]
    return out


@pandas_udf(DoubleType())
def iv(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, call: pd.Series) -> pd.Series:
    return pd.Series(implied_volatility(p, s, k, t, r.to_numpy()[0] if len(r) else 0.0, call.fillna(False)))


@pandas_udf(StructType([StructField(c, DoubleType()) for c in ("delta", "gamma", "vega", "vanna", "price")]))
def greeks(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, v: pd.Series, call: pd.Series) -> pd.DataFrame:
    s, k, t, r, v = (x.to_numpy(float) for x in (s, k, t, r, v))
    call = call.fillna(False).to_numpy(bool)
    with np.errstate(all="ignore"):
        d1, d2 = d1_d2(s, k, t, r, v)
        bad = ~np.isfinite(d1)
        cdf, pdf = normal_cdf(np.where(bad, 0.0, d1)), normal_pdf(d1)
        out = pd.DataFrame({"delta": np.where(call, cdf, cdf - 1), "gamma": pdf / (s * v * np.sqrt(t) + 1e-12), "vega": s * pdf * np.sqrt(t), "vanna": -pdf * d2 / (v + 1e-12), "price": price(s, k, t, r, np.where(bad, 1.0, v), call)})
    out[bad] = np.nan
    return out


def parse_symbol(symbol: Column) -> dict[str, Column]:
    """Root, expiry, type and strike of a 21-character option symbol; null where a part can't be read."""
    return {
        "opt_root": F.trim(F.substring(symbol, 1, 6)), "opt_expiry": F.try_to_date(F.substring(symbol, 7, 6), "yyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(symbol, 7, 6), F.lit("yyMMdd"))),
        "opt_type": F.substring(symbol, 13, 1), "opt_strike": F.substring(symbol, 14, 8).try_cast("double") / 1000,
    }


def snapshots(quotes: DataFrame, every_s: int = 60) -> DataFrame:
    """Quotes with a price, by the snapshot that closes after them: ``snap_ns`` counts from the first quote and lies before the last."""
    q = quotes.where(F.col("opt_strike").isNotNull() & F.col("opt_expiry").isNotNull() & (F.col("opt_mid") > LEAST_MID) & F.col("ts_ns").isNotNull())
    ends = q.agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).first()
    lo, hi, step = ends["lo"] or 0, ends["hi"] or 0, every_s * NS
    snap = F.lit(lo) + (C.floor_div(F.col("ts_ns") - F.lit(lo), step) + 1) * F.lit(step)
    return q.withColumn("snap_ns", snap).where(F.col("snap_ns") < hi)


def snapshot_times(quotes: DataFrame, every_s: int = 60) -> DataFrame:
    """``snap_ns`` of every snapshot between the first and the last quote, whether or not it has quotes."""
    q = quotes.where(F.col("opt_strike").isNotNull() & F.col("opt_expiry").isNotNull() & (F.col("opt_mid") > LEAST_MID) & F.col("ts_ns").isNotNull())
    ends = q.agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).first()
    lo, hi, step = ends["lo"] or 0, ends["hi"] or 0, every_s * NS
    return quotes.sparkSession.range(lo + step, hi, step).select(F.col("id").alias("snap_ns"))


def with_empty(measures: DataFrame, times: DataFrame) -> DataFrame:
    """The measures of every snapshot; one with too few quotes or without a spot has none, so that no older one stands in for it."""
    return times.join(measures, "snap_ns", "left")


def priced(snapped: DataFrame, spot: DataFrame, r: float = 0.05) -> DataFrame:
    """Snapshot quotes with ``spot`` (the future's last price less the basis), years ``t``, ``iv`` and ``rank`` of their expiry.

    ``spot`` has ``ts_ns, pos, mid``. Snapshots with fewer than ten quotes, without a spot, or with fewer than five quotes
    that live on have no quotes here; ``with_empty`` brings them back as snapshots without measures.
    """
    w = Window.partitionBy("snap_ns")
    s = snapped.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= LEAST_QUOTES).drop("_n")
    times = s.select("snap_ns").distinct().select(F.col("snap_ns").alias("ts_ns"), F.lit(1).alias("g"))
    at = temporal.backward(times, spot.withColumn("g", F.lit(1)), ["g"], "ts_ns", "pos", ["mid"])
    at = at.where(F.col("mid").isNotNull()).select(F.col("ts_ns").alias("snap_ns"), F.greatest(F.col("mid") - BASIS, F.lit(1.0)).alias("spot"))
    s = s.join(at, "snap_ns")
    left = F.unix_seconds(F.col("opt_expiry").cast("timestamp")) - F.col("snap_ns") / F.lit(float(NS))
    s = s.withColumn("t", F.greatest(left / YEAR_S, F.lit(1e-6))).where(F.col("t") > 1e-6)
    s = s.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= LEAST_VALID)
    s = s.withColumn("rank", F.dense_rank().over(w.orderBy("opt_expiry"))).withColumnRenamed("_n", "n_quotes")
    return s.withColumn("iv", F.nanvl(iv("opt_mid", "spot", "opt_strike", "t", F.lit(r), F.col("opt_type") == "C"), F.lit(None).cast("double")))


_GOOD = (0.02, 3.0)


def _mean_iv(keep: Column) -> Column:
    return F.avg(F.when(keep & (F.col("iv") > _GOOD[0]) & (F.col("iv") < _GOOD[1]), F.col("iv")))


def surface(p: DataFrame, r: float = 0.05, position: str = "ts_ns") -> DataFrame:
    """``snap_ns, atm_iv, term_slope, put_call_skew, net_gex, vanna_pressure, zero_dte_frac`` of each priced snapshot; of equally near strikes the lowest counts first, of its quotes the first by ``position``."""
    call = F.col("opt_type") == "C"
    away = Window.partitionBy("snap_ns", "rank", "opt_type").orderBy(F.abs(F.col("opt_strike") - F.col("spot")), "opt_strike", position)
    p = p.where(F.col("rank") <= 2).withColumn("_near", F.row_number().over(away))
    atm = p.groupBy("snap_ns").agg(_mean_iv(call & (F.col("_near") <= 3) & (F.col("rank") == 1)).alias("atm_iv"), _mean_iv(call & (F.col("_near") <= 3) & (F.col("rank") == 2)).alias("far_iv"))
    near = p.where(F.col("rank") == 1).join(atm, "snap_ns")
    g = greeks("spot", "opt_strike", "t", F.lit(r), "atm_iv", call)
    near = near.withColumn("_off", F.abs(g["delta"] - F.when(call, 0.25).otherwise(-0.25)))
    side = Window.partitionBy("snap_ns", "opt_type")
    usable = (F.col("atm_iv") > _GOOD[0]) & (F.col("_off") <= 0.20)
    near = near.withColumn("_k", F.min_by(F.when(usable, F.col("opt_strike")), F.when(usable, F.struct("_off", "opt_strike"))).over(side))
    near = near.withColumn("_by", F.row_number().over(side.orderBy(F.abs(F.col("opt_strike") - F.col("_k")), "opt_strike", position)))
    own = greeks("spot", "opt_strike", "t", F.lit(r), "iv", call)
    near = near.withColumns({"_gamma": own["gamma"], "_vanna": own["vanna"], "_w": F.greatest(F.coalesce(F.col("bid_sz_00").cast("double"), F.lit(1.0)), F.lit(1.0)) * F.when(call, -1.0).otherwise(1.0)})
    valid = F.col("iv") > _GOOD[0]
    skew = lambda kind: _mean_iv((F.col("opt_type") == kind) & (F.col("_by") <= 2) & F.col("_k").isNotNull())
    return near.groupBy("snap_ns").agg(
        F.max("atm_iv").alias("atm_iv"), (F.max("far_iv") - F.max("atm_iv")).alias("term_slope"), (skew("P") - skew("C")).alias("put_call_skew"),
        F.sum(F.when(valid, F.col("_gamma") * F.col("_w") * F.col("spot") * 100)).alias("net_gex"), F.sum(F.when(valid, F.col("_vanna") * F.col("_w"))).alias("vanna_pressure"),
        F.when(F.max("t") < 1 / 252, F.count("*") / F.max("n_quotes")).otherwise(F.lit(0.0)).alias("zero_dte_frac"),
    )


def aligned(trades: DataFrame, features: DataFrame, group: list[str], position: str, columns: list[str]) -> DataFrame:
    """Each trade with the last snapshot at or before it, and ``iv_change`` to the trade before (0 at the first and where either is missing)."""
    out = temporal.backward(trades, features, group, "ts_ns", "snap_id", columns)
    w = Window.partitionBy(*group).orderBy("ts_ns", position)
    return out.withColumn("iv_change", F.coalesce(F.col("atm_iv") - F.lag("atm_iv").over(w), F.lit(0.0)))
