"""Features of each trade: the shape of the book, and event-time windows over running counters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import codes as C
from tickloom.operators import book, temporal
from tickloom.sources.messages import SESSION

MS = temporal.MS
WINDOWS_MS = (10, 50, 100, 200, 500, 1000, 5000)
HORIZONS_MS = (10, 50, 100, 200, 500, 1000, 5000, 10_000)
EPS = 1e-10


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def trades(ordered: DataFrame, block: int = book.BLOCK) -> DataFrame:
    """One row a trade with the book around it and every running counter, in order of (time, message)."""
    t = temporal.positioned(book.snapshots(book.counted(ordered, block)), SESSION, "ts_ns", "n")
    at = Window.partitionBy(*SESSION).orderBy("r")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    log_mid = F.log(F.greatest("last_mid", F.lit(1e-6)))
    b1, a1 = F.col("bid_sz")[0], F.col("ask_sz")[0]
    t = t.withColumns({"b1": b1, "a1": a1, "log_ret": F.coalesce(log_mid - F.lag(log_mid).over(at), F.lit(0.0))})
    t = t.withColumns({"l1_bid_change": temporal.change("b1", SESSION, "r"), "l1_ask_change": temporal.change("a1", SESSION, "r")})
    lat = F.coalesce(F.col("ts_in_delta"), F.lit(0)).cast("double")
    total = lambda c: F.sum(c).over(upto)
    gap = F.least(F.greatest(F.coalesce(F.col("ts_ns") - F.lag("ts_ns").over(at), F.lit(0)), F.lit(0)), F.lit(60_000 * MS))
    t = t.withColumns({"_gap": gap, "_held": F.coalesce(F.lag("spread_ticks").over(at), F.lit(0)) * gap})
    return t.withColumns(
        {
            "cum_buy": total(F.when(F.col("side_code") == C.BID, F.col("size")).otherwise(0)),
            "cum_sell": total(F.when(F.col("side_code") == C.ASK, F.col("size")).otherwise(0)),
            "cum_gap": total("_gap"),
            "cum_held": total("_held"),
            "cum_sq": total(F.col("log_ret") * F.col("log_ret")),
            "cum_lat": total(lat),
            "cum_lat_sq": total(lat * lat),
            "cum_b_churn": total(F.abs("l1_bid_change")),
            "cum_a_churn": total(F.abs("l1_ask_change")),
        }
    ).drop("_gap", "_held")


def shape(t: DataFrame) -> DataFrame:
    """Point-in-time shape: imbalance, slope, curvature and concentration over five ticks a side, order counts and depth."""
    out: dict[str, Column] = {}
    for k in range(book.LEVELS):
        b, a = F.col("bid_sz")[k], F.col("ask_sz")[k]
        out[f"imb_l{k + 1}"] = ratio(b - a, b + a)
    for name in ("bid", "ask"):
        log = [F.log1p(F.col(f"{name}_sz")[k].cast("double")) for k in range(book.LEVELS)]
        out[f"{name}_slope"] = sum((log[k] * (k - 2) for k in range(1, book.LEVELS)), log[0] * -2) / (10 + EPS)
        out[f"{name}_curv"] = log[2] - 2 * log[1] + log[0]
        whole = F.aggregate(f"{name}_sz", F.lit(0).cast("bigint"), lambda x, y: x + y)
        floor = F.greatest(whole, F.lit(1))
        out[f"{name}_hhi"] = F.aggregate(f"{name}_sz", F.lit(0).cast("bigint"), lambda x, y: x + y * y) / (floor * floor)
        out[f"{name}_order_count"] = F.col(f"{name}_oc")[0]
        out[f"{name}_avg_order_size"] = ratio(F.col(f"{name}_sz")[0], F.col(f"{name}_oc")[0])
    b, a = F.col("bid_depth_l2_5"), F.col("ask_depth_l2_5")
    out["depth_imbalance"] = ratio(b - a, b + a)
    return t.withColumns(out)


def _sum(d, parts: Iterable[str]) -> Column:
    """Signed sum of counter growths, each part written ``+name`` or ``-name``."""
    out = None
    for p in parts:
        x = d(p[1:])
        out = (x if p[0] == "+" else -x) if out is None else (out + x if p[0] == "+" else out - x)
    return out


#: Families of windowed features: the counters each one reads and its columns, from ``d`` (growth of a counter) and ``n`` (trades).
def _flow(d, n, w):
    out = {"ofi": _sum(d, ["+cum_add_bid", "-cum_canc_bid", "-cum_add_ask", "+cum_canc_ask"])}
    for lv in ("L1", "L2", "deep"):
        out[f"ofi_{lv}"] = _sum(d, [f"+cum_add_bid_{lv}", f"-cum_canc_bid_{lv}", f"-cum_fill_bid_{lv}", f"-cum_add_ask_{lv}", f"+cum_canc_ask_{lv}", f"+cum_fill_ask_{lv}"])
    near, deep = _sum(d, ["+cum_canc_bid_L1", "+cum_canc_ask_L1"]), _sum(d, ["+cum_canc_bid_deep", "+cum_canc_ask_deep"])
    out["canc_L1_share"] = near / (near + deep + F.lit(EPS))
    return out


def _trade_flow(d, n, w):
    buy, sell = d("cum_buy"), d("cum_sell")
    some = F.greatest(n, F.lit(1))
    return {
        "n_trades": n, "trade_rate": n / F.lit(w / 1000), "signed_volume": buy - sell, "vol_imbalance": ratio(F.abs(buy - sell), buy + sell),
        "cancel_trade_ratio": (d("cum_n_canc_bid") + d("cum_n_canc_ask")) / some, "modify_trade_ratio": (d("cum_n_mod_bid") + d("cum_n_mod_ask")) / some,
    }


def _fills(d, n, w):
    b, a, bs, as_ = d("cum_n_fill_bid"), d("cum_n_fill_ask"), d("cum_fill_bid"), d("cum_fill_ask")
    return {"fill_asymmetry": ratio(b - a, b + a), "fill_size_asymmetry": ratio(bs - as_, bs + as_)}


def _volatility(d, n, w):
    some = F.greatest(n, F.lit(1))
    mean = d("cum_lat") / some
    return {
        "realized_vol": F.sqrt(F.greatest(d("cum_sq"), F.lit(0.0)) / some), "mean_latency_ns": mean,
        "latency_std_ns": F.sqrt(F.greatest(d("cum_lat_sq") / some - mean * mean, F.lit(0.0))),
        "resilience_bid": d("cum_b_churn") / some, "resilience_ask": d("cum_a_churn") / some,
    }


def _quotes(d, n, w):
    bu, bd, au, ad = d("cum_bid_up"), d("cum_bid_dn"), d("cum_ask_up"), d("cum_ask_dn")
    moves = F.greatest(bu + bd + au + ad, F.lit(1))
    wide, narrow = d("cum_widen"), d("cum_narrow")
    return {
        "quote_flicker": d("cum_flicker"), "bid_move_rate": (bu - bd) / moves, "ask_move_rate": (au - ad) / moves,
        "spread_widen_rate": ratio(wide, wide + narrow), "twas": F.when(d("cum_wall_time") > 0, d("cum_spread_time") / d("cum_wall_time")),
    }


def _trade_twas(d, n, w):
    """Time-weighted spread from trades alone, for streams without message counters; gaps count for a minute at most."""
    return {"trade_twas": F.when(d("cum_gap") > 0, d("cum_held") / d("cum_gap"))}


_LEVELED = [f"cum_{k}_{s}_{lv}" for k in ("add", "canc", "fill") for s in ("bid", "ask") for lv in ("L1", "L2", "deep")]
FAMILIES = {
    "flow": (_flow, ["cum_add_bid", "cum_canc_bid", "cum_add_ask", "cum_canc_ask", *_LEVELED]),
    "trades": (_trade_flow, ["cum_buy", "cum_sell", "cum_n_canc_bid", "cum_n_canc_ask", "cum_n_mod_bid", "cum_n_mod_ask"]),
    "fills": (_fills, ["cum_n_fill_bid", "cum_n_fill_ask", "cum_fill_bid", "cum_fill_ask"]),
    "volatility": (_volatility, ["cum_sq", "cum_lat", "cum_lat_sq", "cum_b_churn", "cum_a_churn"]),
    "trade_twas": (_trade_twas, ["cum_gap", "cum_held"]),
    "quotes": (_quotes, ["cum_flicker", "cum_bid_up", "cum_bid_dn", "cum_ask_up", "cum_ask_dn", "cum_widen", "cum_narrow", "cum_spread_time", "cum_wall_time"]),
}


def windowed(t: DataFrame, windows_ms: Iterable[int] = WINDOWS_MS, families: Iterable[str] = tuple(FAMILIES), depletion: bool = True) -> DataFrame:
    """Adds ``{feature}_{w}ms`` of the families for each window; all windows share the one order of the session."""
    windows, families = list(windows_ms), list(families)
    needed = sorted({c for f in families for c in FAMILIES[f][1]} | ({"b1", "a1"} if depletion else set()))
    t = temporal.as_of_window_start(t, SESSION, "ts_ns", "r", needed, [w * MS for w in windows])
    out = {}
    for w in windows:
        d = lambda c, w=w: temporal.delta(c, w * MS)
        n = temporal.delta("r", w * MS)
        for f in families:
            out |= {f"{name}_{w}ms": c for name, c in FAMILIES[f][0](d, n, w).items()}
        if depletion:
            out |= {f"{s}_depletion_{w}ms": F.coalesce(F.col(f"_w{w * MS}.{c}"), F.lit(0)) - F.col(c) for s, c in (("bid", "b1"), ("ask", "a1"))}
    return t.withColumns(out).drop(*[f"_w{w * MS}" for w in windows])


def forward_returns(t: DataFrame, horizons_ms: Iterable[int] = HORIZONS_MS) -> DataFrame:
    """Adds ``fwd_return_{h}ms`` of the mid and ``fwd_mp_{h}ms`` of the microprice: the first trade at or after the horizon less now; null past the end."""
    for h in horizons_ms:
        t = temporal.forward(t, SESSION, "ts_ns", "r", ["last_mid", "microprice"], h * MS, "_f")
        t = t.withColumns({f"fwd_return_{h}ms": F.col("_f.last_mid") - F.col("last_mid"), f"fwd_mp_{h}ms": F.col("_f.microprice") - F.col("microprice")}).drop("_f")
    return t
