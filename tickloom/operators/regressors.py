"""The catalogue of model inputs: weighted z-scores of features, differences of them, and products scored again.

Two passes of the weighted scan cover everything: one over all plain columns and the terms of the price impact, one over
the products and the impact itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import temporal
from tickloom.operators.ewm import ewm, impact, zscore
from tickloom.sources.messages import SESSION

FAST, SLOW = 500.0, 5000.0
WINDOWS_MS = (10, 50, 100, 200, 500, 1000, 5000)

#: The inputs of an exported model, in the order of its weights.
NAMES = (
    "z_ofi_L1_10ms z_ofi_L1_50ms z_ofi_L1_100ms z_ofi_L1_200ms z_ofi_L1_500ms z_ofi_L1_1000ms z_ofi_L1_5000ms z_ofi_L2_500ms z_ofi_L2_5000ms z_ofi_deep_500ms z_ofi_deep_5000ms "
    "z_imb_L1 z_imb_L2 z_imb_L3 z_L1_L2_disagree z_microprice_delta z_vol_imbalance_500ms z_vol_imbalance_5000ms z_kyle_lambda z_trade_accel z_trade_rate "
    "z_cancel_ratio_500ms z_canc_L1_share_500ms spread_ticks z_spread z_flicker_50ms z_flicker_200ms z_flicker_1000ms z_bid_move_200ms z_ask_move_200ms z_bid_move_1000ms z_ask_move_1000ms "
    "z_widen_rate_200ms z_widen_rate_1000ms z_twas_500ms z_twas_5000ms z_slope_bid z_slope_ask z_curv_bid z_curv_ask z_hhi_bid z_hhi_ask z_avg_ord_sz_bid z_avg_ord_sz_ask "
    "z_net_depletion_50ms z_net_depletion_500ms z_modify_rate_500ms z_realized_vol z_signed_vol_500ms z_signed_vol_5000ms z_resilience_bid_500ms z_resilience_ask_500ms z_fill_asym_500ms z_latency "
    "ofi_L1_x_vol ofi_L1_x_spread imb_L2_x_vol slope_x_accel flicker_x_vol widen_x_ofi"
).split()
#: Features behind the inputs of a window, by the input's name without it.
WINDOWED = {
    "z_ofi_L1": "ofi_L1", "z_ofi_L2": "ofi_L2", "z_ofi_deep": "ofi_deep", "z_vol_imbalance": "vol_imbalance", "z_cancel_ratio": "cancel_trade_ratio", "z_canc_L1_share": "canc_L1_share",
    "z_flicker": "quote_flicker", "z_bid_move": "bid_move_rate", "z_ask_move": "ask_move_rate", "z_widen_rate": "spread_widen_rate", "z_twas": "twas", "z_modify_rate": "modify_trade_ratio",
    "z_signed_vol": "signed_volume", "z_resilience_bid": "resilience_bid", "z_resilience_ask": "resilience_ask", "z_fill_asym": "fill_asymmetry",
}
LONG_MEMORY = ("z_spread", "z_latency", "z_twas")


def _features() -> dict[str, Column]:
    """Expressions of the inputs that aren't one windowed feature."""
    c = F.col
    sided = {"slope": "slope", "curv": "curv", "hhi": "hhi", "avg_ord_sz": "avg_order_size"}
    return {f"z_{k}_{s}": c(f"{s}_{f}") for k, f in sided.items() for s in ("bid", "ask")} | {f"z_imb_L{k}": c(f"imb_l{k}") for k in (1, 2, 3)} | {
        "z_L1_L2_disagree": -F.signum("imb_l1") * F.signum("imb_l2"), "z_microprice_delta": temporal.change("microprice", SESSION, "r"),
        "z_trade_accel": F.log1p("trade_rate_50ms") - F.log1p("trade_rate_5000ms"), "z_trade_rate": c("trade_rate_500ms"), "z_spread": c("spread_ticks"),
        "z_realized_vol": c("realized_vol_500ms"), "z_latency": c("mean_latency_ns_500ms"),
    }


def _plain() -> dict[str, tuple[Column, float]]:
    """Name, expression over the features, and halflife of every input that is one z-score."""
    own, out = _features(), {}
    for name in NAMES:
        stem, _, window = name.rpartition("_")
        if stem in WINDOWED:
            e = F.col(f"{WINDOWED[stem]}_{window}")
        elif stem == "z_net_depletion":
            e = F.col(f"bid_depletion_{window}") - F.col(f"ask_depletion_{window}")
        elif name in own:
            e = own[name]
        else:
            continue
        out[name] = (e, SLOW if name.startswith(LONG_MEMORY) else FAST)
    return out


def inputs_like(columns: list[str], stems: tuple[str, ...] = ("z_",)) -> list[str]:
    """The columns that are scores by their names, and the products of such, in the columns' order."""
    return [c for c in columns if c.startswith(stems) or c in PRODUCTS]


#: Products of inputs, scored again.
PRODUCTS = {
    "ofi_L1_x_vol": ("z_ofi_L1_500ms", "z_realized_vol"), "ofi_L1_x_spread": ("z_ofi_L1_500ms", "z_spread"), "imb_L2_x_vol": ("z_imb_L2", "z_realized_vol"),
    "slope_x_accel": ("_slope", "z_trade_accel"), "flicker_x_vol": ("z_flicker_200ms", "z_realized_vol"), "widen_x_ofi": ("z_widen_rate_200ms", "z_ofi_L1_500ms"),
}


def catalogue(t: DataFrame, restart_daily: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Session, ``n``, ``ts_ns``, every model input and the columns to ``keep`` of each trade with windowed features; missing inputs count as 0.

    Only what the inputs need goes through the two scans, so the many feature columns are pruned before their checkpoints.

    The weighted statistics run over an instrument's whole history, or with ``restart_daily`` start anew each session.
    """
    group = SESSION if restart_daily else ["instrument_id"]
    order = ["ts_ns", "n"] if restart_daily else ["trade_date", "ts_ns", "n"]
    plain = _plain()
    inputs = {k: F.coalesce(e.cast("double"), F.lit(0.0)) for k, (e, _) in plain.items()} | {"dmid": temporal.change("last_mid", SESSION, "r"), "_flow": F.col("ofi_L1_500ms").cast("double")}
    t = t.select(*SESSION, "n", "ts_ns", "spread_ticks", *keep, *[e.alias(k) for k, e in inputs.items()])
    t = t.withColumn("_xy", F.col("dmid") * F.col("_flow"))
    t = ewm(t, group, order, {k: h for k, (_, h) in plain.items()} | {"_xy": FAST, "_flow": FAST}, complete=True)
    t = t.withColumn("kyle_lambda", impact("_xy", "_flow")).withColumns({k: zscore(k) for k in plain})
    t = t.drop("_xy", "_flow", "dmid", *[f"{k}_{x}" for k in [*plain, "_xy", "_flow"] for x in ("mean", "var")])
    t = t.withColumn("_slope", (F.col("z_slope_bid") + F.col("z_slope_ask")) / 2)
    t = t.withColumns({k: F.col(a) * F.col(b) for k, (a, b) in PRODUCTS.items()})
    t = ewm(t, group, order, dict.fromkeys(PRODUCTS, FAST) | {"kyle_lambda": SLOW}, complete=True)
    t = t.withColumn("z_kyle_lambda", zscore("kyle_lambda")).withColumns({k: zscore(k) for k in PRODUCTS})
    return t.drop("_slope", *[f"{k}_{x}" for k in [*PRODUCTS, "kyle_lambda"] for x in ("mean", "var")])
