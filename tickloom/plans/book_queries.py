"""Queries of the order book and its features with their DuckDB twins; the twins find the live orders of each message by a range join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.cluster import tables
from tickloom.functions import codes as C
from tickloom.operators import analysis, book, features, models, signals, temporal
from tickloom.sources import messages as M

WINDOWS = (1000, 60_000, 600_000)
HORIZONS = (1000, 60_000)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ORDER = """
WITH d AS (
  SELECT * FROM mbo_messages WHERE sequence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date, instrument_id, sequence ORDER BY seq) = 1),
m AS (
  SELECT trade_date AS d, instrument_id AS i, row_number() OVER (PARTITION BY trade_date, instrument_id ORDER BY sequence) AS n, order_id AS o,
         coalesce(ts_ns, nullif(ts_recv, 0)) AS ts, coalesce(ts_recv, 0) AS recv, ts_in_delta, sequence, flags, coalesce(size, 0) AS size,
         CASE upper(action) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'M' THEN 2 WHEN 'T' THEN 3 WHEN 'F' THEN 4 WHEN 'R' THEN 5 ELSE 6 END AS act,
         CASE upper(side) WHEN 'B' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS s,
         CASE WHEN price IS NULL OR (cast(price AS VARCHAR) = 'nan') OR isinf(price) THEN 0 ELSE cast(round_even(price / 0.25, 0) AS BIGINT) END AS px FROM d),
e AS (
  SELECT *, CASE WHEN act IN (0, 2) AND px > 0 AND s < 2 AND size > 0 THEN 1 WHEN act = 2 AND px > 0 THEN 2 WHEN act = 1 THEN 2 WHEN act = 4 THEN 3 WHEN act = 5 THEN 4 END AS kind FROM m),
c AS (
  SELECT *, count(*) FILTER (WHERE kind = 4) OVER (PARTITION BY d, i ORDER BY n) AS ep,
         min(CASE WHEN kind = 4 THEN n END) OVER (PARTITION BY d, i ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cleared FROM e),
g AS (SELECT *, count(*) FILTER (WHERE kind < 3) OVER w AS gen, lead(n) OVER w AS nxt FROM c WHERE kind < 4 WINDOW w AS (PARTITION BY d, i, ep, o ORDER BY n)),
l AS (
  SELECT *, first_value(kind) OVER w AS k0, first_value(px) OVER w AS px0, first_value(s) OVER w AS s0, first_value(size) OVER w AS z0,
         sum(CASE WHEN kind = 3 THEN greatest(size, 0) ELSE 0 END) OVER w AS filled FROM g WHERE gen > 0 WINDOW w AS (PARTITION BY d, i, ep, o, gen ORDER BY n)),
st AS (SELECT d, i, o, n, least(nxt, cleared) AS until, px0 AS px, s0 AS s, cast(z0 - filled AS BIGINT) AS remaining FROM l WHERE k0 = 1 AND z0 > filled)
"""
_BOOK = _ORDER + """,
b0 AS (
  SELECT m.d, m.i, m.n, max(st.px) FILTER (WHERE st.s = 0) AS bid, min(st.px) FILTER (WHERE st.s = 1) AS ask
  FROM m LEFT JOIN st ON m.d = st.d AND m.i = st.i AND st.n <= m.n AND (st.until IS NULL OR m.n < st.until) GROUP BY 1, 2, 3),
b AS (SELECT m.*, bid, ask, lag(bid) OVER w AS bid0, lag(ask) OVER w AS ask0, lag(ts) OVER w AS ts0 FROM m JOIN b0 USING (d, i, n) WINDOW w AS (PARTITION BY d, i ORDER BY n)),
f0 AS (
  SELECT d, i, n, ts, 'bid' AS which, cast(sign(bid - bid0) AS INT) AS dir FROM b WHERE bid <> bid0
  UNION ALL SELECT d, i, n, ts, 'ask', cast(sign(ask - ask0) AS INT) FROM b WHERE ask <> ask0),
f AS (SELECT *, CASE WHEN lag(dir) OVER w = -dir AND ts - lag(ts) OVER w <= 50000000 THEN 1 ELSE 0 END AS flicker FROM f0 WINDOW w AS (PARTITION BY d, i, which ORDER BY n)),
ff AS (SELECT d, i, n, sum(flicker) AS flick FROM f GROUP BY 1, 2, 3),
o AS (
  SELECT b.*, coalesce(flick, 0) AS flick, CASE WHEN px <= 0 THEN 99 WHEN s = 0 THEN coalesce(bid0 - px, 0) WHEN s = 1 THEN coalesce(px - ask0, 0) ELSE 99 END AS off,
         ask - bid AS sp, ask0 - bid0 AS sp0, greatest(ts - ts0, 0) AS dt FROM b LEFT JOIN ff USING (d, i, n))
"""


def _run(cond: str, value: str = "1") -> str:
    return f"cast(sum(CASE WHEN {cond} THEN {value} ELSE 0 END) OVER w AS BIGINT)"


def _counter_sql() -> dict[str, str]:
    out = {}
    for s, name in enumerate(("bid", "ask")):
        on = f"s = {s}"
        out |= {
            f"cum_add_{name}": _run(f"{on} AND act = 0", "size"), f"cum_canc_{name}": _run(f"{on} AND act = 1", "size"), f"cum_fill_{name}": _run(f"{on} AND act = 4", "size"),
            f"cum_n_canc_{name}": _run(f"{on} AND act = 1"), f"cum_n_mod_{name}": _run(f"{on} AND act = 2"), f"cum_n_fill_{name}": _run(f"{on} AND act = 4"),
        }
        for lv, off in (("L1", "off <= 0"), ("L2", "off = 1"), ("deep", "off > 1")):
            out |= {
                f"cum_add_{name}_{lv}": _run(f"{on} AND {off} AND act IN (0, 2)", "size"), f"cum_canc_{name}_{lv}": _run(f"{on} AND {off} AND act IN (1, 2)", "size"),
                f"cum_fill_{name}_{lv}": _run(f"{on} AND {off} AND act = 4", "size"),
            }
        out |= {f"cum_{name}_up": _run(f"{name} > {name}0"), f"cum_{name}_dn": _run(f"{name} < {name}0")}
    out |= {"cum_widen": _run("sp0 > 0 AND sp > sp0"), "cum_narrow": _run("sp0 > 0 AND sp > 0 AND sp < sp0")}
    return out | {"cum_spread_time": _run("sp0 > 0", "sp0 * dt"), "cum_wall_time": _run("dt > 0", "dt"), "cum_flicker": _run("flick > 0", "flick")}


_CUM = _counter_sql()
_COUNTED = _BOOK + ",\nk AS (SELECT *, " + ",\n".join(f"{v} AS {c}" for c, v in _CUM.items()) + "\nFROM o WINDOW w AS (PARTITION BY d, i ORDER BY n ROWS UNBOUNDED PRECEDING))"
_LV = ",\n".join(f"coalesce(sum(st.remaining) FILTER (WHERE st.s = {s} AND st.px = {p} {sg} {k}), 0) AS {n}{k + 1}, count(*) FILTER (WHERE st.s = {s} AND st.px = {p} {sg} {k}) AS {n}c{k + 1}" for s, n, p, sg in ((0, "b", "t.bid", "-"), (1, "a", "t.ask", "+")) for k in range(5))
_TRADES = _COUNTED + f""",
t0 AS (
  SELECT t.d, t.i, t.n, {_LV}, count(DISTINCT st.px) FILTER (WHERE st.s = 0) AS bid_levels, count(DISTINCT st.px) FILTER (WHERE st.s = 1) AS ask_levels,
         coalesce(sum(st.remaining) FILTER (WHERE st.s = 0), 0) AS bid_total, coalesce(sum(st.remaining) FILTER (WHERE st.s = 1), 0) AS ask_total
  FROM k t LEFT JOIN st ON t.d = st.d AND t.i = st.i AND st.n <= t.n AND (st.until IS NULL OR t.n < st.until) WHERE t.act = 3 GROUP BY t.d, t.i, t.n),
t1 AS (
  SELECT k.*, t0.* EXCLUDE (d, i, n), CASE WHEN ask > bid THEN cast(bid + ask AS DOUBLE) * 0.125 END AS mid, CASE WHEN ask > bid THEN ask - bid ELSE 0 END AS spread FROM k JOIN t0 USING (d, i, n)),
t2 AS (
  SELECT *, coalesce(last_value(mid IGNORE NULLS) OVER (PARTITION BY d, i ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS last_mid,
         row_number() OVER (PARTITION BY d, i ORDER BY ts, n) AS r FROM t1),
t3 AS (
  SELECT *, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL AND b1 + a1 > 0 THEN (ask * 0.25 * b1 + bid * 0.25 * a1) / (a1 + b1) ELSE last_mid END AS micro,
         least(greatest(coalesce(ts - lag(ts) OVER w, 0), 0), 60000000000) AS gap, coalesce(lag(spread) OVER w, 0) * least(greatest(coalesce(ts - lag(ts) OVER w, 0), 0), 60000000000) AS held,
         CASE WHEN lag(last_mid) OVER w IS NULL THEN 0 ELSE ln(greatest(last_mid, 1e-6)) - ln(greatest(lag(last_mid) OVER w, 1e-6)) END AS lr,
         coalesce(b1 - lag(b1) OVER w, 0) AS db, coalesce(a1 - lag(a1) OVER w, 0) AS da, cast(coalesce(ts_in_delta, 0) AS DOUBLE) AS lat
  FROM t2 WINDOW w AS (PARTITION BY d, i ORDER BY r)),
t AS (
  SELECT *, cast(sum(CASE WHEN s = 0 THEN size ELSE 0 END) OVER w AS BIGINT) AS cum_buy, cast(sum(CASE WHEN s = 1 THEN size ELSE 0 END) OVER w AS BIGINT) AS cum_sell,
         cast(sum(gap) OVER w AS BIGINT) AS cum_gap, cast(sum(held) OVER w AS BIGINT) AS cum_held, sum(lr * lr) OVER w AS cum_sq, sum(lat) OVER w AS cum_lat, sum(lat * lat) OVER w AS cum_lat_sq, cast(sum(abs(db)) OVER w AS BIGINT) AS cum_b_churn, cast(sum(abs(da)) OVER w AS BIGINT) AS cum_a_churn
  FROM t3 WINDOW w AS (PARTITION BY d, i ORDER BY r ROWS UNBOUNDED PRECEDING))
"""
_ID = "strftime(d, '%Y-%m-%d') AS day, i AS instrument_id, n"


def _id(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "instrument_id", "n", *cols)


def _q(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return keep


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.in_order(tables(spark, sf_dir, "mbo_messages"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trades(_ordered(spark, sf_dir))


@_q("src_profile", "SELECT instrument_id, count(*) AS n, min(price) FILTER (WHERE NOT (cast(price AS VARCHAR) = 'nan')) AS price_min, max(price) FILTER (WHERE NOT (cast(price AS VARCHAR) = 'nan')) AS price_max, min(symbol) AS symbol, count(DISTINCT upper(action)) AS n_actions FROM mbo_messages GROUP BY 1")
def src_profile(spark, sf_dir):
    return M.profile(tables(spark, sf_dir, "mbo_messages"))


@_q("src_dominant_instrument", "SELECT instrument_id, count(*) AS n FROM mbo_messages GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def src_dominant_instrument(spark, sf_dir):
    return M.dominant_instrument(tables(spark, sf_dir, "mbo_messages"))


@_q("src_timestamps", "SELECT seq, coalesce(ts_ns, nullif(ts_recv, 0)) AS ts_ns, coalesce(ts_recv, 0) AS ts_recv FROM mbo_messages")
def src_timestamps(spark, sf_dir):
    return M.timestamps(tables(spark, sf_dir, "mbo_messages")).select("seq", "ts_ns", "ts_recv")


@_q("prj_action_codes", "SELECT seq, CASE upper(action) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'M' THEN 2 WHEN 'T' THEN 3 WHEN 'F' THEN 4 WHEN 'R' THEN 5 ELSE 6 END AS act, CASE upper(side) WHEN 'B' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS side FROM mbo_messages")
def prj_action_codes(spark, sf_dir):
    return tables(spark, sf_dir, "mbo_messages").select("seq", C.action_code(F.col("action")).alias("act"), C.side_code(F.col("side")).alias("side"))


@_q("prj_ticks", "SELECT seq, CASE WHEN price IS NULL OR (cast(price AS VARCHAR) = 'nan') OR isinf(price) THEN 0 ELSE cast(round_even(price / 0.25, 0) AS BIGINT) END AS ticks, CASE WHEN price IS NULL OR (cast(price AS VARCHAR) = 'nan') OR isinf(price) THEN 0 ELSE round_even(price / 0.25, 0) * 0.25 END AS price FROM mbo_messages")
def prj_ticks(spark, sf_dir):
    ticks = C.price_ticks(F.col("price"))
    return tables(spark, sf_dir, "mbo_messages").select("seq", ticks.alias("ticks"), C.ticks_price(ticks).alias("price"))


@_q("prj_flag_bits", "SELECT seq, cast((flags & 128) > 0 AS INT) AS is_last, cast((flags & 64) > 0 AS INT) AS is_tob, cast((flags & 32) > 0 AS INT) AS is_snapshot FROM mbo_messages")
def prj_flag_bits(spark, sf_dir):
    f = F.col("flags")
    return tables(spark, sf_dir, "mbo_messages").select("seq", C.flag(f, C.FLAG_LAST).alias("is_last"), C.flag(f, C.FLAG_TOB).alias("is_tob"), C.flag(f, C.FLAG_SNAPSHOT).alias("is_snapshot"))


@_q("prj_valid_messages", "SELECT act, count(*) AS n FROM (" + _ORDER + "SELECT * FROM m WHERE NOT (px <= 0 AND act NOT IN (5, 1, 4))) GROUP BY 1")
def prj_valid_messages(spark, sf_dir):
    m = _ordered(spark, sf_dir)
    return m.where(book.valid()).groupBy(F.col("act").cast("int").alias("act")).agg(F.count("*").alias("n"))


@_q("prj_seq_gap", _ORDER + f"SELECT {_ID}, coalesce(sequence - lag(sequence) OVER (PARTITION BY d, i ORDER BY n), 0) AS gap, CASE WHEN recv > 0 THEN recv - ts END AS recv_event_delta_ns FROM m")
def prj_seq_gap(spark, sf_dir):
    m = _ordered(spark, sf_dir)
    return _id(m, temporal.change("sequence", M.SESSION, "n").alias("gap"), F.when(F.col("ts_recv") > 0, F.col("ts_recv") - F.col("ts_ns")).alias("recv_event_delta_ns"))


@_q("lob_order_states", _ORDER + f"SELECT {_ID}, o AS order_id, until, px, s AS side, remaining FROM st")
def lob_order_states(spark, sf_dir):
    return _id(book.order_states(_ordered(spark, sf_dir)), "order_id", "until", "px", F.col("side_code").cast("int").alias("side"), "remaining")


@_q("lob_bbo", _BOOK + f"SELECT {_ID}, bid, ask, bid0, ask0 FROM b")
def lob_bbo(spark, sf_dir):
    return _id(book.replay(_ordered(spark, sf_dir)), "bid", "ask", "bid0", "ask0")


@_q("lob_snapshot_levels", _TRADES + f"SELECT {_ID}, " + ", ".join(f"cast({x}{k} AS BIGINT) AS {x}{k}" for x in "ba" for k in range(1, 6)) + ", " + ", ".join(f"cast({x}c{k} AS BIGINT) AS {x}c{k}" for x in "ba" for k in range(1, 4)) + ", bid_levels, ask_levels, cast(bid_total AS BIGINT) AS bid_total, cast(ask_total AS BIGINT) AS ask_total FROM t1")
def lob_snapshot_levels(spark, sf_dir):
    t = book.replay(_ordered(spark, sf_dir)).where(F.col("act") == C.TRADE)
    sides = (("b", "bid"), ("a", "ask"))
    return _id(t, *[F.col(f"{s}_sz")[k].alias(f"{x}{k + 1}") for x, s in sides for k in range(5)], *[F.col(f"{s}_oc")[k].alias(f"{x}c{k + 1}") for x, s in sides for k in range(3)], "bid_levels", "ask_levels", "bid_total", "ask_total")


@_q("lob_imbalance_microprice", _TRADES + f"SELECT {_ID}, last_mid AS mid, spread AS spread_ticks, bid IS NOT NULL AND ask IS NOT NULL AS two_sided, coalesce(bid >= ask, FALSE) AS crossed, round(CASE WHEN b1 + a1 > 0 THEN (b1 - a1) / (b1 + a1) ELSE 0 END, 6) AS imbalance, round(micro, 6) AS microprice, cast(b2 + b3 + b4 + b5 AS BIGINT) AS bid_depth, cast(a2 + a3 + a4 + a5 AS BIGINT) AS ask_depth FROM t")
def lob_imbalance_microprice(spark, sf_dir):
    t = book.snapshots(book.replay(_ordered(spark, sf_dir)))
    return _id(t, F.col("last_mid").alias("mid"), "spread_ticks", "two_sided", "crossed", F.round("imbalance", 6).alias("imbalance"), F.round("microprice", 6).alias("microprice"), F.col("bid_depth_l2_5").alias("bid_depth"), F.col("ask_depth_l2_5").alias("ask_depth"))


_PLAIN = list(_CUM)


@_q("lob_counters", _COUNTED + f"SELECT {_ID}, " + ", ".join(_PLAIN) + " FROM k")
def lob_counters(spark, sf_dir):
    return _id(book.counted(_ordered(spark, sf_dir)), *_PLAIN)


# the same by blocks far shorter than the test sessions, so that every session crosses some
SHORT_BLOCK = 40


@_q("lob_bbo_blocks", ORACLES["lob_bbo"])
def lob_bbo_blocks(spark, sf_dir):
    return _id(book.replay(_ordered(spark, sf_dir), SHORT_BLOCK), "bid", "ask", "bid0", "ask0")


@_q("lob_counters_blocks", ORACLES["lob_counters"])
def lob_counters_blocks(spark, sf_dir):
    return _id(book.counted(_ordered(spark, sf_dir), SHORT_BLOCK), *_PLAIN)


@_q("lob_order_states_blocks", ORACLES["lob_order_states"])
def lob_order_states_blocks(spark, sf_dir):
    return _id(book.order_states(_ordered(spark, sf_dir), SHORT_BLOCK), "order_id", "until", "px", F.col("side_code").cast("int").alias("side"), "remaining")


@_q("lob_flicker", _BOOK + f"SELECT {_ID}, which, dir, flicker FROM f")
def lob_flicker(spark, sf_dir):
    return _id(book.flickers(book.replay(_ordered(spark, sf_dir))), "which", "dir", "flicker")


_SH = {f"imb_l{k}": f"CASE WHEN b{k} + a{k} > 0 THEN (b{k} - a{k}) / (b{k} + a{k}) ELSE 0 END" for k in range(1, 6)}
for _x, _s in (("b", "bid"), ("a", "ask")):
    _lg = [f"ln(1 + {_x}{k})" for k in range(1, 6)]
    _sum5 = " + ".join(f"{_x}{k}" for k in range(1, 6))
    _SH |= {
        f"{_s}_slope": f"(-2 * {_lg[0]} - {_lg[1]} + {_lg[3]} + 2 * {_lg[4]}) / (10 + 1e-10)", f"{_s}_curv": f"{_lg[2]} - 2 * {_lg[1]} + {_lg[0]}",
        f"{_s}_hhi": "(" + " + ".join(f"{_x}{k} * {_x}{k}" for k in range(1, 6)) + f") / (greatest({_sum5}, 1) * greatest({_sum5}, 1))", f"{_s}_avg_order_size": f"CASE WHEN {_x}c1 > 0 THEN {_x}1 / {_x}c1 ELSE 0 END",
    }
_SH["depth_imbalance"] = "CASE WHEN b2+b3+b4+b5+a2+a3+a4+a5 > 0 THEN (b2+b3+b4+b5-a2-a3-a4-a5) / (b2+b3+b4+b5+a2+a3+a4+a5) ELSE 0 END"


@_q("bk_shape", _TRADES + f"SELECT {_ID}, " + ", ".join(f"round({v}, 9) AS {c}" for c, v in _SH.items()) + ", bc1 AS bid_order_count, ac1 AS ask_order_count FROM t1")
def bk_shape(spark, sf_dir):
    t = features.shape(book.snapshots(book.replay(_ordered(spark, sf_dir))))
    return _id(t, *[F.round(c, 9).alias(c) for c in _SH], "bid_order_count", "ask_order_count")


@_q("bk_l1_change", _TRADES + f"SELECT {_ID}, cast(db AS BIGINT) AS l1_bid_change, cast(da AS BIGINT) AS l1_ask_change FROM t3")
def bk_l1_change(spark, sf_dir):
    return _id(_trades(spark, sf_dir), "l1_bid_change", "l1_ask_change")


def _win(cols: list[str], exprs: Callable[[int], dict[str, str]], windows: tuple[int, ...] = WINDOWS) -> str:
    """Twin of a family: counter growth since the last trade before each window."""
    base = ", ".join(f"coalesce(arg_max({c}, r) OVER w{w}, 0) AS s{w}_{c}" for w in windows for c in ["r", *cols])
    frames = ", ".join(f"w{w} AS (PARTITION BY d, i ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND {w * 1_000_000 + 1} PRECEDING)" for w in windows)
    picks = ", ".join(f"{v} AS {name}_{w}ms" for w in windows for name, v in exprs(w).items())
    return _TRADES + f", x AS (SELECT *, {base} FROM t WINDOW {frames}) SELECT {_ID}, {picks} FROM x"


def _g(c: str, w: int) -> str:
    return f"({c} - s{w}_{c})"


def _gs(parts: str, w: int) -> str:
    return "cast(" + " ".join(f"{p[0]} {_g(p[1:], w)}" for p in parts.split()) + " AS BIGINT)"


def _div(a: str, b: str, digits: int = 6) -> str:
    return f"round(CASE WHEN {b} <> 0 THEN {a} / {b} ELSE 0 END, {digits})"


def _flow_sql(w: int) -> dict[str, str]:
    out = {"ofi": _gs("+cum_add_bid -cum_canc_bid -cum_add_ask +cum_canc_ask", w)}
    for lv in ("L1", "L2", "deep"):
        out[f"ofi_{lv}"] = _gs(f"+cum_add_bid_{lv} -cum_canc_bid_{lv} -cum_fill_bid_{lv} -cum_add_ask_{lv} +cum_canc_ask_{lv} +cum_fill_ask_{lv}", w)
    near, deep = _gs("+cum_canc_bid_L1 +cum_canc_ask_L1", w), _gs("+cum_canc_bid_deep +cum_canc_ask_deep", w)
    return out | {"canc_L1_share": f"round({near} / ({near} + {deep} + 1e-10), 6)"}


def _trades_sql(w: int) -> dict[str, str]:
    n, b, s = _g("r", w), _g("cum_buy", w), _g("cum_sell", w)
    return {
        "n_trades": n, "trade_rate": f"round({n} / ({w} / 1000.0), 6)", "signed_volume": f"{b} - {s}", "vol_imbalance": _div(f"abs({b} - {s})", f"({b} + {s})"),
        "cancel_trade_ratio": f"round({_gs('+cum_n_canc_bid +cum_n_canc_ask', w)} / greatest({n}, 1), 6)", "modify_trade_ratio": f"round({_gs('+cum_n_mod_bid +cum_n_mod_ask', w)} / greatest({n}, 1), 6)",
    }


def _fills_sql(w: int) -> dict[str, str]:
    out = {}
    for name, c in (("fill_asymmetry", "cum_n_fill"), ("fill_size_asymmetry", "cum_fill")):
        b, a = _g(f"{c}_bid", w), _g(f"{c}_ask", w)
        out[name] = _div(f"({b} - {a})", f"({b} + {a})")
    return out


def _volatility_sql(w: int) -> dict[str, str]:
    n = f"greatest({_g('r', w)}, 1)"
    mean = f"({_g('cum_lat', w)} / {n})"
    return {
        "realized_vol": f"round(sqrt(greatest({_g('cum_sq', w)}, 0) / {n}), 6)", "mean_latency_ns": f"round({mean}, 3)",
        "resilience_bid": f"round({_g('cum_b_churn', w)} / {n}, 6)", "resilience_ask": f"round({_g('cum_a_churn', w)} / {n}, 6)",
    }


def _quotes_sql(w: int) -> dict[str, str]:
    moves = "greatest(" + " + ".join(_g(c, w) for c in ("cum_bid_up", "cum_bid_dn", "cum_ask_up", "cum_ask_dn")) + ", 1)"
    wide, narrow = _g("cum_widen", w), _g("cum_narrow", w)
    return {
        "quote_flicker": _g("cum_flicker", w), "bid_move_rate": f"round(({_g('cum_bid_up', w)} - {_g('cum_bid_dn', w)}) / {moves}, 6)", "ask_move_rate": f"round(({_g('cum_ask_up', w)} - {_g('cum_ask_dn', w)}) / {moves}, 6)",
        "spread_widen_rate": _div(wide, f"({wide} + {narrow})"), "twas": f"round(CASE WHEN {_g('cum_wall_time', w)} > 0 THEN {_g('cum_spread_time', w)} / {_g('cum_wall_time', w)} END, 6)",
    }


def _trade_twas_sql(w: int) -> dict[str, str]:
    return {"trade_twas": f"round(CASE WHEN {_g('cum_gap', w)} > 0 THEN {_g('cum_held', w)} / {_g('cum_gap', w)} END, 6)"}


def _family(family: str, skip: tuple[str, ...] = (), windows: tuple[int, ...] = WINDOWS):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = features.windowed(_trades(spark, sf_dir), windows, [family], depletion=False)
        made = [c for c in t.columns if c.endswith("ms") and not c.startswith(skip or ("\0",))]
        digits = lambda c: 3 if c.startswith("mean_latency") else 6
        double = {c for c, kind in t.dtypes if kind == "double"}
        return _id(t, *[F.round(c, digits(c)).alias(c) if c in double else F.col(c) for c in made])

    return run


for _name, _sql, _skip in (("flow", _flow_sql, ()), ("trades", _trades_sql, ()), ("fills", _fills_sql, ()), ("volatility", _volatility_sql, ("latency_std",)), ("quotes", _quotes_sql, ()), ("trade_twas", _trade_twas_sql, ())):
    QUERIES[f"wn_{_name}"] = _family(_name, _skip)
    ORACLES[f"wn_{_name}"] = _win(features.FAMILIES[_name][1], _sql)
    # the operator's own windows, which the sparse test trades seldom fill
    QUERIES[f"wn_{_name}_ms"] = _family(_name, _skip, features.WINDOWS_MS)
    ORACLES[f"wn_{_name}_ms"] = _win(features.FAMILIES[_name][1], _sql, features.WINDOWS_MS)


def _depletion_sql(w: int) -> dict[str, str]:
    return {"bid_depletion": f"cast(s{w}_b1 - b1 AS BIGINT)", "ask_depletion": f"cast(s{w}_a1 - a1 AS BIGINT)"}


def _depletion(spark: SparkSession, sf_dir: str, windows: tuple[int, ...]) -> DataFrame:
    t = features.windowed(_trades(spark, sf_dir), windows, [], depletion=True)
    return _id(t, *[c for c in t.columns if "_depletion_" in c])


@_q("wn_depletion", _win(["b1", "a1"], _depletion_sql))
def wn_depletion(spark, sf_dir):
    return _depletion(spark, sf_dir, WINDOWS)


@_q("wn_depletion_ms", _win(["b1", "a1"], _depletion_sql, features.WINDOWS_MS))
def wn_depletion_ms(spark, sf_dir):
    return _depletion(spark, sf_dir, features.WINDOWS_MS)


def _latency_std_sql(w: int) -> dict[str, str]:
    return {"latency_std_ns": f"round(sqrt(greatest({_g('cum_lat_sq', w)} / greatest({_g('r', w)}, 1) - pow({_g('cum_lat', w)} / greatest({_g('r', w)}, 1), 2), 0)), 0)"}


def _latency_std(spark: SparkSession, sf_dir: str, windows: tuple[int, ...]) -> DataFrame:
    t = features.windowed(_trades(spark, sf_dir), windows, ["volatility"], depletion=False)
    return _id(t, *[F.round(c, 0).alias(c) for c in t.columns if c.startswith("latency_std")])


@_q("wn_latency_std", _win(["cum_lat", "cum_lat_sq"], _latency_std_sql))
def wn_latency_std(spark, sf_dir):
    return _latency_std(spark, sf_dir, WINDOWS)


@_q("wn_latency_std_ms", _win(["cum_lat", "cum_lat_sq"], _latency_std_sql, features.WINDOWS_MS))
def wn_latency_std_ms(spark, sf_dir):
    return _latency_std(spark, sf_dir, features.WINDOWS_MS)


def _forward_sql(horizons: tuple[int, ...]) -> str:
    picks = ", ".join(f"round(arg_min({v}, r) OVER h{h} - {v}, 6) AS {name}_{h}ms" for h in horizons for name, v in (("fwd_return", "last_mid"), ("fwd_mp", "micro")))
    frames = ", ".join(f"h{h} AS (PARTITION BY d, i ORDER BY ts RANGE BETWEEN {h * 1_000_000} FOLLOWING AND UNBOUNDED FOLLOWING)" for h in horizons)
    return _TRADES + f"SELECT {_ID}, {picks} FROM t3 WINDOW {frames}"


def _forward(spark: SparkSession, sf_dir: str, horizons: tuple[int, ...]) -> DataFrame:
    t = features.forward_returns(_trades(spark, sf_dir), horizons)
    return _id(t, *[F.round(c, 6).alias(c) for c in t.columns if c.startswith("fwd_")])


@_q("aj_fwd_return", _forward_sql(HORIZONS))
def aj_fwd_return(spark, sf_dir):
    return _forward(spark, sf_dir, HORIZONS)


@_q("aj_fwd_return_ms", _forward_sql(features.HORIZONS_MS))
def aj_fwd_return_ms(spark, sf_dir):
    return _forward(spark, sf_dir, features.HORIZONS_MS)


@_q("aj_excursion_fill", _TRADES + f""", x AS (
  SELECT t.d, t.i, t.n, t.s, t.last_mid, max(u.last_mid) AS hi, min(u.last_mid) AS lo FROM t3 t LEFT JOIN t3 u ON t.d = u.d AND t.i = u.i AND u.r > t.r AND u.ts < t.ts + 60000000000 GROUP BY ALL)
SELECT {_ID}, CASE WHEN s = 0 THEN hi - last_mid ELSE last_mid - lo END AS excursion FROM x""")
def aj_excursion_fill(spark, sf_dir):
    t = temporal.excursion(_trades(spark, sf_dir), M.SESSION, "ts_ns", "r", "last_mid", 60_000 * features.MS)
    return _id(t, F.when(F.col("side_code") == C.BID, F.col("fwd_max") - F.col("last_mid")).otherwise(F.col("last_mid") - F.col("fwd_min")).alias("excursion"))


# ---- cost analysis over the features of the book -----------------------------------------------------------------------

_RATIOS = [f"{k}_trade_ratio_{w}ms" for k in ("cancel", "modify") for w in (50, 500, 5000)]
_ASYMMETRIES = [f"fill_asymmetry_{w}ms" for w in (500, 5000)]


def _long(twin: str, columns: list[str], picks: str) -> str:
    names, values = ", ".join(f"'{c}'" for c in columns), ", ".join(columns)
    return f"SELECT metric, {picks} FROM (SELECT unnest([{names}]) AS metric, unnest([{values}]) AS v FROM ({twin})) WHERE v IS NOT NULL GROUP BY 1"


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@_q("ag_tca_ratios", _long(ORACLES["wn_trades_ms"], _RATIOS, "count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99"))
def ag_tca_ratios(spark, sf_dir):
    t = features.windowed(_trades(spark, sf_dir), (50, 500, 5000), ["trades"], depletion=False)
    return _rounded(analysis.distribution(t, _RATIOS), 4)


@_q("ag_tca_fills", _long(ORACLES["wn_fills_ms"], _ASYMMETRIES, "count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(avg(CASE WHEN v > 0.3 THEN 1.0 ELSE 0 END), 4) AS above, round(avg(CASE WHEN v < -0.3 THEN 1.0 ELSE 0 END), 4) AS below"))
def ag_tca_fills(spark, sf_dir):
    return _rounded(analysis.asymmetry(features.windowed(_trades(spark, sf_dir), (500, 5000), ["fills"], depletion=False), _ASYMMETRIES), 4)


@_q("ag_tca_depletion", f"""SELECT CASE WHEN t > 2 THEN 'up' WHEN t < -2 THEN 'down' ELSE 'neutral' END AS move, count(*) AS n, round(avg(bid_depletion_500ms), 6) AS bid_depletion, round(avg(ask_depletion_500ms), 6) AS ask_depletion
FROM (SELECT fwd_return_1000ms / 0.25 AS t, bid_depletion_500ms, ask_depletion_500ms FROM ({ORACLES["wn_depletion_ms"]}) JOIN ({ORACLES["aj_fwd_return_ms"]}) USING (day, instrument_id, n)) WHERE abs(t) > 2 OR abs(t) <= 0.5 GROUP BY 1 HAVING count(*) > 10""")
def ag_tca_depletion(spark, sf_dir):
    t = features.forward_returns(features.windowed(_trades(spark, sf_dir), (500,), [], depletion=True), (1000,))
    return _rounded(analysis.depletion_before_moves(t, F.col("fwd_return_1000ms") / C.TICK, "bid_depletion_500ms", "ask_depletion_500ms"), 6)


_SNAP = {"z_ofi_L1_500ms": 0.4, "z_imb_L2": -0.2, "z_slope_bid": 0.1, "z_hhi_ask": 0.3, "z_spread": 0.05, "z_microprice_delta": 0.2, "z_cancel_ratio_500ms": 0.7}
_LOGS = [f"ln(greatest(b{k}, 1.0))" for k in range(1, 6)]
_ASKS = "(" + " + ".join(f"a{k}" for k in range(1, 6)) + ")"
_PROXY = {
    "z_ofi_L1_500ms": "CASE WHEN b1 + a1 > 0 THEN (b1 - a1) / (b1 + a1) ELSE 0 END", "z_imb_L2": "CASE WHEN b2 + a2 > 0 THEN (b2 - a2) / (b2 + a2) ELSE 0 END", "z_slope_bid": f"(-2 * {_LOGS[0]} - {_LOGS[1]} + {_LOGS[3]} + 2 * {_LOGS[4]}) / 10",
    "z_hhi_ask": f"CASE WHEN {_ASKS} < 1 THEN 1.0 ELSE ({' + '.join(f'a{k} * a{k}' for k in range(1, 6))}) / ({_ASKS} * {_ASKS}) END", "z_spread": "spread", "z_microprice_delta": "micro - last_mid", "z_cancel_ratio_500ms": "0.0",
}
_RAW = "0.05 + " + " + ".join(f"{w} * coalesce(({_PROXY[c]} - 0.1) / sqrt(1.21 + 1e-8), 0)" for c, w in _SNAP.items())


@_q("ml_snapshot_score", _TRADES + f", sz AS (SELECT d, i, n, s, {_RAW} AS raw FROM t), sc AS (SELECT *, CASE WHEN abs(raw) <= 0.1 THEN 0.05 WHEN abs(raw) >= 1.5 THEN 0.9 ELSE 0.05 + (abs(raw) - 0.1) / 1.4 * 0.85 END AS p FROM sz) SELECT {_ID}, round(raw, 6) AS raw, round(CASE WHEN s = 0 AND raw > 0 THEN least(p * 1.1, 1) ELSE p END, 6) AS p FROM sc")
def ml_snapshot_score(spark, sf_dir):
    t = book.snapshots(book.replay(_ordered(spark, sf_dir)))
    inputs = signals.snapshot_inputs(list(_SNAP), F.col("bid_sz"), F.col("ask_sz"), F.col("spread_ticks"), F.col("microprice") - F.col("last_mid"), F.lit(0.0), F.lit(0))
    t = t.withColumns(inputs)
    raw = models.Linear(list(_SNAP), np.array([0.05, *_SNAP.values()]), np.full(len(_SNAP), 0.1), np.full(len(_SNAP), 1.21)).score(t)
    t = t.withColumn("raw", raw)
    p = models.snapshot_probability(F.col("raw"), models.interpolate(F.abs("raw"), [0.1, 1.5], [0.05, 0.9]), F.col("side_code") == C.BID)
    return _id(t, F.round("raw", 6).alias("raw"), F.round(p, 6).alias("p"))


@_q("bk_depth_levels", _TRADES + f"SELECT {_ID}, round(CASE WHEN b + a > 0 THEN b / (b + a) ELSE 0 END, 9) AS qi_bid, round(CASE WHEN b + a > 0 THEN a / (b + a) ELSE 0 END, 9) AS qi_ask, round(CASE WHEN na > 0.001 THEN nb / na ELSE 1 END, 9) AS depth_ratio FROM (SELECT *, b1 + b2 + b3 + b4 + b5 AS b, a1 + a2 + a3 + a4 + a5 AS a, b1 + b2 + b3 AS nb, a1 + a2 + a3 AS na FROM t)")
def bk_depth_levels(spark, sf_dir):
    t = book.replay(_ordered(spark, sf_dir)).where(F.col("act") == C.TRADE)
    return _id(t, *[F.round(v, 9).alias(k) for k, v in signals.depth_balance(F.col("bid_sz"), F.col("ask_sz")).items()])
