"""Queries of the statistical, model, quote, option and execution operators with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.cluster import tables
from tickloom.functions import codes as C
from tickloom.operators import analysis as A
from tickloom.operators import ewm as W
from tickloom.operators import models as ML
from tickloom.operators import options as OP
from tickloom.operators import signals as SG
from tickloom.operators import simulator as SM
from tickloom.operators import temporal
from tickloom.operators.ordered import previous

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _q(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _nn(c: str, name: str | None = None) -> str:
    return f"CASE WHEN NOT (cast({c} AS VARCHAR) = 'nan') THEN {c} END AS {name or c}"


_COLS = {"mid": "mid", "spread": "spread_ticks", "imb": "imbalance", "b1": "bid_size_l1", "a1": "ask_size_l1", "lat": "mean_latency_ns_500ms", "lsd": "latency_std_ns_500ms", "ntr": "n_trades_500ms", "fwd": "fwd_return_1000ms", "delta": "ts_in_delta_ns"}
_TF = (
    "WITH tf0 AS (SELECT row_id, trade_date, instrument_id AS i, ts_ns AS ts, trade_side AS side, " + ", ".join(_nn(c, k) for k, c in _COLS.items()) + " FROM trade_features),\n"
    "tf AS (SELECT *, (CASE WHEN side = 0 THEN 1.0 ELSE -1.0 END) * fwd / 0.25 AS signed FROM tf0)\n"
)


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "trade_features")
    t = t.select("row_id", "trade_date", F.col("instrument_id").alias("i"), F.col("ts_ns").alias("ts"), F.col("trade_side").alias("side"), *[A.clean(c).alias(k) for k, c in _COLS.items()])
    return t.withColumn("signed", A.sign(F.col("side")) * F.col("fwd") / C.TICK)


def _round(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- cost analysis ------------------------------------------------------------------------------------------------

_MK = f"WITH m AS (SELECT window_ms, trade_side AS side, {_nn('raw_move', 'raw')}, {_nn('signed_markout', 's')}, {_nn('spread_ticks', 'sp')} FROM markouts), d AS (SELECT *, s - sp / 2 AS net FROM m WHERE s IS NOT NULL)\n"


@_q("ag_markout", _MK + "SELECT window_ms, count(*) AS n, round(avg(raw), 6) AS mean_raw, round(stddev_pop(s), 6) AS std_signed, round(avg(s), 6) AS mean_signed, round(avg(net), 6) AS mean_net, round(avg(CASE WHEN side = 0 THEN s END), 6) AS mean_buy, round(avg(CASE WHEN side = 1 THEN s END), 6) AS mean_sell, round(avg(CASE WHEN s < 0 THEN 1.0 ELSE 0 END), 6) AS pct_adverse, round(median(s), 6) AS median_signed, round(median(net), 6) AS median_net FROM d GROUP BY 1")
def ag_markout(spark, sf_dir):
    return _round(A.markout_table(tables(spark, sf_dir, "markouts"), "window_ms", "trade_side", "raw_move", "signed_markout", "spread_ticks"))


_ADV = "count(*) AS n, round(avg(signed), 6) AS mean_signed, round(avg(CASE WHEN signed < 0 THEN 1.0 ELSE 0 END), 6) AS pct_adverse"


@_q("ag_adverse_spread", _TF + f"SELECT CASE WHEN spread <= 1 THEN '1' WHEN spread <= 2 THEN '2' ELSE '3+' END AS bucket, {_ADV} FROM tf WHERE spread IS NOT NULL AND signed IS NOT NULL GROUP BY 1")
def ag_adverse_spread(spark, sf_dir):
    return _round(A.adverse_by(_tf(spark, sf_dir), A.spread_bucket(F.col("spread")), "signed"))


@_q("ag_adverse_imb", _TF + f"SELECT CASE WHEN imb >= 0.33 THEN 2 WHEN imb >= -0.33 THEN 1 ELSE 0 END AS bucket, {_ADV} FROM tf WHERE imb IS NOT NULL AND signed IS NOT NULL GROUP BY 1")
def ag_adverse_imb(spark, sf_dir):
    return _round(A.adverse_by(_tf(spark, sf_dir), A.imbalance_bucket(F.col("imb")), "signed"))


@_q("ag_adverse_hour", _TF + f"SELECT cast(ts // 3600000000000 % 24 AS INT) AS bucket, {_ADV} FROM tf WHERE ts IS NOT NULL AND signed IS NOT NULL GROUP BY 1 HAVING count(*) > 100")
def ag_adverse_hour(spark, sf_dir):
    return _round(A.adverse_by(_tf(spark, sf_dir), A.utc_hour(F.col("ts")), "signed", least=100))


_THR = "thr AS (SELECT CASE WHEN count(*) >= 10 THEN quantile_cont(lsd, 0.33) ELSE 0 END AS q1, CASE WHEN count(*) >= 10 THEN quantile_cont(lsd, 0.67) ELSE 1e10 END AS q2 FROM tf WHERE lsd > 0)"


@_q("ag_adverse_vol", _TF + f", {_THR} SELECT CASE WHEN lsd >= q2 THEN 2 WHEN lsd >= q1 THEN 1 ELSE 0 END AS bucket, {_ADV} FROM tf, thr WHERE lsd > 0 AND signed IS NOT NULL GROUP BY 1")
def ag_adverse_vol(spark, sf_dir):
    t = _tf(spark, sf_dir).where(F.col("lsd") > 0)
    return _round(A.adverse_by(t, A.level(F.col("lsd"), A.thresholds(t, "lsd")), "signed"))


@_q("ag_adverse_grouping_sets", _TF + ", b AS (SELECT CASE WHEN spread <= 1 THEN '1' WHEN spread <= 2 THEN '2' ELSE '3+' END AS spread_b, CASE WHEN imb >= 0.33 THEN 2 WHEN imb >= -0.33 THEN 1 ELSE 0 END AS imb_b, signed FROM tf WHERE spread IS NOT NULL AND imb IS NOT NULL AND signed IS NOT NULL) SELECT spread_b, imb_b, count(*) AS n, round(avg(signed), 6) AS mean_signed FROM b GROUP BY GROUPING SETS ((spread_b), (imb_b), ())")
def ag_adverse_grouping_sets(spark, sf_dir):
    t = _tf(spark, sf_dir).where(F.col("spread").isNotNull() & F.col("imb").isNotNull() & F.col("signed").isNotNull())
    t = t.select(A.spread_bucket(F.col("spread")).alias("spread_b"), A.imbalance_bucket(F.col("imb")).alias("imb_b"), "signed")
    return _round(t.groupingSets([["spread_b"], ["imb_b"], []], "spread_b", "imb_b").agg(F.count("*").alias("n"), F.avg("signed").alias("mean_signed")))


@_q("ag_adverse_cube", _TF + ", b AS (SELECT CASE WHEN spread <= 1 THEN '1' WHEN spread <= 2 THEN '2' ELSE '3+' END AS spread_b, CASE WHEN imb >= 0.33 THEN 2 WHEN imb >= -0.33 THEN 1 ELSE 0 END AS imb_b, signed FROM tf WHERE spread IS NOT NULL AND imb IS NOT NULL AND signed IS NOT NULL) SELECT spread_b, imb_b, count(*) AS n, round(avg(signed), 6) AS mean_signed FROM b GROUP BY CUBE (spread_b, imb_b)")
def ag_adverse_cube(spark, sf_dir):
    return _round(_adverse_cells(spark, sf_dir).cube("spread_b", "imb_b").agg(F.count("*").alias("n"), F.avg("signed").alias("mean_signed")))


@_q("ag_adverse_rollup", ORACLES["ag_adverse_cube"].replace("CUBE", "ROLLUP"))
def ag_adverse_rollup(spark, sf_dir):
    return _round(_adverse_cells(spark, sf_dir).rollup("spread_b", "imb_b").agg(F.count("*").alias("n"), F.avg("signed").alias("mean_signed")))


def _adverse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tf(spark, sf_dir).where(F.col("spread").isNotNull() & F.col("imb").isNotNull() & F.col("signed").isNotNull())
    return t.select(A.spread_bucket(F.col("spread")).alias("spread_b"), A.imbalance_bucket(F.col("imb")).alias("imb_b"), "signed")


@_q("ag_distribution", _TF + ", l AS (SELECT unnest(['ntr', 'lat', 'spread']) AS metric, unnest([ntr, lat, spread]) AS v FROM tf) SELECT metric, count(*) AS n, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.95), 3) AS p95, round(quantile_cont(v, 0.99), 3) AS p99 FROM l WHERE v IS NOT NULL GROUP BY 1")
def ag_distribution(spark, sf_dir):
    return _round(A.distribution(_tf(spark, sf_dir), ["ntr", "lat", "spread"]), 3)


@_q("ag_asymmetry", _TF + "SELECT count(*) AS n, round(avg(imb), 6) AS mean, round(stddev_pop(imb), 6) AS std, round(avg(CASE WHEN imb > 0.3 THEN 1.0 ELSE 0 END), 6) AS above, round(avg(CASE WHEN imb < -0.3 THEN 1.0 ELSE 0 END), 6) AS below FROM tf WHERE imb IS NOT NULL")
def ag_asymmetry(spark, sf_dir):
    return _round(A.asymmetry(_tf(spark, sf_dir), ["imb"]).drop("metric"))


_MOVE = "CASE WHEN fwd / 0.25 > 2 THEN 'up' WHEN fwd / 0.25 < -2 THEN 'down' WHEN abs(fwd / 0.25) <= 0.5 THEN 'neutral' END"


@_q("ag_depletion_moves", _TF + f", x AS (SELECT *, lag(b1) OVER w - b1 AS db, lag(a1) OVER w - a1 AS da, {_MOVE} AS move FROM tf WINDOW w AS (PARTITION BY i, trade_date ORDER BY ts, row_id)) SELECT move, count(*) AS n, round(avg(db), 6) AS bid_depletion, round(avg(da), 6) AS ask_depletion FROM x WHERE move IS NOT NULL GROUP BY 1 HAVING count(*) > 10")
def ag_depletion_moves(spark, sf_dir):
    at = Window.partitionBy("i", "trade_date").orderBy("ts", "row_id")
    t = _tf(spark, sf_dir).withColumns({"db": F.lag("b1").over(at) - F.col("b1"), "da": F.lag("a1").over(at) - F.col("a1")})
    return _round(A.depletion_before_moves(t, F.col("fwd") / C.TICK, "db", "da"))


@_q("ag_latency", _TF + ", l AS (SELECT delta AS v, abs(signed) AS m FROM tf WHERE delta > 0) SELECT count(*) AS n, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.95), 2) AS p95, round(quantile_cont(v, 0.99), 2) AS p99, max(v) AS max, round(corr(v, m), 6) AS corr_markout FROM l")
def ag_latency(spark, sf_dir):
    return _round(A.latency(_tf(spark, sf_dir), "delta", "signed"), 2, corr_markout=6)


@_q("ag_deciles", _TF + ", s AS (SELECT abs(imb) AS score, signed AS s FROM tf WHERE imb IS NOT NULL AND signed IS NOT NULL), q AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM s), b AS (SELECT cast(greatest(len(list_filter(e, lambda x: score > x)) - 1, 0) AS INT) AS bin, score, s FROM s, q) SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(s), 6) AS mean_signed, round(avg(CASE WHEN s < 0 THEN 1.0 ELSE 0 END), 6) AS pct_adverse, round(median(s), 6) + 0.0 AS median_signed FROM b GROUP BY 1")
def ag_deciles(spark, sf_dir):
    return _round(A.deciles(_tf(spark, sf_dir), "imb", "signed")).withColumn("median_signed", F.col("median_signed") + 0.0)


_X = ["z_ofi_l1_500ms", "z_imb_l1", "z_kyle_lambda", "z_realized_vol", "z_latency"]
_RG = "WITH r AS (SELECT row_id, trade_date, instrument_id AS i, ts_ns AS ts, " + ", ".join(_nn(c) for c in ["mid", "spread_ticks", *_X]) + " FROM regressors)\n"


def _rg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "regressors").select("row_id", "trade_date", F.col("instrument_id").alias("i"), F.col("ts_ns").alias("ts"), *[A.clean(c).alias(c) for c in ["mid", "spread_ticks", *_X]])


@_q("ag_univariate", _RG + ", l AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in _X) + "]) AS feature, unnest([" + ", ".join(_X) + "]) AS x, spread_ticks AS y FROM r) SELECT feature, count(*) AS n, round(corr(x, y), 6) AS corr, round(covar_samp(x, y) / var_samp(x), 6) AS beta, round(pow(corr(x, y), 2), 6) AS r2, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) >= 100")
def ag_univariate(spark, sf_dir):
    return _round(A.univariate(_rg(spark, sf_dir), _X, "spread_ticks"))


_PAIRS = [(a, b) for k, a in enumerate(_X) for b in _X[k + 1 :]]


@_q("ag_corr_top", _RG + ", z AS (SELECT " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _X) + " FROM r), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM z" for a, b in _PAIRS) + ") SELECT a, b, round(c, 6) AS corr, abs(c) > 0.7 AS high FROM p ORDER BY abs(c) DESC LIMIT 15")
def ag_corr_top(spark, sf_dir):
    return _round(spark.createDataFrame(ML.correlations(_rg(spark, sf_dir), _X)))


@_q("ag_vif")
def ag_vif(spark, sf_dir):
    return _round(spark.createDataFrame(ML.vif(_rg(spark, sf_dir), _X)))


_ST = _TF + f", {_THR}, x AS (SELECT tf.*, q1, q2, (mid - lag(mid) OVER (PARTITION BY i ORDER BY ts, row_id)) / 0.25 AS dm FROM tf, thr), s AS (SELECT CASE WHEN lsd >= q2 THEN 2 WHEN lsd >= q1 THEN 1 ELSE 0 END AS regime, least(greatest(cast(trunc(spread) AS INT) - 1, 0), 2) * 3 + CASE WHEN imb >= 0.33 THEN 2 WHEN imb >= -0.33 THEN 1 ELSE 0 END AS state, CASE WHEN dm IS NULL THEN 0 ELSE least(greatest(cast(trunc(greatest(least(dm, 1e6), -1e6)) AS INT), -5), 5) END + 5 AS outcome FROM x WHERE spread IS NOT NULL AND imb IS NOT NULL AND lsd IS NOT NULL), g AS (SELECT r.range AS regime, s.range AS state, o.range AS outcome FROM range(3) r, range(9) s, range(11) o), n AS (SELECT regime, state, outcome, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT cast(g.regime AS INT) AS regime, cast(g.state AS INT) AS state, cast(g.outcome AS INT) AS outcome, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (regime, state, outcome)), p AS (SELECT *, (n + 0.1 / 11) / (sum(n) OVER (PARTITION BY regime, state) + 0.1) AS prob FROM c)\n"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tf(spark, sf_dir)
    cuts = A.thresholds(t, "lsd")
    t = previous(t.select("i", "ts", "row_id", "mid", "spread", "imb", "lsd"), ["i"], ["ts", "row_id"], "mid", "before")
    t = t.withColumn("dm", (F.col("mid") - F.col("before")) / C.TICK).where(F.col("spread").isNotNull() & F.col("imb").isNotNull() & F.col("lsd").isNotNull())
    return t.select(A.level(F.col("lsd"), cuts).alias("regime"), (A.spread_state(F.col("spread")) * 3 + A.imbalance_bucket(F.col("imb"))).alias("state"), A.outcome(F.col("dm")).alias("outcome"))


@_q("ag_markov_counts", _ST + "SELECT * FROM c")
def ag_markov_counts(spark, sf_dir):
    return A.transition_counts(_states(spark, sf_dir))


@_q("ag_markov_probs", _ST + "SELECT regime, state, outcome, round(prob, 6) AS prob FROM p")
def ag_markov_probs(spark, sf_dir):
    return _round(A.transition_probs(A.transition_counts(_states(spark, sf_dir))).drop("n"))


@_q("ag_markov_expect", _ST + "SELECT regime, state, round(sum(prob * (outcome - 5)), 6) + 0.0 AS expected, round(sqrt(greatest(sum(prob * pow(outcome - 5, 2)) - pow(sum(prob * (outcome - 5)), 2), 0)), 6) AS uncertainty FROM p GROUP BY 1, 2")
def ag_markov_expect(spark, sf_dir):
    return _round(A.transition_moments(A.transition_probs(A.transition_counts(_states(spark, sf_dir))))).withColumn("expected", F.col("expected") + 0.0)


@_q("ag_gex_bins", f"WITH o AS (SELECT snap_id, {_nn('net_gex')} FROM options_features), q AS (SELECT quantile_cont(net_gex, 0.33) AS a, quantile_cont(net_gex, 0.67) AS b FROM o WHERE net_gex IS NOT NULL) SELECT snap_id, CASE WHEN net_gex IS NULL THEN 1 WHEN net_gex >= b THEN 2 WHEN net_gex >= a THEN 1 ELSE 0 END AS gex FROM o, q")
def ag_gex_bins(spark, sf_dir):
    o = tables(spark, sf_dir, "options_features").select("snap_id", A.clean("net_gex").alias("net_gex"))
    return o.select("snap_id", F.coalesce(A.level(F.col("net_gex"), A.thresholds(o, "net_gex", positive=False)), F.lit(1)).alias("gex"))


_SPT = _TF + f""", {_THR}, e AS (SELECT list_sort(list_distinct(quantile_cont(abs(imb), [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS ed FROM tf WHERE imb IS NOT NULL),
c0 AS (SELECT CASE WHEN lsd >= q2 THEN 2 WHEN lsd >= q1 THEN 1 ELSE 0 END AS vol, greatest(len(list_filter(ed, lambda x: abs(imb) > x)) - 1, 0) AS tox, 0 AS gex, abs(signed) AS ex, signed AS mo FROM tf, thr, e WHERE lsd IS NOT NULL AND imb IS NOT NULL AND signed IS NOT NULL),
z AS (SELECT vol, tox, gex, count(*) AS trades, avg(mo) AS mm FROM c0 GROUP BY 1, 2, 3),
h AS (SELECT unnest([.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5]) AS hs),
a AS (SELECT vol, tox, gex, cast(hs AS DOUBLE) AS hs, count(*) FILTER (WHERE ex >= hs) AS fills, avg(hs - mo) FILTER (WHERE ex >= hs) AS gain FROM c0, h GROUP BY 1, 2, 3, 4),
v AS (SELECT a.*, trades, fills / trades * gain AS ev FROM a JOIN z USING (vol, tox, gex) WHERE fills >= 10 AND trades >= 50),
b AS (SELECT vol, tox, gex, hs FROM v QUALIFY row_number() OVER (PARTITION BY vol, tox, gex ORDER BY ev DESC, hs) = 1),
g AS (SELECT v.range AS vol, t.range AS tox, 0 AS gex FROM range(3) v, range(10) t)
SELECT cast(vol AS INT) AS vol, cast(tox AS INT) AS tox, gex, coalesce(trades, 0) AS trades, CASE WHEN trades >= 50 THEN coalesce(hs, 1.0) ELSE 1.0 END AS half_spread, round(CASE WHEN trades >= 50 THEN least(greatest(0.5 * mm, -2), 2) ELSE 0 END, 6) AS skew
FROM g LEFT JOIN z USING (vol, tox, gex) LEFT JOIN b USING (vol, tox, gex)"""


@_q("ag_spread_table", _SPT)
def ag_spread_table(spark, sf_dir):
    t = _tf(spark, sf_dir)
    tox = A.in_bin(F.abs("imb"), A.quantile_edges(t.withColumn("ai", F.abs("imb")), "ai"))
    cells = t.where(F.col("lsd").isNotNull() & F.col("imb").isNotNull()).select(A.level(F.col("lsd"), A.thresholds(t, "lsd")).alias("vol"), tox.alias("tox"), F.lit(0).alias("gex"), F.abs("signed").alias("excursion"), F.col("signed").alias("markout"))
    grid = spark.range(30).select(F.floor(F.col("id") / 10).cast("int").alias("vol"), (F.col("id") % 10).cast("int").alias("tox"), F.lit(0).alias("gex"))
    return _round(A.spread_table(cells, grid))


_WHOLE = _SPT[: _SPT.index("c0 AS (")] + f"""gq AS (SELECT quantile_cont(net_gex, 0.33) AS ga, quantile_cont(net_gex, 0.67) AS gb FROM (SELECT {_nn('net_gex')} FROM options_features) WHERE net_gex IS NOT NULL),
os AS (SELECT instrument_id AS i, ts_ns AS ts, {_nn('net_gex')} FROM options_features WHERE ts_ns IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument_id, ts_ns ORDER BY snap_id DESC) = 1),
ps AS (SELECT *, row_number() OVER (PARTITION BY i, trade_date ORDER BY ts, row_id) AS r FROM tf WHERE ts IS NOT NULL),
rc AS (SELECT t.row_id, max(u.mid) AS hi, min(u.mid) AS lo FROM ps t JOIN ps u ON t.i = u.i AND t.trade_date = u.trade_date AND u.r > t.r AND u.ts < t.ts + 600000000000 GROUP BY 1),
c0 AS (SELECT CASE WHEN lsd >= q2 THEN 2 WHEN lsd >= q1 THEN 1 ELSE 0 END AS vol, greatest(len(list_filter(ed, lambda x: abs(imb) > x)) - 1, 0) AS tox, CASE WHEN os.net_gex IS NULL THEN 1 WHEN os.net_gex >= gb THEN 2 WHEN os.net_gex >= ga THEN 1 ELSE 0 END AS gex, CASE WHEN side = 0 THEN hi - mid ELSE mid - lo END / 0.25 AS ex, signed AS mo
  FROM ps ASOF LEFT JOIN os ON ps.i = os.i AND ps.ts >= os.ts LEFT JOIN rc USING (row_id), thr, e, gq WHERE lsd IS NOT NULL AND imb IS NOT NULL AND signed IS NOT NULL AND hi - mid IS NOT NULL),
""" + _SPT[_SPT.index("z AS (SELECT vol") : _SPT.index("g AS (SELECT v.range")].replace("trades >= 50", "trades >= 20").replace("fills >= 10", "fills >= 3") + _SPT[_SPT.index("g AS (SELECT v.range") :].replace("0 AS gex FROM range(3) v, range(10) t", "x.range AS gex FROM range(3) v, range(10) t, range(3) x").replace("cast(tox AS INT) AS tox, gex,", "cast(tox AS INT) AS tox, cast(gex AS INT) AS gex,").replace("trades >= 50", "trades >= 20")


@_q("ag_spread_table_whole", _WHOLE)
def ag_spread_table_whole(spark, sf_dir):
    """Cells by volatility, toxicity and gamma, with what the mid reached within ten minutes; the least sizes suit the test tables."""
    t = _tf(spark, sf_dir).where(F.col("ts").isNotNull())
    tox = A.in_bin(F.abs("imb"), A.quantile_edges(_tf(spark, sf_dir).withColumn("ai", F.abs("imb")), "ai"))
    vol = A.level(F.col("lsd"), A.thresholds(_tf(spark, sf_dir), "lsd"))
    o = tables(spark, sf_dir, "options_features").select(F.col("instrument_id").alias("i"), F.col("ts_ns").alias("ts"), "snap_id", A.clean("net_gex").alias("net_gex"))
    gex = F.coalesce(A.level(F.col("net_gex"), A.thresholds(o, "net_gex", positive=False)), F.lit(1))
    t = temporal.excursion(t, ["i", "trade_date"], "ts", "row_id", "mid", 600 * ML.NS)
    t = temporal.backward(t, o.where(F.col("ts").isNotNull()), ["i"], "ts", "snap_id", ["net_gex"])
    reach = F.when(F.col("side") == 0, F.col("fwd_max") - F.col("mid")).otherwise(F.col("mid") - F.col("fwd_min")) / C.TICK
    cells = t.where(F.col("lsd").isNotNull() & F.col("imb").isNotNull()).select(vol.alias("vol"), tox.alias("tox"), gex.alias("gex"), reach.alias("excursion"), F.col("signed").alias("markout"))
    grid = spark.range(90).select(F.floor(F.col("id") / 30).cast("int").alias("vol"), (F.floor(F.col("id") / 3) % 10).cast("int").alias("tox"), (F.col("id") % 3).cast("int").alias("gex"))
    return _round(A.spread_table(cells, grid, least_trades=20, least_fills=3))


# ---- weighted and rolling statistics ------------------------------------------------------------------------------

_EW = _RG + f""", x AS (SELECT i, row_id, z_ofi_l1_500ms AS x, row_number() OVER (PARTITION BY i ORDER BY ts NULLS FIRST, row_id) AS k FROM r),
s AS (SELECT a.i, a.row_id, a.k, a.x, sum(CASE WHEN b.x IS NOT NULL THEN pow(0.5, (a.k - b.k) / 50.0) END) AS w, sum(CASE WHEN b.x IS NOT NULL THEN pow(0.5, 2 * (a.k - b.k) / 50.0) END) AS u, sum(b.x * pow(0.5, (a.k - b.k) / 50.0)) AS s1, sum(b.x * b.x * pow(0.5, (a.k - b.k) / 50.0)) AS s2 FROM x a JOIN x b ON a.i = b.i AND b.k <= a.k GROUP BY 1, 2, 3, 4),
e AS (SELECT *, s1 / w AS m, CASE WHEN w * w - u > 1e-9 * w * w THEN (s2 / w - pow(s1 / w, 2)) * w * w / (w * w - u) END AS v FROM s)
"""


@_q("ew_mean_var", _EW + "SELECT row_id, round(m, 6) AS mean, round(v, 5) AS var FROM e")
def ew_mean_var(spark, sf_dir):
    e = W.ewm(_rg(spark, sf_dir), ["i"], ["ts", "row_id"], {"z_ofi_l1_500ms": 50.0}, block=1024)
    return e.select("row_id", F.round("z_ofi_l1_500ms_mean", 6).alias("mean"), F.round("z_ofi_l1_500ms_var", 5).alias("var"))


@_q("ew_zscore", _EW + "SELECT row_id, round(CASE WHEN x IS NOT NULL THEN coalesce((x - m) / sqrt(greatest(v, 1e-12)), (x - m) / 1e-6) END, 4) AS z FROM e")
def ew_zscore(spark, sf_dir):
    e = W.ewm(_rg(spark, sf_dir), ["i"], ["ts", "row_id"], {"z_ofi_l1_500ms": 50.0}, block=1024)
    return e.select("row_id", F.round(F.when(F.col("z_ofi_l1_500ms_var").isNull(), F.col("z_ofi_l1_500ms") * 0).otherwise(W.zscore("z_ofi_l1_500ms")), 4).alias("z"))


@_q("ew_kyle_lambda")
def ew_kyle_lambda(spark, sf_dir):
    r = _rg(spark, sf_dir).where(F.col("ts").isNotNull()).withColumn("dmid", temporal.change("mid", ["i", "trade_date"], "ts", "row_id"))
    return W.kyle_lambda(r, ["i"], ["ts", "row_id"], "dmid", "z_ofi_l1_500ms", 500.0, 5000.0).select("row_id", F.round("kyle_lambda", 6).alias("kyle_lambda"), F.round("z_kyle_lambda", 4).alias("z_kyle_lambda"))


_RL = _RG + """, o AS (SELECT *, mid AS v, row_number() OVER (PARTITION BY i, trade_date ORDER BY ts, row_id) AS k FROM r WHERE ts IS NOT NULL AND mid IS NOT NULL),
d AS (SELECT *, list(v) OVER (PARTITION BY i, trade_date ORDER BY k ROWS 49 PRECEDING) AS l50, list(v) OVER (PARTITION BY i, trade_date ORDER BY k ROWS 199 PRECEDING) AS l200, v - lag(v) OVER w AS df, CASE WHEN lag(v) OVER w <> 0 THEN (v - lag(v) OVER w) / lag(v) OVER w END AS rt FROM o WINDOW w AS (PARTITION BY i, trade_date ORDER BY k))
SELECT row_id, round(avg(v) OVER w5 - avg(v) OVER w20, 6) AS mom_5_20, round(avg(v) OVER w5 - avg(v) OVER p15, 6) AS mom_5_prev15, df AS mom_1, round(avg(v) OVER w3 - avg(v) OVER w10, 6) AS mom_3_10,
 round(stddev_pop(v) OVER w10, 5) AS vol_sd10, round(avg(v) OVER wa, 5) AS run_mean, round(stddev_pop(v) OVER wa, 4) AS run_sd, round(sqrt(avg(rt * rt) OVER w50), 8) AS vol_rms50, round(stddev_samp(abs(df)) OVER w20, 5) AS vol_sd_abs20,
 round(len(list_filter(l50, lambda x: x < v)) / len(l50), 6) AS rank_50, round(len(list_filter(l200, lambda x: x < v)) / len(l200), 6) AS rank_200
FROM d WINDOW w3 AS (PARTITION BY i, trade_date ORDER BY k ROWS 2 PRECEDING), w5 AS (PARTITION BY i, trade_date ORDER BY k ROWS 4 PRECEDING), w10 AS (PARTITION BY i, trade_date ORDER BY k ROWS 9 PRECEDING), w20 AS (PARTITION BY i, trade_date ORDER BY k ROWS 19 PRECEDING),
 w50 AS (PARTITION BY i, trade_date ORDER BY k ROWS 49 PRECEDING), p15 AS (PARTITION BY i, trade_date ORDER BY k ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING), wa AS (PARTITION BY i, trade_date ORDER BY k ROWS UNBOUNDED PRECEDING)"""


@_q("ew_rolling", _RL)
def ew_rolling(spark, sf_dir):
    r = _rg(spark, sf_dir).where(F.col("ts").isNotNull() & F.col("mid").isNotNull())
    out = W.rolling(r, ["i", "trade_date"], ["ts", "row_id"], "mid")
    return _round(out.select("row_id", "mom_5_20", "mom_5_prev15", "mom_1", "mom_3_10", "vol_sd10", "run_mean", "run_sd", "vol_rms50", "vol_sd_abs20", "rank_50", "rank_200"), 6, vol_sd10=5, run_mean=5, run_sd=4, vol_rms50=8, vol_sd_abs20=5)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.operators import features, regressors
    from tickloom.sources import messages

    t = features.windowed(features.trades(messages.in_order(tables(spark, sf_dir, "mbo_messages"))), regressors.WINDOWS_MS)
    return regressors.catalogue(features.shape(t)).select("trade_date", "instrument_id", "n", *regressors.NAMES)


@_q("rg_catalogue")
def rg_catalogue(spark, sf_dir):
    return _catalogue(spark, sf_dir)


@_q("rg_core")
def rg_core(spark, sf_dir):
    cols = {"z_ofi_L1_500ms": 4, "z_realized_vol": 4, "z_imb_L1": 4, "z_spread": 4, "z_microprice_delta": 4, "ofi_L1_x_vol": 3, "z_kyle_lambda": 3}
    return _catalogue(spark, sf_dir).select(F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "instrument_id", "n", *[F.round(c, d).alias(c) for c, d in cols.items()])


# ---- models -------------------------------------------------------------------------------------------------------

_FO = "WITH o AS (SELECT row_id, ts_ns AS ts, trade_side AS y, row_number() OVER (ORDER BY ts_ns, row_id) - 1 AS rn, count(*) OVER () AS n FROM regressors WHERE ts_ns IS NOT NULL), f AS (SELECT *, cast(least(rn // (n // 5), 4) AS INT) AS fold FROM o), b AS (SELECT fold, min(ts) AS s, max(ts) AS e FROM f GROUP BY 1)\n"


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rg(spark, sf_dir).where(F.col("ts").isNotNull())
    return ML.folds(ML.numbered(r, ["ts", "row_id"]), r.count())


@_q("ml_folds", _FO + "SELECT row_id, rn, fold FROM f")
def ml_folds(spark, sf_dir):
    return _folded(spark, sf_dir).select("row_id", "rn", "fold")


@_q("ml_purged_folds", _FO + "SELECT b.fold AS test, count(*) AS n FROM f JOIN b ON f.fold <> b.fold AND ((f.fold < b.fold AND f.ts < b.s - 600000000000) OR (f.fold > b.fold AND f.ts > b.e + 300000000000)) GROUP BY 1")
def ml_purged_folds(spark, sf_dir):
    f = _folded(spark, sf_dir)
    return ML.training_rows(f, ML.fold_bounds(f, "ts"), "ts", 600 * ML.NS, 300 * ML.NS).groupBy("test").agg(F.count("*").alias("n"))


@_q("ml_fold_moments", _RG + _FO.replace("WITH o AS", ", o AS") + "SELECT fold, count(*) AS n, round(sum(coalesce(z_imb_l1, 0)), 4) AS sx, round(sum(pow(coalesce(z_imb_l1, 0), 2)), 4) AS sxx FROM f JOIN r USING (row_id) GROUP BY 1")
def ml_fold_moments(spark, sf_dir):
    x = F.coalesce(F.col("z_imb_l1"), F.lit(0.0))
    return _round(_folded(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx")), 4)


@_q("ml_split", "WITH o AS (SELECT row_id, row_number() OVER (ORDER BY ts_ns, row_id) AS rn, count(*) OVER () AS n FROM regressors WHERE ts_ns IS NOT NULL) SELECT row_id, rn <= cast(trunc(n * 0.6) AS BIGINT) AS training FROM o")
def ml_split(spark, sf_dir):
    r = _rg(spark, sf_dir).where(F.col("ts").isNotNull())
    n = r.count()
    return ML.numbered(r, ["ts", "row_id"]).select("row_id", (F.col("rn") < int(n * 0.6)).alias("training"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rg(spark, sf_dir).where(F.col("ts").isNotNull())
    at = Window.partitionBy("i").orderBy("ts", "row_id")
    return r.withColumn("y", F.lead("mid").over(at) - F.col("mid"))


@_q("ml_ridge")
def ml_ridge(spark, sf_dir):
    session = ["i", "trade_date"]
    r = temporal.positioned(_rg(spark, sf_dir).where(F.col("ts").isNotNull()), session, "ts", "row_id")
    for h, _, _ in ML.HORIZONS.values():
        r = temporal.forward(r, session, "ts", "r", ["mid"], h * temporal.MS, "_f").withColumn(f"fwd_return_{h}ms", F.col("_f.mid") - F.col("mid")).drop("_f")
    models = ML.ridge_horizons(r, _X, ["ts", "row_id"])
    out = [(label, c, round(float(w), 6)) for label, m in models.items() for c, w in zip(["intercept", *m.features], m.weights)]
    return spark.createDataFrame(out, "horizon string, feature string, weight double")


@_q("ml_spread_regression")
def ml_spread_regression(spark, sf_dir):
    t = _tf(spark, sf_dir)
    t = t.select("signed", F.abs("imb").alias("tox"), A.level(F.col("lsd"), A.thresholds(t, "lsd")).cast("double").alias("vol"), "spread")
    terms = ML.spread_regression(t, "signed", "tox", "vol", "spread")
    return _round(spark.createDataFrame(list(terms.items()), "term string, coefficient double"))


@_q("ml_isotonic")
def ml_isotonic(spark, sf_dir):
    t = _tf(spark, sf_dir)
    t = t.withColumns({"score": F.abs("imb"), "label": ML.adverse_label(F.col("fwd"), ML.adverse_threshold(t, "fwd"))})
    xs, ys = ML.isotonic(t, "score", "label")
    return _round(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), 9)


_WTS = {"z_ofi_l1_500ms": 0.4, "z_imb_l1": -0.2, "z_kyle_lambda": 0.1, "z_realized_vol": 0.05, "z_latency": 0.01}
_LIN = "0.05 + " + " + ".join(f"{w} * coalesce(({c} - 0.1) / sqrt(1.21 + 1e-8), 0)" for c, w in _WTS.items())
_CALX, _CALY = [0.1, 0.4, 0.8, 1.5], [0.05, 0.3, 0.6, 0.9]
_CAL = "CASE WHEN a <= 0.1 THEN 0.05 WHEN a >= 1.5 THEN 0.9 WHEN a < 0.4 THEN 0.05 + (a - 0.1) / 0.3 * 0.25 WHEN a < 0.8 THEN 0.3 + (a - 0.4) / 0.4 * 0.3 ELSE 0.6 + (a - 0.8) / 0.7 * 0.3 END"


def _model() -> ML.Linear:
    import numpy as np

    p = len(_WTS)
    return ML.Linear(list(_WTS), np.array([0.05, *_WTS.values()]), np.full(p, 0.1), np.full(p, 1.21))


@_q("ml_score", _RG + f"SELECT row_id, round({_LIN}, 6) AS score FROM r")
def ml_score(spark, sf_dir):
    r = _rg(spark, sf_dir)
    return r.select("row_id", F.round(_model().score(r), 6).alias("score"))


@_q("ml_calibrate", _RG + f", s AS (SELECT row_id, abs({_LIN}) AS a FROM r) SELECT row_id, round({_CAL}, 6) AS p FROM s")
def ml_calibrate(spark, sf_dir):
    r = _rg(spark, sf_dir)
    r = r.withColumn("a", F.abs(_model().score(r)))
    return r.select("row_id", F.round(ML.interpolate(F.col("a"), _CALX, _CALY), 6).alias("p"))


@_q("ml_logistic", _RG + ", s AS (SELECT row_id, 0.1 + 0.5 * coalesce(z_imb_l1, 0) - 0.3 * coalesce(z_latency, 0) AS s FROM r), p AS (SELECT row_id, 1 / (1 + exp(-(s * 1.2 - 0.1))) AS p FROM s) SELECT row_id, round(least(CASE WHEN -(p * log2(p) + (1 - p) * log2(1 - p)) > 0.65 THEN p * 1.15 ELSE p END, 1), 6) AS p FROM p")
def ml_logistic(spark, sf_dir):
    p = ML.logistic({"z_imb_l1": 0.5, "z_latency": -0.3}, 0.1, (1.2, -0.1))
    return _rg(spark, sf_dir).select("row_id", F.round(p, 6).alias("p"))


_CEN = [(-1.0, 1.0), (0.0, 2.0), (1.5, 4.0)]
_FAR = [f"pow(z_realized_vol - {v}, 2) + pow(spread_ticks - {s}, 2)" for v, s in _CEN]


@_q("ml_regime_hysteresis", _RG + f", x AS (SELECT row_id, i, trade_date, row_number() OVER (PARTITION BY i, trade_date ORDER BY ts, row_id) AS k, CASE WHEN {_FAR[0]} <= least({_FAR[1]}, {_FAR[2]}) THEN 0 WHEN {_FAR[1]} <= {_FAR[2]} THEN 1 ELSE 2 END AS raw FROM r WHERE ts IS NOT NULL AND z_realized_vol IS NOT NULL AND spread_ticks IS NOT NULL), a AS (SELECT *, CASE WHEN min(raw) OVER w = max(raw) OVER w AND count(*) OVER w = 5 THEN raw END AS agreed FROM x WINDOW w AS (PARTITION BY i, trade_date ORDER BY k ROWS 4 PRECEDING)) SELECT row_id, raw, coalesce(last_value(agreed IGNORE NULLS) OVER (PARTITION BY i, trade_date ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS regime FROM a")
def ml_regime_hysteresis(spark, sf_dir):
    r = _rg(spark, sf_dir).where(F.col("ts").isNotNull() & F.col("z_realized_vol").isNotNull() & F.col("spread_ticks").isNotNull())
    r = r.withColumn("raw", ML.nearest_regime(F.col("z_realized_vol"), F.col("spread_ticks"), _CEN))
    return ML.hysteresis(r, ["i", "trade_date"], ["ts", "row_id"], "raw").select("row_id", "raw", "regime")


_PR70 = "list_sort(list({c}) OVER w100)[cast(floor(count({c}) OVER w100 * 0.7) AS BIGINT) + 1]"


@_q("ml_regime_percentile", _RG + f", o AS (SELECT *, row_number() OVER (PARTITION BY i, trade_date ORDER BY ts, row_id) AS k FROM r WHERE ts IS NOT NULL AND z_realized_vol IS NOT NULL AND spread_ticks IS NOT NULL), p AS (SELECT row_id, z_realized_vol AS v, spread_ticks AS s, count(*) OVER w100 AS n, {_PR70.format(c='z_realized_vol')} AS qv, {_PR70.format(c='spread_ticks')} AS qs FROM o WINDOW w100 AS (PARTITION BY i, trade_date ORDER BY k ROWS 99 PRECEDING)) SELECT row_id, cast(CASE WHEN n < 10 THEN 0 ELSE CASE WHEN v > qv THEN 1 ELSE 0 END + CASE WHEN s > qs THEN 2 ELSE 0 END END AS INT) AS regime FROM p")
def ml_regime_percentile(spark, sf_dir):
    r = _rg(spark, sf_dir).where(F.col("ts").isNotNull() & F.col("z_realized_vol").isNotNull() & F.col("spread_ticks").isNotNull())
    return SG.percentile_regime(r, ["i", "trade_date"], ["ts", "row_id"], "z_realized_vol", "spread_ticks", least=10).select("row_id", "regime")


@_q("ml_entry_filter", _RG + f"SELECT row_id, round(least(greatest((({_LIN}) + 2) / 4, 0), 1), 6) AS p FROM r")
def ml_entry_filter(spark, sf_dir):
    r = _rg(spark, sf_dir)
    return r.select("row_id", F.round(ML.entry_probability(_model().score(r)), 6).alias("p"))


@_q("ml_meta", _RG + f"SELECT row_id, round(1 / (1 + exp(-({_LIN}))), 6) AS p FROM r")
def ml_meta(spark, sf_dir):
    r = _rg(spark, sf_dir)
    return r.select("row_id", F.round(ML.sigmoid(_model().score(r)), 6).alias("p"))


@_q("ml_rls")
def ml_rls(spark, sf_dir):
    return _round(ML.online_errors(_labelled(spark, sf_dir), ["i", "trade_date"], ["ts", "row_id"], _X, "y").select("row_id", "err"))


@_q("ml_online_rmse")
def ml_online_rmse(spark, sf_dir):
    errors = ML.online_errors(_labelled(spark, sf_dir), ["i", "trade_date"], ["ts", "row_id"], _X, "y")
    return _round(ML.online_rmse(errors, ["i", "trade_date"]).select(F.col("i").alias("instrument_id"), F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "n_updates", "rmse"), 5)


# ---- quotes -------------------------------------------------------------------------------------------------------

_CLIP = "least(greatest({}, {}), {})"
_QV = "coalesce(abs(z_realized_vol), 1)"
_QS = f"round_even(1.5 * {_CLIP.format(f'{_QV} / (1 + 1e-10)', 0.5, 3)} * (1 + 0.5 * abs(inv) / 10) * (1 + 4 * abs(tox)) * (1 - 0.3 * {_CLIP.format('gex', -1, 1)}), 0)"
_QB = _RG + ", q AS (SELECT *, row_id % 21 - 10 AS inv, coalesce(z_ofi_l1_500ms, 0) / 10 AS tox, coalesce(z_kyle_lambda, 0) AS gex FROM r)\n"


def _quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rg(spark, sf_dir).withColumns({"inv": F.col("row_id") % 21 - 10, "tox": F.coalesce(F.col("z_ofi_l1_500ms"), F.lit(0.0)) / 10, "gex": F.coalesce(F.col("z_kyle_lambda"), F.lit(0.0))})


@_q("qt_spread", _QB + f"SELECT row_id, cast({_CLIP.format(_QS, 1, 8)} AS INT) AS spread FROM q")
def qt_spread(spark, sf_dir):
    q = _quote_rows(spark, sf_dir)
    return q.select("row_id", ML.quote_spread(F.lit(1.5), F.coalesce(F.abs("z_realized_vol"), F.lit(1.0)), F.lit(1.0), F.col("inv"), F.col("tox"), F.col("gex")).alias("spread"))


@_q("qt_skew", _QB + "SELECT row_id, cast(round_even(-sign(inv) * least(abs(inv) / 5, 2) - sign(tox) * least(abs(tox) / 0.25, 1.5), 0) AS INT) AS skew FROM q")
def qt_skew(spark, sf_dir):
    q = _quote_rows(spark, sf_dir)
    return q.select("row_id", ML.quote_skew(F.col("inv"), F.col("tox")).alias("skew"))


@_q("qt_blend", _QB + ", b AS (SELECT row_id, inv, least(greatest((0.7 * coalesce(spread_ticks, 1.0) + 0.3 * least(greatest(1 + tox, 0.5), 5)) * (1 + 0.1 * abs(gex)), 0.5), 5) AS h, least(greatest(0.02 * inv, -2), 2) AS k FROM q) SELECT row_id, round(h, 9) AS half_spread, round(least(greatest(h + k, 0.5), 8), 9) AS bid_off, round(least(greatest(h - k, 0.5), 8), 9) AS ask_off FROM b")
def qt_blend(spark, sf_dir):
    q = _quote_rows(spark, sf_dir)
    cols = ML.blended_half_spread(F.col("spread_ticks"), 1 + F.col("tox"), F.abs("gex"), F.col("inv"))
    return q.select("row_id", *[F.round(v, 9).alias(k) for k, v in cols.items()])


@_q("prj_rebuilt_quotes", _TF + "SELECT row_id, " + ", ".join(f"round(mid {'-' if s == 'bid' else '+'} (spread * 0.125 + {k * 0.25}), 6) AS {s}_px_{k:02d}" for s in ("bid", "ask") for k in range(10)) + " FROM tf")
def prj_rebuilt_quotes(spark, sf_dir):
    cols = SM.rebuilt_quotes(F.col("mid"), F.col("spread"))
    return _tf(spark, sf_dir).select("row_id", *[F.round(v, 6).alias(k) for k, v in cols.items()])


# ---- options ------------------------------------------------------------------------------------------------------

_OQ = """WITH s AS (SELECT row_id, ts AS ts_ns, trade_price AS px, trade_size AS bid_sz_00, 'SPX   ' || strftime(trade_date + cast(row_id % 3 * 7 + 1 AS INT), '%y%m%d') || CASE WHEN row_id % 2 = 1 THEN 'C' ELSE 'P' END || lpad(cast(cast((floor(trade_price / 25) * 25 + (row_id % 9 - 4) * 25) * 1000 AS BIGINT) AS VARCHAR), 8, '0') AS symbol FROM trades WHERE ts IS NOT NULL AND trade_price > 200),
q AS (SELECT *, cast(substr(symbol, 14, 8) AS DOUBLE) / 1000 AS opt_strike, substr(symbol, 13, 1) AS opt_type, trim(substr(symbol, 1, 6)) AS opt_root, strptime(substr(symbol, 7, 6), '%y%m%d')::DATE AS opt_expiry FROM s),
p AS (SELECT *, greatest(CASE WHEN opt_type = 'C' THEN px - 24 - opt_strike ELSE opt_strike - px + 24 END, 0) + 5 + row_id % 7 AS opt_mid FROM q)
"""


def _option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with option symbols made from the trades, as no option quotes are among the tables."""
    t = tables(spark, sf_dir, "trades").where(F.col("ts").isNotNull() & (F.col("trade_price") > 200))
    strike = (F.floor(F.col("trade_price") / 25) * 25 + (F.col("row_id") % 9 - 4) * 25) * 1000
    symbol = F.concat(F.lit("SPX   "), F.date_format(F.date_add("trade_date", (F.col("row_id") % 3 * 7 + 1).cast("int")), "yyMMdd"), F.when(F.col("row_id") % 2 == 1, "C").otherwise("P"), F.lpad(strike.cast("bigint").cast("string"), 8, "0"))
    t = t.select("row_id", F.col("ts").alias("ts_ns"), F.col("trade_price").alias("px"), F.col("trade_size").alias("bid_sz_00"), symbol.alias("symbol"))
    t = t.withColumns(OP.parse_symbol(F.col("symbol")))
    inner = F.when(F.col("opt_type") == "C", F.col("px") - 24 - F.col("opt_strike")).otherwise(F.col("opt_strike") - F.col("px") + 24)
    return t.withColumn("opt_mid", F.greatest(inner, F.lit(0.0)) + 5 + F.col("row_id") % 7)


@_q("op_symbol_parse", _OQ + "SELECT row_id, opt_root, strftime(opt_expiry, '%Y-%m-%d') AS opt_expiry, opt_type, opt_strike FROM p")
def op_symbol_parse(spark, sf_dir):
    return _option_quotes(spark, sf_dir).select("row_id", "opt_root", F.date_format("opt_expiry", "yyyy-MM-dd").alias("opt_expiry"), "opt_type", "opt_strike")


@_q("op_tumbling_snapshots", _OQ + ", e AS (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM p), k AS (SELECT lo + ((ts_ns - lo) // 60000000000 + 1) * 60000000000 AS snap_ns, hi, p.* FROM p, e) SELECT snap_ns, count(*) AS n, count(DISTINCT opt_strike) AS strikes FROM k WHERE snap_ns < hi GROUP BY 1 HAVING count(*) >= 2")
def op_tumbling_snapshots(spark, sf_dir):
    return OP.snapshots(_option_quotes(spark, sf_dir)).groupBy("snap_ns").agg(F.count("*").alias("n"), F.countDistinct("opt_strike").alias("strikes")).where(F.col("n") >= 2)


@_q("op_topk_strikes", _OQ + ", e AS (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM p), k AS (SELECT lo + ((ts_ns - lo) // 60000000000 + 1) * 60000000000 AS snap_ns, hi, p.* FROM p, e) SELECT snap_ns, row_id, cast(row_number() OVER w AS INT) AS near FROM k WHERE snap_ns < hi AND opt_type = 'C' WINDOW w AS (PARTITION BY snap_ns, opt_expiry ORDER BY abs(opt_strike - px), opt_strike, row_id) QUALIFY row_number() OVER w <= 3")
def op_topk_strikes(spark, sf_dir):
    w = Window.partitionBy("snap_ns", "opt_expiry").orderBy(F.abs(F.col("opt_strike") - F.col("px")), "opt_strike", "row_id")
    return OP.snapshots(_option_quotes(spark, sf_dir)).where(F.col("opt_type") == "C").withColumn("near", F.row_number().over(w)).where(F.col("near") <= 3).select("snap_ns", "row_id", "near")


def _op_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    spot = tables(spark, sf_dir, "trades").where(F.col("ts").isNotNull()).select(F.col("ts").alias("ts_ns"), F.col("row_id").alias("pos"), F.col("trade_price").alias("mid"))
    return OP.priced(OP.snapshots(_option_quotes(spark, sf_dir), 3600), spot)


@_q("op_iv")
def op_iv(spark, sf_dir):
    return _op_priced(spark, sf_dir).select("snap_ns", "row_id", "rank", F.round("iv", 4).alias("iv"))


@_q("op_greeks")
def op_greeks(spark, sf_dir):
    g = OP.greeks("spot", "opt_strike", "t", F.lit(0.05), "iv", F.col("opt_type") == "C")
    return _op_priced(spark, sf_dir).where(F.col("iv").isNotNull()).select("snap_ns", "row_id", g.alias("g")).select("snap_ns", "row_id", *[F.round(f"g.{c}", n).alias(c) for c, n in (("delta", 5), ("gamma", 7), ("vega", 3), ("vanna", 4), ("price", 3))])


@_q("op_surface")
def op_surface(spark, sf_dir):
    quotes = _option_quotes(spark, sf_dir)
    measures = OP.surface(_op_priced(spark, sf_dir), position="row_id")
    return _round(OP.with_empty(measures, OP.snapshot_times(quotes, 3600)), 4, net_gex=0, vanna_pressure=2, zero_dte_frac=6)


@_q("aj_back_snapshot", f"WITH s AS (SELECT instrument_id, ts_ns, snap_id, {_nn('atm_iv')}, {_nn('net_gex')} FROM options_features WHERE ts_ns IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument_id, ts_ns ORDER BY snap_id DESC) = 1) SELECT r.row_id, s.atm_iv, s.net_gex FROM regressors r ASOF LEFT JOIN s ON r.instrument_id = s.instrument_id AND r.ts_ns >= s.ts_ns WHERE r.ts_ns IS NOT NULL")
def aj_back_snapshot(spark, sf_dir):
    o = tables(spark, sf_dir, "options_features").select("instrument_id", "ts_ns", "snap_id", A.clean("atm_iv").alias("atm_iv"), A.clean("net_gex").alias("net_gex")).where(F.col("ts_ns").isNotNull())
    r = tables(spark, sf_dir, "regressors").select("instrument_id", "ts_ns", "row_id").where(F.col("ts_ns").isNotNull())
    return temporal.backward(r, o, ["instrument_id"], "ts_ns", "snap_id", ["atm_iv", "net_gex"]).select("row_id", "atm_iv", "net_gex")


@_q("aj_iv_change")
def aj_iv_change(spark, sf_dir):
    o = tables(spark, sf_dir, "options_features").select("instrument_id", "ts_ns", "snap_id", A.clean("atm_iv").alias("atm_iv")).where(F.col("ts_ns").isNotNull())
    r = tables(spark, sf_dir, "regressors").select("instrument_id", "ts_ns", "row_id").where(F.col("ts_ns").isNotNull())
    return OP.aligned(r, o, ["instrument_id"], "row_id", ["atm_iv"]).select("row_id", "atm_iv", "iv_change")


@_q("aj_fwd_same_date", f"WITH r AS (SELECT row_id, trade_date, instrument_id AS i, ts_ns AS ts, {_nn('mid')}, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns, row_id) AS k FROM regressors WHERE ts_ns IS NOT NULL), x AS (SELECT *, min(k) OVER (PARTITION BY i ORDER BY ts RANGE BETWEEN 60000000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS fk FROM r) SELECT x.row_id, CASE WHEN f.trade_date = x.trade_date THEN round(f.mid - x.mid, 6) END AS fwd FROM x LEFT JOIN r f ON f.i = x.i AND f.k = x.fk")
def aj_fwd_same_date(spark, sf_dir):
    r = tables(spark, sf_dir, "regressors").where(F.col("ts_ns").isNotNull()).select("row_id", "trade_date", F.col("instrument_id").alias("i"), F.col("ts_ns").alias("ts"), A.clean("mid").alias("mid"))
    later = r.withColumnsRenamed({"trade_date": "fdate", "mid": "fmid"})
    r = temporal.first_after(r, later, ["i"], "ts", "row_id", ["fdate", "fmid"], 60 * ML.NS)
    return r.select("row_id", F.when(F.col("fdate") == F.col("trade_date"), F.round(F.col("fmid") - F.col("mid"), 6)).alias("fwd"))


# ---- execution ----------------------------------------------------------------------------------------------------


@_q("sm_backtest")
def sm_backtest(spark, sf_dir):
    return SM.simulate(tables(spark, sf_dir, "market_data"))


@_q("sm_kpis")
def sm_kpis(spark, sf_dir):
    return SM.kpis(SM.simulate(tables(spark, sf_dir, "market_data")))


_MD = "WITH m AS (SELECT row_id, symbol, timestamp_ns AS ts, timestamp_ns // 86400000000000 AS day, trade_side, bid_px_00, ask_px_00, row_number() OVER (PARTITION BY symbol, timestamp_ns // 86400000000000 ORDER BY timestamp_ns, row_id) AS k, (CASE WHEN NOT (cast(bid_px_00 AS VARCHAR) = 'nan') THEN bid_px_00 END + CASE WHEN NOT (cast(ask_px_00 AS VARCHAR) = 'nan') THEN ask_px_00 END) / 2 AS mid FROM market_data)\n"


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "market_data").select("row_id", "symbol", F.col("timestamp_ns").alias("ts"), C.floor_div(F.col("timestamp_ns"), 86_400 * ML.NS).alias("day"), "trade_side", ((A.clean("bid_px_00") + A.clean("ask_px_00")) / 2).alias("mid"))


@_q("sm_streaks", _MD + ", g AS (SELECT *, CASE WHEN lag(trade_side) OVER w IS DISTINCT FROM trade_side THEN 1 ELSE 0 END AS nw FROM m WINDOW w AS (PARTITION BY symbol, day ORDER BY k)), r AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, day ORDER BY k) AS run FROM g) SELECT row_id, cast(row_number() OVER (PARTITION BY symbol, day, run ORDER BY k) AS INT) AS streak FROM r")
def sm_streaks(spark, sf_dir):
    return SM.streaks(_md(spark, sf_dir), ["symbol", "day"], ["ts", "row_id"], F.coalesce("trade_side", F.lit(""))).select("row_id", "streak")


@_q("sm_hindsight", _MD + ", v AS (SELECT row_id, symbol, day, k, mid FROM m WHERE mid IS NOT NULL) SELECT row_id, " + ", ".join(f"max(mid) OVER w{n} - mid AS rise_{n}, min(mid) OVER w{n} - mid AS fall_{n}" for n in (10, 20, 40)) + " FROM v WINDOW " + ", ".join(f"w{n} AS (PARTITION BY symbol, day ORDER BY k ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)" for n in (10, 20, 40)))
def sm_hindsight(spark, sf_dir):
    return SM.hindsight(_md(spark, sf_dir).where(F.col("mid").isNotNull()), ["symbol", "day"], ["ts", "row_id"], "mid").drop("symbol", "day", "ts", "trade_side", "mid")


@_q("sm_entry_sampling", _MD + "SELECT symbol, count(*) AS n, round(avg(mid), 4) AS mean_mid FROM m WHERE k % 20 = 0 GROUP BY 1")
def sm_entry_sampling(spark, sf_dir):
    s = SM.systematic_sample(_md(spark, sf_dir), ["symbol", "day"], ["ts", "row_id"])
    return _round(s.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("mid").alias("mean_mid")), 4)


_INV = "cast(sum(CASE trade_side WHEN 'B' THEN 7 WHEN 'A' THEN -7 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT)"


@_q("sm_inventory_control", _MD + f", v AS (SELECT row_id, mid, {_INV} AS inv FROM m) SELECT row_id, cast(round(0.15 * abs(inv), 6) AS DOUBLE) AS penalty, mid - CASE WHEN inv > 0 THEN least(inv // 10, 3) ELSE 0 END * 0.25 AS skewed_bid, cast(CASE WHEN abs(inv) > 50 THEN greatest(5 // 2, 1) ELSE 5 END AS INT) AS size FROM v")
def sm_inventory_control(spark, sf_dir):
    w = Window.partitionBy("symbol", "day").orderBy("ts", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    side = F.when(F.col("trade_side") == "B", 7).when(F.col("trade_side") == "A", -7).otherwise(0)
    m = _md(spark, sf_dir).withColumn("inv", F.sum(side).over(w))
    out = m.withColumns(SG.inventory_control(F.col("inv"), F.col("mid"), F.lit(5)))
    return out.select("row_id", F.round("penalty", 6).alias("penalty"), "skewed_bid", "size")


@_q("sm_entry_means", "WITH v AS (SELECT trade_side, symbol, timestamp_ns // 86400000000000 AS day, timestamp_ns AS ts, row_id, " + ", ".join(_nn(c) for c in ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00")) + " FROM market_data WHERE trade_side IN ('B', 'A')), s AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, trade_side ORDER BY ts, row_id) AS k FROM v) SELECT trade_side, count(*) AS n, round(avg((ask_px_00 - bid_px_00) / 0.25), 5) AS mean_spread, round(avg(CASE WHEN bid_sz_00 + ask_sz_00 > 0 THEN bid_sz_00 / (bid_sz_00 + ask_sz_00) ELSE 0 END), 5) AS mean_qi_bid FROM s WHERE k % 20 = 0 GROUP BY 1")
def sm_entry_means(spark, sf_dir):
    m = tables(spark, sf_dir, "market_data").where(F.col("trade_side").isin("B", "A"))
    b, a = A.clean("bid_sz_00"), A.clean("ask_sz_00")
    m = m.select("trade_side", "symbol", C.floor_div(F.col("timestamp_ns"), 86_400 * ML.NS).alias("day"), F.col("timestamp_ns").alias("ts"), "row_id", ((A.clean("ask_px_00") - A.clean("bid_px_00")) / C.TICK).alias("spread"), F.when(b + a > 0, b / (b + a)).otherwise(0.0).alias("qi_bid"))
    return _round(SM.entry_means(m, ["symbol", "day"], ["ts", "row_id"], "trade_side", ["spread", "qi_bid"]), 5)


@_q("sm_cancel_hindsight")
def sm_cancel_hindsight(spark, sf_dir):
    marked = SM.hindsight(_md(spark, sf_dir).where(F.col("mid").isNotNull()), ["symbol", "day"], ["ts", "row_id"], "mid")
    return SM.cancel_hindsight(SM.simulate(tables(spark, sf_dir, "market_data")), marked, "symbol", "ts", [f"{k}_{n}" for n in (10, 20, 40) for k in ("rise", "fall")])


@_q("sm_rolling_share", _TF + "SELECT row_id, round(avg(CASE WHEN abs(imb) > 0.5 THEN 1.0 ELSE 0 END) OVER (PARTITION BY i, trade_date ORDER BY ts, row_id ROWS 999 PRECEDING), 6) AS share FROM tf WHERE ts IS NOT NULL")
def sm_rolling_share(spark, sf_dir):
    return _round(SM.rolling_share(_tf(spark, sf_dir).where(F.col("ts").isNotNull()), ["i", "trade_date"], ["ts", "row_id"], F.abs("imb") > 0.5).select("row_id", "share"))


@_q("sm_inventory", _MD + "SELECT row_id, cast(sum(CASE trade_side WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inventory FROM m")
def sm_inventory(spark, sf_dir):
    w = Window.partitionBy("symbol", "day").orderBy("ts", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    side = F.when(F.col("trade_side") == "B", 1).when(F.col("trade_side") == "A", -1).otherwise(0)
    return _md(spark, sf_dir).select("row_id", F.sum(side).over(w).alias("inventory"))


# ---- signals over depth rows --------------------------------------------------------------------------------------

_SG = "WITH m AS (SELECT row_id, symbol, timestamp_ns AS ts, timestamp_ns // 86400000000000 AS day, " + ", ".join(_nn(c) for c in ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "trade_size")) + " FROM market_data), v AS (SELECT *, (bid_px_00 + ask_px_00) / 2 AS mid, coalesce(trade_size, 0) AS vol, CASE WHEN coalesce(bid_sz_00, 0) + coalesce(ask_sz_00, 0) > 0 THEN (coalesce(bid_sz_00, 0) - coalesce(ask_sz_00, 0)) / (coalesce(bid_sz_00, 0) + coalesce(ask_sz_00, 0)) ELSE 0 END AS flow, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, row_id) AS k FROM m WHERE bid_px_00 IS NOT NULL AND ask_px_00 IS NOT NULL)\n"
_W = "(PARTITION BY symbol, day ORDER BY k{})"


def _depth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables(spark, sf_dir, "market_data")
    m = m.select("row_id", "symbol", F.col("timestamp_ns").alias("ts"), C.floor_div(F.col("timestamp_ns"), 86_400 * ML.NS).alias("day"), *[A.clean(c).alias(c) for c in ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "trade_size")])
    m = m.where(F.col("bid_px_00").isNotNull() & F.col("ask_px_00").isNotNull())
    b, a = F.coalesce("bid_sz_00", F.lit(0.0)), F.coalesce("ask_sz_00", F.lit(0.0))
    return m.withColumns({"mid": (F.col("bid_px_00") + F.col("ask_px_00")) / 2, "vol": F.coalesce("trade_size", F.lit(0.0)), "flow": F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0)})


_KEY = (["symbol", "day"], ["ts", "row_id"])


@_q("aj_row_lookbacks", _SG + f"SELECT row_id, lag(mid, 5) OVER {_W.format('')} AS mid_back5, lag(mid, 10) OVER {_W.format('')} AS mid_back10 FROM v")
def aj_row_lookbacks(spark, sf_dir):
    return SG.row_lookbacks(_depth_rows(spark, sf_dir), *_KEY, "mid").select("row_id", "mid_back5", "mid_back10")


_PR = f""", s AS (SELECT *, coalesce((mid - lag(mid, 4) OVER w) / 0.25, 0) AS momentum, coalesce((lag(mid, 10) OVER w - lag(mid, 5) OVER w) / 0.25, 0) AS momentum_acc,
  CASE WHEN k >= 10 THEN (sum(vol) OVER {_W.format(' ROWS 4 PRECEDING')} - sum(vol) OVER {_W.format(' ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING')}) / 5 ELSE 0 END AS volume_acc,
  CASE WHEN k >= 5 THEN avg(flow) OVER {_W.format(' ROWS 2 PRECEDING')} - avg(flow) OVER {_W.format(' ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING')} ELSE 0 END AS flow_trend FROM v WINDOW w AS {_W.format('')})
"""
_MV = {n: f"CASE WHEN k >= 10 THEN least((CASE WHEN {s}momentum > 0.2 THEN 0.3 ELSE 0 END + CASE WHEN {s}momentum_acc > 0.1 THEN 0.3 ELSE 0 END + CASE WHEN volume_acc > 5 THEN 0.2 ELSE 0 END + CASE WHEN {s}flow_trend > 0.1 THEN 0.2 ELSE 0 END) * (greatest({s}momentum, 0) + greatest({s}momentum_acc, 0)), 5) ELSE 0 END" for n, s in (("up", ""), ("down", "-"))}


@_q("sm_predictor", _SG + _PR + f"SELECT row_id, momentum, momentum_acc, round(volume_acc, 6) AS volume_acc, round(flow_trend, 6) AS flow_trend, round({_MV['up']}, 6) + 0.0 AS move_up, round({_MV['down']}, 6) + 0.0 AS move_down FROM s")
def sm_predictor(spark, sf_dir):
    p = SG.predictor(_depth_rows(spark, sf_dir), *_KEY, "mid", "vol", "flow")
    p = _round(p.select("row_id", "momentum", "momentum_acc", "volume_acc", "flow_trend", "move_up", "move_down"))
    return p.withColumns({c: F.col(c) + 0.0 for c in ("move_up", "move_down")})


@_q("ew_impact_ratio", _SG + f""", d AS (SELECT *, abs(mid - lag(mid) OVER w) / 0.25 AS dm, abs(flow - lag(flow) OVER w) AS dfl FROM v WINDOW w AS {_W.format('')}),
s AS (SELECT *, sum(CASE WHEN dfl > 0.001 THEN dm ELSE 0 END) OVER w AS up, sum(CASE WHEN dfl > 0.001 THEN dfl ELSE 0 END) OVER w AS dn FROM d WINDOW w AS {_W.format(' ROWS 3 PRECEDING')}),
i AS (SELECT *, CASE WHEN k > 4 AND dn > 0.001 THEN least(greatest(up / dn, 0.001), 0.05) END AS impact FROM s),
a AS (SELECT *, CASE WHEN impact IS NOT NULL THEN avg(impact) OVER (PARTITION BY symbol, day, impact IS NULL ORDER BY k ROWS 49 PRECEDING) END AS av FROM i)
SELECT row_id, round(impact, 6) AS impact, round(coalesce(last_value(av IGNORE NULLS) OVER {_W.format(' ROWS UNBOUNDED PRECEDING')}, 0.01), 6) AS avg_impact FROM a""")
def ew_impact_ratio(spark, sf_dir):
    return _round(SG.impact_ratio(_depth_rows(spark, sf_dir), *_KEY, "mid", "flow").select("row_id", "impact", "avg_impact"))


@_q("ew_stale_scaler", _SG + f""", f AS (SELECT *, CASE WHEN k % 50 = 0 OR k >= 500 THEN avg(mid) OVER {_W.format(' ROWS 499 PRECEDING')} END AS mm, CASE WHEN k % 50 = 0 OR k >= 500 THEN stddev_pop(mid) OVER {_W.format(' ROWS 499 PRECEDING')} END AS ss FROM v),
c AS (SELECT *, coalesce(last_value(mm IGNORE NULLS) OVER w, 0) AS m0, coalesce(last_value(ss IGNORE NULLS) OVER w, 1) AS s0 FROM f WINDOW w AS {_W.format(' ROWS UNBOUNDED PRECEDING')})
SELECT row_id, round((mid - m0) / CASE WHEN s0 < 1e-6 THEN 1 ELSE s0 END, 4) AS mid_scaled FROM c""")
def ew_stale_scaler(spark, sf_dir):
    return _round(SG.stale_scaler(_depth_rows(spark, sf_dir), *_KEY, "mid").select("row_id", "mid_scaled"), 4)


@_q("bk_depth_balance", _SG + "SELECT row_id, round(CASE WHEN b + a > 0 THEN b / (b + a) ELSE 0 END, 9) AS qi_bid, round(CASE WHEN b + a > 0 THEN a / (b + a) ELSE 0 END, 9) AS qi_ask, round(CASE WHEN a > 0.001 THEN b / a ELSE 1 END, 9) AS depth_ratio FROM (SELECT row_id, coalesce(bid_sz_00, 0) AS b, coalesce(ask_sz_00, 0) AS a FROM v)")
def bk_depth_balance(spark, sf_dir):
    d = _depth_rows(spark, sf_dir)
    return _round(d.select("row_id", *[v.alias(k) for k, v in SG.depth_balance(F.array("bid_sz_00"), F.array("ask_sz_00")).items()]), 9)
