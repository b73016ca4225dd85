"""DuckDB twins of the numerical queries: linear systems by elimination, weighted sums by quadratic joins, volatilities by halving."""

from __future__ import annotations

from tickloom.operators import models as ML
from tickloom.operators import options as OP
from tickloom.plans.book_queries import _SH, _TRADES, _g, _gs
from tickloom.plans.stat_queries import _OQ, _RG, _TF, _THR, _X, _nn

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _eliminated(keys: str, source: str, p: int) -> str:
    """A recursive relation ``gj`` that solves the systems ``m`` (rows of coefficients and right-hand sides) of ``source`` by elimination."""
    step = "list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / row[k]) ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END)"
    return f"gj AS (SELECT 1 AS k, {keys}, m FROM {source} UNION ALL SELECT k + 1, {keys}, {step} FROM gj WHERE k <= {p})"


# ---- inverse covariance, regressions ----------------------------------------------------------------------------------

_P = len(_X)
_COV = "[" + ", ".join("[" + ", ".join([*[f"covar_samp({a}, {b})" + (" + 1e-6" if a == b else "") for b in _X], *["1.0" if a == b else "0.0" for b in _X]]) + "]" for a in _X) + "]"
_RR = _RG.replace("WITH r AS", "WITH RECURSIVE r AS", 1)
ORACLES["ag_vif"] = (
    _RR + ", z AS (SELECT " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _X) + f" FROM r), g0 AS (SELECT 0 AS one, {_COV} AS m FROM z), " + _eliminated("one", "g0", _P)
    + ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, m[{k}][{_P + k}] * (SELECT var_samp({c}) FROM z) AS vif FROM gj WHERE k = {_P + 1}" for k, c in enumerate(_X, 1)) + ") SELECT feature, round(vif, 6) AS vif FROM v"
)

_SX = ["tox", "vol", "spread", "tox_vol"]
_SYS = "[" + ", ".join("[" + ", ".join([*[f"covar_pop({a}, {b}) * count(*) / ((stddev_pop({a}) + 1e-8) * (stddev_pop({b}) + 1e-8))" + (" + 1e-4 * count(*)" if a == b else "") for b in _SX], f"covar_pop({a}, y) * count(*) / (stddev_pop({a}) + 1e-8)"]) + "]" for a in _SX) + "]"
ORACLES["ml_spread_regression"] = (
    _TF.replace("WITH tf0 AS", "WITH RECURSIVE tf0 AS", 1)
    + f", {_THR}, t AS (SELECT least(greatest(abs(signed), 0.5), 5) AS y, abs(imb) AS tox, cast(CASE WHEN lsd >= q2 THEN 2 WHEN lsd >= q1 THEN 1 ELSE 0 END AS DOUBLE) AS vol, spread, abs(imb) * CASE WHEN lsd >= q2 THEN 2 WHEN lsd >= q1 THEN 1 ELSE 0 END AS tox_vol FROM tf, thr WHERE lsd IS NOT NULL AND imb IS NOT NULL AND spread IS NOT NULL AND signed IS NOT NULL),"
    + f" g0 AS (SELECT 0 AS one, {_SYS} AS m FROM t), " + _eliminated("one", "g0", len(_SX))
    + ", s AS (SELECT avg(y) AS y, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS s_{c}" for c in _SX) + " FROM t),"
    + " b AS (SELECT s.*, " + ", ".join(f"m[{k}][{len(_SX) + 1}] / s_{c} AS b_{c}" for k, c in enumerate(_SX, 1)) + f" FROM gj, s WHERE k = {len(_SX) + 1}), o AS ("
    + "SELECT 'intercept' AS term, y - " + " - ".join(f"b_{c} * m_{c}" for c in _SX) + " AS coefficient FROM b" + "".join(f" UNION ALL SELECT '{c}', b_{c} FROM b" for c in _SX) + ") SELECT term, round(coefficient, 6) AS coefficient FROM o"
)

_V = ["1.0", *[f"x{k}" for k in range(1, _P + 1)], "y"]
_AT = {(i, j): n for n, (i, j) in enumerate(((i, j) for i in range(_P + 2) for j in range(i, _P + 2)), 1)}
_SUMS = "[" + ", ".join(f"sum({_V[i]} * {_V[j]})" for i, j in _AT) + "]"


def _s(name: str, i: int, j: int) -> str:
    return f"{name}[{_AT[min(i, j), max(i, j)]}]"


def _sd(name: str, i: int) -> str:
    return f"(sqrt(greatest({_s(name, i, i)} / {_s(name, 0, 0)} - pow({_s(name, 0, i)} / {_s(name, 0, 0)}, 2), 0)) + 1e-8)"


_RSYS = "[" + ", ".join(
    "[" + ", ".join([*[f"({_s('s', i, j)} - {_s('s', 0, i)} * {_s('s', 0, j)} / {_s('s', 0, 0)}) / (sd[{i}] * sd[{j}])" + (" + alpha" if i == j else "") for j in range(1, _P + 1)], f"({_s('s', i, _P + 1)} - {_s('s', 0, i)} * {_s('s', 0, _P + 1)} / {_s('s', 0, 0)}) / sd[{i}]"]) + "]"
    for i in range(1, _P + 1)
) + "]"
_FULL = [*[f"fu[{k}]" for k in range(1, _P + 2)], "(-1.0)"]
_SSE = " + ".join(f"{_FULL[i]} * {_FULL[j]} * {_s('te', i, j)} * {1 if i == j else 2}" for i, j in _AT)
ORACLES["ml_ridge"] = _RR + f""", o AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS rn, count(*) OVER () AS n, row_number() OVER (PARTITION BY i, trade_date ORDER BY ts, row_id) AS k FROM r WHERE ts IS NOT NULL),
fo AS (SELECT *, cast(least(rn // greatest(n // 5, 1), 4) AS INT) AS fold FROM o),
b AS (SELECT fold, min(ts) AS st, max(ts) AS en FROM fo GROUP BY 1),
w AS (SELECT fold, ts, {", ".join(f"coalesce({c}, 0) AS x{k}" for k, c in enumerate(_X, 1))}, {", ".join(f"arg_min({{'v': mid}}, k) OVER (PARTITION BY i, trade_date ORDER BY ts RANGE BETWEEN {h * 1_000_000} FOLLOWING AND UNBOUNDED FOLLOWING).v - mid AS y_{name}" for name, (h, _, _) in ML.HORIZONS.items())} FROM fo),
l AS ({" UNION ALL ".join(f"SELECT '{name}' AS h, {p * 1_000_000} AS purge, {e * 1_000_000} AS emb, fold, ts, {', '.join(_V[1:-1])}, y_{name} AS y FROM w WHERE y_{name} IS NOT NULL" for name, (_, p, e) in ML.HORIZONS.items())}),
tr AS (SELECT h, b.fold AS f, {_SUMS} AS s FROM l JOIN b ON l.fold < b.fold AND ts < st - purge OR l.fold > b.fold AND ts > en + emb GROUP BY 1, 2),
tt AS (SELECT h, fold AS f, {_SUMS} AS te FROM l GROUP BY 1, 2),
us AS (SELECT tr.*, te FROM tr JOIN tt USING (h, f) WHERE s[1] >= 100 AND te[1] >= 10),
wh AS (SELECT h, -1 AS f, {_SUMS} AS s FROM l GROUP BY 1),
al AS (SELECT unnest([{", ".join(repr(a) for a in ML.ALPHAS)}]) AS alpha),
a0 AS (SELECT h, f, alpha, s, te, [{", ".join(_sd("s", k) for k in range(1, _P + 1))}] AS sd FROM (SELECT h, f, s, te FROM us UNION ALL SELECT h, f, s, NULL FROM wh), al),
g0 AS (SELECT h, f, alpha, {_RSYS} AS m FROM a0),
{_eliminated("h, f, alpha", "g0", _P)},
sol AS (SELECT h, f, alpha, s, te, sd, list_transform(m, lambda row: row[{_P + 1}]) AS w FROM gj JOIN a0 USING (h, f, alpha) WHERE k = {_P + 1}),
er AS (SELECT h, alpha, sum(greatest({_SSE}, 0)) AS sse FROM (SELECT *, [{_s("s", 0, _P + 1)} / s[1] - {" - ".join(f"w[{k}] / sd[{k}] * {_s('s', 0, k)} / s[1]" for k in range(1, _P + 1))}, {", ".join(f"w[{k}] / sd[{k}]" for k in range(1, _P + 1))}] AS fu FROM sol WHERE te IS NOT NULL) GROUP BY 1, 2),
pt AS (SELECT h, sum({_s("te", _P + 1, _P + 1)}) - pow(sum({_s("te", 0, _P + 1)}), 2) / sum(te[1]) AS total FROM us GROUP BY 1),
ch AS (SELECT h, arg_max(alpha, r2) AS alpha FROM (SELECT h, alpha, 1 - sse / total AS r2 FROM er JOIN pt USING (h) WHERE total > 0) GROUP BY 1),
fin AS (SELECT wh.h, coalesce(ch.alpha, 1.0) AS alpha, wh.s FROM wh LEFT JOIN ch USING (h)),
ow AS (SELECT fin.h, fin.s, w FROM fin JOIN sol ON fin.h = sol.h AND fin.alpha = sol.alpha AND sol.f = -1)
SELECT h AS horizon, 'intercept' AS feature, round({_s("s", 0, _P + 1)} / s[1], 6) AS weight FROM ow
{" ".join(f"UNION ALL SELECT h, '{c}', round(w[{k}], 6) FROM ow" for k, c in enumerate(_X, 1))}"""

_LAM, _Q = 0.9999, _P + 1
_RV = ["1.0", *[f"x{k}" for k in range(1, _P + 1)]]
_PREV = "(PARTITION BY i, trade_date ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RLS = "[" + ", ".join(
    "[" + ", ".join([*[f"coalesce(sum({_RV[a]} * {_RV[b]} * g) OVER {_PREV}, 0) / last_g" + (" + 0.01 / last_g" if a == b else "") for b in range(_Q)], f"coalesce(sum({_RV[a]} * y * g) OVER {_PREV}, 0) / last_g"]) + "]" for a in range(_Q)
) + "]"
#: The recursion's weights before a row solve the least squares of the rows before it, weighted down by age, with a start of 1/100.
ORACLES["ml_rls"] = _RR + f""", o AS (SELECT *, lead(mid) OVER (PARTITION BY i ORDER BY ts, row_id) - mid AS y FROM r WHERE ts IS NOT NULL),
d AS (SELECT row_id, i, trade_date, {", ".join(f"coalesce({c}, 0) AS x{k}" for k, c in enumerate(_X, 1))}, y, row_number() OVER (PARTITION BY i, trade_date ORDER BY ts, row_id) AS k FROM o WHERE y IS NOT NULL),
e AS (SELECT *, pow({_LAM}, -k) AS g, pow({_LAM}, -(k - 1)) AS last_g FROM d),
g0 AS (SELECT row_id, {_RLS} AS m FROM e),
{_eliminated("row_id", "g0", _Q)},
f AS (SELECT row_id, y - ({" + ".join(f"{v} * m[{k}][{_Q + 1}]" for k, v in enumerate(_RV, 1))}) AS err FROM gj JOIN e USING (row_id) WHERE gj.k = {_Q + 1})
SELECT o.row_id, round(err, 6) AS err FROM o LEFT JOIN f USING (row_id)"""

ORACLES["ml_online_rmse"] = ORACLES["ml_rls"].replace("SELECT o.row_id, round(err, 6) AS err FROM o LEFT JOIN f USING (row_id)", "SELECT i AS instrument_id, strftime(trade_date, '%Y-%m-%d') AS day, count(err) AS n_updates, round(coalesce(sqrt(avg(err * err)), 0), 5) AS rmse FROM o LEFT JOIN f USING (row_id) GROUP BY 1, 2")

# ---- isotonic regression: the greatest over starts of the least over ends of the mean between --------------------------

ORACLES["ml_isotonic"] = _TF + """, c AS (SELECT avg(CASE WHEN abs(fwd) > 0.125 THEN 1.0 ELSE 0 END) AS rate, coalesce(nullif(median(abs(fwd)), 0), 0.125) AS md FROM tf WHERE fwd IS NOT NULL),
d AS (SELECT abs(imb) AS s, sum(CASE WHEN abs(fwd) > CASE WHEN rate < 0.05 OR rate > 0.95 THEN md ELSE 0.125 END THEN 1 ELSE 0 END) AS y, count(*) AS n FROM tf, c WHERE imb IS NOT NULL AND fwd IS NOT NULL GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY s) AS k, s, sum(y) OVER (ORDER BY s) AS cy, sum(n) OVER (ORDER BY s) AS cn, y, n FROM d),
p AS (SELECT a.k AS a, b.k AS b, cast(b.cy - a.cy + a.y AS DOUBLE) / (b.cn - a.cn + a.n) AS mean FROM k a JOIN k b ON b.k >= a.k),
l AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM p),
f AS (SELECT i, max(low) AS fit FROM l GROUP BY 1),
g AS (SELECT fit, min(s) AS lo, max(s) AS hi FROM f JOIN k ON i = k.k GROUP BY 1)
SELECT round(lo, 9) AS x, round(fit, 9) AS y FROM g UNION ALL SELECT round(hi, 9), round(fit, 9) FROM g WHERE hi > lo"""

# ---- weighted statistics -----------------------------------------------------------------------------------------------


def _weighted(source: str, value: str, half: float, extra: str = "") -> str:
    """Weighted mean and variance of a value over an instrument's rows up to each one."""
    d = f"(a.k - b.k) / {half}"
    return f"""(SELECT i, k, {value}{extra}, s1 / w AS m, CASE WHEN w * w - u > 1e-9 * w * w THEN (s2 / w - pow(s1 / w, 2)) * w * w / (w * w - u) END AS v FROM (
  SELECT a.i, a.k, a.{value}{extra.replace(", ", ", a.")}, sum(CASE WHEN b.{value} IS NOT NULL THEN pow(0.5, {d}) END) AS w, sum(CASE WHEN b.{value} IS NOT NULL THEN pow(0.25, {d}) END) AS u,
         sum(b.{value} * pow(0.5, {d})) AS s1, sum(b.{value} * b.{value} * pow(0.5, {d})) AS s2 FROM {source} a JOIN {source} b ON a.i = b.i AND b.k <= a.k GROUP BY ALL))"""


ORACLES["ew_kyle_lambda"] = _RG + f""", o AS (SELECT row_id, i, z_ofi_l1_500ms AS flow, row_number() OVER (PARTITION BY i ORDER BY ts, row_id) AS k, coalesce(mid - lag(mid) OVER (PARTITION BY i, trade_date ORDER BY ts, row_id), 0) AS dm FROM r WHERE ts IS NOT NULL),
x AS (SELECT *, dm * flow AS xy FROM o),
a1 AS (SELECT * FROM {_weighted("x", "xy", 500.0)}), a2 AS (SELECT * FROM {_weighted("x", "flow", 500.0, ", row_id")}),
q AS (SELECT a2.row_id, i, k, coalesce(CASE WHEN abs(a2.v) > 1e-10 THEN a1.m / a2.v END, 0) AS lam FROM a1 JOIN a2 USING (i, k)),
z AS (SELECT * FROM {_weighted("q", "lam", 5000.0, ", row_id")})
SELECT row_id, round(lam, 6) AS kyle_lambda, round(coalesce((lam - m) / sqrt(greatest(v, 1e-12)), (lam - m) / 1e-6), 4) AS z_kyle_lambda FROM z"""

ORACLES["aj_iv_change"] = f"""WITH s AS (SELECT instrument_id, ts_ns, {_nn('atm_iv')} FROM options_features WHERE ts_ns IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument_id, ts_ns ORDER BY snap_id DESC) = 1),
a AS (SELECT r.row_id, r.instrument_id, r.ts_ns, s.atm_iv FROM regressors r ASOF LEFT JOIN s ON r.instrument_id = s.instrument_id AND r.ts_ns >= s.ts_ns WHERE r.ts_ns IS NOT NULL)
SELECT row_id, atm_iv, coalesce(atm_iv - lag(atm_iv) OVER (PARTITION BY instrument_id ORDER BY ts_ns, row_id), 0) AS iv_change FROM a"""

# ---- options -----------------------------------------------------------------------------------------------------------


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _cdf(x: str) -> str:
    a = f"least(abs({x}), 37.0)"
    far = f"1 / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / sqrt(2 * pi())"
    tail = f"exp(-0.5 * {a} * {a}) * CASE WHEN {a} >= {OP.HART_BOUND!r} THEN {far} ELSE {_poly(OP.HART_UP, a)} / {_poly(OP.HART_DOWN, a)} END"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


def _with_price(source: str, vol: str) -> str:
    """``source`` (s, strike, t, sg) with ``d1``, ``d2`` and the model ``price`` at a volatility."""
    d = f"SELECT *, (ln(s / strike) + (0.05 + 0.5 * {vol} * {vol}) * t) / ({vol} * sqrt(t) + 1e-12) AS d1 FROM {source}"
    u = f"SELECT *, d1 - {vol} * sqrt(t) AS d2, sg * d1 AS u1, sg * (d1 - {vol} * sqrt(t)) AS u2 FROM ({d})"
    return f"(SELECT *, sg * (s * {_cdf('u1')} - strike * exp(-0.05 * t) * {_cdf('u2')}) AS price FROM ({u}))"


_HOUR = 3600 * 1_000_000_000
_PRICED = _OQ.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + f""", p1 AS (SELECT * FROM p WHERE opt_mid > {OP.LEAST_MID} AND opt_strike IS NOT NULL),
en AS (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM p1),
k0 AS (SELECT lo + ((ts_ns - lo) // {_HOUR} + 1) * {_HOUR} AS snap_ns, hi, p1.* FROM p1, en),
k1 AS (SELECT *, count(*) OVER (PARTITION BY snap_ns) AS c FROM k0 WHERE snap_ns < hi),
sp AS (SELECT ts AS ts_ns, arg_max({{'v': trade_price}}, row_id).v AS mid FROM trades WHERE ts IS NOT NULL GROUP BY 1),
sn AS (SELECT t.snap_ns, greatest(sp.mid - {OP.BASIS}, 1.0) AS spot FROM (SELECT DISTINCT snap_ns FROM k1 WHERE c >= {OP.LEAST_QUOTES}) t ASOF JOIN sp ON t.snap_ns >= sp.ts_ns WHERE sp.mid IS NOT NULL AND NOT (cast(sp.mid AS VARCHAR) = 'nan')),
k2 AS (SELECT k1.*, spot, greatest((epoch(opt_expiry) - snap_ns / 1e9) / {OP.YEAR_S}, 1e-6) AS t FROM k1 JOIN sn USING (snap_ns) WHERE c >= {OP.LEAST_QUOTES}),
k3 AS (SELECT *, count(*) OVER (PARTITION BY snap_ns) AS n_quotes FROM k2 WHERE t > 1e-6),
k4 AS (SELECT *, cast(dense_rank() OVER (PARTITION BY snap_ns ORDER BY opt_expiry) AS INT) AS rank FROM k3 WHERE n_quotes >= {OP.LEAST_VALID}),
q0 AS (SELECT snap_ns, row_id, opt_mid, spot AS s, opt_strike AS strike, t, CASE WHEN opt_type = 'C' THEN 1.0 ELSE -1.0 END AS sg FROM k4 WHERE opt_mid >= greatest(CASE WHEN opt_type = 'C' THEN spot - opt_strike ELSE opt_strike - spot END, 0) + 1e-6),
h0 AS (SELECT lo.snap_ns, lo.row_id FROM {_with_price("q0", repr(OP.LOW_VOL))} lo JOIN {_with_price("q0", repr(OP.HIGH_VOL))} hi USING (snap_ns, row_id) WHERE (lo.price - lo.opt_mid) * (hi.price - hi.opt_mid) <= 0),
it AS (SELECT 0 AS step, q0.*, cast({OP.LOW_VOL} AS DOUBLE) AS lo, cast({OP.HIGH_VOL} AS DOUBLE) AS hi FROM q0 JOIN h0 USING (snap_ns, row_id)
  UNION ALL SELECT step + 1, snap_ns, row_id, opt_mid, s, strike, t, sg, CASE WHEN price > opt_mid THEN lo ELSE mv END, CASE WHEN price > opt_mid THEN mv ELSE hi END FROM {_with_price("(SELECT *, (lo + hi) / 2 AS mv FROM it WHERE step < 24)", "mv")}),
iv AS (SELECT snap_ns, row_id, (lo + hi) / 2 AS iv FROM it WHERE step = 24),
pr AS (SELECT k4.*, iv FROM k4 LEFT JOIN iv USING (snap_ns, row_id))
"""
ORACLES["op_iv"] = _PRICED + "SELECT snap_ns, row_id, rank, round(iv, 4) AS iv FROM pr"


def _with_greeks(source: str, vol: str) -> str:
    """``source`` (s, strike, t, sg and the volatility) with delta, gamma, vega, vanna and price."""
    pdf = "exp(-0.5 * d1 * d1) / sqrt(2 * pi())"
    return f"(SELECT *, CASE WHEN sg > 0 THEN {_cdf('d1')} ELSE {_cdf('d1')} - 1 END AS delta, {pdf} / (s * {vol} * sqrt(t) + 1e-12) AS gamma, s * {pdf} * sqrt(t) AS vega, -{pdf} * d2 / ({vol} + 1e-12) AS vanna FROM {_with_price(source, vol)})"


_GREEK_DIGITS = {"delta": 5, "gamma": 7, "vega": 3, "vanna": 4, "price": 3}
_OWN = "(SELECT *, spot AS s, opt_strike AS strike, CASE WHEN opt_type = 'C' THEN 1.0 ELSE -1.0 END AS sg FROM pr WHERE iv IS NOT NULL)"
ORACLES["op_greeks"] = _PRICED + "SELECT snap_ns, row_id, " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in _GREEK_DIGITS.items()) + f" FROM {_with_greeks(_OWN, 'iv')}"

_MEAN = "avg(iv) FILTER (WHERE {} AND iv > 0.02 AND iv < 3.0)"
ORACLES["op_surface"] = _PRICED + f""", n0 AS (SELECT *, row_number() OVER (PARTITION BY snap_ns, rank, opt_type ORDER BY abs(opt_strike - spot), opt_strike, row_id) AS near FROM pr WHERE rank <= 2),
am AS (SELECT snap_ns, {_MEAN.format("opt_type = 'C' AND near <= 3 AND rank = 1")} AS atm_iv, {_MEAN.format("opt_type = 'C' AND near <= 3 AND rank = 2")} AS far_iv FROM n0 GROUP BY 1),
n1 AS (SELECT n0.*, atm_iv, far_iv, spot AS s, opt_strike AS strike, CASE WHEN opt_type = 'C' THEN 1.0 ELSE -1.0 END AS sg FROM n0 JOIN am USING (snap_ns) WHERE rank = 1),
g1 AS (SELECT snap_ns, row_id, abs(delta - CASE WHEN sg > 0 THEN 0.25 ELSE -0.25 END) AS off FROM {_with_greeks("(SELECT * FROM n1 WHERE atm_iv > 0.02)", "atm_iv")}),
n2 AS (SELECT n1.*, arg_min(CASE WHEN off <= 0.20 THEN opt_strike END, CASE WHEN off <= 0.20 THEN {{'o': off, 'k': opt_strike}} END) OVER (PARTITION BY snap_ns, opt_type) AS at_k FROM n1 LEFT JOIN g1 USING (snap_ns, row_id)),
n3 AS (SELECT *, row_number() OVER (PARTITION BY snap_ns, opt_type ORDER BY abs(opt_strike - at_k), opt_strike, row_id) AS by_k FROM n2),
g2 AS (SELECT snap_ns, row_id, gamma, vanna FROM {_with_greeks("(SELECT * FROM n1 WHERE iv > 0.02)", "iv")}),
n4 AS (SELECT n3.*, gamma, vanna, greatest(coalesce(cast(bid_sz_00 AS DOUBLE), 1.0), 1.0) * CASE WHEN opt_type = 'C' THEN -1.0 ELSE 1.0 END AS wt FROM n3 LEFT JOIN g2 USING (snap_ns, row_id)),
su AS (SELECT snap_ns, round(max(atm_iv), 4) AS atm_iv, round(max(far_iv) - max(atm_iv), 4) AS term_slope, round({_MEAN.format("opt_type = 'P' AND by_k <= 2 AND at_k IS NOT NULL")} - {_MEAN.format("opt_type = 'C' AND by_k <= 2 AND at_k IS NOT NULL")}, 4) AS put_call_skew,
  round(sum(gamma * wt * spot * 100), 0) AS net_gex, round(sum(vanna * wt), 2) AS vanna_pressure, round(CASE WHEN max(t) < 1.0 / 252 THEN count(*) / max(n_quotes) ELSE 0 END, 6) AS zero_dte_frac FROM n4 GROUP BY 1),
gr AS (SELECT lo + g * {_HOUR} AS snap_ns FROM en, generate_series(1, 100000) x(g) WHERE lo + g * {_HOUR} < hi)
SELECT gr.snap_ns, su.* EXCLUDE (snap_ns) FROM gr LEFT JOIN su USING (snap_ns)"""

# ---- model inputs --------------------------------------------------------------------------------------------------------

_INPUTS = {
    "z_ofi_L1_500ms": ("coalesce(" + _gs("+cum_add_bid_L1 -cum_canc_bid_L1 -cum_fill_bid_L1 -cum_add_ask_L1 +cum_canc_ask_L1 +cum_fill_ask_L1", 500) + ", 0)", 500.0),
    "z_realized_vol": (f"sqrt(greatest({_g('cum_sq', 500)}, 0) / greatest({_g('r', 500)}, 1))", 500.0),
    "z_imb_L1": (_SH["imb_l1"], 500.0), "z_spread": ("cast(spread AS DOUBLE)", 5000.0),
    "z_microprice_delta": ("coalesce(micro - lag(micro) OVER (PARTITION BY d, i ORDER BY r), 0)", 500.0),
}
_READ = ["r", "cum_sq", *[f"cum_{k}_{s}_L1" for k in ("add", "canc", "fill") for s in ("bid", "ask")]]
_BASE = ", ".join(f"coalesce(arg_max({c}, r) OVER w500, 0) AS s500_{c}" for c in _READ)


def _scored(source: str, value: str, half: float) -> str:
    return f"(SELECT i, k, coalesce(({value} - m) / sqrt(greatest(v, 1e-12)), ({value} - m) / 1e-6) AS {value} FROM {_weighted(source, value, half)})"


ORACLES["rg_core"] = (
    _TRADES + f", xw AS (SELECT *, {_BASE} FROM t WINDOW w500 AS (PARTITION BY d, i ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 500000001 PRECEDING)),\n"
    + "fi AS (SELECT d, i, n, row_number() OVER (PARTITION BY i ORDER BY d, ts, n) AS k, coalesce(last_mid - lag(last_mid) OVER (PARTITION BY d, i ORDER BY r), 0) AS dm, "
    + ", ".join(f"{e} AS {c}" for c, (e, _) in _INPUTS.items()) + " FROM xw),\n" + "fx AS (SELECT *, dm * z_ofi_L1_500ms AS xy FROM fi),\n"
    + ",\n".join(f"e_{c} AS (SELECT * FROM {_scored('fx', c, h)})" for c, (_, h) in _INPUTS.items())
    + f""",
pr AS (SELECT i, k, e_z_ofi_L1_500ms.z_ofi_L1_500ms * e_z_realized_vol.z_realized_vol AS ofi_L1_x_vol FROM e_z_ofi_L1_500ms JOIN e_z_realized_vol USING (i, k)),
ep AS (SELECT * FROM {_scored('pr', 'ofi_L1_x_vol', 500.0)}),
ka AS (SELECT * FROM {_weighted('fx', 'xy', 500.0)}), kb AS (SELECT * FROM {_weighted('fx', 'z_ofi_L1_500ms', 500.0)}),
kl AS (SELECT i, k, coalesce(CASE WHEN abs(kb.v) > 1e-10 THEN ka.m / kb.v END, 0) AS z_kyle_lambda FROM ka JOIN kb USING (i, k)),
ek AS (SELECT * FROM {_scored('kl', 'z_kyle_lambda', 5000.0)})
SELECT strftime(d, '%Y-%m-%d') AS day, fx.i AS instrument_id, n, """
    + ", ".join(f"round(e_{c}.{c}, 4) AS {c}" for c in _INPUTS) + ", round(ep.ofi_L1_x_vol, 3) AS ofi_L1_x_vol, round(ek.z_kyle_lambda, 3) AS z_kyle_lambda FROM fx "
    + " ".join(f"JOIN {t} ON fx.i = {t}.i AND fx.k = {t}.k" for t in [*[f"e_{c}" for c in _INPUTS], "ep", "ek"])
)
