"""Cost analysis, discretisers, transition histograms and spread tables as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import codes as C
from tickloom.operators.ordered import exact_percentiles


def sign(side: Column) -> Column:
    """+1 for a buy, -1 for anything else, a trade without a side included."""
    return F.when(side == C.BID, 1.0).otherwise(-1.0)


def clean(c: str) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(F.col(c)), F.col(c))


def markout_table(df: DataFrame, window: str, side: str, raw: str, signed: str, spread: str) -> DataFrame:
    """Per window: count, mean and population deviation of the move, mean and median of the signed move before and after half the spread, means by side, share against."""
    d = df.select(F.col(window).alias("window_ms"), F.col(side).alias("side"), clean(raw).alias("raw"), clean(signed).alias("s"), clean(spread).alias("sp")).where(F.col("s").isNotNull())
    d = d.withColumn("net", F.col("s") - F.col("sp") / 2)
    mids = exact_percentiles(d, ["window_ms"], "s", [0.5]).select("window_ms", F.col("q")[0].alias("median_signed"))
    nets = exact_percentiles(d, ["window_ms"], "net", [0.5]).select("window_ms", F.col("q")[0].alias("median_net"))
    g = d.groupBy("window_ms").agg(
        F.count("*").alias("n"), F.avg("raw").alias("mean_raw"), F.stddev_pop("s").alias("std_signed"), F.avg("s").alias("mean_signed"), F.avg("net").alias("mean_net"),
        F.avg(F.when(F.col("side") == C.BID, F.col("s"))).alias("mean_buy"), F.avg(F.when(F.col("side") == C.ASK, F.col("s"))).alias("mean_sell"), F.avg((F.col("s") < 0).cast("double")).alias("pct_adverse"),
    )
    return g.join(mids, "window_ms", "left").join(nets, "window_ms", "left")


def spread_bucket(spread: Column) -> Column:
    return F.when(spread <= 1, "1").when(spread <= 2, "2").when(spread > 2, "3+")


def imbalance_bucket(imb: Column) -> Column:
    """0 ask-heavy, 1 balanced, 2 bid-heavy."""
    return F.when(imb >= 0.33, 2).when(imb >= -0.33, 1).when(imb < -0.33, 0)


def utc_hour(ts: Column) -> Column:
    return F.pmod(C.floor_div(ts, 3_600_000_000_000), F.lit(24)).cast("int")


def adverse_by(df: DataFrame, bucket: Column, signed: str, least: int = 0) -> DataFrame:
    """Per bucket: ``bucket, n, mean_signed, pct_adverse``, of more than ``least`` rows."""
    d = df.select(bucket.alias("bucket"), F.col(signed).alias("s")).where(F.col("bucket").isNotNull() & F.col("s").isNotNull())
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("s").alias("mean_signed"), F.avg((F.col("s") < 0).cast("double")).alias("pct_adverse")).where(F.col("n") > least)


def thresholds(df: DataFrame, value: str, ps: tuple[float, float] = (0.33, 0.67), least: int = 10, positive: bool = True) -> tuple[float, float]:
    """Two quantiles of the (positive) values; (0, 1e10) with fewer than ``least`` of them. Two numbers, fitted once and kept."""
    d = df.where(F.col(value) > 0) if positive else df
    r = exact_percentiles(d.withColumn("_all", F.lit(1)), ["_all"], value, list(ps)).first()
    return tuple(r["q"]) if r and r["n"] >= least else (0.0, 1e10)


def level(value: Column, cuts: tuple[float, ...]) -> Column:
    """How many cuts are at or below the value."""
    return sum(((value >= F.lit(c)).cast("int") for c in cuts[1:]), (value >= F.lit(cuts[0])).cast("int"))


def distribution(df: DataFrame, columns: list[str], ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``metric, n, mean, p50, p95, p99`` of each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), clean(c).alias("v")) for c in columns])).alias("x")).select("x.*").where(F.col("v").isNotNull())
    q = exact_percentiles(long, ["metric"], "v", list(ps))
    return long.groupBy("metric").agg(F.avg("v").alias("mean")).join(q, "metric").select("metric", "n", "mean", *[F.col("q")[k].alias(f"p{round(p * 100)}") for k, p in enumerate(ps)])


def asymmetry(df: DataFrame, columns: list[str], cut: float = 0.3) -> DataFrame:
    """``metric, n, mean, std, above, below``: mean, population deviation and the shares beyond ``cut`` to either side."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), clean(c).alias("v")) for c in columns])).alias("x")).select("x.*").where(F.col("v").isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), share(F.col("v") > cut).alias("above"), share(F.col("v") < -cut).alias("below"))


def depletion_before_moves(df: DataFrame, ticks: Column, bid: str, ask: str, large: float = 2.0, calm: float = 0.5, least: int = 10) -> DataFrame:
    """``move, n, bid_depletion, ask_depletion``: mean depletion before large moves up and down and before none, each of more than ``least`` rows."""
    move = F.when(ticks > large, "up").when(ticks < -large, "down").when(F.abs(ticks) <= calm, "neutral")
    d = df.select(move.alias("move"), bid, ask).where(F.col("move").isNotNull())
    return d.groupBy("move").agg(F.count("*").alias("n"), F.avg(bid).alias("bid_depletion"), F.avg(ask).alias("ask_depletion")).where(F.col("n") > least)


def univariate(df: DataFrame, features: list[str], target: str, least: int = 100) -> DataFrame:
    """``feature, n, corr, beta, r2, mean, std`` of each feature against the target, over the rows that have both, from ``least`` rows on."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), clean(c).alias("x")) for c in features])).alias("l"), clean(target).alias("y")).select("l.*", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    g = long.groupBy("feature").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"), (F.covar_samp("x", "y") / F.var_samp("x")).alias("beta"), F.pow(F.corr("x", "y"), 2).alias("r2"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return g.where(F.col("n") >= least)


def latency(df: DataFrame, delta: str, markout: str) -> DataFrame:
    """One row: ``n, mean, p50, p95, p99, max`` of the latencies above 0 and their correlation with the markout's size."""
    t = df.where(F.col(delta) > 0).select(F.col(delta).alias("v"), F.abs(F.col(markout)).alias("m"), F.lit(1).alias("one"))
    q = exact_percentiles(t, ["one"], "v", [0.5, 0.95, 0.99])
    g = t.groupBy("one").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.corr(F.when(F.col("m").isNotNull(), F.col("v")), F.col("m")).alias("corr_markout"))
    return g.join(q, "one").select("n", "mean", *[F.col("q")[k].alias(p) for k, p in enumerate(("p50", "p95", "p99"))], "max", "corr_markout")


def quantile_edges(df: DataFrame, value: str, bins: int = 10) -> list[float]:
    """Distinct edges of equal-frequency bins; at most ``bins + 1`` numbers."""
    r = exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, [k / bins for k in range(bins + 1)]).first()
    return sorted(set(r["q"])) if r else []


def in_bin(value: Column, edges: list[float]) -> Column:
    """Bin of a value between the edges: closed on the right, the lowest edge included; null outside."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    above = sum(((value > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when((value >= F.lit(edges[0])) & (value <= F.lit(edges[-1])), above)


def deciles(df: DataFrame, score: str, signed: str, bins: int = 10) -> DataFrame:
    """Per bin of the score's size: ``bin, n, mean_score, mean_signed, median_signed, pct_adverse``; bins of equal edges are one."""
    d = df.select(F.abs(clean(score)).alias("score"), clean(signed).alias("s")).where(F.col("score").isNotNull() & F.col("s").isNotNull())
    d = d.withColumn("bin", in_bin(F.col("score"), quantile_edges(d, "score", bins))).where(F.col("bin").isNotNull())
    med = exact_percentiles(d, ["bin"], "s", [0.5]).select("bin", F.col("q")[0].alias("median_signed"))
    g = d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("s").alias("mean_signed"), F.avg((F.col("s") < 0).cast("double")).alias("pct_adverse"))
    return g.join(med, "bin")


# ---- regimes, states and outcomes ---------------------------------------------------------------------------------

REGIMES, SPREADS, IMBALANCES, OUTCOMES, ALPHA = 3, 3, 3, 11, 0.1


def spread_state(spread: Column) -> Column:
    return F.least(F.greatest(spread.cast("int") - 1, F.lit(0)), F.lit(SPREADS - 1))


def outcome(ticks: Column) -> Column:
    """Price change in ticks, cut towards zero and to five either way, from 0; missing and infinite changes are 5 (none)."""
    cut = F.when(ticks.isNull() | F.isnan(ticks) | (F.abs(ticks) == float("inf")), F.lit(0)).otherwise(F.least(F.greatest(ticks, F.lit(-1e6)), F.lit(1e6)).cast("int"))
    return F.least(F.greatest(cut, F.lit(-5)), F.lit(5)) + 5


def transition_counts(states: DataFrame) -> DataFrame:
    """``regime, state, outcome, n`` over the whole grid, from rows with the first three."""
    spark = states.sparkSession
    grid = spark.range(REGIMES * SPREADS * IMBALANCES * OUTCOMES).select(
        F.floor(F.col("id") / (SPREADS * IMBALANCES * OUTCOMES)).cast("int").alias("regime"), (F.floor(F.col("id") / OUTCOMES) % (SPREADS * IMBALANCES)).cast("int").alias("state"), (F.col("id") % OUTCOMES).cast("int").alias("outcome")
    )
    counts = states.groupBy("regime", "state", "outcome").agg(F.count("*").alias("n"))
    return grid.join(counts, ["regime", "state", "outcome"], "left").fillna(0, ["n"])


def transition_probs(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds ``prob``, smoothed by ``alpha`` over all outcomes of a state."""
    each = alpha / OUTCOMES
    w = Window.partitionBy("regime", "state")
    return counts.withColumn("prob", (F.col("n") + each) / (F.sum("n").over(w) + alpha))


def transition_moments(probs: DataFrame, steps: int = 1) -> DataFrame:
    """Per regime and state the expected change over ``steps`` and its deviation, in ticks."""
    v = F.col("outcome") - 5
    g = probs.groupBy("regime", "state").agg(F.sum(F.col("prob") * v).alias("m"), F.sum(F.col("prob") * v * v).alias("q"))
    return g.select("regime", "state", (F.col("m") * steps).alias("expected"), F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("uncertainty"))


# ---- optimal spreads ----------------------------------------------------------------------------------------------

HALF_SPREADS = tuple(0.5 * k for k in range(1, 11))


def spread_table(cells: DataFrame, grid: DataFrame, half_spreads: tuple[float, ...] = HALF_SPREADS, least_trades: int = 50, least_fills: int = 10) -> DataFrame:
    """For each cell (``vol, tox, gex``) the half-spread of the highest expected value, of equal ones the smallest, and the skew.

    ``cells`` has a row a trade with ``excursion`` (ticks within reach, null if unknown) and ``markout``. The value of a
    half-spread is the share of trades that would fill it times the mean of it less the markout given a fill. A cell of
    fewer than ``least_trades`` has 1.0 and no skew; half-spreads of fewer than ``least_fills`` are passed over.
    """
    key = ["vol", "tox", "gex"]
    arms = F.explode(F.array(*[F.lit(h) for h in half_spreads]))
    d = cells.where(F.col("markout").isNotNull() & F.col("excursion").isNotNull())
    sizes = d.groupBy(*key).agg(F.count("*").alias("trades"), F.avg("markout").alias("mean_markout"))
    # one row a trade and half-spread before the aggregate, which combines on the map side: ten rows a trade never leave their task
    hit = F.col("excursion") >= F.col("hs")
    arm = d.select(*key, "excursion", "markout", arms.alias("hs")).groupBy(*key, "hs").agg(F.sum(hit.cast("int")).alias("fills"), F.avg(F.when(hit, F.col("hs") - F.col("markout"))).alias("gain"))
    arm = arm.join(sizes, key).where((F.col("fills") >= least_fills) & (F.col("trades") >= least_trades))
    best = arm.withColumn("ev", F.col("fills") / F.col("trades") * F.col("gain")).groupBy(*key).agg(F.max_by("hs", F.struct("ev", -F.col("hs"))).alias("hs"))
    out = grid.join(sizes, key, "left").join(best, key, "left")
    enough = F.col("trades") >= least_trades
    return out.select(
        *key, F.coalesce("trades", F.lit(0)).alias("trades"), F.when(enough, F.coalesce("hs", F.lit(1.0))).otherwise(F.lit(1.0)).alias("half_spread"),
        F.when(enough, F.least(F.greatest(0.5 * F.col("mean_markout"), F.lit(-2.0)), F.lit(2.0))).otherwise(F.lit(0.0)).alias("skew"),
    )
