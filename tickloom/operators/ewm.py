"""Exponentially weighted statistics over whole histories, by a scan in blocks of rows.

Within a block, running sums of ``x / decay**k`` give the weighted sums with native windows; a block is short enough
that the powers stay within a double. Only the last row of each block goes on: a fold over these tails gives what each
block takes over from all before it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.cluster import checkpoint
from tickloom.operators.ordered import numbered

BLOCK = 4096
FLOOR = 1e-12


def ewm(df: DataFrame, group: list[str], order: list[str], values: dict[str, float], block: int = BLOCK, complete: bool = False) -> DataFrame:
    """Adds ``{v}_mean`` and ``{v}_var`` (unbiased, null at a group's first value) of each value by its halflife in rows.

    One checkpoint holds the sums within blocks, for both the fold over the blocks' tails and the rows it is joined to.

    Weights are normalised by their sum so far. A null value keeps its row but adds nothing, and the statistics at it
    are those of the rows before it, with weights that went on decaying. With ``complete`` no value is null, and the
    sums of the weights follow from the row numbers alone.
    """
    decay = {v: 0.5 ** (1.0 / h) for v, h in values.items()}
    df = numbered(df, order, "_rn", group)
    df = df.withColumns({"_blk": F.floor(F.col("_rn") / block).cast("bigint"), "_k": (F.col("_rn") % block).cast("int")})
    w = Window.partitionBy(*group, "_blk").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for v in values:
        grow, shrink = F.pow(F.lit(1 / decay[v]), F.col("_k")), F.pow(F.lit(decay[v]), F.col("_k"))
        x, has = F.coalesce(F.col(v), F.lit(0.0)), F.col(v).isNotNull().cast("double")
        sums |= {f"_{v}_s": F.sum(x * grow).over(w) * shrink, f"_{v}_q": F.sum(x * x * grow).over(w) * shrink}
        if not complete:
            sums |= {f"_{v}_w": F.sum(has * grow).over(w) * shrink, f"_{v}_u": F.sum(has * grow * grow).over(w) * shrink * shrink}
    df = checkpoint(df.withColumns(sums))
    names = list(sums)
    tails = df.where(F.col("_k") == block - 1).select(*group, "_blk", *names)
    power = {f"_{v}_{k}": (decay[v] ** block) ** (2 if k == "u" else 1) for v in values for k in "sqwu"}
    schema = ", ".join([*[f"{c} {dict(df.dtypes)[c]}" for c in group], "_blk bigint", *[f"_in{n} double" for n in names]])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        held = dict.fromkeys(names, 0.0)
        rows = []
        for r in pdf.itertuples(index=False):
            row = dict(zip(pdf.columns, r))
            held = {n: held[n] * power[n] + row[n] for n in names}
            rows.append([*[row[c] for c in group], row["_blk"] + 1, *[held[n] for n in names]])
        return pd.DataFrame(rows, columns=[*group, "_blk", *[f"_in{n}" for n in names]])

    carried = tails.groupBy(*group).applyInPandas(fold, schema)
    df = df.join(carried, [*group, "_blk"], "left")
    out = {}
    for v in values:
        later = F.pow(F.lit(decay[v]), F.col("_k") + 1)
        whole = lambda n, p=later: F.col(n) + F.coalesce(F.col(f"_in{n}"), F.lit(0.0)) * p
        s, q = whole(f"_{v}_s"), whole(f"_{v}_q")
        if complete:
            wt, u = ((1 - F.pow(F.lit(d), F.col("_rn") + 1)) / (1 - d) for d in (decay[v], decay[v] ** 2))
        else:
            wt, u = whole(f"_{v}_w"), whole(f"_{v}_u", later * later)
        mean = F.when(wt > 0, s / wt)
        out |= {f"{v}_mean": mean, f"{v}_var": F.when(wt * wt - u > 1e-9 * wt * wt, (q / wt - mean * mean) * wt * wt / (wt * wt - u))}
    return df.withColumns(out).drop("_rn", "_blk", "_k", *names, *[f"_in{n}" for n in names])


def zscore(value: str) -> Column:
    """Deviation from the weighted mean in weighted standard deviations, the variance at least 1e-12; 0 at the first row, where there is none."""
    dev = F.col(value) - F.col(f"{value}_mean")
    return F.when(F.col(value).isNotNull(), F.coalesce(dev / F.sqrt(F.greatest(F.col(f"{value}_var"), F.lit(FLOOR))), dev / F.lit(FLOOR**0.5)))


def kyle_lambda(df: DataFrame, group: list[str], order: list[str], change: str, flow: str, fast: float, slow: float) -> DataFrame:
    """Adds ``kyle_lambda``: mean of change times flow over the variance of flow (0 where that is missing or at most 1e-10), and its slow ``z_kyle_lambda``."""
    df = ewm(df.withColumn("_xy", F.col(change) * F.col(flow)), group, order, {"_xy": fast, flow: fast})
    df = ewm(df.withColumn("kyle_lambda", impact("_xy", flow)), group, order, {"kyle_lambda": slow})
    return df.withColumn("z_kyle_lambda", zscore("kyle_lambda")).drop("_xy", "_xy_mean", "_xy_var")


def impact(product: str, flow: str) -> Column:
    """Mean of the product over the variance of the flow; 0 where that is missing or at most 1e-10."""
    var = F.col(f"{flow}_var")
    return F.coalesce(F.when(F.abs(var) > 1e-10, F.col(f"{product}_mean") / var), F.lit(0.0))


def rolling(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Adds running row statistics of ``value``: momentum in four forms, volatility in three, percentile ranks (the share strictly below) among the last 50 and 200, and a running mean and deviation."""
    at = Window.partitionBy(*group).orderBy(*order)
    last = lambda n, skip=0: at.rowsBetween(-(n - 1) - skip, -skip)
    v = F.col(value)
    diff = v - F.lag(v).over(at)
    ret = F.when(F.lag(v).over(at) != 0, diff / F.lag(v).over(at))
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    rank = lambda n: F.when(F.count(v).over(last(n)) > 0, F.size(F.filter(F.collect_list(v).over(last(n)), lambda x: x < v)) / F.count(v).over(last(n)))
    return df.withColumns(
        {
            "mom_5_20": F.avg(v).over(last(5)) - F.avg(v).over(last(20)),
            "mom_5_prev15": F.avg(v).over(last(5)) - F.avg(v).over(last(15, 5)),
            "mom_1": diff,
            "mom_3_10": F.avg(v).over(last(3)) - F.avg(v).over(last(10)),
            "vol_sd10": F.stddev_pop(v).over(last(10)),
            "_ret": ret,
            "_adiff": F.abs(diff),
            "run_mean": F.avg(v).over(upto),
            "run_sd": F.stddev_pop(v).over(upto),
            "rank_50": rank(50), "rank_200": rank(200),
        }
    ).withColumns({"vol_rms50": F.sqrt(F.avg(F.col("_ret") * F.col("_ret")).over(last(50))), "vol_sd_abs20": F.stddev_samp("_adiff").over(last(20))}).drop("_ret", "_adiff")
