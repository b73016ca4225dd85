"""Spikes, stuck values and impossible readings, per source against the source's own behaviour.

A reading's departure is how far it leaves both the last reading before and the first after an excursion of one to three
readings; a move that stays has none. Departures are divided by the source's factor for the hour of the day, and a
generalised Pareto tail fitted to each source's peaks over a threshold gives the cutoff that a reading passes by chance
with a fixed risk. Only readings past that cutoff are candidates for a spike, and the plausibility rule confirms those that also
depart by so many typical changes of the source. Runs of equal readings and readings below zero come beside them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import broadcast_checked, checkpoint
from tickloom.functions import codes as C
from tickloom.operators.ordered import exact_median, look, spread

LONGEST = 3
#: The risk, per reading, of passing the cutoff by chance; the threshold of the peaks; the typical changes that confirm a spike.
RISK, THRESHOLD, FACTOR = 0.01, 0.9, 12.0
#: No tail is fitted to fewer peaks, and none is taken to be heavier than this shape (above it a tail has no variance).
LEAST_PEAKS, HEAVIEST = 20, 0.5
PRICE_RUN, LATENCY_RUN = 20, 12
HOUR_NS = 3600 * 1_000_000_000
SEP = "\x1f"


def readings(df: DataFrame, source_table: str, source: Column, t: Column, row_id: Column, fields: list[str]) -> DataFrame:
    """``key, t, row_id, value``, one row a reading of a field. Null, NaN and 0 are no readings; rows without source or time have no place in a series, and only the sign of their values can be judged."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    long = df.select(source.cast("string").alias("source"), t.cast("bigint").alias("t"), row_id.cast("bigint").alias("row_id"), F.explode(parts).alias("x"))
    value = F.col("x.value")
    long = long.where(value.isNotNull() & ~F.isnan(value) & (value != 0))
    return long.select(F.concat_ws(SEP, F.lit(source_table), F.col("x.field"), F.col("source")).alias("key"), "t", "row_id", value.alias("value"), F.col("source").isNotNull().alias("_sourced"))


def departure(values: np.ndarray) -> np.ndarray:
    """For each reading the greatest distance by which an excursion of up to three readings that holds it leaves both its neighbours."""
    n, out = len(values), np.zeros(len(values))
    for size in range(1, LONGEST + 1):
        if n < size + 2:
            break
        before, after = values[: n - size - 1], values[size + 1 :]
        least = np.full(n - size - 1, np.inf)
        for k in range(size):
            x = values[1 + k : n - size + k]
            least = np.minimum(least, np.minimum(np.abs(x - before), np.abs(x - after)))
        for k in range(size):
            np.maximum(out[1 + k : n - size + k], least, out=out[1 + k : n - size + k])
    return out


def stuck(values: np.ndarray, least: int) -> np.ndarray:
    """The readings after the first in runs of at least ``least`` equal ones."""
    if not len(values):
        return np.zeros(0, bool)
    new = np.concatenate([[True], values[1:] != values[:-1]])
    run = np.cumsum(new) - 1
    return (np.bincount(run)[run] >= least) & ~new


def judge(rows: DataFrame, runs: dict[str, int], risk: float = RISK, factor: float = FACTOR) -> DataFrame:
    """Flagged rows ``source_table, field, source, t, row_id, value, departure, cutoff, reason`` of ``readings()``; all rows of a reading together.

    A spike is a candidate, past the ``cutoff`` of its source's tail at this ``risk``, that the rule confirms: it departs by more
    than ``factor`` typical (median absolute) changes between consecutive readings. ``runs`` says for each field from how
    many equal readings on a source is stuck. A source of fewer than three readings can show neither a departure nor, as a
    rule, a run. Repeated rows (same source and time) are one reading, with the value of the smallest row id.
    """
    placed = rows.where(F.col("_sourced") & F.col("t").isNotNull())
    seen = _series(placed, runs)
    confirmed = F.col("away") > F.lit(factor) * F.col("median")
    spike = (F.col("away") > F.col("cutoff")) & confirmed
    reason = F.when(F.col("value") < 0, "negative").when(F.coalesce(spike, F.lit(False)), "spike").when(F.col("is_stuck"), "stuck")
    found = _with_cutoffs(seen, risk, factor).select("key", "t", "row_id", "value", F.col("away").alias("departure"), "cutoff", reason.alias("reason")).where(F.col("reason").isNotNull())
    loose = rows.where(~(F.col("_sourced") & F.col("t").isNotNull()) & (F.col("value") < 0))
    loose = loose.select("key", "t", "row_id", "value", F.lit(None).cast("double").alias("departure"), F.lit(None).cast("double").alias("cutoff"), F.lit("negative").alias("reason"))
    return _named(found.unionByName(loose)).select("source_table", "field", "source", "t", "row_id", "value", "departure", "cutoff", "reason")


def candidates(rows: DataFrame, runs: dict[str, int], risk: float = RISK, factor: float = FACTOR) -> DataFrame:
    """What the tails let through to the rule, and what the rule alone would take: ``source_table, field, n_readings, n_candidates, n_confirmed, n_rule`` per field.

    ``n_confirmed`` below ``n_rule`` means that the risk is too small: readings the rule takes lie under the cutoff.
    """
    seen = _series(rows.where(F.col("_sourced") & F.col("t").isNotNull()), runs).where("is_first")
    past, rule = F.col("away") > F.col("cutoff"), F.col("away") > F.lit(factor) * F.col("median")
    count = lambda c: F.count(F.when(c, 1))
    counted = _named(_with_cutoffs(seen, risk, factor)).groupBy("source_table", "field")
    return counted.agg(F.count("*").alias("n_readings"), count(past).alias("n_candidates"), count(past & rule).alias("n_confirmed"), count(rule).alias("n_rule"))


def _named(df: DataFrame) -> DataFrame:
    parts = F.split("key", SEP)
    return df.withColumns({"source_table": parts[0], "field": parts[1], "source": F.get(parts, F.lit(2))})


def _series(placed: DataFrame, runs: dict[str, int]) -> DataFrame:
    """Every row with its reading's departure, change from the reading before, and whether it is stuck."""

    def per_series(times: np.ndarray, values: np.ndarray, key: str) -> dict[str, np.ndarray]:
        with np.errstate(invalid="ignore"):
            change = np.abs(np.diff(values, prepend=np.nan))
            away = np.nan_to_num(departure(values), nan=0.0)
        return {"away": away, "change": change, "is_stuck": stuck(values, runs[key.split(SEP)[1]])}

    reach = max(*runs.values(), LONGEST + 1) + 1
    return checkpoint(look(spread(placed), reach, per_series, "away double, change double, is_stuck boolean"))


def _with_cutoffs(seen: DataFrame, risk: float, factor: float) -> DataFrame:
    """``seen`` with its source's ``median`` change and ``cutoff``: the tail's level at this risk, times the factor of the hour.

    The factor of an hour is its mean change over the source's, of changes cut at ``factor`` medians, and kept within a quarter
    and four. The tail is fitted to departures of at most ``factor`` medians, so frequent spikes lift neither. A source with
    too few peaks for a tail, or whose typical change is 0, has cutoff 0: each of its departures is a candidate.
    """
    hour = F.pmod(C.floor_div(F.col("t"), HOUR_NS), F.lit(24)).cast("int")
    ones = seen.where("is_first")
    usual = exact_median(ones, "key", "change").select(F.col("key").alias("_key"), "median")
    usual = checkpoint(usual)
    cut = ones.join(broadcast_checked(usual), ones["key"] == F.col("_key")).select("key", "median", hour.alias("hour"), F.least("change", F.lit(factor) * F.col("median")).alias("c"))
    hourly = cut.groupBy("key", "hour").agg(F.max("median").alias("median"), F.sum("c").alias("s"), F.count("c").alias("n"))
    mean = F.sum("s") / F.sum("n")
    seasons = hourly.groupBy("key").agg(F.max("median").alias("median"), mean.alias("mean"), F.map_from_entries(F.collect_list(F.struct("hour", F.expr("try_divide(s, n)").alias("m")))).alias("by_hour"))
    seasons = checkpoint(seasons.withColumnRenamed("key", "_key"))
    season = F.coalesce(F.least(F.greatest(F.expr("try_divide(element_at(by_hour, hour), mean)"), F.lit(0.25)), F.lit(4.0)), F.lit(1.0))

    scaled = ones.withColumn("hour", hour).join(broadcast_checked(seasons), ones["key"] == F.col("_key")).where(F.col("away") <= F.lit(factor) * F.col("median")).select("key", (F.col("away") / season).alias("z"))
    above = lambda p: 1 - (1 - THRESHOLD) * (1 - p)
    fitted = scaled.groupBy("key").agg(F.percentile_approx("z", [THRESHOLD, above(0.5), above(0.75)], 10_000).alias("q"), F.count("*").alias("n"))
    tails = fitted.select("key", F.when(F.col("n") * (1 - THRESHOLD) >= LEAST_PEAKS, tail_cutoff(risk)).alias("tail"))
    limits = checkpoint(seasons.join(tails, seasons["_key"] == tails["key"], "left").drop("key"))
    cutoff = F.when(F.col("median") > 0, F.coalesce(F.col("tail") * season, F.lit(0.0))).otherwise(F.lit(0.0))
    joined = seen.withColumn("hour", hour).join(broadcast_checked(limits), seen["key"] == F.col("_key"), "left")
    return joined.withColumn("cutoff", cutoff).drop("_key", "by_hour", "mean", "tail", "hour")


def tail_cutoff(risk: float) -> Column:
    """The level a reading passes with probability ``risk``, from the quartiles of the peaks over a threshold.

    ``q`` holds the threshold and the levels that half and a quarter of the peaks pass. For a generalised Pareto tail the
    upper quartile over the median of the excess is 2**shape + 1; quartiles, unlike moments, stay put when some of the
    peaks are spikes. Peaks that don't spread put the cutoff at the threshold.
    """
    u, mid, high = F.col("q")[0], F.col("q")[1] - F.col("q")[0], F.col("q")[2] - F.col("q")[0]
    grown = F.greatest(F.try_divide(high, mid) - 1, F.lit(0.25))
    shape = F.least(F.log2(grown), F.lit(HEAVIEST))
    flat = F.abs(shape) < 1e-6
    scale = F.when(flat, mid / F.lit(float(np.log(2)))).otherwise(mid * shape / (F.pow(F.lit(2.0), shape) - 1))
    ratio = F.lit(risk / (1 - THRESHOLD))
    return u + F.coalesce(F.when(flat, -scale * F.log(ratio)).otherwise(scale / shape * (F.pow(ratio, -shape) - 1)), F.lit(0.0))


def market_readings(market_data: DataFrame, trade_features: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Prices of ``market_data`` by symbol and latencies of ``trade_features`` by instrument, and the runs from which these are stuck."""
    prices = ["trade_price", "bid_px_00", "ask_px_00"]
    rows = readings(market_data, "market_data", F.col("symbol"), F.col("timestamp_ns"), F.col("row_id"), prices).unionByName(
        readings(trade_features, "trade_features", F.col("instrument_id"), F.col("ts_ns"), F.col("row_id"), ["mean_latency_ns_500ms"])
    )
    return rows, dict.fromkeys(prices, PRICE_RUN) | {"mean_latency_ns_500ms": LATENCY_RUN}


def market_spikes(market_data: DataFrame, trade_features: DataFrame) -> DataFrame:
    return judge(*market_readings(market_data, trade_features))
