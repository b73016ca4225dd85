"""Market-by-order messages: ingest rules, session order and instrument selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import codes as C
from tickloom.operators.ordered import number_ranges

SESSION = ["trade_date", "instrument_id"]


def timestamps(df: DataFrame, event: str = "ts_ns", recv: str = "ts_recv") -> DataFrame:
    """Event time, or receive time where it is missing; a table with neither column is an error. An absent receive time is 0."""
    have = [c for c in (event, recv) if c in df.columns]
    if not have:
        raise ValueError(f"neither {event} nor {recv} is there")
    filled = F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) if c == recv else F.col(c) for c in have])
    return df.withColumns({event: filled, recv: F.coalesce(F.col(recv), F.lit(0)) if recv in df.columns else F.lit(0)})


def encode(messages: DataFrame) -> DataFrame:
    """Messages with ``act``, ``side_code``, ``px`` (ticks) and a size that is never null."""
    return messages.withColumns(
        {
            "act": C.action_code(F.col("action")).cast("tinyint"),
            "side_code": C.side_code(F.col("side")).cast("tinyint"),
            "px": C.price_ticks(F.col("price")),
            "size": F.coalesce(F.col("size"), F.lit(0)).cast("bigint"),
        }
    )


def in_order(messages: DataFrame) -> DataFrame:
    """Each message once, numbered ``n`` from 1 in the true order of its session.

    The sequence gives the order; of copies the first in the file counts; messages without a sequence have no place and
    are left out. Messages are range-partitioned by session and sequence, so a long session is many tasks, and the result
    lies in a checkpoint, which its uses read again instead of ordering anew.
    """
    once = Window.partitionBy(*SESSION, "sequence").orderBy("seq")
    ranged = encode(timestamps(messages)).where(F.col("sequence").isNotNull()).repartitionByRange(*SESSION, "sequence")
    ranged = ranged.withColumn("_k", F.row_number().over(once)).where(F.col("_k") == 1).drop("_k")
    return number_ranges(ranged, "n", SESSION, start=1)


def dominant_instrument(df: DataFrame) -> DataFrame:
    """The most frequent instrument, of equally frequent ones the lowest id, as one row."""
    return df.groupBy("instrument_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "instrument_id").limit(1)


def profile(df: DataFrame) -> DataFrame:
    """Messages, prices and symbol of each instrument; NaN prices don't count."""
    price = F.when(~F.isnan("price"), F.col("price"))
    return df.groupBy("instrument_id").agg(
        F.count("*").alias("n"), F.min(price).alias("price_min"), F.max(price).alias("price_max"), F.min("symbol").alias("symbol"), F.countDistinct(F.upper("action")).alias("n_actions"),
    )


def session_label(path):
    """The last dash-separated part of a file name, up to its first dot."""
    return F.regexp_extract(path, r"([^/\-.]*)(?:\.[^/]*)?$", 1)
