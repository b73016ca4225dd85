"""Scalar ingest functions: action and side codes, price ticks, flag bits, floor division of epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the message format.
TICK = 0.25
POINT_VALUE = 50.0
ADD, CANCEL, MODIFY, TRADE, FILL, CLEAR, UNKNOWN = 0, 1, 2, 3, 4, 5, 6
BID, ASK, NO_SIDE = 0, 1, 2
FLAG_LAST, FLAG_TOB, FLAG_SNAPSHOT, FLAG_MBP = 0x80, 0x40, 0x20, 0x10


def action_code(action: Column) -> Column:
    """A C M T F R, in either case, as 0 to 5; anything else, null included, is 6."""
    a = F.upper(action)
    return (
        F.when(a == "A", ADD).when(a == "C", CANCEL).when(a == "M", MODIFY)
        .when(a == "T", TRADE).when(a == "F", FILL).when(a == "R", CLEAR).otherwise(UNKNOWN)
    )


def side_code(side: Column) -> Column:
    """B A N, in either case, as 0 1 2; anything else, null included, is 2."""
    s = F.upper(side)
    return F.when(s == "B", BID).when(s == "A", ASK).otherwise(NO_SIDE)


def price_ticks(price: Column, tick: float = TICK) -> Column:
    """Whole ticks, halves to even; null, NaN and infinite prices are 0."""
    infinite = F.abs(price) == F.lit(float("inf"))
    return F.when(price.isNull() | F.isnan(price) | infinite, F.lit(0)).otherwise(F.rint(price / F.lit(tick))).cast("bigint")


def ticks_price(ticks: Column, tick: float = TICK) -> Column:
    return ticks * F.lit(tick)


def flag(flags: Column, bit: int) -> Column:
    return (flags.cast("int").bitwiseAND(F.lit(bit)) > 0).cast("int")


def floor_to(ns: Column, step: int) -> Column:
    """The multiple of ``step`` at or below ``ns``, also for negative times; exact over all 64 bits."""
    return ns - F.pmod(ns, F.lit(step).cast("bigint"))


def floor_div(ns: Column, step: int) -> Column:
    """Whole ``step`` units at or below ``ns``, also for negative times; exact over all 64 bits."""
    return F.call_function("div", floor_to(ns, step), F.lit(step))
