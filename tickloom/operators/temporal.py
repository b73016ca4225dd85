"""Event-time combinators: window deltas of running counters, as-of look-ups both ways, excursions, prefix differences.

Rows are ordered by (time, position). A window of width w at a row reaches back to the first row at or after its time
less w, and ends with the row itself: later rows of the same time are outside. Values are differences of running totals,
so a window costs one pass however wide it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import codes as C

MS = 1_000_000
#: Stretch of time that one task looks up in.
SHARD_NS = 6 * 3600 * 1_000_000_000


def _before(group: list[str], time: str, width: int):
    """The frame of all rows earlier than ``time - width``."""
    return Window.partitionBy(*group).orderBy(time).rangeBetween(Window.unboundedPreceding, -(width + 1))


def positioned(df: DataFrame, group: list[str], time: str, tie: str, name: str = "r") -> DataFrame:
    """Rows numbered in order of (time, tie) within their group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(time, tie)).cast("bigint"))


def as_of_window_start(df: DataFrame, group: list[str], time: str, position: str, values: list[str], widths: list[int]) -> DataFrame:
    """Adds ``_w{width}``, a struct of ``values`` at the last row before each window, null if there is none."""
    pick = F.struct(position, *values)
    return df.withColumns({f"_w{w}": F.max(pick).over(_before(group, time, w)) for w in widths})


def delta(value: str, width: int) -> Column:
    """Growth of a running total over the window that ``as_of_window_start`` opened."""
    return F.col(value) - F.coalesce(F.col(f"_w{width}.{value}"), F.lit(0))


def forward(df: DataFrame, group: list[str], time: str, position: str, values: list[str], horizon: int, name: str) -> DataFrame:
    """Adds a struct of ``values`` at the first row at or after ``time + horizon``, null past the end.

    The frame runs over negated time, so it grows from the far end and each row is added once; a frame that shrinks
    towards the end would be scanned anew at every row.
    """
    w = Window.partitionBy(*group).orderBy((-F.col(time)).asc()).rangeBetween(Window.unboundedPreceding, -horizon)
    return df.withColumn(name, F.min(F.struct(position, *values)).over(w))


def backward(left: DataFrame, right: DataFrame, group: list[str], time: str, position: str, values: list[str], shard_ns: int = SHARD_NS) -> DataFrame:
    """Each left row with ``values`` of the last right row at or before its time, however long ago; null if there is none.

    Of right rows of one time the last by ``position`` counts; the right row is taken whole, so its nulls stay nulls.
    """
    return _as_of(left, right, group, F.col(time), F.col(time), F.col(position), values, shard_ns)


def first_after(left: DataFrame, right: DataFrame, group: list[str], time: str, position: str, values: list[str], horizon: int = 0, shard_ns: int = SHARD_NS) -> DataFrame:
    """Each left row with ``values`` of the first right row at or after its time plus ``horizon``, of several of one time the first by ``position``."""
    return _as_of(left, right, group, -(F.col(time) + F.lit(horizon)), -F.col(time), -F.col(position), values, shard_ns)


def _as_of(left: DataFrame, right: DataFrame, group: list[str], at: Column, when: Column, tie: Column, values: list[str], shard_ns: int) -> DataFrame:
    """Look-up by stretches of time: inside a stretch one ordered pass over both sides; what a stretch takes over from
    those before it comes from one row a stretch. So a group is as many tasks as it has stretches."""
    shard = lambda c: C.floor_div(c, shard_ns)
    r = right.select(*group, when.alias("_t"), F.lit(0).alias("_side"), tie.cast("bigint").alias("_p"), F.struct(*values).alias("_r")).where(F.col("_t").isNotNull())
    cols = [c for c in left.columns if c not in values]
    a = left.select(*left.columns).withColumns({"_t": at, "_side": F.lit(1), "_p": F.lit(0).cast("bigint")}).drop(*[v for v in values if v in left.columns])
    both = a.unionByName(r, allowMissingColumns=True).withColumn("_s", shard(F.col("_t")))
    own = Window.partitionBy(*group, "_s").orderBy("_t", "_side", "_p").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_r", F.last("_r", ignorenulls=True).over(own)).where(F.col("_side") == 1)
    ends = r.withColumn("_s", shard(F.col("_t"))).groupBy(*group, "_s").agg(F.max_by("_r", F.struct("_t", "_p")).alias("_r"))
    marks = ends.unionByName(a.select(*group, shard(F.col("_t")).alias("_s")).distinct(), allowMissingColumns=True).groupBy(*group, "_s").agg(F.first("_r", ignorenulls=True).alias("_r"))
    before = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_s").alias("_g_s"), F.last("_r", ignorenulls=True).over(before).alias("_carry"))
    same = F.col("_s").eqNullSafe(F.col("_g_s"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = seen.join(carried, same, "left").withColumn("_r", F.coalesce("_r", "_carry"))
    return out.select(*cols, *[F.when(F.col("_t").isNotNull(), F.col(f"_r.{v}")).alias(v) for v in values])


def excursion(df: DataFrame, group: list[str], time: str, position: str, value: str, horizon: int) -> DataFrame:
    """Adds ``fwd_max`` and ``fwd_min``: extremes over the rows after this one and before ``time + horizon``; null if there is none."""
    later = Window.partitionBy(*group).orderBy(time).rangeBetween(1, horizon - 1)
    peers = Window.partitionBy(*group, time).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumns({"fwd_max": F.greatest(F.max(value).over(later), F.max(value).over(peers)), "fwd_min": F.least(F.min(value).over(later), F.min(value).over(peers))})


def change(value: str, group: list[str], *position: str) -> Column:
    """Difference to the row before; 0 at the first row."""
    return F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy(*position)), F.lit(0))
