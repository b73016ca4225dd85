"""Applying a change feed: inserts, updates, deletes and decrements, in log order, each once.

Copies of a change are removed by their identifier, window ranking over the log sequence keeps the latest state of each
key, the result is merged into an optional base table and deleted keys are dropped.

Skew. A change log is cut into blocks of ``block`` sequence numbers, and every key is first reduced within each block,
then over its blocks: no task sorts more than one block of one key, however hot the key, and copies are combined on the
map side before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.cluster import broadcast_checked, checkpoint
from tickloom.functions import codes as C
from tickloom.operators.book import effects
from tickloom.sources.messages import encode

#: Kinds of a change: the key gets the row's payload; the key is removed; the key's amount shrinks; all keys go.
SET, DELETE, DECREMENT, CLEAR = 1, 2, 3, 4


def apply_changes(changes: DataFrame, *, scope: list[str], key: list[str], payload: list[str], amount: str = "size", base: DataFrame | None = None, block: int = 1 << 16) -> DataFrame:
    """The rows alive in each ``scope`` after its last change.

    ``changes`` has the columns of ``scope`` and ``key``, ``sequence`` BIGINT (the order in its scope, and with the
    scope the change's identifier), ``kind`` (SET, DELETE, DECREMENT or CLEAR), the ``payload`` columns a SET writes,
    and ``amount``: what a SET starts with and a DECREMENT takes away. ``base`` (scope, key, payload, amount) is the
    table before the first change.

    Result: scope, key, payload and the remaining amount, one row a key. Defined cases:
    - a change without a sequence has no place in the order and is left out, as is one of a null kind;
    - changes of one scope and sequence count once; where such copies differ, a CLEAR counts, else the smallest by kind,
      key, payload and amount, nulls first;
    - a SET replaces what was there; DELETE and DECREMENT of an unknown key do nothing;
    - a DECREMENT of a negative or null amount takes nothing; an amount that reaches 0 removes the key for good;
    - null scope or key values form a scope or key of their own; an empty feed gives the base, or no rows;
    - other columns of ``changes`` are ignored, whatever their names.
    """
    if amount in payload:
        raise ValueError("amount is carried by itself and must not be in payload")
    cols = [F.col(c) for c in (*scope, *key)]
    body = changes.select(*cols, "sequence", F.col("kind").cast("tinyint").alias("kind"), *payload, F.col(amount).cast("bigint").alias("_amount"))
    body = body.where(F.col("sequence").isNotNull() & F.col("kind").isNotNull())
    cleared = body.where(F.col("kind") == CLEAR).groupBy(*scope).agg(F.max("sequence").alias("_cleared"))
    live = body.where(F.col("kind") != CLEAR)
    first = None
    if base is not None:
        first = base.select(*cols, F.lit(-(1 << 63)).cast("bigint").alias("sequence"), F.lit(SET).cast("tinyint").alias("kind"), *payload, F.col(amount).cast("bigint").alias("_amount"))
    # a checkpoint, so that counting the clears and joining them read the feed's few columns once
    gone = broadcast_checked(checkpoint(cleared.select(*[F.col(c).alias(f"_c_{c}") for c in scope], "_cleared")))
    same = F.lit(True)
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    after = lambda df: df.join(gone, same, "left").where(F.col("_cleared").isNull() | (F.col("sequence") > F.col("_cleared")))
    # copies of a CLEAR fall away here, as their sequence is not after it
    once = after(live).groupBy(*scope, "sequence").agg(F.min(F.struct("kind", *key, *payload, "_amount")).alias("_c"))
    live = once.select(*scope, "sequence", "_c.*")
    if first is not None:
        live = live.unionByName(after(first).select(*live.columns).distinct())
    live = live.select(*cols, "sequence", "kind", *payload, "_amount", C.floor_div(F.col("sequence"), block).alias("_block"))

    ends = F.col("kind").isin(SET, DELETE)
    taken = F.when((F.col("kind") == DECREMENT) & (F.col("_amount") > 0), F.col("_amount")).otherwise(F.lit(0))
    part = _latest(live.withColumn("_ends", ends.cast("int")), [*scope, *key, "_block"], "sequence").groupBy(*scope, *key, "_block").agg(
        F.max("_ends").alias("_ends"),
        F.sum(taken).alias("_taken"),
        F.max(F.when(ends, F.col("kind"))).alias("kind"),
        *[F.max(F.when(ends, F.col(p))).alias(p) for p in payload],
        F.max(F.when(ends, F.col("_amount"))).alias("_amount"),
    )
    whole = _latest(part, [*scope, *key], "_block").groupBy(*scope, *key).agg(
        F.sum("_taken").alias("_taken"),
        F.max("kind").alias("kind"),
        *[F.max(p).alias(p) for p in (*payload, "_amount")],
    )
    left = F.col("_amount") - F.col("_taken")
    return whole.where((F.col("kind") == SET) & (left > 0)).select(*cols, *payload, left.alias(amount))


def _latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key, the last row that ends what was before it, and all rows after that one; a running window, so nothing is buffered."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    seen = df.withColumn("_n", F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    after: Column = (F.col("_n") == 0) | ((F.col("_n") == 1) & (F.col("_ends") == 1))
    return seen.where(after).drop("_n")


def order_changes(messages: DataFrame) -> DataFrame:
    """Order messages as changes of the book: ``trade_date``, ``instrument_id``, ``order_id``, ``sequence``, ``kind``, ``price_ticks``, ``size``, ``side``.

    An ADD needs a side, a size and a price above zero, else it does nothing. A MODIFY needs a price above zero, else it
    does nothing; without a side or a size it removes the order, else it replaces it. CANCEL removes, FILL decrements,
    CLEAR empties the book, and neither needs a price. TRADE and unknown actions leave the book as it is.
    """
    m = encode(messages.select("trade_date", "instrument_id", "order_id", "sequence", "action", "side", "price", "size"))
    m = effects(m).where(F.col("kind").isNotNull())
    sets = F.col("kind") == SET
    return m.select(
        "trade_date", "instrument_id", "order_id", "sequence", "kind",
        F.when(sets, F.col("px")).alias("price_ticks"), F.when(sets, F.col("side_code")).cast("tinyint").alias("side"),
        F.when(sets | (F.col("kind") == DECREMENT), F.col("size")).alias("size"),
    )


def resting_orders(messages: DataFrame) -> DataFrame:
    """The orders alive after the last message of each (``trade_date``, ``instrument_id``); each session starts empty."""
    return apply_changes(order_changes(messages), scope=["trade_date", "instrument_id"], key=["order_id"], payload=["price_ticks", "side"])
