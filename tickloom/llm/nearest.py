"""Pairing records of two tables with the nearest in time of the same entity, within a tolerance.

Both tables are cut into shards of one entity and a stretch of time. A shard's right-hand times, with those up to the
tolerance beyond its edges, form a sorted array under a piecewise-linear learned index: a few line segments that predict
a time's position with a bounded error, so that the exact neighbours lie within a fixed small window around it.

Left rows stream past the index in Arrow batches, so a task holds one shard's distinct right-hand times and one batch.
Repeated right-hand times are reduced before the shuffle; shards with more than a thousandth of all left rows, of which
there can be at most a thousand, are dealt out over several tasks, each with its own copy of the shard's index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = 1_000_000_000
SHARD_NS = 4 * 3600 * NS
EPS = 4
HOT_SHARDS, HOT_ROWS = 1000, 100_000
#: Right-hand times that a shard should hold at most.
INDEX_ROWS = 4_000_000


class LearnedIndex:
    """Sorted distinct int64 keys under line segments whose prediction is at most ``eps`` positions off."""

    def __init__(self, keys: np.ndarray, eps: int = EPS):
        self.keys, self.eps = keys, eps
        first, last = np.array([0]), np.array([max(len(keys) - 1, 0)])
        while len(keys):
            seg = np.repeat(np.arange(len(first)), last - first + 1)
            at = np.arange(len(keys))
            span = np.maximum(keys[last] - keys[first], 1)
            slope = (last - first) / span
            miss = np.abs(first[seg] + (keys - keys[first][seg]) * slope[seg] - at)
            bad = np.maximum.reduceat(miss, first) > eps
            if not bad.any():
                break
            half = (first + last) // 2
            first, last = (
                np.sort(np.concatenate([first, half[bad] + 1])),
                np.sort(np.concatenate([last, half[bad]])),
            )
        self.first = first
        self.start = keys[first] if len(keys) else np.zeros(0, np.int64)
        self.slope = slope if len(keys) else np.zeros(0)

    def below(self, q: np.ndarray) -> np.ndarray:
        """How many keys are at or below each ``q``: predicted, then settled within the window the bound allows."""
        n = len(self.keys)
        seg = np.maximum(np.searchsorted(self.start, q, side="right") - 1, 0)
        end = np.concatenate([self.first[1:], [n]])[seg]
        guess = self.first[seg] + np.maximum(q - self.start[seg], 0) * self.slope[seg]
        guess = np.minimum(guess, end).astype(np.int64)
        low = np.maximum(guess - self.eps - 1, 0)
        at = low[:, None] + np.arange(2 * self.eps + 4)
        inside = (at < n) & (self.keys[np.minimum(at, n - 1)] <= q[:, None])
        return low + inside.sum(axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the nearest key and its distance; of two equally near the earlier."""
        n, after = len(self.keys), self.below(q)
        prev, nxt = np.maximum(after - 1, 0), np.minimum(after, n - 1)
        far = np.iinfo(np.int64).max
        back = np.where(after > 0, q - self.keys[prev], far)
        ahead = np.where(after < n, self.keys[nxt] - q, far)
        return np.where(back <= ahead, prev, nxt), np.minimum(back, ahead)


def nearest_in_time(left: DataFrame, right: DataFrame, *, entity: tuple[Column, Column], time: tuple[Column, Column], ident: tuple[Column, Column], tolerance_ns: int, values: dict[str, Column] | None = None, usable: Column | None = None, shard_ns: int = SHARD_NS, keep_unmatched: bool = False) -> DataFrame:
    """For each left row the nearest usable right row of its entity, at most ``tolerance_ns`` away, inclusive.

    Result: ``left_id, right_id, distance_ns`` and the right row's ``values``. Of two equally near the earlier, of
    several with that time the smallest id. Defined cases: a left row without entity or time, or without a right row in
    reach, has no match: it is left out, or with ``keep_unmatched`` given with nulls; right rows without entity or time,
    or not ``usable``, are never matched; repeated left rows each get their match; empty tables give an empty result. The
    tables' own column names don't matter, as only the given expressions are read.
    """
    values = values or {}
    put = right.where(usable) if usable is not None else right
    payload = F.struct(ident[1].cast("bigint").alias("id"), *[c.cast("double").alias(f"v{k}") for k, c in enumerate(values.values())])
    put = put.select(entity[1].cast("string").alias("e"), time[1].cast("bigint").alias("t"), payload.alias("r")).where(F.col("e").isNotNull() & F.col("t").isNotNull())
    put = put.groupBy("e", "t").agg(F.min("r").alias("r"))
    ask = left.select(entity[0].cast("string").alias("e"), time[0].cast("bigint").alias("t"), ident[0].cast("bigint").alias("i"))
    placed = ask.where(F.col("e").isNotNull() & F.col("t").isNotNull())

    # crowded times get narrower shards, counted each time, down to the tolerance, where a right row lies in three of them
    while shard_ns >= 2 * max(tolerance_ns, 1) and (put.groupBy("e", _shard(F.col("t"), shard_ns)).count().agg(F.max("count")).first()[0] or 0) > INDEX_ROWS:
        shard_ns //= 2
    placed = placed.withColumn("b", _shard(F.col("t"), shard_ns))
    least = max(HOT_ROWS, placed.count() // HOT_SHARDS)
    hot_rows = placed.groupBy("e", "b").count().where(F.col("count") > least).select("e", "b", F.ceil(F.col("count") / F.lit(least)).cast("int")).collect()  # under HOT_SHARDS rows
    if hot_rows:
        small = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in hot_rows], "e string, b bigint, parts int"))
        placed = placed.join(small, ["e", "b"], "left").withColumn("s", F.pmod(F.xxhash64("i", "t"), F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")).drop("parts")
    else:
        placed = placed.withColumn("s", F.lit(0))
    reach = F.sequence(_shard(F.col("t") - F.lit(tolerance_ns), shard_ns), _shard(F.col("t") + F.lit(tolerance_ns), shard_ns))
    put = put.withColumn("b", F.explode(reach))
    if hot_rows:
        put = put.join(small, ["e", "b"], "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        put = put.withColumn("s", F.lit(0))
    both = put.select("e", "b", "s", F.lit(False).alias("asks"), "t", F.col("r.id").alias("i"), *[F.col(f"r.v{k}").alias(f"v{k}") for k in range(len(values))])
    both = both.unionByName(placed.select("e", "b", "s", F.lit(True).alias("asks"), "t", "i"), allowMissingColumns=True)
    both = both.repartition("e", "b", "s").sortWithinPartitions("e", "b", "s", "asks", "t", "i")

    extra = [f"v{k}" for k in range(len(values))]
    schema = ", ".join(["left_id bigint", "right_id bigint", "distance_ns bigint", *[f"{c} double" for c in extra]])

    def run(batches):
        return _match(batches, tolerance_ns, extra, keep_unmatched)

    out = both.mapInArrow(run, schema)
    if keep_unmatched:
        lost = ask.where(F.col("e").isNull() | F.col("t").isNull()).select(F.col("i").alias("left_id"))
        out = out.unionByName(lost, allowMissingColumns=True)
    return out.withColumnsRenamed(dict(zip(extra, values)))


def _shard(t: Column, shard_ns: int) -> Column:
    width = F.lit(shard_ns).cast("bigint")
    return F.call_function("div", t - F.pmod(t, width), width)


def _match(batches: Iterator[pa.RecordBatch], tolerance: int, extra: list[str], keep: bool) -> Iterator[pa.RecordBatch]:
    shard, parts, index = None, [], None
    names = ["left_id", "right_id", "distance_ns", *extra]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        e, b, s = batch.column("e"), batch.column("b").to_numpy(zero_copy_only=False), batch.column("s").to_numpy(zero_copy_only=False)
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        t, i = batch.column("t").to_numpy(zero_copy_only=False), batch.column("i").to_numpy(zero_copy_only=False)
        vs = [batch.column(c).to_numpy(zero_copy_only=False) for c in extra]
        code = e.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change = (code[1:] != code[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1]) | (asks[1:] != asks[:-1])
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        found: list[list[np.ndarray]] = []
        for lo, hi in zip(starts, [*starts[1:], n]):
            here = (e[int(lo)].as_py(), int(b[lo]), int(s[lo]))
            if here != shard:
                shard, parts, index = here, [], None
            if not asks[lo]:
                parts.append([t[lo:hi], i[lo:hi], *[v[lo:hi] for v in vs]])
                continue
            if index is None and parts:
                held = [np.concatenate(x) for x in zip(*parts)]
                index = LearnedIndex(held[0])
            if index is None:
                if keep:
                    found.append([i[lo:hi], np.full(hi - lo, -1), np.full(hi - lo, -1), *[np.full(hi - lo, np.nan)] * len(extra)])
                continue
            at, far = index.nearest(t[lo:hi])
            ok = far <= tolerance
            if keep:
                found.append([i[lo:hi], np.where(ok, held[1][at], -1), np.where(ok, far, -1), *[np.where(ok, v[at], np.nan) for v in held[2:]]])
            elif ok.any():
                found.append([i[lo:hi][ok], held[1][at][ok], far[ok], *[v[at][ok] for v in held[2:]]])
        if found:
            cols = [np.concatenate(x) for x in zip(*found)]
            none = cols[2] < 0
            arrays = [pa.array(cols[0]), pa.array(cols[1], mask=none), pa.array(cols[2], mask=none), *[pa.array(c.astype(float), mask=np.isnan(c.astype(float))) for c in cols[3:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def regressor_snapshots(regressors: DataFrame, options: DataFrame, tolerance_ns: int = 40 * NS) -> DataFrame:
    """Each regressor row with the ``atm_iv`` and ``net_gex`` of the nearest usable option snapshot of its instrument."""
    has = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return nearest_in_time(
        regressors, options, entity=(F.col("instrument_id"), F.col("instrument_id")), time=(F.col("ts_ns"), F.col("ts_ns")), ident=(F.col("row_id"), F.col("snap_id")),
        tolerance_ns=tolerance_ns, values={"atm_iv": F.col("atm_iv"), "net_gex": F.col("net_gex")}, usable=has("atm_iv") & has("net_gex"),
    )
