"""Neighbour-aware passes over series that are split anywhere, also within one key.

Rows are range-partitioned by (key, time, row id), so a key that holds a third of all rows is spread over as many tasks
as its rows need. A first pass takes from each partition the few readings at its edges; the driver, which holds at most
``2 * reach`` readings a partition, tells each partition what lies before and after it; the second pass then sees every
reading with ``reach`` neighbours on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.cluster import broadcast_checked, checkpoint

#: Keys of at most so many values are ranked whole: their brackets could be narrower than the two ranks they must hold.
SMALL = 5000
EDGES = "pid int, tail boolean, k int, key string, t bigint, value double"

#: From readings (times, values, key) to arrays, one value a reading.
Look = Callable[[np.ndarray, np.ndarray, str], dict[str, np.ndarray]]


def spread(rows: DataFrame) -> DataFrame:
    """``key, t, row_id, value`` in order over the partitions of a checkpoint, which keeps them as they are for every later pass."""
    return checkpoint(rows.select("key", "t", "row_id", "value").repartitionByRange("key", "t", "row_id").sortWithinPartitions("key", "t", "row_id"))


def numbered(df: DataFrame, order: list[str], name: str = "rn", group: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 in a global order, or in each ``group``, without a task that holds a whole group.

    Range partitions of a checkpoint are counted, one number each; a partition's rows follow on from those before it, and
    a group's numbers count from its first row.
    """
    group = group or []
    by = [*group, *order]
    return number_ranges(df.repartitionByRange(*by).sortWithinPartitions(*by), name, group)


def number_ranges(ranged: DataFrame, name: str = "rn", group: list[str] | None = None, start: int = 0) -> DataFrame:
    """Rows that already lie in range partitions in their order, numbered from ``start`` in that order, or in each ``group``."""
    kept = checkpoint(ranged.withColumn("_pid", F.spark_partition_id()))
    first, sofar = {}, 0
    for r in sorted(kept.groupBy("_pid").count().collect()):
        first[r["_pid"]], sofar = sofar, sofar + r["count"]
    begin = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in first]), F.array(*[F.lit(v).cast("bigint") for v in first.values()])), F.col("_pid")) if first else F.lit(0)
    rows = kept.withColumn(name, begin + F.lit(start) + F.monotonically_increasing_id() - F.spark_partition_id().cast("bigint") * F.lit(1 << 33)).drop("_pid")
    if not group:
        return rows
    starts = rows.groupBy(*group).agg((F.min(name) - F.lit(start)).alias("_at"))
    return with_group(rows, starts, group).withColumn(name, F.col(name) - F.col("_at")).drop("_at")


def with_group(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined to one row a key of ``few``, null keys equal; ``few`` is broadcast if its size allows it."""
    same = F.lit(True)
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    few = few.withColumnsRenamed({c: f"_g{k}" for k, c in enumerate(keys)})
    return rows.join(broadcast_checked(few), same, "left").drop(*[f"_g{k}" for k in range(len(keys))])


def carried(df: DataFrame, group: list[str], block: str, totals: dict[str, Column], fold: dict[str, Callable[[str], Column]]) -> DataFrame:
    """What each block of a group takes over from the blocks before it, each total folded over these: one row a block, so a group's blocks fit in a task."""
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*group, block).agg(*[c.alias(name) for name, c in totals.items()])
    return checkpoint(parts.select(*group, block, *[fold[name](name).over(before).alias(name) for name in totals]))


def previous(df: DataFrame, group: list[str], order: list[str], value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Adds the value of the row before in the group's order, null at its first row; a group is as many tasks as it has blocks of rows."""
    rows = numbered(df, order, "_rn", group)
    rows = rows.withColumn("_b", F.floor(F.col("_rn") / block).cast("bigint"))
    at = Window.partitionBy(*group, "_b").orderBy("_rn")
    last = carried(rows, group, "_b", {"_last": F.max_by(F.struct(F.col(value).alias("v")), "_rn")}, {"_last": F.last})
    rows = with_group(rows.withColumns({name: F.lag(value).over(at), "_first": F.row_number().over(at) == 1}), last, [*group, "_b"])
    return rows.withColumn(name, F.when(F.col("_first"), F.col("_last.v")).otherwise(F.col(name))).drop("_rn", "_b", "_first", "_last")


#: Rows of a key that a task holds at once.
CHUNK = 1_000_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of one key in an ordered partition, a batch at a time: key, times, row ids and values."""
    for b in batches:
        if b.num_rows:
            code = b.column("key").dictionary_encode()
            index = code.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
            names = code.dictionary.take(pa.array(index[starts])).to_pylist()
            t, row, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "row_id", "value"))
            for name, lo, hi in zip(names, starts, [*starts[1:], b.num_rows]):
                yield name, t[lo:hi], row[lo:hi], v[lo:hi]


def _readings(t: np.ndarray) -> np.ndarray:
    """Which rows are the first of their reading."""
    return np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)


def edges(spreaded: DataFrame, reach: int) -> list:
    """At most ``2 * reach`` readings of each partition: the first ones of its first key, the last ones of its last."""

    def run(batches):
        head: list = []
        name, tail_t, tail_v, first_key = None, np.zeros(0, np.int64), np.zeros(0), None
        for key, t, _, v in _runs(batches):
            first_key = key if first_key is None else first_key
            if key != name:
                name, tail_t, tail_v = key, t[:0], v[:0]
            joined_t, joined_v = np.concatenate([tail_t, t]), np.concatenate([tail_v, v])
            new = np.flatnonzero(_readings(joined_t))
            if key == first_key and len(head) < reach:
                known = len(tail_t)
                head += [(int(joined_t[i]), float(joined_v[i])) for i in new if i >= known][: reach - len(head)]
            tail_t, tail_v = joined_t[new[-reach:]], joined_v[new[-reach:]]
        if first_key is None:
            return
        pid = TaskContext.get().partitionId()
        out = [(pid, False, k, first_key, t, v) for k, (t, v) in enumerate(head)] + [(pid, True, k, name, int(t), float(v)) for k, (t, v) in enumerate(zip(tail_t, tail_v))]
        yield pa.RecordBatch.from_pylist([dict(zip(("pid", "tail", "k", "key", "t", "value"), x)) for x in out], schema=pa.schema([("pid", pa.int32()), ("tail", pa.bool_()), ("k", pa.int32()), ("key", pa.string()), ("t", pa.int64()), ("value", pa.float64())]))

    return spreaded.mapInArrow(run, EDGES).collect()


def halos(rows: list, reach: int) -> dict[int, tuple[list, list]]:
    """For each partition the readings before it (of its first key) and after it (of its last), as lists of (t, value)."""
    parts: dict[int, dict[bool, list]] = {}
    for r in sorted(rows, key=lambda r: (r["pid"], r["tail"], r["k"])):
        parts.setdefault(r["pid"], {False: [], True: []})[r["tail"]].append((r["key"], r["t"], r["value"]))
    order, out = sorted(parts), {}
    for at, pid in enumerate(order):
        first, last = parts[pid][False][0][0], parts[pid][True][0][0]
        before: list = []
        for j in range(at - 1, -1, -1):
            tail = parts[order[j]][True]
            if tail[0][0] != first:
                break
            # a reading that goes on from partition j into the next one has its value from here, where it began
            before = [x[1:] for x in tail] + [x for x in before if x[0] != tail[-1][1]]
            if len(before) >= reach + 1 and parts[order[j]][False][0][0] != first:
                break
            if len(before) >= 2 * reach:
                break
        after: list = []
        for j in range(at + 1, len(order)):
            head = parts[order[j]][False]
            if head[0][0] != last:
                break
            after += [x[1:] for x in head if not after or x[1] != after[-1][0]]
            if len(after) > reach:
                break
        out[pid] = (before, after)
    return out


def look(spreaded: DataFrame, reach: int, fn: Look, schema: str, chunk: int = CHUNK) -> DataFrame:
    """Apply ``fn`` to all readings and give its results to their rows: ``key, t, row_id, value, is_first`` and what ``schema`` names.

    A reading is all rows of one key and time; its value is that of its smallest row id, and ``is_first`` marks that row. A
    task holds some ``chunk`` rows of a key at once, and the ``reach`` readings on both sides; ``fn`` must need no more.
    """
    around = halos(edges(spreaded, reach), reach)
    extra = [c.split()[0] for c in schema.split(", ")]

    def judged(name, lead, held, trail, stop):
        """The rows of ``held`` before ``stop``, judged among all its readings and those before and after it."""
        t, row, v = held
        ts, vs = np.concatenate([lead[0], t, trail[0]]), np.concatenate([lead[1], v, trail[1]])
        new = _readings(ts)
        reading = np.cumsum(new) - 1
        found = fn(ts[new], vs[new], name)
        own = slice(len(lead[0]), len(lead[0]) + stop)
        cols = [pa.array([name] * stop), pa.array(t[:stop]), pa.array(row[:stop]), pa.array(vs[new][reading[own]]), pa.array(new[own])]
        for c in extra:
            x = found[c][reading[own]]
            cols.append(pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" else pa.array(x))
        return pa.RecordBatch.from_arrays(cols, names=["key", "t", "row_id", "value", "is_first", *extra])

    def pair(readings):
        return np.array([x[0] for x in readings], np.int64), np.array([x[1] for x in readings], float)

    def run(batches):
        before, after = around.get(TaskContext.get().partitionId(), ([], []))
        none = pair([])
        name, lead, parts, size = None, pair(before), [], 0
        for key, *cols in _runs(batches):
            if key != name:
                if parts:
                    held = tuple(np.concatenate(x) for x in zip(*parts))
                    yield judged(name, lead, held, none, len(held[0]))
                    lead = none
                name, parts, size = key, [], 0
            parts.append(cols)
            size += len(cols[0])
            if size >= chunk:
                held = tuple(np.concatenate(x) for x in zip(*parts))
                new = np.flatnonzero(_readings(held[0]))
                if len(new) > reach + 1:  # the last readings wait for what follows them
                    stop = int(new[-reach - 1])
                    yield judged(name, lead, held, none, stop)
                    seen_t, seen_v = np.concatenate([lead[0], held[0][new[: -reach - 1]]]), np.concatenate([lead[1], held[2][new[: -reach - 1]]])
                    lead, held = (seen_t[-reach:], seen_v[-reach:]), tuple(x[stop:] for x in held)
                parts, size = [held], 0
        if parts:
            held = tuple(np.concatenate(x) for x in zip(*parts))
            yield judged(name, lead, held, pair(after), len(held[0]))

    return spreaded.mapInArrow(run, f"key string, t bigint, row_id bigint, value double, is_first boolean, {schema}")


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """``keys, n, q`` (array): exact percentiles of each key, linear between ranks, with no task ever holding a whole key.

    Mergeable sketches give each key brackets of 0.2 % of its rows around each percentile; a counting pass says how many
    values lie between the brackets, and only the distinct values inside are ranked. Null and NaN values don't count, keys
    without a value are not listed, null keys are a key.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    sides = sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-1e-3, 1e-3)})
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", sides, 10_000).alias("_b"), F.count("*").alias("n"))
    sketch = checkpoint(sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_b", "n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = rows.join(broadcast_checked(sketch), same)
    # the brackets' sides cut the line into pieces; a piece between two brackets is only counted, at its upper end
    at = lambda p: sides.index(min(1.0, max(0.0, p)))
    inside, nxt = F.col("n") <= SMALL, F.lit(None).cast("double")
    for p in ps:
        inside = inside | ((F.col("_v") >= F.col("_b")[at(p - 1e-3)]) & (F.col("_v") <= F.col("_b")[at(p + 1e-3)]))
    for p in sorted(ps, reverse=True):
        lo = F.col("_b")[at(p - 1e-3)]
        nxt = F.when(F.col("_v") < lo, lo).otherwise(nxt)
    spot = met.select(*keys, "n", inside.alias("_in"), F.when(inside, F.col("_v")).otherwise(nxt).alias("_v")).where(F.col("_v").isNotNull())
    counts = spot.groupBy(*keys, "_v", "_in").agg(F.count("*").alias("_c"), F.max("n").alias("n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v", "_in").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto)
    hit = lambda rank: F.min(F.when(F.col("_in") & (F.col("_upto") > rank), F.col("_v")))
    out = []
    for p in ps:
        h = (F.col("n") - 1) * F.lit(float(p))
        low, high = hit(F.floor(h)), hit(F.ceil(h))
        part = F.max(h - F.floor(h))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * part))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*out).alias("q"))


def exact_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, median, n``."""
    return exact_percentiles(rows, [key], value, [0.5]).select(key, F.col("q")[0].alias("median"), "n")
