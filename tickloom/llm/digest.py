"""Percentiles of very large columns from mergeable centroid digests, with certified rank errors.

Sorted values are clustered so that a cluster at quantile q holds about ``2 pi / size * sqrt(q (1 - q))`` of the rows:
many small clusters at the tails. Equal values are pooled first, and a value that alone is heavier than a cluster may be
stays a cluster of its own, so ties are exact. Digests merge by clustering their centroids again, in any order.

A digest is built where the rows lie, so one task sends on at most a digest a group, however hot the group. A second
pass counts the rows below and up to every estimate, which certifies its rank error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import broadcast_checked, checkpoint

#: Twice the most clusters of a digest; the stated bound on a rank error follows from it.
SIZE = 1000
QUANTILES = (0.05, 0.5, 0.95, 0.99)
KEYS = ["metric", "grp", "day"]
#: Values and centroids a task gathers before it clusters them.
GATHER = 400_000


def bound(q: float, size: int = SIZE) -> float:
    """The stated bound on the rank error at quantile ``q``: two clusters."""
    return 4 * float(np.pi) / size * float(np.sqrt(q * (1 - q)))


def cluster(code: np.ndarray, mean: np.ndarray, weight: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids by group code (sorted), for any number of groups at once."""
    if not len(code):
        return code, mean, weight
    order = np.lexsort((mean, code))
    code, mean, weight = code[order], mean[order], weight[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (mean[1:] != mean[:-1])])
    at = np.flatnonzero(new)
    code, mean, weight = code[at], mean[at], np.add.reduceat(weight, at)
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    lengths = np.diff([*starts, len(code)])
    group = np.repeat(np.arange(len(starts)), lengths)
    total = np.add.reduceat(weight, starts)[group].astype(float)
    upto = np.cumsum(weight)
    upto = upto - np.concatenate([[0], upto])[starts][group]
    k = lambda q: size / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1))
    left, right = k((upto - weight) / total), k(upto / total)
    heavy = (right - left >= 1) | (lengths[group] <= size // 2)
    slot = np.floor((left + right) / 2)
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (slot[1:] != slot[:-1]) | heavy[1:] | heavy[:-1]])
    at = np.flatnonzero(fresh)
    w = np.add.reduceat(weight, at)
    lone = np.diff([*at, len(code)]) == 1
    with np.errstate(over="ignore", invalid="ignore"):
        m = np.add.reduceat(mean / w[np.cumsum(fresh) - 1] * weight, at)
    return code[at], np.where(lone, mean[at], m), w


def quantile(mean: np.ndarray, weight: np.ndarray, qs: tuple[float, ...], size: int = SIZE) -> list[float]:
    """Estimates from one digest: linear between the middles of neighbouring clusters, and the value itself in a cluster of ties."""
    upto, out = np.cumsum(weight), []
    n = upto[-1]
    k = lambda q: size / (2 * np.pi) * np.arcsin(2 * q - 1)
    for q in qs:
        rank = q * n
        j = min(int(np.searchsorted(upto, rank, side="left")), len(mean) - 1)
        w, before = weight[j], upto[j] - weight[j]
        part = (rank - before) / w
        i = j - 1 if part < 0.5 else j + 1
        if w == 1 or not 0 <= i < len(mean) or k(upto[j] / n) - k(before / n) >= 1 or not np.isfinite(mean[i] - mean[j]):
            out.append(float(mean[j]))
            continue
        edge = mean[j] + (mean[i] - mean[j]) * w / (w + weight[i])
        out.append(float(mean[j] + (edge - mean[j]) * abs(part - 0.5) * 2))
    return out


DIGEST = "metric string, grp bigint, day date, n bigint, means array<double>, weights array<bigint>"
_ARROW = pa.schema([("metric", pa.string()), ("grp", pa.int64()), ("day", pa.date32()), ("n", pa.int64()), ("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.int64()))])


def _gather(size: int, most: int = 4_000_000, ordered: bool = False):
    """A pass that turns rows (``value``) or digests (``means, weights``) into one digest a group of its partition.

    Past ``most`` clusters all digests are let go, to be merged by a later pass; with ``ordered`` the rows come by group,
    and all but the open group's are whole by then. So a task's memory doesn't grow with the groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        parts: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def settle():
            nonlocal held, parts, waiting
            held, parts, waiting = cluster(*(np.concatenate(x) for x in zip(held, *parts)), size), [], 0

        def give() -> pa.RecordBatch:
            code, mean, weight = held
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            which = {v: k for k, v in names.items()}
            keys = [which[int(code[s])] for s in starts]
            offsets = pa.array([*starts, len(code)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.date32()), pa.array(np.add.reduceat(weight, starts)), pa.ListArray.from_arrays(offsets, pa.array(mean)), pa.ListArray.from_arrays(offsets, pa.array(weight))],
                schema=_ARROW,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.Table.from_batches([batch]).select(KEYS)
            at = np.zeros(batch.num_rows, np.int64)
            columns = [keys.column(c).combine_chunks().dictionary_encode() for c in KEYS]
            for c in columns:
                at = at * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
            _, one, back = np.unique(at, return_index=True, return_inverse=True)
            mine = [names.setdefault(tuple(x.values()), len(names)) for x in keys.take(pa.array(one)).to_pylist()]
            code = np.array(mine, np.int64)[back]
            if "value" in batch.schema.names:
                value = batch.column("value").to_numpy(zero_copy_only=False)
                parts.append((code, value, np.ones(len(value), np.int64)))
            else:
                lists = batch.column("means")
                parts.append((np.repeat(code, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()))
            waiting += len(parts[-1][0])
            if waiting >= min(GATHER, most):
                settle()
                if len(held[0]) >= most:
                    last = names[tuple(keys.slice(batch.num_rows - 1).to_pylist()[0].values())]
                    keep = held[0] == last if ordered else np.zeros(len(held[0]), bool)
                    open_group, held = tuple(x[keep] for x in held), tuple(x[~keep] for x in held)
                    if len(held[0]):
                        yield give()
                    names = {k: 0 for k, v in names.items() if ordered and v == last}
                    held = (np.zeros(len(open_group[0]), np.int64), *open_group[1:])
        settle()
        if len(held[0]):
            yield give()

    return run


def digests(rows: DataFrame, size: int = SIZE, most: int = 4_000_000) -> DataFrame:
    """One digest a (``metric, grp, day``) of rows with a ``value``, or of digests to merge.

    Values that are null or NaN don't count; groups without values have no digest; a null group or day is a group. Digests of a group are
    first merged in up to 16 parts, so the last task gets 16 digests of it however many tasks read its rows.
    """
    if "value" in rows.columns:
        rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*KEYS, "value")
        rows = rows.mapInArrow(_gather(size, most), DIGEST).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(16)))
        rows = rows.repartition(*KEYS, "_part").drop("_part").mapInArrow(_gather(size, most), DIGEST)
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_gather(size, most, ordered=True), DIGEST)


def estimates(digest: DataFrame, qs: tuple[float, ...] = QUANTILES, size: int = SIZE) -> DataFrame:
    """``metric, grp, day, q`` (array of estimates) of each digest."""

    def run(batches):
        for b in batches:
            means, weights = b.column("means"), b.column("weights")
            got = [quantile(np.asarray(means[i].values), np.asarray(weights[i].values), qs, size) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in KEYS], pa.array(got, pa.list_(pa.float64()))], names=[*KEYS, "q"])

    return digest.mapInArrow(run, "metric string, grp bigint, day date, q array<double>")


def percentiles(rows: DataFrame, qs: tuple[float, ...] = QUANTILES, size: int = SIZE) -> DataFrame:
    """Per group and day, and (``day`` null, ``over_days``) per group over all days from the daily digests alone.

    Result: ``metric, grp, day, over_days, p, estimate, n, below, upto, rank_error, bound``: ``below`` and ``upto`` are the
    counted rows under and up to the estimate, ``rank_error`` the distance of ``p`` from that range of ranks, as a share of n.
    """
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    daily = checkpoint(digests(rows, size))
    overall = digests(daily.withColumn("day", F.lit(None).cast("date")), size)
    per_day = estimates(daily, qs, size).select(F.col("metric").alias("_m"), F.col("grp").alias("_g"), F.col("day").alias("_d"), F.col("q").alias("qd"))
    per_group = estimates(overall, qs, size).select(F.col("metric").alias("_m2"), F.col("grp").alias("_g2"), F.col("q").alias("qo"))
    both = checkpoint(per_day.join(per_group, F.col("_m").eqNullSafe(F.col("_m2")) & F.col("_g").eqNullSafe(F.col("_g2"))).drop("_m2", "_g2"))
    few = broadcast_checked(both)
    same = F.col("metric").eqNullSafe(F.col("_m")) & F.col("grp").eqNullSafe(F.col("_g")) & F.col("day").eqNullSafe(F.col("_d"))
    if few is not both:
        met = rows.join(few, same)
    else:  # too many to broadcast: rows are dealt out over 16 copies of the estimates, so no group is one task's
        salted = rows.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
        met = salted.join(both.withColumn("_s2", F.explode(F.sequence(F.lit(0), F.lit(15)))), same & (F.col("_s") == F.col("_s2")))
    count = lambda c: F.sum(c.cast("bigint"))
    v = F.col("value")
    sums = [x for kind in ("qd", "qo") for k in range(len(qs)) for x in (count(v < F.col(kind)[k]).alias(f"{kind}_b{k}"), count(v <= F.col(kind)[k]).alias(f"{kind}_u{k}"))]
    counted = met.groupBy("metric", "grp", "day").agg(F.count("*").alias("n"), *sums)
    counted = checkpoint(counted)
    day_rows = counted.join(both.drop("qo"), same).select("metric", "grp", "day", F.lit(False).alias("over_days"), "n", F.col("qd").alias("q"), *[F.col(f"qd_{c}{k}").alias(f"{c}{k}") for k in range(len(qs)) for c in "bu"])
    group_sums = counted.groupBy("metric", "grp").agg(F.sum("n").alias("n"), *[F.sum(f"qo_{c}{k}").alias(f"{c}{k}") for k in range(len(qs)) for c in "bu"])
    one = both.groupBy(F.col("_m"), F.col("_g")).agg(F.first("qo").alias("q"))
    all_rows = group_sums.join(one, F.col("metric").eqNullSafe(F.col("_m")) & F.col("grp").eqNullSafe(F.col("_g"))).select("metric", "grp", F.lit(None).cast("date").alias("day"), F.lit(True).alias("over_days"), "n", "q", *[f"{c}{k}" for k in range(len(qs)) for c in "bu"])
    wide = day_rows.unionByName(all_rows)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("q")[k].alias("estimate"), F.col(f"b{k}").alias("below"), F.col(f"u{k}").alias("upto"), F.lit(bound(p, size)).alias("bound")) for k, p in enumerate(qs)]))
    out = wide.select("metric", "grp", "day", "over_days", "n", each.alias("x")).select("metric", "grp", "day", "over_days", "n", "x.*")
    rank = F.col("p") * F.col("n")
    miss = F.greatest(F.lit(0.0), F.col("below") - rank, rank - F.col("upto")) / F.col("n")
    return out.withColumn("rank_error", miss)


def market_values(markouts: DataFrame, trade_features: DataFrame, options: DataFrame) -> DataFrame:
    """The three measured columns as ``metric, grp, day, value``."""
    pick = lambda df, metric, grp, value: df.select(F.lit(metric).alias("metric"), F.col(grp).cast("bigint").alias("grp"), F.col("trade_date").alias("day"), F.col(value).alias("value"))
    return pick(markouts, "signed_markout", "window_ms", "signed_markout").unionByName(pick(trade_features, "spread_ticks", "instrument_id", "spread_ticks")).unionByName(pick(options, "net_gex", "instrument_id", "net_gex"))
