"""Filling containers of fixed capacity with items of varying size, by shortest-pack-first over the histogram of sizes.

Only the histogram reaches the driver: at most one count a size, however many items there are. It is packed from the
largest size down, always into the least filled packs that still hold the size, many equal packs at a time, so packs
are counted as patterns. Each pattern then owns a range of ranks of each of its sizes; items get their rank within
their size by counts over parts, and with it their container. An item larger than a container is divided into full
containers and a rest; no other item is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.cluster import checkpoint
from tickloom.llm import tokens

CAPACITY = 2048
#: Items a part holds on average, by which the number of parts is chosen, up to ``MOST_PARTS``.
PART_ROWS, MOST_PARTS = 1_000_000, 1024


def pack_histogram(sizes: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, tuple]], int]:
    """Patterns ``(number of packs, ((size, items), ...))`` for items of sizes 1 to ``capacity``, and the number of packs."""
    spare: dict[int, list[list]] = {}  # space left -> groups [packs, chain of (chain, size, items)]
    heap: list[int] = []  # negative spaces that may have groups

    def keep(space: int, packs: int, chain: tuple) -> None:
        if space not in spare:
            spare[space] = []
            heapq.heappush(heap, -space)
        spare[space].append([packs, chain])

    for size, count in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
        while count:
            while heap and not spare.get(-heap[0]):
                spare.pop(-heapq.heappop(heap), None)
            space = -heap[0] if heap else 0
            if space >= size:
                group = spare[space][-1]
                used = min(count, group[0])
                group[0] -= used
                chain = group[1]
                if not group[0]:
                    spare[space].pop()
                count -= used
                more = (chain[0], size, chain[2] + 1) if chain[1] == size else (chain, size, 1)
                keep(space - size, used, more)
            else:  # no pack has room: each new one takes as many as fit before the next is the least filled
                each = capacity // size
                full, rest = divmod(count, each)
                if full:
                    keep(capacity - each * size, full, ((), size, each))
                if rest:
                    keep(capacity - rest * size, 1, ((), size, rest))
                count = 0
    patterns = []
    for groups in spare.values():
        for packs, chain in groups:
            items = []
            while chain:
                items.append(chain[1:])
                chain = chain[0]
            patterns.append((packs, tuple(reversed(items))))
    return patterns, sum(p for p, _ in patterns)


def ranges(patterns: list[tuple[int, tuple]], capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Runs of ranks, sorted by size and first rank: first key (``size << 44 | rank``), container of the first, items a container."""
    nxt = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for packs, items in patterns:
        for size, each in items:
            rows.append(((size << 44) | int(nxt[size]), base, each))
            nxt[size] += packs * each
        base += packs
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def containers(items: DataFrame, ident: Column, size: Column, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, size, container_id``: the container of each item, or of each piece of one that is too large.

    Pieces count from 0; all but the last are full and have containers of their own. An item of size 0 or of null size
    takes no space: it is listed once, with size 0 and a null container. Repeated ids are items of their own. Containers
    count from 0 without gaps; an empty table gives no rows.
    """
    ids = items.select(ident.cast("bigint").alias("doc_id"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    ids = checkpoint(ids.withColumn("uid", F.monotonically_increasing_id()))
    few = ids.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("size") / capacity)).alias("full")).first()
    parts = max(1, min(MOST_PARTS, few["n"] // PART_ROWS + 1))
    split = ids.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    rest = split.withColumn("piece", F.floor(F.col("size") / capacity).cast("int")).withColumn("rest", (F.col("size") % capacity).cast("int"))
    by_part = rest.where(F.col("rest") > 0).groupBy("rest", "part").count().orderBy("rest", "part").toPandas()  # at most capacity * parts rows
    sizes = by_part["rest"].to_numpy(np.int64)
    n = by_part["count"].to_numpy(np.int64)
    first = np.cumsum(n) - n
    if len(sizes):
        starts = np.concatenate([[True], sizes[1:] != sizes[:-1]])
        first = first - first[starts][np.cumsum(starts) - 1]
        one = np.flatnonzero(starts)
        patterns, packs = pack_histogram(sizes[one], np.add.reduceat(n, one), capacity)
    else:
        patterns, packs = [], 0
    key, base, each = ranges(patterns, capacity)
    offset = np.zeros((capacity, parts), np.int64)
    offset[sizes, by_part["part"].to_numpy(np.int64)] = first
    shared = ids.sparkSession.sparkContext.broadcast((key, base, each, offset))

    w = Window.partitionBy("rest", "part").orderBy("uid")
    ranked = rest.where(F.col("rest") > 0).withColumn("at", F.row_number().over(w) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, each, offset = shared.value
        for b in batches:
            size, part, at = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rest", "part", "at"))
            want = (size << 44) | (offset[size, part] + at)
            run = np.searchsorted(key, want, side="right") - 1
            box = base[run] + (want - key[run]) // each[run]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), pa.array(size), pa.array(box)], names=["doc_id", "piece", "size", "container_id"])

    out = "doc_id bigint, piece int, size bigint, container_id bigint"
    placed = ranked.select("doc_id", "piece", "rest", "part", "at").mapInArrow(place, out)
    empty = ids.where(F.col("size") == 0).select("doc_id", F.lit(0).alias("piece"), "size", F.lit(None).cast("bigint").alias("container_id"))
    placed = placed.unionByName(empty)
    if not few["full"]:
        return placed
    large = rest.where(F.col("piece") > 0)
    per_part = {r["part"]: r["s"] for r in large.groupBy("part").agg(F.sum("piece").alias("s")).collect()}  # at most MOST_PARTS rows
    sofar, starts_at = packs, []
    for p in range(parts):
        starts_at.append(sofar)
        sofar += int(per_part.get(p, 0))
    before = F.sum("piece").over(Window.partitionBy("part").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    begun = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts_at]), F.col("part") + 1)
    large = large.withColumn("begin", begun + F.coalesce(before, F.lit(0)))
    full = large.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("piece") - 1)).alias("piece"), "begin")
    return placed.unionByName(full.select("doc_id", "piece", F.lit(capacity).cast("bigint").alias("size"), (F.col("begin") + F.col("piece")).alias("container_id")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """The containers of ``docs`` by ``doc_id``, their ``text`` measured in tokens."""
    counted = tokens.token_ids(docs, F.col("doc_id"), F.col("text"), vocabulary, counts_only=True)
    return containers(counted, F.col("doc_id"), F.col("n_tokens"), capacity).withColumnRenamed("size", "n_tokens")
