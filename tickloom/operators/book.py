"""The limit order book of each session: order lifetimes as relations, the book at every message by replay in blocks.

Lifetimes are windows over one order's own messages. The best prices at every message need the whole book, so a session
is cut into blocks of messages: the orders alive where a block starts come from the lifetimes, and each block is
replayed on its own, streaming. A session that holds a third of all messages is thus as many tasks as its blocks, and a
task holds the live orders of one block's book and one Arrow batch. Running counters go block by block, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickloom.cluster import checkpoint
from tickloom.functions import codes as C
from tickloom.operators.ordered import carried, with_group
from tickloom.sources.messages import SESSION

BLOCK = 100_000
LEVELS, COUNT_LEVELS = 5, 3
#: Fixed value: a best price that turns back within this time flickers.
FLICKER_NS = 50_000_000


def valid() -> Column:
    """Messages with a price above zero, and those that need none: cancels, fills and clears."""
    return (F.col("px") > 0) | F.col("act").isin(C.CLEAR, C.CANCEL, C.FILL)


def effects(ordered: DataFrame) -> DataFrame:
    """Ordered messages with ``kind``: 1 an order is set, 2 removed, 3 filled, 4 the book emptied, null nothing happens."""
    act, whole, priced = F.col("act"), (F.col("side_code") != C.NO_SIDE) & (F.col("size") > 0), valid()
    kind = (
        F.when(act.isin(C.ADD, C.MODIFY) & priced & whole, 1).when((act == C.MODIFY) & priced, 2).when(act == C.CANCEL, 2)
        .when(act == C.FILL, 3).when(act == C.CLEAR, 4)
    )
    return ordered.withColumn("kind", kind.cast("tinyint"))


def is_long(ordered: DataFrame, block: int) -> bool:
    """Whether any session has more messages than a block; without one, blocks take over nothing. Only the plan depends on it."""
    return bool(ordered.where(F.col("n") == block + 1).take(1))


def order_states(ordered: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each order's states: ``trade_date, instrument_id, order_id, n, until, px, side_code, remaining``.

    A state begins with message ``n`` and holds up to, not including, message ``until`` (null: the end of the session). Orders are
    independent given the number of times the book was emptied before, so this is windows over (session, epoch, order). Times
    are counted in blocks of a session, each with what the blocks before it had.
    """
    e = effects(ordered).where(F.col("kind").isNotNull()).withColumn("_b", C.floor_div(F.col("n") - 1, block))
    clear = (F.col("kind") == 4).cast("int")
    epoch = F.sum(clear).over(Window.partitionBy(*SESSION, "_b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    if is_long(ordered, block):
        e = with_group(e.withColumn("epoch", epoch), carried(e, SESSION, "_b", {"_ep": F.sum(clear)}, {"_ep": F.sum}), [*SESSION, "_b"])
        e = e.withColumn("epoch", F.col("epoch") + F.coalesce("_ep", F.lit(0)))
    else:
        e = e.withColumn("epoch", epoch)
    clears = checkpoint(e.where(F.col("kind") == 4).select(*SESSION, (F.col("epoch") - 1).alias("epoch"), F.col("n").alias("cleared")))
    own = Window.partitionBy(*SESSION, "epoch", "order_id").orderBy("n")
    o = e.where(F.col("kind") < 4).withColumn("gen", F.sum((F.col("kind") < 3).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    o = o.withColumn("next", F.lead("n").over(own))
    life = Window.partitionBy(*SESSION, "epoch", "order_id", "gen").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.sum(F.when(F.col("kind") == 3, F.greatest(F.col("size"), F.lit(0))).otherwise(0)).over(life)
    born = F.first(F.when(F.col("kind") < 3, F.struct("kind", "px", "side_code", "size"))).over(life)
    o = o.withColumns({"born": born, "filled": filled}).where((F.col("born.kind") == 1) & (F.col("born.size") > F.col("filled")))
    o = o.select(*SESSION, "epoch", "order_id", "n", "next", F.col("born.px").alias("px"), F.col("born.side_code").alias("side_code"), (F.col("born.size") - F.col("filled")).alias("remaining"))
    o = with_group(o, clears, [*SESSION, "epoch"])
    return o.select(*SESSION, "order_id", "n", F.least("next", "cleared").alias("until"), "px", "side_code", "remaining")


KEEP = ["seq", "ts_ns", "ts_recv", "ts_in_delta", "sequence", "flags"]
OUT = (
    "trade_date date, instrument_id bigint, n bigint, seq bigint, ts_ns bigint, ts_recv bigint, ts_in_delta int, sequence bigint, flags smallint, "
    "act tinyint, side_code tinyint, px bigint, size bigint, bid0 bigint, ask0 bigint, bid bigint, ask bigint, "
    "bid_sz array<bigint>, ask_sz array<bigint>, bid_oc array<bigint>, ask_oc array<bigint>, bid_levels bigint, ask_levels bigint, bid_total bigint, ask_total bigint"
)


class Book:
    """Orders and price levels of one instrument; ``best`` is kept as long as its level lasts, then found on a heap of the side's prices."""

    def __init__(self):
        self.orders: dict = {}
        self.levels: tuple[dict, dict] = ({}, {})
        self.best: list[int | None] = [None, None]
        self.total = [0, 0]
        self.heaps: tuple[list, list] = ([], [])  # prices, bids negated; those of levels that are gone are passed over

    def put(self, oid, px: int, size: int, side: int) -> None:
        self.take(oid)
        self.orders[oid] = [px, size, side]
        level = self.levels[side].get(px)
        if level is None:
            level = self.levels[side][px] = [0, 0]
            heappush(self.heaps[side], px if side else -px)
        level[0] += size
        level[1] += 1
        self.total[side] += size
        best = self.best[side]
        if best is None or (px > best if side == 0 else px < best):
            self.best[side] = px

    def take(self, oid, fill: int | None = None) -> None:
        """Remove an order, or so much of it."""
        order = self.orders.get(oid)
        if order is None:
            return
        px, size, side = order
        gone = size if fill is None else min(max(fill, 0), size)
        level = self.levels[side][px]
        level[0] -= gone
        self.total[side] -= gone
        if gone < size:
            order[1] -= gone
            return
        del self.orders[oid]
        level[1] -= 1
        if not level[1]:
            del self.levels[side][px]
            if self.best[side] == px:
                rest, heap, sign = self.levels[side], self.heaps[side], 1 if side else -1
                while heap and sign * heap[0] not in rest:
                    heappop(heap)
                self.best[side] = sign * heap[0] if heap else None

    def around(self, side: int, field: int, depth: int) -> list[int]:
        """Size or order count at the best price and at the ticks behind it; an empty tick is 0."""
        best, levels, step = self.best[side], self.levels[side], 1 - 2 * side
        if best is None:
            return [0] * depth
        return [levels[p][field] if (p := best - step * k) in levels else 0 for k in range(depth)]


def _replay(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    here, book = None, Book()
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("trade_date", "instrument_id", "block", "kind", "order_id", "px", "size", "side_code", "act")}
        made: dict[str, list] = {c: [] for c in ("bid0", "ask0", "bid", "ask", "bid_sz", "ask_sz", "bid_oc", "ask_oc", "bid_levels", "ask_levels", "bid_total", "ask_total")}
        kept = []
        for k, (day, inst, block, kind, oid, px, size, side, act) in enumerate(zip(*cols.values())):
            if (day, inst, block) != here:
                here, book = (day, inst, block), Book()
            if kind == 0:
                book.put(oid, px, size, side)
                continue
            kept.append(k)
            made["bid0"].append(book.best[0])
            made["ask0"].append(book.best[1])
            if kind == 1:
                book.put(oid, px, size, side)
            elif kind == 2:
                book.take(oid)
            elif kind == 3:
                book.take(oid, size)
            elif kind == 4:
                book = Book()
            made["bid"].append(book.best[0])
            made["ask"].append(book.best[1])
            trade = act == C.TRADE
            for s, name in enumerate(("bid", "ask")):
                made[f"{name}_sz"].append(book.around(s, 0, LEVELS) if trade else None)
                made[f"{name}_oc"].append(book.around(s, 1, COUNT_LEVELS) if trade else None)
                made[f"{name}_levels"].append(len(book.levels[s]) if trade else None)
                made[f"{name}_total"].append(book.total[s] if trade else None)
        if kept:
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) if f.name not in made else pa.array(made[f.name], f.type) for f in types], schema=types)


def replay(ordered: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every message with the best prices before (``bid0, ask0``) and after it, and at trades the depth around them.

    ``bid_sz, ask_sz`` are sizes at the best tick and the four behind it, ``bid_oc, ask_oc`` order counts of the first
    three, ``*_levels`` the occupied prices, ``*_total`` the whole side. An empty side has a null price and zeros.
    """
    e = effects(ordered).withColumn("block", C.floor_div(F.col("n") - 1, block))
    cols = [*SESSION, "block", "n", "kind", "order_id", "px", "size", "side_code", "act", *KEEP]
    rows = e.select(*[F.coalesce("kind", F.lit(9)).cast("tinyint").alias("kind") if c == "kind" else F.col(c) for c in cols])
    if is_long(ordered, block):
        ends = ordered.groupBy(*SESSION).agg(C.floor_div(F.max("n") - 1, block).alias("last"))
        alive = order_states(ordered, block).withColumn("b0", C.floor_div(F.col("n") - 1, block))
        alive = with_group(alive, ends, SESSION).withColumn("b1", F.coalesce(C.floor_div(F.col("until") - 1, block), F.col("last")))
        alive = alive.where(F.col("b1") > F.col("b0")).withColumn("block", F.explode(F.sequence(F.col("b0") + 1, F.col("b1"))))
        start = alive.select(*SESSION, "block", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("tinyint").alias("kind"), "order_id", "px", F.col("remaining").alias("size"), "side_code")
        rows = rows.unionByName(start, allowMissingColumns=True)
    rows = rows.repartition(*SESSION, "block").sortWithinPartitions(*SESSION, "block", "n")
    types = to_arrow_schema(StructType.fromDDL(OUT))

    def run(batches):
        return _replay(batches, types)

    return rows.mapInArrow(run, OUT)


def quotes(replayed: DataFrame) -> DataFrame:
    """Best prices as ``mid`` (null unless the ask is above the bid), ``spread_ticks`` (0 if crossed or one-sided) and flags."""
    bid, ask = F.col("bid"), F.col("ask")
    both = bid.isNotNull() & ask.isNotNull()
    return replayed.withColumns(
        {
            "two_sided": F.coalesce(both, F.lit(False)),
            "crossed": F.coalesce(bid >= ask, F.lit(False)),
            "mid": F.when(ask > bid, (bid + ask) * F.lit(C.TICK / 2)),
            "spread_ticks": F.coalesce(F.when(ask > bid, ask - bid), F.lit(0)),
        }
    )


def snapshots(replayed: DataFrame) -> DataFrame:
    """One row a trade: book shape, imbalance, microprice and the mid carried over one-sided and crossed books."""
    w = Window.partitionBy(*SESSION).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    t = quotes(replayed.where(F.col("act") == C.TRADE))
    b, a = F.col("bid_sz")[0], F.col("ask_sz")[0]
    t = t.withColumn("last_mid", F.coalesce(F.last("mid", ignorenulls=True).over(w), F.lit(0.0)))
    micro = F.when(F.col("two_sided") & (a + b > 0), (F.col("ask") * F.lit(C.TICK) * b + F.col("bid") * F.lit(C.TICK) * a) / (a + b)).otherwise(F.col("last_mid"))
    rest = lambda c: F.aggregate(F.slice(c, 2, LEVELS - 1), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return t.withColumns(
        {
            "imbalance": F.when(a + b > 0, (b - a) / (a + b)).otherwise(F.lit(0.0)),
            "microprice": micro,
            "bid_depth_l2_5": rest("bid_sz"),
            "ask_depth_l2_5": rest("ask_sz"),
        }
    )


def counted(ordered: DataFrame, block: int = BLOCK) -> DataFrame:
    """``counters`` of the replayed messages; where a session is longer than a block, block by block."""
    replayed = replay(ordered, block)
    return counters(checkpoint(replayed), block) if is_long(ordered, block) else counters(replayed)


def counters(replayed: DataFrame, block: int | None = None) -> DataFrame:
    """Every message with running counters of its session.

    Sizes and counts of adds, cancels and fills by side, the same by distance from the best price before the message (at
    or inside it, one tick behind, deeper), moves of the best prices, spread changes, and spread-weighted time. A modify
    counts in both the add and the cancel of its level, and in no aggregate size; only fills, not trades, count as fills.

    With ``block`` no task sees more of a session than so many messages: each block has its own running sums, and takes
    over the sums of the blocks before it, the time of the last message and the last turns of the best prices. ``replayed``
    is then read three times and should lie in a checkpoint.
    """
    rows = replayed if block is None else replayed.withColumn("_b", C.floor_div(F.col("n") - 1, block))
    part = SESSION if block is None else [*SESSION, "_b"]
    at = Window.partitionBy(*part).orderBy("n")
    act, side, size = F.col("act"), F.col("side_code"), F.col("size")

    turns = {}
    for name in ("bid", "ask"):
        was, now = F.col(f"{name}0"), F.col(name)
        turns[f"_{name}_turn"] = F.when((was > 0) & (now > 0) & (was != now), F.struct(F.signum(now - was).cast("int").alias("dir"), F.col("ts_ns").alias("ts")))
    rows = rows.withColumns(turns)
    since, last = F.lag("ts_ns").over(at), {c: F.last(c, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1)) for c in turns}
    if block is not None:
        latest = {"_ts": F.max_by(F.struct("ts_ns"), "n")} | {f"_in{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))) for c in turns}
        rows = with_group(rows, carried(rows, SESSION, "_b", latest, dict.fromkeys(latest, lambda c: F.last(c, ignorenulls=True))), part)
        since = F.when(F.row_number().over(at) == 1, F.col("_ts.ts_ns")).otherwise(since)
        last = {c: F.coalesce(v, F.col(f"_in{c}")) for c, v in last.items()}
    flick = F.lit(0)
    rows = rows.withColumns({"_dt": F.col("ts_ns") - since} | {f"_last{c}": v for c, v in last.items()})
    for c in turns:
        back = (F.col(f"_last{c}.dir") == -F.col(f"{c}.dir")) & (F.col("ts_ns") - F.col(f"_last{c}.ts") <= FLICKER_NS)
        flick = flick + F.coalesce(back.cast("int"), F.lit(0))

    out = {}
    count = lambda cond, value=None: F.when(cond, F.lit(1) if value is None else value).otherwise(0)
    for s, name in enumerate(("bid", "ask")):
        on = side == s
        out |= {
            f"cum_add_{name}": count(on & (act == C.ADD), size), f"cum_canc_{name}": count(on & (act == C.CANCEL), size), f"cum_fill_{name}": count(on & (act == C.FILL), size),
            f"cum_n_canc_{name}": count(on & (act == C.CANCEL)), f"cum_n_mod_{name}": count(on & (act == C.MODIFY)), f"cum_n_fill_{name}": count(on & (act == C.FILL)),
        }
        best = F.col(f"{name}0")
        off = F.when(F.col("px") <= 0, 99).when(best.isNull(), 0).otherwise((best - F.col("px")) if s == 0 else (F.col("px") - best))
        for level, here in (("L1", off <= 0), ("L2", off == 1), ("deep", off > 1)):
            out |= {
                f"cum_add_{name}_{level}": count(on & here & act.isin(C.ADD, C.MODIFY), size), f"cum_canc_{name}_{level}": count(on & here & act.isin(C.CANCEL, C.MODIFY), size),
                f"cum_fill_{name}_{level}": count(on & here & (act == C.FILL), size),
            }
        now, was = F.col(name), F.col(f"{name}0")
        out |= {f"cum_{name}_up": count((was > 0) & (now > 0) & (now > was)), f"cum_{name}_dn": count((was > 0) & (now > 0) & (now < was))}
    now, was = F.col("ask") - F.col("bid"), F.col("ask0") - F.col("bid0")
    dt = F.col("_dt")
    out |= {
        "cum_widen": count((was > 0) & (now > 0) & (now > was)), "cum_narrow": count((was > 0) & (now > 0) & (now < was)),
        "cum_spread_time": count((dt > 0) & (was > 0), was * dt), "cum_wall_time": count(dt > 0, dt), "cum_flicker": flick,
    }
    helpers = ["_dt", *turns, *[f"_last{c}" for c in turns]]
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    if block is None:
        return rows.withColumns({c: F.sum(v).over(upto) for c, v in out.items()}).drop(*helpers)
    before = carried(rows, SESSION, "_b", {f"_s{c}": F.sum(v) for c, v in out.items()}, dict.fromkeys([f"_s{c}" for c in out], F.sum))
    rows = with_group(rows.withColumns({c: F.sum(v).over(upto) for c, v in out.items()}), before, part)
    whole = {c: F.col(c) + F.coalesce(f"_s{c}", F.lit(0)) for c in out}
    return rows.withColumns(whole).drop(*helpers, "_b", "_ts", *[f"_in{c}" for c in turns], *before.columns[len(part) :])


def flickers(replayed: DataFrame, within_ns: int = FLICKER_NS) -> DataFrame:
    """``trade_date, instrument_id, n, flicker`` of each change of a best price: 1 if it turns the side's last change back within the time, inclusive."""
    sides = []
    for name in ("bid", "ask"):
        was, now = F.col(f"{name}0"), F.col(name)
        sides.append(replayed.where((was > 0) & (now > 0) & (was != now)).select(*SESSION, "n", "ts_ns", F.lit(name).alias("which"), F.signum(now - was).cast("int").alias("dir")))
    w = Window.partitionBy(*SESSION, "which").orderBy("n")
    moved = sides[0].unionByName(sides[1])
    back = (F.lag("dir").over(w) == -F.col("dir")) & (F.col("ts_ns") - F.lag("ts_ns").over(w) <= within_ns)
    return moved.withColumn("flicker", F.coalesce(back.cast("int"), F.lit(0))).select(*SESSION, "n", "which", "dir", "flicker")
