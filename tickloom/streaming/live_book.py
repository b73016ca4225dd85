"""The order book over a live stream: one state a session, a snapshot for each trade, corrected as late messages arrive."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions import codes as C
from tickloom.operators.book import Book, effects
from tickloom.sources.messages import SESSION, encode

OUT = "trade_date date, instrument_id bigint, sequence bigint, bid bigint, ask bigint, bid_size bigint, ask_size bigint, revision int"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: Messages that can still be preceded by a late one, at least; a session is let go after so long without messages, in processing time.
KEEP, IDLE_S = 2000, 86_400


class Replay:
    """The book before the last messages, as a checkpoint, and these messages in true order with the snapshots given out."""

    def __init__(self):
        self.start, self.floor = Book(), None  # all up to sequence ``floor`` is in the checkpoint
        self.order: list[int] = []
        self.held: dict[int, tuple] = {}
        self.given: dict[int, tuple] = {}

    def take(self, messages: list[tuple]) -> list[tuple]:
        """New or corrected snapshots ``(sequence, bid, ask, bid_size, ask_size, revision)`` after some messages, in any order.

        A copy of a message held, and one that comes before the checkpoint, changes nothing.
        """
        late = False
        for m in messages:
            at = m[0]
            if at in self.held or (self.floor is not None and at <= self.floor):
                continue
            self.held[at] = m
            k = bisect_left(self.order, at)
            late |= k < len(self.order)
            self.order.insert(k, at)
        book, out = pickle.loads(pickle.dumps(self.start)), []
        for at in self.order:
            _, kind, oid, px, size, side, act = self.held[at]
            if kind == 1:
                book.put(oid, px, size, side)
            elif kind == 2:
                book.take(oid)
            elif kind == 3:
                book.take(oid, size)
            elif kind == 4:
                book = Book()
            if act == C.TRADE:
                now = (*book.best, book.around(0, 0, 1)[0], book.around(1, 0, 1)[0])
                was = self.given.get(at)
                if was is None or was[:-1] != now:
                    self.given[at] = (*now, 0 if was is None else was[-1] + 1)
                    out.append((at, *self.given[at]))
        return out

    def settle(self, keep: int) -> None:
        """Move all but the last ``keep`` messages into the checkpoint."""
        for at in self.order[:-keep]:
            _, kind, oid, px, size, side, _ = self.held.pop(at)
            self.given.pop(at, None)
            if kind == 1:
                self.start.put(oid, px, size, side)
            elif kind in (2, 3):
                self.start.take(oid, size if kind == 3 else None)
            elif kind == 4:
                self.start = Book()
            self.floor = at
        self.order = self.order[-keep:]


def live_book(messages: DataFrame, keep: int = KEEP, idle_s: int | None = IDLE_S) -> DataFrame:
    """Best prices and sizes at each trade of streaming messages, in append mode; a later ``revision`` of a trade replaces the earlier ones.

    Messages are applied by sequence. One that comes after its successors restores the checkpoint before these, replays
    the suffix, and gives out the snapshots that it changes anew. One that is older than the last ``keep`` messages and all
    that came with them, and a copy, is left out. The state is the live orders of a session and the messages since the
    checkpoint; it is let go after ``idle_s`` without messages (None: never, for queries that end by themselves).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        replay: Replay = pickle.loads(state.get[0]) if state.exists else Replay()
        rows = pd.concat(list(batches)).sort_values(["sequence", "seq"])
        got = replay.take(list(rows[["sequence", "kind", "order_id", "px", "size", "side_code", "act"]].itertuples(index=False, name=None)))
        if len(replay.order) > 2 * keep:
            replay.settle(keep)
        state.update((pickle.dumps(replay),))
        if idle_s is not None:
            state.setTimeoutDuration(idle_s * 1000)
        yield pd.DataFrame([(*key, *r) for r in got], columns=COLUMNS).astype({"bid": "Int64", "ask": "Int64", "revision": "int32"})

    rows = effects(encode(messages)).where("sequence is not null").fillna(9, ["kind"])
    rows = rows.select(*SESSION, "seq", "sequence", "kind", "order_id", "px", "size", "side_code", "act")
    timeout = GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(*SESSION).applyInPandasWithState(step, OUT, "held binary", "append", timeout)
