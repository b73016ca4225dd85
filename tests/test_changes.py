"""The change feed against a sequential fold."""

import datetime
import random

import pytest

from tickloom.operators import book, changes
from tickloom.sources import messages as M

DAY = datetime.date(2024, 1, 2)
SCHEMA = "seq bigint, trade_date date, ts_ns bigint, ts_recv bigint, action string, side string, price double, size bigint, order_id bigint, flags smallint, ts_in_delta int, sequence bigint, channel_id smallint, publisher_id int, instrument_id bigint, symbol string"


def frame(spark, rows, inst=1):
    """Rows of (action, side, price, size, order_id), in order, as messages."""
    full = [(k + 1, DAY, 1000 + k, 2000 + k, a, s, p, z, o, 0, 1, k + 1, 1, 1, inst, "X") for k, (a, s, p, z, o) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def fold(rows):
    """The plainest book: one message after the other."""
    alive = {}
    for a, s, p, z, o in rows:
        a, s, z = (a or "").upper(), (s or "").upper(), z or 0
        px = 0 if p is None or p != p or abs(p) == float("inf") else round(p / 0.25)
        side = {"B": 0, "A": 1}.get(s)
        if px <= 0 and a not in ("R", "C", "F"):
            continue
        if a == "A" and side is not None and z > 0:
            alive[o] = (px, z)
        elif a == "C":
            alive.pop(o, None)
        elif a == "M":
            alive.pop(o, None)
            if side is not None and z > 0:
                alive[o] = (px, z)
        elif a == "F" and o in alive:
            px, left = alive[o]
            left -= min(z, left)
            if left <= 0:
                del alive[o]
            else:
                alive[o] = (px, left)
        elif a == "R":
            alive.clear()
    return alive


def resting(df):
    return {r["order_id"]: (r["price_ticks"], r["size"]) for r in changes.resting_orders(df).collect()}


CASES = {
    "duplicate add": ([("A", "B", 25.0, 5, 1), ("A", "B", 25.25, 3, 1)], {1: (101, 3)}),
    "zero-size duplicate add": ([("A", "B", 25.0, 5, 1), ("A", "B", 25.25, 0, 1)], {1: (100, 5)}),
    "modify to zero": ([("A", "B", 25.0, 5, 1), ("M", "B", 25.0, 0, 1)], {}),
    "modify without a price": ([("A", "B", 25.0, 5, 1), ("M", "B", None, 3, 1)], {1: (100, 5)}),
    "unknown cancel and fill": ([("C", "B", 1.0, 1, 9), ("F", "B", 1.0, 1, 9)], {}),
    "over-fill": ([("A", "A", 26.25, 4, 1), ("F", "A", 26.25, 10, 1), ("F", "A", 26.25, 1, 1)], {}),
    "partial fill then modify": ([("A", "B", 25.0, 5, 1), ("F", "B", 25.0, 2, 1), ("M", "B", 24.75, 6, 1)], {1: (99, 6)}),
    "clear": ([("A", "B", 25.0, 5, 1), ("A", "A", 26.0, 5, 2), ("R", "N", None, 0, 0), ("A", "B", 24.0, 1, 3)], {3: (96, 1)}),
    "bad price": ([("A", "B", 0.0, 5, 1), ("A", "B", 25.0, 5, 2), ("C", "B", 0.0, 0, 2)], {}),
    "small letters and unknown actions": ([("a", "b", 25.0, 5, 1), (None, "B", 25.0, 9, 1), ("X", "B", 25.0, 9, 1), ("T", "B", 25.0, 9, 1)], {1: (100, 5)}),
    "negative fill takes nothing": ([("A", "B", 25.0, 5, 1), ("F", "B", 25.0, -3, 1)], {1: (100, 5)}),
    "null order id is an id": ([("A", "B", 25.0, 5, None)], {None: (100, 5)}),
}


@pytest.mark.parametrize("name", CASES)
def test_scripts(spark, name):
    rows, want = CASES[name]
    assert resting(frame(spark, rows)) == want


def random_rows(seed, n):
    rng = random.Random(seed)
    return [
        (rng.choice("AAAACMFFTR" if rng.random() < 0.05 else "AAAACMFFT"), rng.choice(["B", "A", "B", "A", "N", None]), rng.choice([25 + 0.25 * rng.randint(0, 9), 25.0, 0.0, None, float("nan")]), rng.randint(0, 6), rng.randint(1, 12))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_with_copies_and_disorder(spark, seed):
    rows = random_rows(seed, 400)
    df = frame(spark, rows)
    copies = df.where("seq % 3 = 0").selectExpr("seq + 1000 as seq", *[c for c in df.columns if c != "seq"])
    mixed = df.unionByName(copies).orderBy("order_id")
    assert resting(mixed) == fold(rows)


def test_small_blocks_give_the_same(spark):
    rows = random_rows(3, 300)
    got = changes.apply_changes(changes.order_changes(frame(spark, rows)), scope=["trade_date", "instrument_id"], key=["order_id"], payload=["price_ticks", "side"], block=16)
    assert {r["order_id"]: (r["price_ticks"], r["size"]) for r in got.collect()} == fold(rows)


def test_empty_and_extra_columns(spark):
    assert resting(frame(spark, [("A", "B", 25.0, 1, 1)]).limit(0)) == {}
    df = frame(spark, [("A", "B", 25.0, 1, 1)]).selectExpr("*", "1 as kind", "2 as price_ticks", "3 as _block", "4 as act")
    assert resting(df) == {1: (100, 1)}


def test_base_is_merged(spark):
    base = spark.createDataFrame([("s", 1, 100, 5), ("s", 2, 101, 5), ("t", 1, 7, 1)], "g string, k bigint, px bigint, size bigint")
    feed = spark.createDataFrame([("s", 1, 10, 3, None, 2), ("s", 2, 11, 2, None, None), ("s", 3, 12, 1, 99, 4)], "g string, k bigint, sequence bigint, kind int, px bigint, size bigint")
    got = changes.apply_changes(feed, scope=["g"], key=["k"], payload=["px"], base=base)
    assert sorted(tuple(r) for r in got.select("g", "k", "px", "size").collect()) == [("s", 1, 100, 3), ("s", 3, 99, 4), ("t", 1, 7, 1)]


def test_replay_in_blocks_equals_one_block(spark):
    rows = random_rows(5, 300)
    ordered = M.in_order(frame(spark, rows))
    pick = ["n", "bid", "ask", "bid0", "ask0", "bid_sz", "ask_oc", "bid_total"]
    whole = [tuple(r) for r in book.replay(ordered).select(*pick).orderBy("n").collect()]
    parts = [tuple(r) for r in book.replay(ordered, block=37).select(*pick).orderBy("n").collect()]
    assert len(whole) == 300
    for a, b, k in zip(whole, parts, range(300)):
        if k % 37 == 0:  # what stood before a block's first message is its start, the same book
            assert a[1:] == b[1:]
        assert a == b


def test_final_book_is_what_rests(spark):
    rows = random_rows(6, 200)
    last = book.order_states(M.in_order(frame(spark, rows))).where("until is null")
    assert {r["order_id"]: (r["px"], r["remaining"]) for r in last.collect()} == fold(rows)


def test_crossed_and_gapped_books(spark):
    rows = [("A", "B", 25.0, 4, 1), ("A", "B", 24.5, 2, 2), ("A", "A", 26.0, 3, 3), ("T", "B", 26.0, 1, 0), ("A", "B", 26.25, 1, 4), ("T", "N", 26.0, 1, 0)]
    t = book.snapshots(book.replay(M.in_order(frame(spark, rows)))).orderBy("n").collect()
    assert t[0]["bid_sz"] == [4, 0, 2, 0, 0] and t[0]["mid"] == 25.5 and t[0]["spread_ticks"] == 4
    assert t[1]["crossed"] and t[1]["mid"] is None and t[1]["last_mid"] == 25.5 and t[1]["spread_ticks"] == 0
    assert t[1]["microprice"] == (26.0 * 1 + 26.25 * 3) / 4


def test_differing_copies_count_once(spark):
    rows = [("s", 1, 10, changes.SET, "x", 5), ("s", 1, 20, changes.DECREMENT, None, 1), ("s", 1, 20, changes.DECREMENT, None, 2), ("s", 2, 30, changes.SET, "z", 9), ("s", 2, 30, changes.SET, "y", 12), ("s", 3, 30, changes.SET, "w", 1)]
    df = spark.createDataFrame(rows, "g string, k bigint, sequence bigint, kind int, p string, size bigint")
    apply = lambda d, **base: sorted(tuple(r) for r in changes.apply_changes(d, scope=["g"], key=["k"], payload=["p"], **base).collect())
    assert apply(df) == [("s", 1, "x", 4), ("s", 2, "y", 12)]
    # base rows share no identifier; a clear among copies wins
    base = spark.createDataFrame([("s", 7, "b", 3), ("s", 8, "c", 4)], "g string, k bigint, p string, size bigint")
    assert apply(df, base=base) == [("s", 1, "x", 4), ("s", 2, "y", 12), ("s", 7, "b", 3), ("s", 8, "c", 4)]
    clear = spark.createDataFrame([("s", None, 30, changes.CLEAR, None, None)], df.schema)
    assert apply(df.union(clear), base=base) == []
