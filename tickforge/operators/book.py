"""L2 order books: levels as of a sequence number, top of book, and the exact builder with snapshot recovery as a fold."""

from __future__ import annotations

import json
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import fold

MAX_LEVELS, BUFFER = 64, 1024


def levels_at(deltas: DataFrame, seq: int | None = None, depth: int = 10) -> DataFrame:
    """instrument, side, level, price, size: the best levels after the deltas up to seq (all if None).

    The last change of a price counts. Equals the exact book as long as no side exceeds MAX_LEVELS.
    """
    seen = deltas if seq is None else deltas.where(F.col("seq") <= seq)
    last = seen.groupBy("instrument", "side", "price").agg(F.max_by("new_size", "seq").alias("size")).where("size > 0")
    best = "row_number() over (partition by instrument, side order by case when side = 'bid' then -price else price end)"
    return last.withColumn("level", F.expr(best)).where(F.col("level") <= depth).select("instrument", "side", "level", "price", "size")


def top_of_book(levels: DataFrame) -> DataFrame:
    """instrument, bid, bid_size, ask, ask_size, spread, mid, crossed (locked books count as crossed)."""
    of = lambda side, column: F.max(F.when((F.col("side") == side) & (F.col("level") == 1), F.col(column)))
    top = levels.groupBy("instrument").agg(of("bid", "price").alias("bid"), of("bid", "size").alias("bid_size"), of("ask", "price").alias("ask"), of("ask", "size").alias("ask_size"))
    return top.select("*", (F.col("ask") - F.col("bid")).alias("spread"), (0.5 * (F.col("bid") + F.col("ask"))).alias("mid"), F.coalesce((F.col("bid") >= F.col("ask")).cast("int"), F.lit(0)).alias("crossed"))


def books_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """instrument, equal: whether both have the same levels, pairwise of equal price and size."""
    shape = lambda d, n: d.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("side", "level", "price", "size"))).alias(n))
    return shape(left, "l").join(shape(right, "r"), "instrument", "full").select("instrument", F.coalesce(F.col("l") == F.col("r"), F.lit(False)).cast("int").alias("equal"))


class Side:
    """Price levels of one side, best first, at most `most`."""

    def __init__(self, sign: int, most: int):
        self.sign, self.most = sign, most
        self.keys: list[float] = []
        self.sizes: dict[float, int] = {}

    def apply(self, price: float, size: int) -> None:
        key = self.sign * price
        if key in self.sizes:
            if size:
                self.sizes[key] = size
            else:
                del self.sizes[key]
                self.keys.pop(bisect_left(self.keys, key))
        elif size:
            if len(self.keys) >= self.most:
                if key >= self.keys[-1]:
                    return
                del self.sizes[self.keys.pop()]
            insort(self.keys, key)
            self.sizes[key] = size

    def levels(self) -> list[list]:
        return [[self.sign * k, self.sizes[k]] for k in self.keys]


class BookBuilder:
    """One instrument's book from deltas and snapshots.

    Rows: (arrival_ix, etype, seq, side, price, new_size, levels as JSON [[side, price, size], ...]); a snapshot's seq is
    the number it is as of. Gives (state, expected, bids, asks, stats) as JSON at the end.
    """

    def __init__(self, most: int = MAX_LEVELS, buffer: int = BUFFER) -> None:
        self.most, self.buffer = most, buffer
        self.bids, self.asks = Side(-1, most), Side(1, most)
        self.live, self.expected = False, 1
        self.pending: list[list] = []
        self.stats = {"applied": 0, "gaps": 0, "recovered": 0, "stale_dropped": 0, "snapshot_too_old": 0, "buffer_overflow": 0}

    def change(self, side: str, price: float, size: int) -> None:
        (self.bids if side == "bid" else self.asks).apply(price, size)

    def hold(self, delta: list) -> None:
        if len(self.pending) < self.buffer:
            self.pending.append(delta)
        else:
            self.stats["buffer_overflow"] += 1

    def on_delta(self, seq: int, side: str, price: float, size: int) -> None:
        if not self.live:
            self.hold([seq, side, price, size])
        elif seq == self.expected:
            self.change(side, price, size)
            self.stats["applied"] += 1
            self.expected += 1
        elif seq > self.expected:
            self.stats["gaps"] += 1
            self.live, self.pending = False, []
            self.hold([seq, side, price, size])
        else:
            self.stats["stale_dropped"] += 1

    def on_snapshot(self, as_of: int, levels: list) -> None:
        if self.live and as_of < self.expected:
            return
        later = [d for d in self.pending if d[0] > as_of]
        if [d[0] for d in later] != list(range(as_of + 1, as_of + 1 + len(later))):
            self.stats["snapshot_too_old"] += 1
            return
        self.bids, self.asks = Side(-1, self.most), Side(1, self.most)
        for side, price, size in levels:
            self.change(side, price, size)
        for _, side, price, size in later:
            self.change(side, price, size)
            self.stats["applied"] += 1
        self.expected, self.live, self.pending = as_of + 1 + len(later), True, []
        self.stats["recovered"] += 1

    def step(self, row: tuple) -> list[tuple]:
        _, etype, seq, side, price, size, levels = row
        if etype == "snapshot":
            self.on_snapshot(seq, json.loads(levels or "[]"))
        else:
            self.on_delta(seq, side, price, size)
        return []

    def finish(self) -> list[tuple]:
        return [("live" if self.live else "recovering", self.expected, json.dumps(self.bids.levels()), json.dumps(self.asks.levels()), json.dumps(self.stats, sort_keys=True))]

    def dump(self) -> str:
        return json.dumps([self.live, self.expected, self.pending, self.stats, self.bids.levels(), self.asks.levels()])

    def load(self, state: str) -> None:
        self.live, self.expected, self.pending, self.stats, bids, asks = json.loads(state)
        self.bids, self.asks = Side(-1, self.most), Side(1, self.most)
        for price, size in bids:
            self.bids.apply(price, size)
        for price, size in asks:
            self.asks.apply(price, size)


def build_books(events: DataFrame, most: int = MAX_LEVELS) -> DataFrame:
    """instrument, state, expected, bids, asks, stats after all events in order of arrival_ix."""
    return fold(events, "instrument", "arrival_ix", ["arrival_ix", "etype", "seq", "side", "price", "new_size", "levels"], lambda: BookBuilder(most), "instrument string, state string, expected long, bids string, asks string, stats string")
