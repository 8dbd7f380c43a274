import json
import random

import pytest

from tickforge.operators import book, feed
from tickforge.operators.book import BookBuilder, Side
from tickforge.operators.feed import Arbitrator
from tickforge.plans import catalogue
from tickforge.sources import adapters

#: window, arrivals (line, seq), delivered or None, what the counts must hold
FEEDS = {
    "one line": (16, [("A", k) for k in range(10)], list(range(10)), {"gaps": 0, "duplicates_b": 0}),
    "both lines": (16, [(line, k) for k in range(5) for line in "AB"], list(range(5)), {"duplicates_b": 5}),
    "alternate": (16, [("A" if k % 2 == 0 else "B", k) for k in range(10)], list(range(10)), {"gaps": 0}),
    "reorder": (16, [("A", 0), ("A", 2), ("A", 1)], [0, 1, 2], {"gaps": 0, "max_reorder": 1}),
    "hole": (16, [("A", k) for k in (0, 1, 3, 4)], [0, 1, 3, 4], {"gaps": 1}),
    "late copy": (16, [("A", 0), ("A", 1), ("A", 2), ("B", 1)], [0, 1, 2], {"duplicates_b": 1}),
    "small window": (4, [("A", 0), ("A", 5), *(("B", k) for k in range(1, 5))], None, {"gaps": 1, "max_reorder": 3}),
    "wide window": (16, [("A", 0), ("A", 5), *(("B", k) for k in range(1, 5))], list(range(6)), {"gaps": 0}),
    "jump": (8, [("A", 0), ("A", 100)], [0, 100], {"delivered": 2, "gaps": 99}),
    "wild": (8, [("A", 0), ("A", 2**62), ("A", 1), ("A", 2)], [0, 1, 2], {"rejected": 1, "gaps": 0}),
}


@pytest.mark.parametrize("name", list(FEEDS))
def test_arbitrator(name):
    window, arrivals, delivered, counts = FEEDS[name]
    arbitrator = Arbitrator(window)
    out = []
    for k, (line, seq) in enumerate(arrivals):
        out += arbitrator.step((k, seq, line, seq))
        again = Arbitrator()
        again.load(arbitrator.dump())  # the state survives being written out at any point
        arbitrator = again
    out += arbitrator.finish()
    if delivered is not None:
        assert [r[1] for r in out if r[0] == "deliver"] == delivered
    stats = json.loads(out[-1][4])
    assert {k: stats[k] for k in counts} == counts


def test_window_form_equals_fold(spark):
    rng = random.Random(3)
    rows = []
    for f in "XY":
        arrivals = [(s, line) for s in range(300) for line in "AB" if rng.random() > 0.1]
        arrivals.sort(key=lambda x: x[0] + rng.random() * 10)
        low = min(s for s, _ in arrivals)
        arrivals.sort(key=lambda x: x[0] != low)
        rows += [(f, s, line, k, s) for k, (s, line) in enumerate(arrivals)]
    packets = spark.createDataFrame(rows, "feed string, seq long, line string, arrival_ix long, payload long")
    exact = feed.arbitrate(packets, 64)
    assert sorted((r.feed, r.seq, r.line) for r in exact.where("event = 'deliver'").collect()) == sorted((r.feed, r.seq, r.line) for r in feed.delivered(packets).collect())
    stats = {r.feed: json.loads(r.stats) for r in exact.where("event = 'stats'").collect()}
    for r in feed.arbitration_stats(packets).collect():
        assert {k: stats[r.feed][k] for k in ("delivered", "duplicates_a", "duplicates_b", "gaps")} == {"delivered": r.delivered, "duplicates_a": r.duplicates_a, "duplicates_b": r.duplicates_b, "gaps": r.gaps}
    assert feed.lost(packets).groupBy("feed").count().collect()


def test_levels():
    bids = Side(-1, 2)
    for price in (99, 98, 100, 1):
        bids.apply(price, 10)
    assert [p for p, _ in bids.levels()] == [100, 99]
    side = Side(-1, 64)
    for price, size in ((99, 100), (99, 250), (98, 5), (99, 0), (97, 0)):
        side.apply(price, size)
    assert side.levels() == [[98, 5]]


def deltas(upto):
    rng = random.Random(9)
    return {s: (rng.choice(["bid", "ask"]), 100 + rng.randint(-5, 5) / 100, 0 if rng.random() < 0.25 else rng.randint(1, 500)) for s in range(1, upto + 1)}


def snapshot(stream, upto):
    builder = BookBuilder()
    builder.on_snapshot(0, [])
    for s in range(1, upto + 1):
        builder.on_delta(s, *stream[s])
    return [["bid", p, n] for p, n in builder.bids.levels()] + [["ask", p, n] for p, n in builder.asks.levels()]


def test_builder():
    stream = deltas(40)
    b = BookBuilder()
    b.on_delta(1, "bid", 99, 5)
    b.on_snapshot(0, [])
    assert (b.live, b.expected, b.bids.levels()) == (True, 2, [[99, 5]])

    b = BookBuilder()
    b.on_snapshot(0, [])
    for s in [*range(1, 21), *range(23, 41)]:
        b.on_delta(s, *stream[s])
    b.on_snapshot(22, snapshot(stream, 22))
    whole = BookBuilder()
    whole.on_snapshot(0, [])
    for s in range(1, 41):
        whole.on_delta(s, *stream[s])
    assert (b.live, b.stats["recovered"], b.expected) == (True, 2, 41)
    assert (b.bids.levels(), b.asks.levels()) == (whole.bids.levels(), whole.asks.levels())

    b = BookBuilder()
    b.on_snapshot(0, [])
    for s in [*range(1, 21), 23, 24, 25, 30]:
        b.on_delta(s, *stream[s])
    b.on_snapshot(22, snapshot(stream, 22))
    assert (b.live, b.stats["snapshot_too_old"]) == (False, 1)
    b.on_snapshot(29, snapshot(stream, 29))
    assert (b.live, b.expected) == (True, 31)

    b = BookBuilder()
    b.on_snapshot(0, [])
    for s in range(1, 21):
        b.on_delta(s, *stream[s])
    b.on_snapshot(10, snapshot(stream, 10))
    b.on_delta(21, *stream[21])
    assert (b.expected, b.stats["gaps"]) == (22, 0)
    b.on_delta(3, *stream[3])
    assert (b.stats["stale_dropped"], b.expected) == (1, 22)


def test_top_of_book(spark):
    rows = [("I", k + 1, s, p, n) for k, (s, p, n) in enumerate([("bid", 99.0, 100), ("bid", 99.5, 200), ("bid", 98.5, 300), ("ask", 100.5, 100), ("ask", 100.0, 200), ("ask", 101.0, 300)])]
    frame = spark.createDataFrame(rows, "instrument string, seq long, side string, price double, new_size long")
    top = book.top_of_book(book.levels_at(frame)).first()
    assert (top.bid, top.ask, top.spread, top.bid_size, top.crossed) == (99.5, 100.0, 0.5, 200, 0)
    more = spark.createDataFrame([("I", 7, "ask", 99.5, 1)], frame.schema)
    assert book.top_of_book(book.levels_at(frame.union(more))).first().crossed == 1


def test_registered_books_read_all_deltas(spark):
    d = "/root/testdata/sf0.01"
    found = catalogue.queries()
    last = {}
    rows = adapters.book_deltas(spark, d).orderBy("instrument", "seq").collect()
    for r in rows:
        last[r.instrument, r.side, r.price] = r.new_size
    want = []
    for instrument, side in {(i, s) for i, s, _ in last}:
        prices = sorted((p for (i, s, p), n in last.items() if (i, s) == (instrument, side) and n > 0), reverse=side == "bid")
        want += [(instrument, side, k + 1, p, last[instrument, side, p]) for k, p in enumerate(prices[:10])]
    assert sorted(map(tuple, found["book_levels"](spark, d).collect())) == sorted(want)
    best = {r.instrument: (r.best_bid, r.best_ask) for r in found["book_builder"](spark, d).collect()}
    assert {r.instrument: (r.bid, r.ask) for r in found["top_of_book"](spark, d).collect()} == best
    # The form as of a number still cuts where it is asked to.
    early = book.levels_at(adapters.book_deltas(spark, d), 150)
    assert sorted(map(tuple, early.collect())) != sorted(want)
