"""Literal vectors for the validator. Rows are applied in order to fresh state."""

import pytest
from pyspark.sql import functions as F

from tickforge import schema as S
from tickforge.operators import reports, validate
from tickforge.schema import TAPE, TAPE_COLUMNS


def t(seq, ts, price=100.0, size=10, symbol="AAPL"):
    return {"kind": "trade", "symbol": symbol, "seq": seq, "ts_ns": ts, "price": float(price), "size": size}


def b(seq, ts, volume=500, count=5, o=100.0, h=101.0, l=99.0, c=100.5, vwap=100.2, symbol="AAPL"):  # noqa: E741
    return {"kind": "bar", "symbol": symbol, "seq": seq, "ts_ns": ts, "open": float(o), "high": float(h), "low": float(l), "close": float(c), "vwap": float(vwap), "volume": volume, "trade_count": count}


def q(seq, ts, bid=100.0, ask=100.5, bs=5, as_=5, symbol="AAPL"):
    return {"kind": "quote", "symbol": symbol, "seq": seq, "ts_ns": ts, "bid_price": float(bid), "ask_price": float(ask), "bid_size": bs, "ask_size": as_}


window = [t(1, 1000, 100, 10), t(2, 2000, 102, 20), t(3, 3000, 101, 30)]


def closing(volume=60, count=3, h=102, vwap=6070 / 60):
    return b(4, 4000, volume, count, 100, h, 100, 101, vwap)


#: name: rows, {row: (bits that are set, bits that are not)}, gap of the last row or None
CASES = {
    "clean trade": ([t(1, 1000)], {0: (0, ~0)}, 0),
    "zero price": ([t(1, 1000, 0)], {0: (1 << 6, 1 << 7)}, None),
    "nan price": ([t(1, 1000, float("nan"))], {0: (1 << 6, 1 << 7)}, None),
    "zero size": ([t(1, 1000, 100, 0)], {0: (1 << 7, 1 << 6)}, None),
    "inverted band": ([b(1, 1000, l=200)], {0: (0b1111, 0)}, None),
    "nan low": ([b(1, 1000, l=float("nan"))], {0: (0, 0b1111)}, None),
    "close above high": ([b(1, 1000, c=105)], {0: (1 << 2, 0b1011)}, None),
    "vwap out": ([b(1, 1000, vwap=50)], {0: (1 << 3, 0b111)}, None),
    "volume without trades": ([b(1, 1000, count=0)], {0: (1 << 5, 0b11111)}, None),
    "ts regression": ([t(1, 5000), t(2, 4000)], {1: (1 << 8, 1 << 9)}, None),
    "per-stream clock": ([t(1, 9000), b(2, 4000), t(3, 8000)], {1: (0, 1 << 8), 2: (1 << 8, 0)}, None),
    "gap": ([t(10, 1000), t(14, 2000)], {1: (1 << 9, 1 << 8)}, 3),
    "gap across kinds": ([t(1, 1000), q(5, 2000)], {1: (1 << 9, 0)}, 3),
    "lower seq rewinds": ([t(10, 1000), t(3, 2000), t(5, 3000)], {1: (0, 1 << 9), 2: (1 << 9, 0)}, 1),
    "symbols apart": ([t(1, 1000), t(1, 1000, symbol="MSFT"), t(2, 2000), t(2, 2000, symbol="MSFT")], {k: (0, ~0) for k in range(4)}, 0),
    "canonical window": ([*window, closing()], {3: (0, ~0)}, None),
    "volume off": ([*window, closing(volume=61)], {3: (1 << 10, 1 << 12 | 1 << 13)}, None),
    "count off": ([*window, closing(count=4)], {3: (1 << 11, 1 << 10)}, None),
    "vwap off": ([*window, closing(vwap=100.5)], {3: (1 << 12, 1 << 3)}, None),
    "high off": ([*window, closing(h=103)], {3: (1 << 13, 1 << 10)}, None),
    "vwap rounds": ([*window, closing(vwap=101.1667)], {3: (0, 1 << 12)}, None),
    "vwap rounds too far": ([*window, closing(vwap=101.17)], {3: (1 << 12, 0)}, None),
    "reset": ([t(1, 1000, 100, 10), b(2, 2000, 10, 1, 100, 100, 100, 100, 100), t(3, 3000, 200, 5), b(4, 4000, 5, 1, 200, 200, 200, 200, 200)], {1: (0, ~0), 3: (0, 0b1111 << 10)}, None),
    "invalid trade left out": ([t(1, 1000, 100, 10), t(2, 2000, -1, 10), b(3, 3000, 10, 1, 100, 100, 100, 100, 100)], {2: (0, 0b1111 << 10)}, None),
    "no trades": ([b(1, 1000)], {0: (0, ~0)}, None),
    "crossed": ([q(1, 1000, 101, 100)], {0: (1 << 14, 1 << 15)}, None),
    "locked": ([q(1, 1000, 100, 100)], {0: (1 << 15, 1 << 14)}, None),
    "quote non-positive": ([q(1, 1000, 0)], {0: (1 << 16, 1 << 17)}, None),
    "quote zero size": ([q(1, 1000, bs=0)], {0: (1 << 17, 1 << 16)}, None),
    "drift": ([t(k, 1000 * k, 100 * 1.01**k) for k in range(1, 51)], {k: (0, 1 << 18) for k in range(50)}, None),
    "spike": ([t(1, 1000, 100), t(2, 2000, 101), t(3, 3000, 160)], {2: (1 << 18, 0)}, None),
    "not poisoned": ([t(1, 1000, 100), t(2, 2000, 160), t(3, 3000, 100)], {2: (0, 1 << 18)}, None),
    "first trade": ([t(1, 1000, 9999)], {0: (0, 1 << 18)}, None),
    "quote mid": ([t(1, 1000, 100), q(2, 2000, 155, 165)], {1: (1 << 18, 0)}, None),
    "re-anchor": ([*(t(k, 1000 * k, 100) for k in range(1, 6)), *(t(k, 1000 * k, 120) for k in range(6, 9)), t(9, 9000, 120.5)], {5: (1 << 18, 0), 7: (1 << 18, 0), 8: (0, 1 << 18)}, None),
}


@pytest.fixture(scope="module")
def flagged(spark):
    """All cases in one tape, each under symbols of its own."""
    rows = []
    for n, (records, _, _) in enumerate(CASES.values()):
        for k, r in enumerate(records):
            full = dict.fromkeys(TAPE_COLUMNS) | r | {"symbol": f"{n}{r['symbol']}", "arrival_ix": n * 1000 + k}
            rows.append(tuple(full.values()))
    out = validate.validate(spark.createDataFrame(rows, TAPE)).select("arrival_ix", "flags", "gap").collect()
    return {r.arrival_ix: (r.flags, r.gap) for r in out}


@pytest.mark.parametrize("name", list(CASES))
def test_vector(flagged, name):
    n = list(CASES).index(name)
    rows, expected, gap = CASES[name]
    for k, (on, off) in expected.items():
        flags = flagged[n * 1000 + k][0]
        assert flags & on == on
        assert flags & off & ~on & (1 << 19) - 1 == 0
    if gap is not None:
        assert flagged[n * 1000 + len(rows) - 1][1] == gap


def test_surfaced_and_log(spark):
    rows = spark.createDataFrame([("trade", "AAPL", 1_700_000_000_123_456_789, 5, 1 << 6 | 1 << 8), ("bar", "AAPL", 1, 6, 1 << 9 | 1 << 12)], "kind string, symbol string, ts_ns long, seq long, flags int")
    assert [r.value for r in reports.violation_log(rows).collect()] == ['{"checks":["trade non-positive price"],"kind":"trade","seq":5,"symbol":"AAPL","ts":"1700000000123456789"}']
    assert S.SURFACED & (1 << 8 | 1 << 9 | 0b1111 << 10) == 0


def test_histogram(spark):
    ns = spark.range(1, 1001).select(F.col("id").alias("ns"))
    assert {r.p: r.ns for r in reports.percentiles(ns, 2000, [0.5, 0.99]).collect()} == {0.5: 500, 0.99: 990}
    two = spark.createDataFrame([(50,), (1_000_000,)], "ns long")
    got = reports.latency_summary(two, 100).first()
    assert (got.n, got.overflow, got.most) == (2, 1, 1_000_000)
    assert {r.ns for r in reports.percentiles(two.limit(0), 100, [0.5]).collect()} == {0}


def test_empty_tape(spark):
    empty = spark.createDataFrame([], TAPE)
    assert validate.validate(empty).count() == 0
    assert reports.tallies(validate.validate(empty)).first().n_trades == 0
