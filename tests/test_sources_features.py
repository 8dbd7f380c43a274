import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.functions.scalars import backoff_ceiling, parse_rfc3339_ns
from tickforge.operators import anomaly, backtest, features, feed, generators, reports, validate
from tickforge.schema import FEATURES, TAPE, TAPE_COLUMNS
from tickforge.sources import frames, packets, replay

# Frames as the wire protocol's documentation shows them, which pin field names, types and times.
FRAMES = [
    '[{"T":"success","msg":"connected"}]',
    '[{"T":"subscription","trades":["AAPL"]}]',
    '[{"T":"t","i":96921,"S":"AAPL","x":"V","p":144.5,"s":25,"c":["@","I"],"z":"C","t":"2022-01-12T19:46:00.000000000Z"}]',
    '[{"T":"b","S":"AAPL","o":175.6,"h":175.8,"l":175.5,"c":175.7,"v":1234,"t":"2022-01-12T19:30:00.000000000Z","n":50,"vw":175.65}]',
    '[{"T":"q","S":"AAPL","bx":"V","bp":144.50,"bs":2,"ax":"W","ap":144.60,"as":7,"z":"C","t":"2022-01-12T19:46:00.000000000Z"}]',
    '[{"T":"error","code":402,"msg":"auth failed"}]',
    '[{"T":"someNewType","foo":"bar"}, 3, {"x":1}]',
    "not json at all",
    '[{"T":"t","S":"LONGSYMBOL","p":"1.5","s":-1,"i":25.7,"x":5,"t":"oops"}]',
    "[]",
]


def test_frames(spark):
    parsed = frames.messages(spark.createDataFrame(list(enumerate(FRAMES)), "frame_ix int, frame string"))
    classes = {(r.frame_ix, r.msg_class, r.msg) for r in parsed.select("frame_ix", "msg_class", "msg").collect()}
    assert {(0, "success", "connected"), (1, "subscription", None), (5, "error", "auth failed"), (6, "unknown", "someNewType"), (6, "unknown", "<not an object>"), (6, "unknown", "<missing T>"), (7, "reject", "frame is not a JSON array")} <= classes
    rows = {r.frame_ix: r for r in frames.market_rows(parsed).collect()}
    assert (rows[2].ts_ns, rows[2].trade_id, rows[2].price, rows[2].size, rows[2].exchange, rows[2].tape) == (1642016760000000000, 96921, 144.5, 25, "V", "C")
    assert (rows[3].ts_ns, rows[3].volume, rows[3].trade_count, rows[3].vwap) == (1642015800000000000, 1234, 50, 175.65)
    assert (rows[4].bid_size, rows[4].ask_size, rows[4].bid_price, rows[4].ask_exchange) == (2, 7, 144.5, "W")
    assert (rows[8].symbol, rows[8].price, rows[8].size, rows[8].trade_id, rows[8].exchange, rows[8].ts_ns) == ("LONGSYMB", 0.0, 0, 0, None, None)


def test_frame_order(spark):
    at = '"t":"2031-02-03T04:05:06Z"'
    frame = f'[{{"T":"b","S":"A",{at}}},{{"T":"q","S":"A",{at}}},{{"T":"t","S":"A","t":"oops"}},{{"T":"t","S":"A",{at}}},{{"T":"t","S":"",{at}}}]'
    tape = frames.to_tape(frames.market_rows(frames.messages(spark.createDataFrame([(0, frame)], "frame_ix int, frame string"))))
    assert [(r.kind, r.seq) for r in tape.orderBy("seq").collect()] == [("trade", 1), ("quote", 2), ("bar", 3)]


def test_timestamps(spark):
    given = {"1970-01-01T00:00:00.000000001Z": 1, "1970-01-01T00:00:00.123Z": 123000000, "1970-01-01T00:00:00.000123Z": 123000, "1970-01-01T00:00:00Z": 0, "": 0, "1970-01-01T00:00:00.1234567899Z": 123456789, "1970-01-01T00:00:00": None, "not a timestamp": None}
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", parse_rfc3339_ns(F.col("t")).alias("ns")).collect()
    assert {r.t: r.ns for r in rows} == given


def test_backoff(spark):
    rows = spark.range(40).select("id", backoff_ceiling(F.lit(100), F.col("id"), F.lit(2000)).alias("c")).collect()
    assert [r.c for r in rows][:6] == [100, 200, 400, 800, 1600, 2000]
    assert rows[39].c == 2000


def tape_of(spark, rows):
    return spark.createDataFrame([tuple((dict.fromkeys(TAPE_COLUMNS) | r | {"arrival_ix": k}).values()) for k, r in enumerate(rows)], TAPE)


def test_replay(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    rows = [
        {"kind": "trade", "symbol": "AAPL", "ts_ns": 1000, "seq": 1, "trade_id": 7, "price": 100.5, "size": 10, "exchange": "V", "tape": "C"},
        {"kind": "quote", "symbol": "AAPL", "ts_ns": 2000, "seq": 2, "bid_price": 100.0, "ask_price": 100.5, "bid_size": 1, "ask_size": 2, "bid_exchange": "V", "ask_exchange": "W", "tape": "C"},
        {"kind": "bar", "symbol": "MSFT", "ts_ns": 3000, "seq": 1, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "vwap": 1.2, "volume": 10, "trade_count": 3},
    ]
    tape = tape_of(spark, rows)
    replay.write_replay(tape, path)
    assert struct.unpack("<IIQ", open(path, "rb").read(16)) == (0x564C484F, 2, 3)
    assert open(path, "rb").seek(0, 2) == 16 + 3 * 88
    back = replay.read_replay(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tape.collect()))
    body = open(path, "rb").read()
    bad = {"short": (b"", "too short"), "magic": (struct.pack("<IIQ", 0xDEADBEEF, 2, 0), "bad magic"), "count": (struct.pack("<IIQ", replay.MAGIC, 2, 200000) + body[16:192], "stride mismatch"), "huge": (struct.pack("<IIQ", replay.MAGIC, 2, 2**64 - 1) + body[16:], "stride mismatch"), "stride": (struct.pack("<IIQ", replay.MAGIC, 2, 0) + b"x" * 50, "stride mismatch")}
    for name, (raw, why) in bad.items():
        wrong = tmp_path / name
        wrong.write_bytes(raw)
        with pytest.raises(ValueError, match=why):
            replay.count_records(str(wrong))
    trailing = tmp_path / "trailing"
    trailing.write_bytes(body + b"zz")
    assert replay.count_records(str(trailing), strict=False) == 3


def bars(spark, closes, times, symbol="TEST"):
    rows = [(symbol, s, k, c, c * 1.001, c * 0.999, c, c, 1000, 10) for k, (c, s) in enumerate(zip(closes, times, strict=True))]
    return spark.createDataFrame(rows, "symbol string, start_ns long, arrival_ix long, open double, high double, low double, close double, vwap double, volume long, trade_count long")


MINUTE = 60_000_000_000


def test_returns_and_sessions(spark):
    times = [0, MINUTE, 2 * MINUTE, 1022 * MINUTE, 1023 * MINUTE]
    got = [r.log_return for r in features.features(bars(spark, [100.0, 100.0, 100.0, 105.0, 105.5], times)).orderBy("start_ns").collect()]
    assert got[0] == got[3] == 0
    assert got[4] == pytest.approx(np.log(105.5 / 105), abs=1e-12)
    got = [r.log_return for r in features.features(bars(spark, [100.0, 101.0], [0, 2 * MINUTE])).orderBy("start_ns").collect()]
    assert got[1] == pytest.approx(np.log(1.01))
    forward = features.forward_returns(bars(spark, [100.0, 110.0, 99.0], [0, MINUTE, 2 * MINUTE])).orderBy("start_ns").collect()
    assert [r.forward_return for r in forward] == pytest.approx([0.1, -0.1])


def test_split_and_leakage(spark):
    rows = bars(spark, [100.0] * 100, [k * MINUTE for k in range(100)])
    split = features.time_split(rows)
    assert {r.fold: r["count"] for r in split.groupBy("fold").count().collect()} == {"fit": 40, "calibrate": 20, "test": 40}
    features.assert_no_leakage(split)
    moved = split.withColumn("fold", F.when(F.col("arrival_ix") == 99, "fit").otherwise(F.col("fold")))
    with pytest.raises(ValueError, match="leakage"):
        features.assert_no_leakage(moved)


def test_environment(spark):
    def run(returns, actions, cost, risk=0.0):
        rows = [("S", k, k, "p", cost, a, f) for k, (a, f) in enumerate(zip(actions, returns, strict=True))]
        steps = spark.createDataFrame(rows, "symbol string, start_ns long, arrival_ix long, policy string, cost double, action int, forward_return double")
        backtest.check_actions(steps)
        return backtest.step(steps, risk)

    steps = run([0.1, -0.2, 0.05], [1, -1, 0], 0.01)
    assert [r.pnl for r in steps.orderBy("start_ns").collect()] == pytest.approx([0.09, 0.18, -0.01])
    assert backtest.episodes(steps).first().pnl == pytest.approx(0.26)
    assert [r.pnl for r in run([0.1, 0.1], [1, 1], 0.05).orderBy("start_ns").collect()] == pytest.approx([0.05, 0.1])
    risky = run([0.1], [1], 0.0, 1.0).first()
    assert (risky.pnl, risky.reward) == pytest.approx((0.1, 0.09))
    flat = backtest.episodes(run([0.1, -0.3], [0, 0], 0.01)).first()
    assert (flat.pnl, flat.sharpe, flat.max_drawdown, flat.trades) == (0, 0, 0, 0)
    with pytest.raises(ValueError, match="action"):
        run([0.1], [2], 0.0)


def test_auc_and_metrics(spark):
    rows = spark.createDataFrame([(0.1, 0, 0), (0.4, 0, 0), (0.35, 1, 0), (0.8, 1, 1)], "score double, label int, is_anomaly int")
    assert anomaly.auc(rows).first().auc == 0.75
    assert np.isnan(anomaly.auc(rows.where("label = 0")).first().auc)
    got = anomaly.confusion(rows).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall) == (1, 0, 1, 2, 1.0, 0.5)
    assert anomaly.confusion(rows.limit(0)).first().f1 == 0
    assert anomaly.calibrated_threshold(rows.limit(0)).first().threshold == float("inf")
    three = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "score double")
    assert anomaly.calibrated_threshold(three).first().threshold == pytest.approx(2.9)


def test_ladder(spark):
    made = generators.joint_anomaly_bars(spark, 900, 1)
    rows = features.time_split(features.features(made).join(made.select("symbol", "start_ns", "label"), ["symbol", "start_ns"]))
    got = {r.rung: r.auc for r in anomaly.ladder(made, rows).collect()}
    assert got["autoencoder"] > 0.8 > got["robust_z"]


def test_synthetic_tape(spark):
    tape = generators.synthetic_tape(spark, 600, 8)
    counts = reports.tallies(validate.validate(tape)).first()
    assert counts.n_bars == 600 and counts.n_quotes == 1200 and 8 * 600 <= counts.n_trades <= 12 * 600
    for name in ("seq_gaps", "crossed_quotes", "locked_quotes", "volume_mismatches", "count_mismatches", "vwap_mismatches"):
        assert 0 < counts[name] < 30
    assert counts.lost_messages == 3 * counts.seq_gaps
    assert set(FEATURES) <= set(features.features(validate.bars_from_trades(tape).withColumns({"start_ns": F.col("bar_window") * MINUTE, "arrival_ix": F.col("bar_window")})).columns)


def test_packets(spark):
    """Datagrams of the right length come back with number, line and record; others go."""
    trade = bytearray(88)
    struct.pack_into("<B7x8sQQQdQ", trade, 0, 0, b"OAK", 1000, 7, 42, 12.5, 9)
    unknown = bytes([9]) + bytes(87)
    rows = [(1, 300, "A", bytes(trade)), (2, 1 << 40, "B", bytes(trade)), (3, 5, "A", unknown), (4, 6, "A", bytes(80))]
    sent = packets.encode(spark.createDataFrame(rows, "arrival_ix long, seq long, line string, body binary"))
    odd = spark.createDataFrame([(5, bytes(104)[:103]), (6, None), (7, bytes(8) + b"\x05" + bytes(95))], "arrival_ix long, packet binary")
    got = packets.decode(sent.unionByName(odd)).orderBy("arrival_ix").collect()
    assert [(r.arrival_ix, r.seq, r.line) for r in got] == [(1, 300, "A"), (2, 1 << 40, "B")]
    assert [(r.record.kind, r.record.symbol, r.record.ts_ns, r.record.seq, r.record.price, r.record["size"]) for r in got] == [("trade", "OAK", 1000, 7, 12.5, 9)] * 2
    assert packets.decode(sent.limit(0)).count() == 0


def test_feed_blocks(spark, monkeypatch):
    """Gaps across blocks of numbers, empty blocks among them, are those of one window."""
    rows = [("X", s, line, s * 2 + k, s) for s in (1, 2, 5, 9, 10, 31, 32, 70) for k, line in enumerate("AB") if (s + k) % 5]
    frame = spark.createDataFrame(rows, "feed string, seq long, line string, arrival_ix long, payload long")
    expected = sorted(map(tuple, feed.delivered(frame).collect()))
    monkeypatch.setattr(feed, "BLOCK", 4)
    assert sorted(map(tuple, feed.delivered(frame).collect())) == expected
    assert sum(r[4] for r in expected) == 70 - len(expected)


def test_robust_deviation():
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=300), 1)
    got = features.robust_deviation(values, 60)
    for k in range(300):
        frame = values[max(0, k - 59) : k + 1]
        scale = 1.4826 * np.median(np.abs(frame - np.median(frame)))
        assert got[k] == pytest.approx((values[k] - np.median(frame)) / scale if scale > 0 else 0.0)
