"""The streaming forms give what the batch gives on the same rows."""

import json
import time

from pyspark.sql import functions as F

from tickforge.operators import feed, validate
from tickforge.operators.feed import Arbitrator
from tickforge.operators.validate import BAND_COLUMNS, PriceBand
from tickforge.sources import adapters, frames
from tickforge.streaming import processors

SF = "/root/testdata/sf0.001"


def streamed(spark, frame, tmp_path, parts, order):
    """frame as files, read one to a trigger in order."""
    source = str(tmp_path / "in")
    n = frame.count()
    cuts = frame.withColumn("_p", F.expr(f"cast((row_number() over (order by {order}) - 1) * {parts} div {n} as int)"))
    for p in range(parts):
        cuts.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_price_band(spark, tmp_path):
    tape = adapters.tape(spark, SF).where("symbol < 'U3'")
    expected = {(r.symbol, r.arrival_ix): r.band_flag for r in validate.price_band(tape).collect()}
    source = streamed(spark, tape, tmp_path, 3, "arrival_ix")
    run(processors.stream_fold(source, "symbol", "arrival_ix", BAND_COLUMNS, PriceBand, "symbol string, arrival_ix long, band_flag int, reference double"), tmp_path, "band")
    assert {(r.symbol, r.arrival_ix): r.band_flag for r in spark.table("band").collect()} == expected


def test_arbitration(spark, tmp_path):
    packets = adapters.packets(spark, SF)
    expected = sorted((r.feed, r.seq, r.line) for r in feed.arbitrate(packets, 16).where("event = 'deliver'").collect())
    source = streamed(spark, packets, tmp_path, 3, "arrival_ix")
    fold = processors.stream_fold(source, "feed", "arrival_ix", ["arrival_ix", "seq", "line", "payload"], lambda: Arbitrator(16), "feed string, event string, seq long, line string, payload long, stats string", idle=2000)
    query = fold.writeStream.format("memory").queryName("arbitrated").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    feeds = len({f for f, _, _ in expected})
    try:  # what is held behind a gap at the end comes once the feed has been idle
        deadline = time.time() + 90
        while time.time() < deadline and spark.sql("select count(distinct feed) from arbitrated where event = 'stats'").first()[0] < feeds:
            time.sleep(1)
    finally:
        query.stop()
    got = sorted((r.feed, r.seq, r.line) for r in spark.sql("select * from arbitrated where event = 'deliver'").collect())
    assert got == expected


def test_live_frames(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    lines = ['[{"T":"t","S":"OAK","p":5.5,"s":3,"t":"2030-05-06T07:08:09Z"}]', '[{"T":"success","msg":"connected"}]', "no frame"]
    (folder / "a.txt").write_text("\n".join(lines))
    run(frames.messages(frames.live(spark, str(folder))).select("msg_class"), tmp_path, "live_messages")
    assert sorted(r.msg_class for r in spark.table("live_messages").collect()) == ["reject", "success", "trade"]


def test_tee(spark, tmp_path):
    rows = spark.createDataFrame([("trade", "A", 1, 1, 64), ("trade", "A", 2, 2, 0)], "kind string, symbol string, ts_ns long, seq long, flags int")
    rows.write.parquet(str(tmp_path / "v"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "v"))
    processors.tee(source, str(tmp_path / "log"), str(tmp_path / "capture"), str(tmp_path / "c")).awaitTermination()
    assert [json.loads(r.value)["seq"] for r in spark.read.text(str(tmp_path / "log")).collect()] == [1]
    assert spark.read.parquet(str(tmp_path / "capture")).count() == 2
