"""JSON frames of a live feed as rows: typed fields with defaults, acknowledgements, errors, unknown messages.

A frame is a JSON array of messages. Fields that are missing or of another type take "", 0.0 or 0. A timestamp that
cannot be read rejects its message, not the whole frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_char, parse_rfc3339_ns, wire_symbol
from ..schema import TAPE_COLUMNS


def kind_of(name: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get(value, '$.{name}', 'variant'))")


def text(name: str) -> Column:
    return F.when(kind_of(name) == "STRING", F.expr(f"try_variant_get(value, '$.{name}', 'string')")).otherwise(F.lit(""))


def number(name: str) -> Column:
    kind = kind_of(name)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.expr(f"try_variant_get(value, '$.{name}', 'double')")).otherwise(F.lit(0.0))


def count(name: str) -> Column:
    """An integer of 0 or more; anything else is 0."""
    return F.when(kind_of(name) == "BIGINT", F.greatest(F.expr(f"try_variant_get(value, '$.{name}', 'bigint')"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def messages(frames: DataFrame) -> DataFrame:
    """frame_ix, pos, msg_class, msg, value for each message of frames (frame_ix, frame).

    msg_class: trade, quote, bar, success, subscription, error, unknown, or reject for a frame that is no JSON array
    (pos null). msg: the message of success and error, and what was unknown.
    """
    parsed = frames.select("frame_ix", F.expr("try_parse_json(frame)").alias("v")).withColumn("ok", F.coalesce(F.expr("schema_of_variant(v)").startswith("ARRAY"), F.lit(False)))
    spark = frames.sparkSession
    each = parsed.where("ok").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("frame_ix", "pos", "value")
    is_object = F.expr("schema_of_variant(value)").startswith("OBJECT")
    kind = F.when(~is_object, F.lit("<not an object>")).when(kind_of("T") == "STRING", F.expr("try_variant_get(value, '$.T', 'string')")).otherwise("<missing T>")
    names = F.create_map(*(F.lit(x) for x in ("t", "trade", "q", "quote", "b", "bar", "success", "success", "subscription", "subscription", "error", "error")))
    classed = each.withColumn("_t", kind).withColumn("msg_class", F.coalesce(names[F.col("_t")], F.lit("unknown")))
    msg = F.when(F.col("msg_class").isin("success", "error"), text("msg")).when(F.col("msg_class") == "unknown", F.col("_t"))
    found = classed.select("frame_ix", "pos", "msg_class", msg.alias("msg"), "value")
    rejected = parsed.where("not ok").select("frame_ix", F.lit(None).cast("int").alias("pos"), F.lit("reject").alias("msg_class"), F.lit("frame is not a JSON array").alias("msg"), F.lit(None).cast("variant").alias("value"))
    return found.unionByName(rejected)


def live(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Frames that a collector lands in a folder, one to a line, as a stream (frame_ix, frame) that messages() reads.

    frame_ix is the time at which the frame's file was landed, in milliseconds, times 2 ** 20, and a hash of the frame
    below that: a frame keeps it when the stream is restarted, since the checkpoint remembers the files read.
    """
    lines = spark.readStream.options(**options).text(folder).select("value", F.unix_millis("_metadata.file_modification_time").alias("landed"))
    return lines.select((F.col("landed") * (1 << 20) + F.pmod(F.xxhash64("value"), F.lit(1 << 20))).alias("frame_ix"), F.col("value").alias("frame"))


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Frames that come over a TCP connection, one to a line, as live() gives them. What was sent before a restart is lost."""
    lines = spark.readStream.format("socket").options(host=host, port=str(port), includeTimestamp="true").load()
    return lines.select((F.unix_millis("timestamp") * (1 << 20) + F.pmod(F.xxhash64("value"), F.lit(1 << 20))).alias("frame_ix"), F.col("value").alias("frame"))


def market_rows(parsed: DataFrame) -> DataFrame:
    """frame_ix, pos and the tape's columns of trades, quotes and bars, without arrival_ix and seq; ts_ns is null where malformed."""
    when = lambda kind, column: F.when(F.col("msg_class") == kind, column)
    rows = parsed.where(F.col("msg_class").isin("trade", "quote", "bar"))
    return rows.select(
        "frame_ix", "pos", F.col("msg_class").alias("kind"), wire_symbol(text("S")).alias("symbol"), parse_rfc3339_ns(text("t")).alias("ts_ns"),
        when("trade", count("i")).alias("trade_id"), when("trade", number("p")).alias("price"), when("trade", count("s")).alias("size"), when("trade", first_char(text("x"))).alias("exchange"),
        F.when(F.col("msg_class") != "bar", first_char(text("z"))).alias("tape"),
        when("quote", number("bp")).alias("bid_price"), when("quote", number("ap")).alias("ask_price"), when("quote", count("bs")).alias("bid_size"), when("quote", count("as")).alias("ask_size"),
        when("quote", first_char(text("bx"))).alias("bid_exchange"), when("quote", first_char(text("ax"))).alias("ask_exchange"),
        when("bar", number("o")).alias("open"), when("bar", number("h")).alias("high"), when("bar", number("l")).alias("low"), when("bar", number("c")).alias("close"), when("bar", number("vw")).alias("vwap"),
        when("bar", count("v")).alias("volume"), when("bar", count("n")).alias("trade_count"),
    )


def to_tape(rows: DataFrame) -> DataFrame:
    """The tape of market rows: within a frame trades, then quotes, then bars; numbered by symbol. Rows without a symbol
    or a readable timestamp go, before numbers are given.

    arrival_ix is built from frame, kind and place, so no window spans all symbols.
    """
    rank = "case kind when 'trade' then 0 when 'quote' then 1 else 2 end"
    kept = rows.where("symbol <> '' and ts_ns is not null").withColumn("arrival_ix", F.expr(f"cast(frame_ix as long) * 4194304 + {rank} * 1048576 + pos"))
    numbered = kept.withColumn("seq", F.expr("cast(row_number() over (partition by symbol order by arrival_ix) as long)"))
    return numbered.select(*(F.col(c).cast(k).alias(c) for c, k in TAPE_COLUMNS.items()))


def acknowledgements(parsed: DataFrame) -> DataFrame:
    """frame_ix, connected, authenticated, subscribed (1 or 0), errors and unknown (sorted lists)."""
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("msg_class") == kind, F.col("msg"))))
    success = F.col("msg_class") == "success"
    return parsed.groupBy("frame_ix").agg(flag(success & (F.col("msg") == "connected")).alias("connected"), flag(success & (F.col("msg") == "authenticated")).alias("authenticated"), flag(F.col("msg_class") == "subscription").alias("subscribed"), of("error").alias("errors"), of("unknown").alias("unknown"))


def history_bars(pages: DataFrame) -> DataFrame:
    """Bars of saved REST pages (a column page with {"bars": {symbol: [bar, ...]}}), numbered from 1 in time for each symbol."""
    bar = "struct<t:string,o:double,h:double,l:double,c:double,vw:double,v:bigint,n:bigint>"
    each = pages.select(F.explode(F.from_json("page", f"bars map<string,array<{bar}>>")["bars"]).alias("symbol", "bars")).select("symbol", F.explode("bars").alias("b"))
    rows = each.select(wire_symbol(F.col("symbol")).alias("symbol"), parse_rfc3339_ns(F.col("b.t")).alias("start_ns"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.vw").alias("vwap"), F.col("b.v").alias("volume"), F.col("b.n").alias("trade_count"))
    return make_bars(rows)


def make_bars(rows: DataFrame, first: int = 1) -> DataFrame:
    """rows (symbol, start_ns, prices, volume, trade_count) with seq from first on in time for each symbol."""
    return rows.withColumn("seq", F.expr(f"cast(row_number() over (partition by symbol order by start_ns) + {first - 1} as long)"))
