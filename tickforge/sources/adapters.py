"""Tables as tapes: the star schema's events as trades, quotes and bars with defects put in by modular rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TAPE_COLUMNS

DAY_NS = 86_400_000_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with symbol, us (microseconds), cents (10000 to 10399) and day."""
    cents = "10000 + cast(round(value * 100) as bigint) % 400"
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "user_id", "event_type", "value", "ts", "concat('U', user_id) as symbol", "unix_micros(cast(ts as timestamp)) as us", f"{cents} as cents", "unix_micros(cast(ts as timestamp)) div 86400000000 as day"
    )


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event a trade, every fifth also a quote; each symbol's day ends with the bar of its valid trades."""
    e = events(spark, sf_dir).selectExpr(
        "*",
        "case when event_id % 101 = 0 then -cents when event_id % 37 = 0 then cents * 16 div 10 else cents end as p",
        "case when event_id % 113 = 0 then 0 else 1 + event_id % 100 end as s",
        f"us * 1000 - case when event_id % 89 = 0 then {3 * DAY_NS} else 0 end as ns",
    )
    e = e.selectExpr("*", "p > 0 and s > 0 as ok")
    trades = e.selectExpr("event_id * 4 as arrival_ix", "'trade' as kind", "symbol", "ns as ts_ns", "event_id", "event_id as trade_id", "p / 100D as price", "s as size", "'V' as exchange", "'C' as tape")
    quotes = e.where("event_id % 5 = 0").selectExpr(
        "event_id * 4 + 1 as arrival_ix", "'quote' as kind", "symbol", "ns as ts_ns", "0L as event_id",
        "case when event_id % 65 = 0 then 0D when event_id % 55 = 0 then (cents + 9) / 100D else cents / 100D end as bid_price",
        "case when event_id % 35 = 0 then cents / 100D else (cents + 2) / 100D end as ask_price",
        "case when event_id % 85 = 0 then 0L else 3L end as bid_size", "5L as ask_size", "'V' as bid_exchange", "'W' as ask_exchange", "'C' as tape",
    )
    days = e.groupBy("symbol", "day").agg(
        F.max("event_id").alias("last"), F.expr("min_by(p, event_id) filter (where ok)").alias("o"), F.expr("max(p) filter (where ok)").alias("h"), F.expr("min(p) filter (where ok)").alias("l"),
        F.expr("max_by(p, event_id) filter (where ok)").alias("c"), F.expr("sum(p * s) filter (where ok)").alias("pv"), F.expr("sum(s) filter (where ok)").alias("v"), F.expr("count(1) filter (where ok)").alias("n"),
    )
    bars = days.where("n > 0").selectExpr(
        "last * 4 + 3 as arrival_ix", "'bar' as kind", "symbol", f"day * {DAY_NS} as ts_ns", "0L as event_id",
        "case when last % 29 = 0 then -1D else o / 100D end as open", "case when last % 17 = 0 then h / 100D + 5 else h / 100D end as high", "case when last % 19 = 0 then h / 100D + 50 else l / 100D end as low", "c / 100D as close",
        "cast(pv as double) / v / 100D * case when last % 13 = 0 then 1.001D else 1D end as vwap",
        "case when last % 23 = 0 then 0L when last % 7 = 0 then v + 100 else v end as volume", "case when last % 11 = 0 then n + 1 else n end as trade_count",
    )
    whole = trades.unionByName(quotes, allowMissingColumns=True).unionByName(bars, allowMissingColumns=True)
    over = "over (partition by symbol order by arrival_ix)"
    return whole.withColumn("seq", F.expr(f"cast(row_number() {over} + 3 * sum(case when kind = 'trade' and event_id % 97 = 0 then 1 else 0 end) {over} as long)")).select(*(F.col(c).cast(k).alias(c) for c, k in TAPE_COLUMNS.items()))


def minute_bars(spark: SparkSession, sf_dir: str, symbols: int = 50) -> DataFrame:
    """symbol, start_ns, arrival_ix and bar columns: every event a bar of one of some symbols, sessions of 50 bars an hour apart."""
    e = events(spark, sf_dir).selectExpr("*", f"concat('M', user_id % {symbols}) as m").selectExpr("*", "row_number() over (partition by m order by event_id) - 1 as k", "cents as c", "cents - event_id % 7 + 3 as o")
    return e.selectExpr(
        "m as symbol", "(1700000000 + 60L * k + 3600L * (k div 50)) * 1000000000 as start_ns", "event_id as arrival_ix", "o / 100D as open", "(greatest(o, c) + 5) / 100D as high", "(least(o, c) - 5) / 100D as low", "c / 100D as close",
        "(o + c + greatest(o, c) + least(o, c)) / 400D as vwap", "100 + (event_id * 37) % 1000 as volume", "1 + event_id % 20 as trade_count",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, seq, line, arrival_ix: events on two lines, each of which loses some; line B comes after A."""
    e = events(spark, sf_dir).selectExpr("event_type as feed", "event_id", "row_number() over (partition by event_type order by event_id) as seq")
    a = e.where("seq % 50 not in (5, 7)").selectExpr("feed", "cast(seq as long) as seq", "'A' as line", "event_id * 2 as arrival_ix", "event_id as payload")
    b = e.where("seq % 50 not in (7, 9)").selectExpr("feed", "cast(seq as long) as seq", "'B' as line", "event_id * 2 + 1 as arrival_ix", "event_id as payload")
    return a.unionByName(b)


def book_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, seq, side, price, new_size, arrival_ix: events as changes of price levels, a quarter of them removals."""
    return events(spark, sf_dir).selectExpr(
        "event_type as instrument", "cast(row_number() over (partition by event_type order by event_id) as long) as seq", "case when event_id % 2 = 0 then 'bid' else 'ask' end as side",
        "cast(case when event_id % 2 = 0 then 100 - cents % 20 else 100 + cents % 20 end as double) as price", "case when event_id % 4 >= 2 and event_id % 3 = 0 then 0L else 1 + event_id % 500 end as new_size", "event_id as arrival_ix",
    )
