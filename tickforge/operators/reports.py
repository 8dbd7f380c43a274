"""Reports over validated records: tallies, live summary, violation log, checksum, latency histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import describe, labels


def has(mask: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(mask)) != 0


def tallies(validated: DataFrame) -> DataFrame:
    """One row: records of each kind, and how many carry each class of violation."""
    count = lambda c: F.count_if(c)
    kinds = [count(F.col("kind") == k).alias(f"n_{k}s") for k in ("trade", "quote", "bar")]
    classes = {
        "bad_trades": S.BAD_TRADE, "bad_bars": S.BAD_BAR, "ts_regressions": S.TIMESTAMP_REGRESSION, "seq_gaps": S.SEQUENCE_GAP,
        "volume_mismatches": S.VOLUME_MISMATCH, "count_mismatches": S.COUNT_MISMATCH, "vwap_mismatches": S.VWAP_MISMATCH, "ohlc_mismatches": S.OHLC_MISMATCH,
        "crossed_quotes": S.QUOTE_CROSSED, "locked_quotes": S.QUOTE_LOCKED, "non_positive_quotes": S.QUOTE_NON_POSITIVE, "zero_size_quotes": S.QUOTE_ZERO_SIZE, "band_breaches": S.PRICE_BAND_BREACH,
    }
    return validated.agg(*kinds, *(count(has(m)).alias(n) for n, m in classes.items()), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("lost_messages"))


def checksum(validated: DataFrame) -> DataFrame:
    """Order-independent digest of a run: records, records with any bit, and the sum of all masks."""
    return validated.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("flags") != 0).alias("violations"), F.coalesce(F.sum("flags"), F.lit(0)).cast("long").alias("checksum"))


def live_summary(validated: DataFrame) -> DataFrame:
    """label, n: how often each surfaced label occurs."""
    return validated.select(F.explode(labels(F.col("flags"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def surfaced(validated: DataFrame) -> DataFrame:
    """Records that carry a surfaced bit, with their description."""
    return validated.where(has(S.SURFACED)).select("kind", "symbol", "ts_ns", "seq", "flags", describe(F.col("flags")).alias("description"))


def violation_log(validated: DataFrame) -> DataFrame:
    """One JSON text for each surfaced record; keys in alphabetical order, ts as text since it exceeds a double's precision."""
    row = F.struct(labels(F.col("flags")).alias("checks"), "kind", "seq", "symbol", F.col("ts_ns").cast("string").alias("ts"))
    return validated.where(has(S.SURFACED)).select(F.to_json(row).alias("value"))


def write_violation_log(validated: DataFrame, path: str) -> None:
    violation_log(validated).write.mode("append").text(path)


def latency_histogram(ns: DataFrame, most: int) -> DataFrame:
    """ns, n: counts of each value up to most; larger ones count at most + 1."""
    return ns.select(F.least(F.col("ns"), F.lit(most + 1)).alias("ns")).groupBy("ns").agg(F.count(F.lit(1)).alias("n"))


def percentiles(ns: DataFrame, most: int, shares: list[float]) -> DataFrame:
    """p, ns: the smallest value whose running count reaches floor(p * count); most + 1 beyond the histogram, 0 if empty.

    The running count is over the histogram's values, which are bounded by most.
    """
    histogram = latency_histogram(ns, most)
    running = histogram.select("ns", F.expr("sum(n) over (order by ns)").alias("upto"), F.expr("sum(n) over ()").alias("total"))
    asked = [F.coalesce(F.min(F.when(F.col("upto") >= F.floor(F.lit(p) * F.col("total")), F.when(F.floor(F.lit(p) * F.col("total")) == 0, 0).otherwise(F.col("ns")))), F.lit(0)).cast("long").alias(f"q{k}") for k, p in enumerate(shares)]
    return running.agg(*asked).select(F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"q{k}").alias("ns")) for k, p in enumerate(shares)))).alias("x")).select("x.p", "x.ns")


def latency_summary(ns: DataFrame, most: int) -> DataFrame:
    return ns.agg(F.count("ns").alias("n"), F.sum("ns").alias("total"), F.min("ns").alias("least"), F.max("ns").alias("most"), F.count_if(F.col("ns") > most).alias("overflow"))


def multicore(seconds: DataFrame) -> DataFrame:
    """cores, seconds -> speedup and efficiency against one core."""
    base = F.expr("max(case when cores = 1 then seconds end) over ()")
    return seconds.select("cores", "seconds", (base / F.col("seconds")).alias("speedup"), (base / F.col("seconds") / F.col("cores")).alias("efficiency"))
