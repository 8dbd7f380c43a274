"""Synthetic inputs from hashes of row numbers: a tape with isolated defects, bars with a joint anomaly, a lossy feed.

They keep the contract of such data (shapes, rates, one defect to a window), not any generator's stream of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TAPE_COLUMNS

SYMBOLS = ["ASH", "BIRCH", "CEDAR", "ELM", "FIR", "LARCH", "OAK", "PINE"]
DEFECTS = ["corrupt_trade", "seq_gap", "ts_regress", "volume", "count", "vwap", "ohlc", "band", "crossed", "locked", "spike"]
BASE_NS = 1_600_000_000_000_000_000


def draw(n: int, seed: int, salt: str, *keys: str) -> Column:
    """0 to n - 1 from a hash of the keys."""
    return F.expr(f"pmod(xxhash64({seed}, '{salt}', {', '.join(keys)}), {n})")


def unit(seed: int, salt: str, *keys: str) -> Column:
    """Above 0, at most 1."""
    return (draw(1 << 40, seed, salt, *keys) + 1) / float(1 << 40)


def normal(seed: int, salt: str, *keys: str) -> Column:
    return F.sqrt(-2 * F.log(unit(seed, salt + "r", *keys))) * F.cos(2 * 3.141592653589793 * unit(seed, salt + "a", *keys))


def symbol_name(ix: Column) -> Column:
    return F.when(ix < len(SYMBOLS), F.element_at(F.array(*(F.lit(s) for s in SYMBOLS)), (F.least(ix, F.lit(len(SYMBOLS) - 1)) + 1).cast("int"))).otherwise(F.format_string("S%05d", ix))


def synthetic_tape(spark: SparkSession, windows: int = 1000, symbols: int = 8, seed: int = 42) -> DataFrame:
    """A tape of windows, dealt to symbols in turn: 8 to 12 trades, 2 quotes, and the bar of the valid trades.

    One window in a hundred has each of the eleven DEFECTS.
    """
    w = spark.range(windows).select(F.col("id").alias("w"), (F.col("id") % symbols).alias("ix"), (8 + draw(5, seed, "n", "id")).cast("int").alias("n"), draw(100, seed, "defect", "id").alias("roll"))
    named = w.withColumns({"symbol": symbol_name(F.col("ix")), "defect": F.element_at(F.array(*(F.lit(d) for d in DEFECTS), F.lit("none")), (F.least("roll", F.lit(len(DEFECTS))) + 1).cast("int"))})
    slots = named.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") + 2))).withColumn("arrival_ix", F.col("w") * 16 + F.col("k"))
    kind = F.when(F.col("k") < F.col("n"), "trade").when(F.col("k") < F.col("n") + 2, "quote").otherwise("bar")
    by = "over (partition by symbol order by arrival_ix)"
    walk = slots.withColumn("kind", kind).withColumn("_step", F.when(F.col("kind") == "trade", (draw(41, seed, "step", "w", "k") - 20) / 100.0).otherwise(0.0))
    walk = walk.withColumns({"_px": F.greatest(F.lit(1.0), F.expr(f"100D + sum(_step) {by}")), "_row": F.expr(f"cast(row_number() {by} as long)"), "_jumps": F.expr(f"sum(case when k = 0 and defect = 'seq_gap' then 3 else 0 end) {by}")})
    first = "k = 0 and defect = "
    rows = walk.withColumns({
        "seq": F.col("_row") + F.col("_jumps"),
        "ts_ns": BASE_NS + F.col("_row") * 1_000_000 - F.expr(f"case when {first}'ts_regress' then 5000000 else 0 end"),
        "price": F.expr(f"case when kind = 'trade' then case when {first}'corrupt_trade' then -1D when {first}'spike' then _px * 1.6D else _px end end"),
        "size": F.when(F.col("kind") == "trade", 1 + draw(100, seed, "size", "w", "k")),
    })
    quote = "kind = 'quote'"
    hit = "kind = 'quote' and k = n and defect = "
    over = "over (partition by w)"
    ok = "kind = 'trade' and price > 0"
    total = {f"_{n}": F.expr(f"{e} {over}") for n, e in {"o": f"min_by(case when {ok} then price end, case when {ok} then k end)", "c": f"max_by(case when {ok} then price end, case when {ok} then k end)", "h": f"max(case when {ok} then price end)", "l": f"min(case when {ok} then price end)", "v": f"sum(case when {ok} then size end)", "pv": f"sum(case when {ok} then price * size end)", "m": f"count(case when {ok} then 1 end)"}.items()}
    whole = rows.withColumns(total).withColumns({
        "trade_id": F.expr("case when kind = 'trade' then arrival_ix end"), "exchange": F.expr("case when kind = 'trade' then 'V' end"), "tape": F.expr("case when kind <> 'bar' then 'C' end"),
        "bid_price": F.expr(f"case when {hit}'crossed' then _px + 0.05D when {hit}'locked' then _px when {quote} then _px - 0.05D end"),
        "ask_price": F.expr(f"case when {hit}'crossed' then _px - 0.05D when {hit}'locked' then _px when {quote} then _px + 0.05D end"),
        "bid_size": F.when(F.expr(quote), 1 + draw(20, seed, "bs", "w", "k")), "ask_size": F.when(F.expr(quote), 1 + draw(20, seed, "as", "w", "k")), "bid_exchange": F.expr(f"case when {quote} then 'V' end"), "ask_exchange": F.expr(f"case when {quote} then 'V' end"),
        "open": F.expr("case when kind = 'bar' then _o end"), "high": F.expr("case when kind = 'bar' then case when defect = 'ohlc' then _h + 5 else _h end end"), "low": F.expr("case when kind = 'bar' then case when defect = 'band' then _h + 5 else _l end end"), "close": F.expr("case when kind = 'bar' then _c end"),
        "vwap": F.expr("case when kind = 'bar' then _pv / _v * case when defect = 'vwap' then 1.001D else 1D end end"), "volume": F.expr("case when kind = 'bar' then _v + case when defect = 'volume' then 100 else 0 end end"), "trade_count": F.expr("case when kind = 'bar' then _m + case when defect = 'count' then 1 else 0 end end"),
    })
    return whole.select(*(F.col(c).cast(t).alias(c) for c, t in TAPE_COLUMNS.items()))


def joint_anomaly_bars(spark: SparkSession, bars: int = 800, symbols: int = 1, seed: int = 7, clean: float = 0.6, anomalies: int = 40) -> DataFrame:
    """Bars of five minutes whose range, volume and trade count all rise with how busy the market is, but for label = 1.

    There the range is that of the opposite level: each number is common by itself, only their combination is not. Such
    bars lie after the clean share, evenly apart, so that a fit on the earlier bars never sees one.
    """
    quiet = int(bars * clean)
    apart = max(1, (bars - quiet) // max(1, anomalies))
    each = spark.range(bars * symbols).selectExpr(f"id % {symbols} as ix", f"id div {symbols} as k").select("ix", "k", symbol_name(F.col("ix")).alias("symbol"), F.expr(f"cast(k >= {quiet} and (k - {quiet}) % {apart} = {apart - 1} as int)").alias("label"))
    keys = ("ix", "k")
    busy = each.withColumn("_busy", unit(seed, "busy", *keys))
    seen = busy.withColumn("_span", F.when(F.col("label") == 1, 1.05 - F.col("_busy")).otherwise(F.col("_busy")) + 0.03 * normal(seed, "span", *keys))
    width = 0.0004 + 0.004 * F.greatest("_span", F.lit(0.0))
    moved = seen.withColumn("_width", width).withColumn("_move", (unit(seed, "side", *keys) - 0.5) * F.col("_width"))
    by = "over (partition by symbol order by k)"
    priced = moved.withColumn("close", F.expr(f"50D * exp(sum(_move) {by})")).withColumn("open", F.expr(f"lag(close, 1, 50D) {by}"))
    spare = F.greatest(F.col("_width") * F.col("open") - F.abs(F.col("close") - F.col("open")), F.lit(0.0)) / 2
    trades = F.round(20 + 180 * F.col("_busy") + 4 * normal(seed, "trades", *keys)).cast("long")
    priced = priced.withColumns({"high": F.greatest("open", "close") + spare, "low": F.least("open", "close") - spare, "trade_count": F.greatest(trades, F.lit(1))})
    return priced.withColumns({"vwap": (F.col("high") + F.col("low") + F.col("close")) / 3, "volume": F.col("trade_count") * (60 + draw(9, seed, "lot", *keys))}).select(
        "symbol", (F.lit(BASE_NS) + F.col("k") * 300_000_000_000).cast("long").alias("start_ns"), F.col("k").alias("arrival_ix"), "open", "high", "low", "close", "vwap", F.col("volume").cast("long").alias("volume"), "trade_count", "label",
    )


def lossy_feed(spark: SparkSession, count: int = 10_000, drop_a: float = 0.02, drop_b: float = 0.02, seed: int = 1) -> DataFrame:
    """Packets 0 to count - 1 of one feed on two lines, each of which drops its share independently."""
    base = spark.range(count)
    line = lambda name, share, k: base.where(draw(1_000_000, seed, name, "id") >= int(share * 1_000_000)).select(F.lit("X").alias("feed"), F.col("id").alias("seq"), F.lit(name).alias("line"), (F.col("id") * 2 + k).alias("arrival_ix"), F.col("id").alias("payload"))
    return line("A", drop_a, 0).unionByName(line("B", drop_b, 1))
