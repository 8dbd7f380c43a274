"""The validator: stateless checks, sequencing, bar reconciliation and the price band, as one bit mask for each record.

All windows are partitioned by symbol and ordered by arrival, so they share one exchange. The band is a fold.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.folds import annotate
from ..functions.scalars import approx_equal, bit, less

BY_SYMBOL = "partition by symbol order by arrival_ix"


def stateless(c=F.col) -> Column:
    """Bits that hang on the record alone. Records of any kind may be in one table."""
    price, size = c("price"), c("size")
    low, high, open_, close, vwap = c("low"), c("high"), c("open"), c("close"), c("vwap")
    bid, ask = c("bid_price"), c("ask_price")
    out = lambda x: less(x, low) | less(high, x)
    trade = bit(~((price > 0) & ~F.isnan(price)), S.TRADE_NON_POSITIVE_PRICE) + bit(size == 0, S.TRADE_NON_POSITIVE_SIZE)
    bar = (
        bit(less(high, low), S.BAR_LOW_ABOVE_HIGH)
        + bit(out(open_), S.BAR_OPEN_OUT_OF_RANGE)
        + bit(out(close), S.BAR_CLOSE_OUT_OF_RANGE)
        + bit(out(vwap), S.BAR_VWAP_OUT_OF_RANGE)
        + bit((open_ <= 0) | (high <= 0) | (low <= 0) | (close <= 0), S.BAR_NON_POSITIVE_PRICE)
        + bit((c("trade_count") == 0) != (c("volume") == 0), S.BAR_VOLUME_INCONSISTENT)
    )
    quote = (
        bit(less(ask, bid), S.QUOTE_CROSSED)
        + bit((bid == ask) & ~F.isnan(bid), S.QUOTE_LOCKED)
        + bit((bid <= 0) | (ask <= 0), S.QUOTE_NON_POSITIVE)
        + bit((c("bid_size") == 0) | (c("ask_size") == 0), S.QUOTE_ZERO_SIZE)
    )
    return F.when(c("kind") == "trade", trade).when(c("kind") == "bar", bar).otherwise(quote)


def with_stateless(tape: DataFrame) -> DataFrame:
    return tape.withColumn("stateless_flags", stateless())


def with_sequencing(tape: DataFrame) -> DataFrame:
    """sequencing_flags and gap. Both cursors follow every record, whether it violates or not; a previous ts of 0 is unseen."""
    before = F.expr("lag(ts_ns) over (partition by symbol, kind order by arrival_ix)")
    last = F.expr(f"lag(seq) over ({BY_SYMBOL})")
    missed = F.when(F.col("seq") > last + 1, F.col("seq") - last - 1).otherwise(F.lit(0)).cast("long")
    return tape.withColumns({"gap": missed, "_back": (before != 0) & (F.col("ts_ns") < before)}).withColumn("sequencing_flags", bit(F.col("_back"), S.TIMESTAMP_REGRESSION) + bit(F.col("gap") > 0, S.SEQUENCE_GAP)).drop("_back")


VALID = "(kind = 'trade' and price > 0 and not isnan(price) and size <> 0)"


def with_bar_window(tape: DataFrame) -> DataFrame:
    """bar_window: how many bars of the symbol came before the record. A bar closes the window of the trades before it."""
    return tape.withColumn("bar_window", F.expr(f"coalesce(count(case when kind = 'bar' then 1 end) over ({BY_SYMBOL} rows between unbounded preceding and 1 preceding), 0)"))


def bars_from_trades(tape: DataFrame) -> DataFrame:
    """symbol, bar_window, open, high, low, close, vwap, volume, trade_count of the valid trades of each window."""
    return (
        with_bar_window(tape).where(F.expr(VALID)).groupBy("symbol", "bar_window")
        .agg(
            F.min_by("price", "arrival_ix").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival_ix").alias("close"),
            (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        )
    )


def with_reconciliation(tape: DataFrame) -> DataFrame:
    """reconcile_flags: bars against the valid trades of their window; none where there are no such trades."""
    over = "over (partition by symbol, bar_window)"
    when = f"case when {VALID} then"
    totals = {
        "_n": f"count({when} 1 end) {over}",
        "_volume": f"sum({when} size end) {over}",
        "_pv": f"sum({when} price * size end) {over}",
        "_high": f"max({when} price end) {over}",
        "_low": f"min({when} price end) {over}",
        "_open": f"min_by({when} price end, {when} arrival_ix end) {over}",
        "_close": f"max_by({when} price end, {when} arrival_ix end) {over}",
    }
    wide = with_bar_window(tape).withColumns({k: F.expr(v) for k, v in totals.items()})
    off = lambda a, b: ~approx_equal(F.col(a), F.col(b))
    flags = (
        bit(F.col("volume") != F.col("_volume"), S.VOLUME_MISMATCH)
        + bit(F.col("trade_count") != F.col("_n"), S.COUNT_MISMATCH)
        + bit(~approx_equal(F.col("vwap"), F.col("_pv") / F.col("_volume")), S.VWAP_MISMATCH)
        + bit(off("open", "_open") | off("high", "_high") | off("low", "_low") | off("close", "_close"), S.OHLC_MISMATCH)
    )
    return wide.withColumn("reconcile_flags", F.when((F.col("kind") == "bar") & (F.col("_n") > 0), flags).otherwise(0)).drop(*totals, "bar_window")


class PriceBand:
    """Reference price of a symbol: valid trades within the band pull it along, a run of breaches moves it.

    Rows: (arrival_ix, kind, price, size, bid_price, ask_price). Gives (arrival_ix, flag, reference) for each.
    """

    def __init__(self) -> None:
        self.reference: float | None = None
        self.run = 0

    def step(self, row: tuple) -> list[tuple]:
        at, kind, price, size, bid, ask = row
        flag = 0
        if kind == "trade":
            if price is not None and price > 0 and size:
                if self.reference is None:
                    self.reference = price
                elif abs(price - self.reference) > S.BAND_FRACTION * self.reference:
                    flag = S.PRICE_BAND_BREACH
                    self.run += 1
                    if self.run >= S.BAND_RUN:
                        self.reference, self.run = price, 0
                else:
                    self.run = 0
                    self.reference = S.BAND_ALPHA * price + (1 - S.BAND_ALPHA) * self.reference
        elif kind == "quote" and self.reference is not None and bid is not None and ask is not None and bid > 0 and ask > 0:
            if abs((bid + ask) * 0.5 - self.reference) > S.BAND_FRACTION * self.reference:
                flag = S.PRICE_BAND_BREACH
        return [(at, flag, self.reference)]

    def finish(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return json.dumps([self.reference, self.run])

    def load(self, state: str) -> None:
        self.reference, self.run = json.loads(state)


BAND_COLUMNS = ["arrival_ix", "kind", "price", "size", "bid_price", "ask_price"]


def band_steps(state: list, columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rules of PriceBand over arrays of kind, price, size, bid_price and ask_price: band_flag and reference (NaN before the first).

    What is not a valid trade or quote is sorted out at once; only the rest is walked. state: reference and run.
    """
    kind, price, size, bid, ask = columns
    trade = (kind == "trade") & (price > 0) & (size != 0) & (size == size)
    quote = (kind == "quote") & (bid > 0) & (ask > 0)
    value = np.where(trade, price, (bid + ask) * 0.5)
    walked = np.flatnonzero(trade | quote)
    breaches, references = [], []
    reference, run = state
    for is_trade, x in zip(trade[walked].tolist(), value[walked].tolist(), strict=True):
        breach = reference is not None and abs(x - reference) > S.BAND_FRACTION * reference
        if is_trade:
            if reference is None:
                reference = x
            elif breach:
                run += 1
                if run >= S.BAND_RUN:
                    reference, run = x, 0
            else:
                reference, run = S.BAND_ALPHA * x + (1 - S.BAND_ALPHA) * reference, 0
        breaches.append(breach)
        references.append(reference)
    flags = np.zeros(len(kind), np.int32)
    flags[walked] = np.where(np.array(breaches, bool), S.PRICE_BAND_BREACH, 0)
    known = np.array([np.nan if state[0] is None else state[0], *(np.nan if r is None else r for r in references)])
    carried = known[np.cumsum(np.bincount(walked, minlength=len(kind)))]
    state[:] = [reference, run]
    return [flags, carried]


def with_band(tape: DataFrame) -> DataFrame:
    """tape, dealt out by symbol, with band_flag and reference (after the record; NaN before the first valid trade)."""
    return annotate(tape, "symbol", "arrival_ix", BAND_COLUMNS[1:], lambda: [None, 0], band_steps, "band_flag int, reference double")


def price_band(tape: DataFrame) -> DataFrame:
    """symbol, arrival_ix, band_flag and reference (after the record, null before the first valid trade) of every record."""
    narrow = tape.select("symbol", *BAND_COLUMNS).repartition("symbol")
    return with_band(narrow).select("symbol", "arrival_ix", "band_flag", F.expr("nullif(reference, double('NaN'))").alias("reference"))


def validate(tape: DataFrame) -> DataFrame:
    """tape with flags (all 19 bits) and gap. The tape is shuffled once, by symbol: windows and fold share that exchange."""
    checked = with_band(with_reconciliation(with_sequencing(with_stateless(tape.repartition("symbol"))))).drop("reference")
    flags = F.col("stateless_flags") + F.col("sequencing_flags") + F.col("reconcile_flags") + F.col("band_flag")
    return checked.withColumn("flags", flags.cast("int")).drop("stateless_flags", "sequencing_flags", "reconcile_flags", "band_flag")


def quote_reference(tape: DataFrame) -> DataFrame:
    """Quotes with the reference price as of the last trade before them, from the trades' fold alone: an as-of join.

    The merged tape is read in order of arrival, carrying the last reference forward.
    """
    trades = price_band(tape.where("kind = 'trade'")).select("symbol", "arrival_ix", F.col("reference").alias("ref_after"))
    merged = tape.select("symbol", "arrival_ix", "kind", "bid_price", "ask_price", F.lit(None).cast("double").alias("ref_after")).where("kind = 'quote'").unionByName(trades, allowMissingColumns=True)
    carried = merged.withColumn("reference", F.expr(f"last(ref_after, true) over ({BY_SYMBOL} rows between unbounded preceding and current row)"))
    quotes = carried.where("kind = 'quote'")
    breach = F.expr("reference is not null and bid_price > 0 and ask_price > 0 and abs((bid_price + ask_price) * 0.5D - reference) > 0.05D * reference")
    return quotes.select("symbol", "arrival_ix", "reference", bit(breach, S.PRICE_BAND_BREACH).alias("band_flag"))
