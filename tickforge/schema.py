"""Schemas, violation bits and constants of the market-data engine."""

from __future__ import annotations

# Bits, labels and limits that results must agree with.
BAR_LOW_ABOVE_HIGH = 1 << 0
BAR_OPEN_OUT_OF_RANGE = 1 << 1
BAR_CLOSE_OUT_OF_RANGE = 1 << 2
BAR_VWAP_OUT_OF_RANGE = 1 << 3
BAR_NON_POSITIVE_PRICE = 1 << 4
BAR_VOLUME_INCONSISTENT = 1 << 5
TRADE_NON_POSITIVE_PRICE = 1 << 6
TRADE_NON_POSITIVE_SIZE = 1 << 7
TIMESTAMP_REGRESSION = 1 << 8
SEQUENCE_GAP = 1 << 9
VOLUME_MISMATCH = 1 << 10
COUNT_MISMATCH = 1 << 11
VWAP_MISMATCH = 1 << 12
OHLC_MISMATCH = 1 << 13
QUOTE_CROSSED = 1 << 14
QUOTE_LOCKED = 1 << 15
QUOTE_NON_POSITIVE = 1 << 16
QUOTE_ZERO_SIZE = 1 << 17
PRICE_BAND_BREACH = 1 << 18
RELATIVE_TOLERANCE = 1e-6
BAND_FRACTION, BAND_ALPHA, BAND_RUN = 0.05, 0.2, 3
LABELS = [
    (TRADE_NON_POSITIVE_PRICE, "trade non-positive price"),
    (TRADE_NON_POSITIVE_SIZE, "trade non-positive size"),
    (PRICE_BAND_BREACH, "price-band outlier"),
    (BAR_LOW_ABOVE_HIGH, "bar low > high"),
    (BAR_OPEN_OUT_OF_RANGE, "bar open out of [low,high]"),
    (BAR_CLOSE_OUT_OF_RANGE, "bar close out of [low,high]"),
    (BAR_VWAP_OUT_OF_RANGE, "bar vwap out of [low,high]"),
    (BAR_NON_POSITIVE_PRICE, "bar non-positive price"),
    (BAR_VOLUME_INCONSISTENT, "bar volume/trade-count inconsistent"),
    (QUOTE_CROSSED, "quote crossed (bid > ask)"),
    (QUOTE_LOCKED, "quote locked (bid == ask)"),
    (QUOTE_NON_POSITIVE, "quote non-positive price"),
    (QUOTE_ZERO_SIZE, "quote zero bid/ask size"),
]
SURFACED = sum(bit for bit, _ in LABELS)
BAD_BAR = 0b111111
BAD_TRADE = TRADE_NON_POSITIVE_PRICE | TRADE_NON_POSITIVE_SIZE

TAPE_COLUMNS = {
    "arrival_ix": "long", "kind": "string", "symbol": "string", "ts_ns": "long", "seq": "long",
    "trade_id": "long", "price": "double", "size": "long", "exchange": "string", "tape": "string",
    "bid_price": "double", "ask_price": "double", "bid_size": "long", "ask_size": "long", "bid_exchange": "string", "ask_exchange": "string",
    "open": "double", "high": "double", "low": "double", "close": "double", "vwap": "double", "volume": "long", "trade_count": "long",
}
TAPE = ", ".join(f"{name} {kind}" for name, kind in TAPE_COLUMNS.items())
FEATURES = ["log_return", "hl_range", "vwap_dev", "log_volume", "trade_count", "realized_vol", "volume_z"]
