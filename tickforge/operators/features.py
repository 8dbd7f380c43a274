"""Per-bar features, sessions, forward returns, time split and its leakage check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION_GAP_NS, WINDOW, MAD_SCALE = 300 * 1_000_000_000, 60, 1.4826
BY_TIME = "partition by symbol order by start_ns, arrival_ix"


def features(bars: DataFrame, window: int = WINDOW) -> DataFrame:
    """symbol, start_ns, arrival_ix, close and the seven features of each bar.

    Returns across gaps of more than five minutes count as 0; the rolling windows cross them. The rolling median and
    deviation are taken with NumPy from the rows as the windows leave them, sorted; a task holds one frame's rows more
    than a batch.
    """
    trailing = f"over ({BY_TIME} rows between {window - 1} preceding and current row)"
    first = bars.withColumns({"_prev": F.expr(f"lag(close) over ({BY_TIME})"), "_since": F.expr(f"start_ns - lag(start_ns) over ({BY_TIME})")})
    base = first.select(
        "symbol", "start_ns", "arrival_ix", "close",
        F.expr(f"case when _prev > 0 and close > 0 and _since <= {SESSION_GAP_NS} then ln(close / _prev) else 0D end").alias("log_return"),
        F.expr("case when close > 0 then (high - low) / close else 0D end").alias("hl_range"),
        F.expr("case when vwap > 0 then (close - vwap) / vwap else 0D end").alias("vwap_dev"),
        F.expr("log1p(cast(greatest(volume, 0) as double))").alias("log_volume"),
        F.col("trade_count").cast("double").alias("trade_count"),
    )
    rolled = base.withColumn("realized_vol", F.expr(f"stddev_pop(log_return) {trailing}")).sortWithinPartitions("symbol", "start_ns", "arrival_ix")
    at = [rolled.columns.index(c) for c in ("symbol", "log_volume")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, np.zeros(0)  # the last rows of the symbol that the batch before ended with
        for batch in batches:
            symbols, values = batch.column(at[0]).dictionary_encode(), batch.column(at[1]).to_numpy(zero_copy_only=False)
            codes = symbols.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            out = np.zeros(len(values))
            for a, b in zip(edges, edges[1:], strict=False):
                symbol = symbols.dictionary[codes[a]].as_py() if b > a else None
                if symbol != now:
                    now, before = symbol, np.zeros(0)
                both = np.concatenate([before, values[a:b]])
                out[a:b] = robust_deviation(both, window)[len(before) :]
                before = both[max(0, len(both) - window + 1) :] if window > 1 else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "volume_z"])

    return rolled.mapInArrow(run, rolled.withColumn("volume_z", F.lit(0.0)).schema)


def robust_deviation(values: np.ndarray, window: int) -> np.ndarray:
    """(value - median) / (1.4826 times the median absolute deviation) over the last window values up to each; 0 without spread."""
    out = np.zeros(len(values))
    padded = np.concatenate([np.full(window - 1, np.nan), values])
    for k in range(0, len(values), 4096):
        frame = np.lib.stride_tricks.sliding_window_view(padded[k : k + 4096 + window - 1], window)
        counts = np.minimum(np.arange(k, k + len(frame)) + 1, window)
        rows = np.arange(len(frame))
        middle = lambda x: (x[rows, (counts - 1) // 2] + x[rows, counts // 2]) / 2  # noqa: B023, E731
        median = middle(np.sort(frame, axis=1))  # values that are missing come last
        scale = middle(np.sort(np.abs(frame - median[:, None]), axis=1)) * MAD_SCALE
        np.divide(values[k : k + len(frame)] - median, scale, out=out[k : k + len(frame)], where=scale > 0)
    return out


def sessions(bars: DataFrame) -> DataFrame:
    """symbol, start_ns, arrival_ix, session (from 0): a gap of more than five minutes starts a new one."""
    starts = bars.withColumn("_new", F.expr(f"case when start_ns - lag(start_ns) over ({BY_TIME}) > {SESSION_GAP_NS} then 1 else 0 end"))
    return starts.select("symbol", "start_ns", "arrival_ix", F.expr(f"sum(_new) over ({BY_TIME})").alias("session"))


def forward_returns(bars: DataFrame) -> DataFrame:
    """symbol, start_ns, arrival_ix, forward_return: to the next bar's close; a symbol's last bar has none. Sessions don't matter."""
    return bars.select("symbol", "start_ns", "arrival_ix", F.expr(f"lead(close) over ({BY_TIME}) / close - 1").alias("forward_return")).where("forward_return is not null")


def time_split(rows: DataFrame, fit: float = 0.4, calibrate: float = 0.2) -> DataFrame:
    """rows with fold: of each symbol's n rows in time the first int(n * fit) fit, the next int(n * calibrate) calibrate, the rest test."""
    n = "count(1) over (partition by symbol)"
    place = f"row_number() over ({BY_TIME}) - 1"
    a = f"cast(floor({n} * {fit}D) as long)"
    b = f"({a} + cast(floor({n} * {calibrate}D) as long))"
    return rows.withColumn("fold", F.expr(f"case when {place} < {a} then 'fit' when {place} < {b} then 'calibrate' else 'test' end"))


def leakage(split: DataFrame) -> DataFrame:
    """Symbols in which a fold reaches into a later one; empty if the split is sound."""
    of = lambda how, fold: how(F.when(F.col("fold") == fold, F.col("start_ns")))
    bounds = split.groupBy("symbol").agg(of(F.max, "fit").alias("fit_to"), of(F.min, "calibrate").alias("calibrate_from"), of(F.max, "calibrate").alias("calibrate_to"), of(F.min, "test").alias("test_from"))
    return bounds.where("fit_to >= test_from or calibrate_to >= test_from or fit_to >= calibrate_from")


def assert_no_leakage(split: DataFrame) -> None:
    if bad := leakage(split).select("symbol").take(5):
        raise ValueError(f"leakage between folds for {[r[0] for r in bad]}")
