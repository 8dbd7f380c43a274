"""Structured Streaming forms of the folds and of the live pipeline. The step functions are those of the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ..functions.folds import Fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Runs a fold over each key's rows, in order within a trigger, with its state kept between triggers.

    With idle, in milliseconds of processing time, a key that gets no rows for that long is finished: the fold gives what
    it holds back. Its state stays, so that later rows go on from there.
    """

    def __init__(self, make: Callable[[], Fold], columns: list[str], order: str, schema: str, idle: int | None = None):
        self.make, self.columns, self.order, self.idle = make, columns, order, idle
        self.names = _parse_datatype_string(schema).names  # here, since executors have no session to parse with

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", StructType([StructField("state", StringType())]))

    def fold(self) -> Fold:
        fold = self.make()
        if self.state.exists():
            fold.load(self.state.get()[0])
        return fold

    def rows(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold = self.fold()
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order)
        values = [[None if pd.isna(v) else v for v in frame[c].tolist()] for c in self.columns]
        out = [r for row in zip(*values, strict=True) for r in fold.step(row)]
        self.state.update((fold.dump(),))
        if self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield from self.rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold = self.fold()
        out = fold.finish()
        self.state.update((fold.dump(),))
        yield from self.rows(key, out)

    def close(self) -> None:
        pass


def stream_fold(rows: DataFrame, key: str, order: str, columns: list[str], make: Callable[[], Fold], schema: str, idle: int | None = None) -> DataFrame:
    """The streaming form of functions.folds.fold; needs the RocksDB state store. Rows of a key must come in order from trigger to trigger.

    idle: milliseconds without rows after which a key is finished. Timers are looked at in each trigger, so the query
    must go on triggering, as with processingTime.
    """
    made = FoldProcessor(make, columns, order, schema, idle)
    return rows.select(key, *columns).groupBy(key).transformWithStateInPandas(made, _parse_datatype_string(schema), "Append", "None" if idle is None else "ProcessingTime")


def session_windows(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """symbol, session window and rows in it, for rows with a timestamp column ts; late rows beyond the delay are dropped."""
    return rows.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", "5 minutes")).agg(F.count(F.lit(1)).alias("n"))


def tee(validated: DataFrame, log_path: str, capture_path: str, checkpoint: str):
    """Writes each trigger's violations as JSON lines and all of its records as Parquet."""
    from ..operators.reports import violation_log

    def both(batch: DataFrame, _: int) -> None:
        batch.persist()
        violation_log(batch).write.mode("append").text(log_path)
        batch.write.mode("append").parquet(capture_path)
        batch.unpersist()

    return validated.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
