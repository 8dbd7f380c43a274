"""Datagrams of a sequenced feed as rows: a sequence number and a line around a record of the replay format."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TAPE_COLUMNS
from . import replay

# Fixed values of the format: sequence number (8 bytes), line (1, 0 is A), 7 unused, record.
LENGTH, RECORD = 104, 16
LINES = ["A", "B"]


def decode(datagrams: DataFrame) -> DataFrame:
    """seq, line and arrival_ix of each datagram (arrival_ix, packet), and in record the tape's columns that it carries.

    Datagrams of another length, of an unknown line or of an unknown kind of record are dropped, nulls too. Rows are
    independent, so streams and batches go the same way. The record's own seq and arrival_ix are as in the datagram's body.
    """
    schema = replay.arrow_schema()
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, LENGTH)
            body = np.ascontiguousarray(raw[:, RECORD:])
            good = (raw[:, 8] < len(LINES)) & (body[:, 0] < len(replay.KINDS))
            raw, body, arrival = raw[good], body[good], batch.column(0).to_numpy(zero_copy_only=False)[good]
            seq = np.ascontiguousarray(raw[:, :8]).view("<u8").reshape(-1)
            if (seq >> np.uint64(63)).any():
                raise ValueError("seq beyond 63 bits")
            record = replay.batch_of(body.tobytes(), 0, schema)
            yield pa.RecordBatch.from_arrays([pa.array(arrival, pa.int64()), pa.array(seq.astype(np.int64)), pa.array([LINES[k] for k in raw[:, 8].tolist()], pa.string()), pa.StructArray.from_arrays(record.columns, names=names)], names=["arrival_ix", "seq", "line", "record"])

    whole = datagrams.where(F.octet_length("packet") == LENGTH).select(F.col("arrival_ix").cast("long").alias("arrival_ix"), "packet")
    return whole.mapInArrow(run, f"arrival_ix long, seq long, line string, record struct<{', '.join(f'{n}: {k}' for n, k in TAPE_COLUMNS.items())}>")


def encode(packets: DataFrame) -> DataFrame:
    """arrival_ix and packet of rows with seq, line and body, the bytes of a record: datagrams for tests and replays."""
    little = F.unhex(F.concat(*(F.substring(F.lpad(F.hex("seq"), 16, "0"), 15 - 2 * k, 2) for k in range(8))))
    line = F.when(F.col("line") == "A", F.unhex(F.lit("0000000000000000"))).otherwise(F.unhex(F.lit("0100000000000000")))
    return packets.select("arrival_ix", F.concat(little, line, "body").alias("packet"))
