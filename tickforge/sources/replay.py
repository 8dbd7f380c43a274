"""The fixed-stride binary replay format as a Spark data source: format("replay").

A file is a 16-byte header (magic, version, record count) and 88-byte records. Reads split by record ranges, writes
go to task files that the commit joins behind a header. Files must be on a file system that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import TAPE, TAPE_COLUMNS

# Fixed values of the format.
MAGIC, VERSION, HEADER, STRIDE = 0x564C484F, 2, 16, 88
KINDS = ["trade", "bar", "quote"]
COMMON = {"type": ("u1", 0), "symbol": ("S8", 8), "ts": ("<u8", 16), "seq": ("<u8", 24)}
FIELDS = {
    "trade": {"trade_id": ("<u8", 32), "price": ("<f8", 40), "size": ("<u8", 48), "exchange": ("S1", 56), "tape": ("S1", 57)},
    "bar": {"open": ("<f8", 32), "high": ("<f8", 40), "low": ("<f8", 48), "close": ("<f8", 56), "vwap": ("<f8", 64), "volume": ("<u8", 72), "trade_count": ("<u8", 80)},
    "quote": {"bid_price": ("<f8", 32), "ask_price": ("<f8", 40), "bid_size": ("<u8", 48), "ask_size": ("<u8", 56), "bid_exchange": ("S1", 64), "ask_exchange": ("S1", 65), "tape": ("S1", 66)},
}


def dtype(kind: str) -> np.dtype:
    fields = COMMON | FIELDS[kind]
    return np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": STRIDE})


def count_records(path: str, strict: bool = True) -> int:
    """Records of a file, or ValueError. A strict read wants the body to fit exactly; else bytes may trail."""
    size = os.path.getsize(path)
    if size < HEADER:
        raise ValueError(f"{path}: too short for a header")
    with open(path, "rb") as file:
        magic, version, count = struct.unpack("<IIQ", file.read(HEADER))
    if magic != MAGIC:
        raise ValueError(f"{path}: bad magic")
    if version != VERSION:
        raise ValueError(f"{path}: version {version} is not supported")
    if count > (size - HEADER) // STRIDE:
        raise ValueError(f"{path}: stride mismatch: {count} records claimed, the body has {size - HEADER} bytes")
    if strict and size - HEADER != count * STRIDE:
        raise ValueError(f"{path}: stride mismatch: {count} records, the body has {size - HEADER} bytes")
    return count


def text(column: np.ndarray) -> pa.Array:
    decoded = [v.decode("ascii", "replace") for v in column.tolist()]
    return pa.array([v if v else None for v in decoded], pa.string())


def batch_of(raw: bytes, first: int, schema: pa.Schema) -> pa.RecordBatch:
    """Records as rows of the tape, in order; records of unknown type are left out."""
    types = np.frombuffer(raw, dtype("trade"))["type"]
    known = types < len(KINDS)
    total = int(known.sum())
    columns: dict[str, pa.Array] = {}
    common = np.frombuffer(raw, dtype("trade"))[known]
    columns["arrival_ix"] = pa.array(np.flatnonzero(known) + first, pa.int64())
    columns["kind"] = pa.array([KINDS[t] for t in types[known].tolist()], pa.string())
    columns["symbol"] = pa.array([v.decode("ascii", "replace") for v in common["symbol"].tolist()], pa.string())
    for name in ("ts", "seq"):
        if (common[name] >> np.uint64(63)).any():
            raise ValueError(f"{name} beyond 63 bits")
    columns["ts_ns"], columns["seq"] = pa.array(common["ts"].astype(np.int64)), pa.array(common["seq"].astype(np.int64))
    for code, kind in enumerate(KINDS):
        mask = types[known] == code
        rows = np.frombuffer(raw, dtype(kind))[known]
        for name, (form, _) in FIELDS[kind].items():
            if form.startswith("S"):
                made = pa.array([v if m else None for v, m in zip(text(rows[name]).to_pylist(), mask.tolist(), strict=True)], pa.string())
            else:
                made = pa.array(rows[name].astype(np.float64 if form == "<f8" else np.int64), mask=~mask)
            columns[name] = made if name not in columns else pa.array([a if a is not None else b for a, b in zip(columns[name].to_pylist(), made.to_pylist(), strict=True)], made.type)
    assert all(len(c) == total for c in columns.values())
    return pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)


def arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in TAPE_COLUMNS.items()])


def records_of(batch: pa.RecordBatch) -> bytes:
    """The batch's rows as records; symbols are cut to eight bytes and padded, texts to their first character."""
    out = np.zeros(batch.num_rows, dtype=np.dtype(f"V{STRIDE}"))
    kinds = np.array(batch.column("kind").to_pylist())
    for code, kind in enumerate(KINDS):
        at = np.flatnonzero(kinds == kind)
        rows = np.zeros(len(at), dtype(kind))
        part = batch.take(pa.array(at))
        rows["type"] = code
        rows["symbol"] = [(v or "").encode("ascii", "replace")[:8] for v in part.column("symbol").to_pylist()]
        for name, source in (("ts", "ts_ns"), ("seq", "seq"), *((n, n) for n in FIELDS[kind])):
            values = part.column(source).to_pylist()
            form = (COMMON | FIELDS[kind])[name][0]
            rows[name] = [(v or "").encode("ascii", "replace")[:1] for v in values] if form.startswith("S") else [v or 0 for v in values]
        out[at] = rows.view(out.dtype)
    return out.tobytes()


@dataclass
class Records(InputPartition):
    first: int
    count: int


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("strict", "true").lower() != "false"
        self.per_task = int(options.get("recordspertask", 1 << 20))

    def partitions(self) -> list[Records]:
        n = count_records(self.path, self.strict)
        return [Records(k, min(self.per_task, n - k)) for k in range(0, n, self.per_task)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema()
        with open(self.path, "rb") as file:
            file.seek(HEADER + partition.first * STRIDE)
            for k in range(0, partition.count, 1 << 16):
                yield batch_of(file.read(STRIDE * min(1 << 16, partition.count - k)), partition.first + k, schema)


@dataclass
class Part(WriterCommitMessage):
    path: str
    task: int
    count: int


class ReplayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.parts, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        path = f"{self.parts}/{uuid.uuid4().hex}"  # another for each attempt; only committed ones are joined
        count = 0
        with open(path, "wb") as file:
            for batch in iterator:
                file.write(records_of(batch))
                count += batch.num_rows
        return Part(path, TaskContext.get().partitionId(), count)

    def commit(self, messages: list[Part | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        with open(f"{self.parts}/whole", "wb") as whole:
            whole.write(struct.pack("<IIQ", MAGIC, VERSION, 0))
            for part in done:
                with open(part.path, "rb") as file:
                    shutil.copyfileobj(file, whole)
            whole.seek(0)
            whole.write(struct.pack("<IIQ", MAGIC, VERSION, sum(p.count for p in done)))
        os.replace(f"{self.parts}/whole", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class ReplaySource(DataSource):
    """spark.read.format("replay").load(path); options strict (true) and recordsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return TAPE

    def reader(self, schema: StructType) -> ReplayReader:
        return ReplayReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> ReplayWriter:
        return ReplayWriter({k.lower(): v for k, v in self.options.items()})


def read_replay(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    spark.dataSource.register(ReplaySource)
    return spark.read.format("replay").option("strict", str(strict).lower()).load(path)


def write_replay(tape: DataFrame, path: str) -> None:
    """tape in order of arrival as one file."""
    tape.sparkSession.dataSource.register(ReplaySource)
    tape.select(*(tape[c].cast(k).alias(c) for c, k in TAPE_COLUMNS.items())).orderBy("arrival_ix").write.format("replay").mode("append").save(path)
