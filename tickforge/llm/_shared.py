"""What the operators of this subpackage have in common: inputs, durable tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without it; then a temporary folder of this machine does, as in tests.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="tickforge-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: what was written outlives lost executors, and values that depend on the layout of the
    input (such as row ids) are fixed from here on.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, by: str) -> DataFrame:
    """rows joined with table on key, where table has each key once and in size how many of the rows have it.

    The rows of a key with more than a thousandth of total, the number of rows, are dealt by a hash of the column by to
    as many partitions as they have thousandths. Such keys are at most a thousand; only they and their shares are broadcast.
    """
    share = max(1, total // 1000)
    ways = F.ceil(F.col(size) / share).cast("int")
    hot = table.where(F.col(size) > share).select(F.col(key).alias("_key"), ways.alias("_ways"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    salted = dealt.withColumn("_salt", F.when(F.col("_ways") > 1, F.pmod(F.xxhash64(F.lit(3), F.col(by)), F.col("_ways")).cast("int")).otherwise(0)).drop("_key", "_ways")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(ways, F.lit(1)) - 1)))
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def released() -> None:
    """Give back the memory that Arrow and the C library keep for reuse: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a worker never holds many texts as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    released()


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, id_col: str = "doc_id", text_col: str = "text", type_: str = "long") -> DataFrame:
    """doc_id and the columns that make()(texts) computes for each batch of texts, null texts being empty.

    make runs once for each task, on the executor. Only the two columns are read; df's other columns are not kept.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in small(batches):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            got = work(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n in names)], names=["doc_id", *names])

    return df.select(df[id_col].cast(type_).alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id long, {schema}")
