"""Global shuffle into shards, as a two-pass external shuffle, with SQL functions only.

Pass 1 scatters the rows uniformly into memory-sized buckets by a seeded hash and writes them. Pass 2 applies a
Fisher-Yates shuffle to each bucket, and deals the buckets out one after another: the row at place g of the whole
order goes to shard g mod n, at slot g div n. So the shards' row counts are at most one apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, durable

#: A bucket's rows and bytes, on average. One swap in SQL functions copies the bucket's index array.
BUCKET_ROWS, BUCKET_BYTES = 1024, 16 << 20
#: Buckets are numbered within groups, so that running totals need no window over all of them.
SUPERS = 256


def fisher_yates(n: str, *salts: str) -> str:
    """SQL for a permutation of 0..n-1: for i from 1 up, swap place i with place hash(salts, i) mod (i + 1)."""
    draws = f"transform(sequence(1, {n} - 1), i -> named_struct('i', i, 'j', cast(pmod(xxhash64({', '.join(salts)}, i), i + 1) as int)))"
    swap = f"if(x.i = x.j, a, concat(slice(a, 1, x.j), array(a[x.i]), slice(a, x.j + 2, x.i - x.j - 1), array(a[x.j]), slice(a, x.i + 2, {n} - x.i - 1)))"
    return f"if({n} < 2, sequence(0, {n} - 1, 1), aggregate({draws}, sequence(0, {n} - 1), (a, x) -> {swap}))"


def external_shuffle(df: DataFrame, n_shards: int = 8, seed: int = 17, key: str = "doc_id", size: str = "octet_length(coalesce(cast(text as string), ''))", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns of df, with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Rows may repeat and hold nulls anywhere, key included: a row's bucket hangs on its place in the input as well
    as on its key, so a hot key spreads evenly. The order is fixed by the seed and the layout of the input. An
    empty table gives no rows. Columns of df named shard or slot are replaced.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    n, n_bytes = df.agg(F.count(F.lit(1)), F.sum(F.expr(size).cast("long"))).first()
    buckets = max(1, math.ceil(n / bucket_rows), math.ceil((n_bytes or 0) / BUCKET_BYTES))
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    scattered = (
        df.select(F.monotonically_increasing_id().alias("_rid"), row.alias("_row"))
        .select("_rid", "_row", F.expr(f"cast(pmod(xxhash64({seed}, _row.`{key}`, _rid), {buckets}) as int)").alias("_bucket"))
    )
    bucketed = durable(
        scattered.groupBy("_bucket").agg(F.collect_list(F.struct("_rid", "_row")).alias("_rows"))
        .withColumns({"_n": F.size("_rows"), "_super": F.col("_bucket") % SUPERS}),
        "shard-buckets",
    )
    # Places: buckets in order of (super, bucket). The totals of the at most SUPERS groups go through the driver.
    counts = bucketed.select("_super", "_bucket", "_n")
    totals, first, starts = dict(counts.groupBy("_super").agg(F.sum("_n")).collect()), 0, []
    for s in range(SUPERS):
        starts.append(first)
        first += totals.get(s, 0)
    running = "sum(_n) over (partition by _super order by _bucket rows between unbounded preceding and current row) - _n"
    places = counts.select("_bucket", F.expr(f"array({', '.join(f'{x}L' for x in starts)})[_super] + {running} as _first"))
    ordered = bucketed.withColumns({
        "_rows": F.expr("array_sort(_rows, (l, r) -> cast(sign(l._rid - r._rid) as int))"),
        "_perm": F.expr(fisher_yates("_n", str(seed), "_bucket")),
    }).join(places, "_bucket")
    place = F.col("_first") + F.col("_pos")
    return (
        ordered.select("_first", F.expr("posexplode(transform(_perm, p -> _rows[p]._row)) as (_pos, _row)"))
        .select(*(F.col("_row")[c].alias(c) for c in kept), (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard, rows in order of their slots within each file."""
    shuffled.repartition(F.col("shard"), F.floor(F.col("slot") / 65536)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return external_shuffle(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
