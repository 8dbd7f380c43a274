"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

A document has two collections of SIDE short signatures of DEPTH minhashes each. Every pair of one from either
collection is a table key, so SIDE ** 2 tables of 2 * DEPTH hashes cost 2 * SIDE * DEPTH minhashes. Two documents of
similarity s share a key unless they differ throughout one collection, with a chance below 2 (1 - s**DEPTH)**SIDE:
0.0008 at 0.8, 0.00002 at 0.87.

Documents with equal sets form one class at first; only classes are compared. In each bucket (documents that share a
key) all are compared with one centre, the document that shares most keys with others: as many pairs as members. What
that leaves in several components is compared across them, by prefix and position: each set's shingles are put in one
order, rarest first, and a pair is formed only at a shingle early enough in both that what follows it could still make
up the overlap that the similarity asks for. Every link passes that at its first common shingle, so none is lost, while
documents that merely share a passage, or differ from a common original each in its own way, form no pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, durable, small, split_join

DEPTH, SIDE = 3, 11
#: A pair of a bucket and its centre is confirmed on the sets if this share of its minhashes is equal: six standard
#: deviations below 0.8, so that a pair of 0.8 is lost with a chance below 0.0000001.
LEAST_AGREEING = 0.5
#: Edges that one task contracts, on average.
LOCAL_EDGES = 500_000
HASHES = DEPTH * 2 * SIDE
MIX = np.random.default_rng(20).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64) | np.uint64(1)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * C2
    return x ^ (x >> np.uint64(29))


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of the n-word shingles of text, A-Z folded. With fewer words, all of them as one."""
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").lower().split())), dtype=np.uint64)
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        if len(hashes) < n:
            out = C3 * np.uint64(len(hashes))
            for h in hashes:
                out = mixed(np.array([out * C1 + h], dtype=np.uint64))[0]
            return np.array([out], dtype=np.uint64)
        out = np.full(len(hashes) - n + 1, C3, dtype=np.uint64)
        for k in range(n):
            out = mixed(out * C1 + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(out)


def minhashes(found: np.ndarray) -> np.ndarray:
    out = np.empty(HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), 4096):
            part = ((found[k : k + 4096, None] ^ MIX[0]) * MIX[1]).min(axis=0)
            out = part if not k else np.minimum(out, part)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Fixed rows of _rid, doc_id, th, tc (digests of the text), n_shingles, cls (digest of the set), hashes, short signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, classes, hashes, shorts = [], [], [], []
            for text in batch.column(3).to_pylist():
                found = shingles(text or "", n)
                sizes.append(len(found))
                classes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if not len(found):
                    hashes.append(None)
                    shorts.append(None)
                    continue
                mins = minhashes(found)
                hashes.append(mins.view(np.int32))
                with np.errstate(over="ignore"):
                    short = np.zeros(HASHES // DEPTH, dtype=np.uint64)
                    for part in mins.reshape(-1, DEPTH).T:
                        short = mixed(short * C1 + part)
                shorts.append(short.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(hashes, pa.list_(pa.int32())), pa.array(shorts, pa.list_(pa.int64()))],
                names=["doc_id", "th", "tc", "n_shingles", "cls", "hashes", "shorts"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.crc32(text.cast("binary")).alias("tc"), text.alias("text"))
    made = read.mapInArrow(run, "doc_id long, th long, tc long, n_shingles long, cls binary, hashes array<int>, shorts array<long>")
    return durable(made.withColumn("_rid", F.monotonically_increasing_id()), "signatures")


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the edges of one task, of bounded number, an edge from each node to the smallest that it reaches by them."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) of every node on an edge (u, v), by alternating large and small stars.

    Each round is written out; only counts reach the driver. A hub's edges meet in joins that can be split, its
    smallest neighbour in a sum that is formed before shuffling.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # u > v throughout
            least = pairs.groupBy("u").agg(F.min("v").alias("m"))
            out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    state = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    # Chains shorten in each task first; rounds then join what lies in several.
    state = durable(state.coalesce(max(1, math.ceil(state.count() / LOCAL_EDGES))).mapInArrow(contracted, "u long, v long"), "edges")
    told = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told or not now[0]:
            break
        told = now
        state = durable(star(star(state, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()


def text_columns(docs: DataFrame) -> DataFrame:
    """id, th, tc (digests of the text) and text of every row; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.crc32(text.cast("binary")).alias("tc"), text.alias("text"))


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the classes in wanted (node, distinct). Written out. Of a class's copies only the first row's text is read."""
    asked = wanted.join(nodes.select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("tc").alias("_tc")), "node")
    rows = text_columns(docs)
    same = (F.col("th") == F.col("_th")) & (F.col("tc") == F.col("_tc")) & F.col("id").eqNullSafe(F.col("_id"))
    return durable(rows.join(asked, same).groupBy("node").agg(F.min("text").alias("text")), "near-texts")


def agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that are of like size and have enough minhashes in common."""
    sized = nodes.select("node", "n_shingles", "hashes")
    agree = F.expr(f"size(filter(zip_with(hashes, hashes_v, (x, y) -> x = y), e -> e)) >= {LEAST_AGREEING} * {HASHES}")
    return (
        pairs.join(sized.withColumnRenamed("node", "u"), "u")
        .join(sized.select(F.col("node").alias("v"), F.col("n_shingles").alias("n_v"), F.col("hashes").alias("hashes_v")), "v")
        .where((100 * F.least("n_shingles", "n_v") >= percent * F.greatest("n_shingles", "n_v")) & agree)
        .select("u", "v")
    )


def confirmed(near: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets' intersection is at least percent % of their union. Written out."""
    near = durable(near, "near-pairs")
    texts = texts_of(near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct(), nodes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            known: dict[int, np.ndarray] = {}
            kept = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for node, t in ((u, a), (v, b)):
                    if node not in known:
                        known[node] = shingles(t, n)
                common = len(np.intersect1d(known[u], known[v], assume_unique=True))
                kept.append(100 * common >= percent * (len(known[u]) + len(known[v]) - common))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    full = near.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").select("u", "v", "a", "b")
    return durable(full.mapInArrow(run, "u long, v long"), "links")


def sharing_rare(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (u, v) across components of wanted (node, component) that the order of their shingles does not rule out.

    Two sets of a and b shingles that reach the similarity t have t / (1 + t) of a + b in common at least. Shingles
    are ordered by how many sets have them. At the first common one, what each set has from there on must make that up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            sets = [shingles(t, n).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = durable(texts_of(wanted.select("node"), nodes, docs).mapInArrow(run, "node long, shingles array<long>"), "shingles")
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    # Shingles of one set alone are the rarest; they take their places in the order without being listed.
    ranked = each.join(common, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    sized = ranked.join(sets.select("node", F.size("shingles").alias("m")), "node").join(wanted, "node")
    # The larger of two sets shares one of its first m - percent % of m, + 1.
    early = f"slice(ranked, 1, greatest(0, m - cast(ceil(m * {percent} / 100) as int) + 1 - (m - size(ranked))))"
    placed = sized.select("node", "component", "m", (F.col("m") - F.size("ranked")).alias("alone"), F.posexplode(F.expr(early)).alias("pos", "r"))
    prefix = durable(placed.select("node", "component", "m", (F.col("m") - F.col("alone") - F.col("pos")).alias("rest"), F.col("r.shingle").alias("shingle")), "rare")
    # rest: the shingles of the set from this one on.
    enough = lambda rest, a, b: (100 + percent) * rest >= percent * (a + b)
    a, b = prefix.where(enough(F.col("rest"), F.col("m"), F.col("m"))).alias("a"), prefix.alias("b")
    smaller = (F.col("a.m") < F.col("b.m")) | ((F.col("a.m") == F.col("b.m")) & (F.col("a.node") < F.col("b.node")))
    like = 100 * F.col("a.m") >= percent * F.col("b.m")
    reach = enough(F.least("a.rest", "b.rest"), F.col("a.m"), F.col("b.m"))
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & smaller & (F.col("a.component") != F.col("b.component")) & like & reach)
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def classes_and_links(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of signatures(), their classes (cls, node, copies, first), and node, component of all that are linked."""
    rows = signatures(docs, n)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "_rid")).alias("first")
    classes = durable(rows.where(F.col("n_shingles") > 0).groupBy("cls").agg(F.min("_rid").alias("node"), F.count(F.lit(1)).alias("copies"), first), "sets")
    nodes = durable(rows.join(classes.select(F.col("node").alias("_rid")), "_rid", "left_semi").withColumnRenamed("_rid", "node").drop("cls"), "classes")
    tensor = f"flatten(transform(slice(shorts, 1, {SIDE}), (a, i) -> transform(slice(shorts, {SIDE + 1}, {SIDE}), (b, j) -> xxhash64(i, j, a, b))))"
    keys = nodes.select("node", F.explode(F.expr(tensor)).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = durable(keys.join(shared, "key"), "buckets")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    pairs = members.join(centres, "key").where(F.col("node") != F.col("centre")).select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()
    links = confirmed(agreeing(pairs, nodes, percent), nodes, docs, n, percent)
    found = durable(components(links), "components")

    # Buckets of three and more that still hold several components: compare across them.
    placed = members.where(F.col("size") > 2).join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    crowd = durable(placed.join(apart, "key").select("node", "component").distinct(), "crowd")
    more = confirmed(sharing_rare(crowd, nodes, docs, n, percent), nodes, docs, n, percent)
    if more.take(1):
        links = links.unionByName(more)
        found = durable(components(links), "components")
    return rows, classes, found


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the document's group), kept, th, tc, first and _rid.

    Null and empty texts, and texts of white space alone, are linked with nothing. first marks one row of each group,
    the smallest by doc_id (nulls last), even where doc_ids repeat or are null; kept is doc_id = component_id, for a
    null doc_id the same as first. th and tc are digests of the text, _rid numbers the rows. An empty table gives no rows.

    Groups are named on classes, whose names then go to the rows; both joins deal large groups to several tasks.
    """
    rows, classes, found = classes_and_links(docs, n, percent)
    total = rows.count()
    grouped = classes.join(found, "node", "left").select("cls", "copies", "first", F.coalesce("component", "node").alias("_group"))
    heads = grouped.groupBy("_group").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("classes"))
    named = split_join(grouped, heads, "_group", "classes", total, "cls").select("cls", "copies", F.col("head.id").alias("component_id"), F.col("head._rid").alias("_head"))
    texts = split_join(rows.where(F.col("n_shingles") > 0), named, "cls", "copies", total, "_rid")
    lone = rows.where(F.col("n_shingles") == 0).withColumns({"component_id": F.col("doc_id"), "_head": F.col("_rid")})
    columns = ["doc_id", "n_shingles", "component_id", "th", "tc", "_rid", "_head"]
    out = texts.select(*columns).unionByName(lone.select(*columns)).withColumn("first", F.col("_rid") == F.col("_head"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first")).alias("kept"), "th", "tc", "first", "_rid")


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns as they were.

    Of rows that repeat with the same doc_id and text one stays; which one is open if other columns differ.
    """
    kept = near_duplicates(docs, n, percent)
    heads = durable(kept.where("first").select("doc_id", "th", "tc"), "heads")
    again = durable(kept.groupBy("doc_id", "th", "tc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "again")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_th"), F.crc32(text.cast("binary")).alias("_tc"))
    same = lambda other: F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_th") == other["th"]) & (F.col("_tc") == other["tc"])
    stay = row.join(heads, same(heads), "left_semi")
    if again.take(1):
        repeated = stay.join(again, same(again), "left_semi").groupBy("_id", "_th", "_tc").agg(F.first("_row").alias("_row")).select("_row")
        stay = stay.join(again, same(again), "left_anti").select("_row").unionByName(repeated)
    return stay.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def op5_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=2).select("doc_id", "n_shingles", "component_id", "kept")
