"""Passages that occur more than once, by longest-previous-factor arrays over suffix arrays of cuts.

Equal strings of LENGTH bytes are brought together first. Each of them has an anchor, the 64-byte gram in it with the
smallest hash, and equal strings have it at the same place. Texts are cut around the anchors whose gram occurs
elsewhere too. Equal cuts are counted as one first, so a passage with very many copies is small from here on; the
different cuts of one gram meet in one task. There their suffixes are put in order by prefix doubling, to the depth of
LENGTH bytes, with the common prefix of neighbours. In that order the nearest suffix to either side that starts earlier
in the text (previous and next smaller position) has the longest common prefix with a suffix that anything earlier
has: its longest previous factor. Where that reaches LENGTH, the string that starts there is a later copy. The same with
larger positions tells what has a copy later on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, durable, small, split_join

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
#: Bytes of cuts in one suffix array. Cuts of one gram stay together unless they are more than HEAVY.
BATCH = 1 << 20
#: Grams with more different cuts than this are resolved by digests of their strings instead, spread over tasks: a
#: suffix array takes some 60 bytes of memory for each byte of its cuts, which are of 270 bytes on average.
HEAVY = 20_000
BASE = 0x9E3779B97F4A7C15 | 1


def rolled(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all strings of that length, mixed."""
    out, have, total = None, 0, len(data) - length + 1
    part, size, power = data.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                piece = part[have : have + total]
                out = piece.copy() if out is None else out * np.uint64(power) + piece
                have += size
            if 2 * size > length:
                break
            part = part[:-size] * np.uint64(power) + part[size:]
            power = power * power % (1 << 64)
            size *= 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return out ^ (out >> np.uint64(29))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text: hash of its gram, first and last start of the strings that it is the anchor of."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = rolled(np.frombuffer(data, np.uint8), GRAM)
    n = len(hashes)
    keys = hashes >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64)  # ties: the first
    padded = np.full(-(-n // WINDOW) * WINDOW, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - WINDOW + 1
    at = (np.minimum(behind[:count], ahead[WINDOW - 1 : WINDOW - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], count) - 1
    return hashes[at[first]], first, last


def suffix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks) of falling lengths from depth to 8: the rank of each suffix among those cut at that length, equal
    for equal strings. By prefix doubling.

    Bytes beyond the end count as zeros; the caller sees to it that no string of interest reaches there.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = padded[:n].copy()
    for k in range(1, 8):
        key = key << np.uint64(8) | padded[k : k + n]
    levels = [(8, ranked(key))]
    while levels[-1][0] < depth:
        have, ranks = levels[-1]
        step = min(have, depth - have)
        shifted = np.zeros(n, np.uint64)
        shifted[: max(0, n - step)] = ranks[step:]
        levels.append((have + step, ranked(ranks.astype(np.uint64) * np.uint64(n + 1) + shifted)))
    return levels[::-1]


def ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    steps = np.zeros(len(key), np.uint32)
    sorted_ = key[order]
    steps[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]])).astype(np.uint32) if len(key) else 0
    return steps


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], at: np.ndarray, least: int = 0) -> np.ndarray:
    """For each of the suffixes at, in order, the length of its common prefix with the one before, up to the depth.

    Below least the value is not exact: where neighbours differ before, nothing shorter is looked at.
    """
    out = np.zeros(len(at), np.int64)
    todo = np.arange(1, len(at))
    depth = levels[0][0]
    shorter = [*levels[1:], *[(1, data)] * 7] if least < depth else []
    for length, ranks in [levels[0], *shorter]:
        a, b = at[todo - 1] + out[todo], at[todo] + out[todo]
        inside = np.maximum(a, b) < len(data)
        same = np.zeros(len(todo), bool)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        out[todo[same]] += length
        todo = todo[out[todo] < depth]
    return np.minimum(out, depth)


def nearest(at: np.ndarray, common: np.ndarray, least: int = 0) -> np.ndarray:
    """For each suffix, the common prefix with the nearest one before it, in suffix order, that has a smaller position; 0 where none has.

    at: positions in suffix order; common: common prefix with the one before. Each looks at the one before it; one that
    is larger passes on what it looks at itself, since all between are larger still. Below least the value is not exact.
    """
    to, low = np.arange(len(at)) - 1, common.copy()
    open_ = np.flatnonzero((to >= 0) & (at[to] > at) & (low >= max(least, 1)))
    while len(open_):
        via = to[open_]
        low[open_], to[open_] = np.minimum(low[open_], low[via]), to[via]
        on = (to[open_] >= 0) & (low[open_] >= max(least, 1))
        open_ = open_[on]
        open_ = open_[at[to[open_]] > at[open_]]
    low[to < 0] = 0
    return low


def previous_factors(at: np.ndarray, common: np.ndarray, least: int = 0) -> np.ndarray:
    """For each suffix in suffix order its longest previous factor: the most it has in common with any of a smaller position."""
    after = np.append(common[1:], 0)[::-1]
    return np.maximum(nearest(at, common, least), nearest(at[::-1], after, least)[::-1])


def repeats(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the cuts in order of their places: starts (in the joined cuts) of strings of LENGTH bytes, whether one equal
    to it starts earlier, and whether one starts later."""
    data = np.frombuffer(b"".join(cuts), np.uint8)
    ends = np.cumsum([len(c) for c in cuts])
    starts = ends - [len(c) for c in cuts]
    counts = np.maximum(0, ends - starts - LENGTH + 1)
    whole = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    levels = suffix_ranks(data, LENGTH)
    # Equal strings in order of their places; one sort of rank and number together is faster than an argsort.
    order = (np.sort(levels[0][1][whole].astype(np.uint64) << np.uint64(32) | np.arange(len(whole), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = whole[order]
    common = common_prefixes(data, levels, at, LENGTH)
    earlier, later = np.zeros(len(whole), bool), np.zeros(len(whole), bool)
    earlier[order] = previous_factors(at, common, LENGTH) >= LENGTH
    later[order] = previous_factors(-at, common, LENGTH) >= LENGTH
    return whole, earlier, later


def runs(flags: np.ndarray) -> list[list[int]]:
    """[first, last] of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [[int(a), int(b) - 1] for a, b in edges.reshape(-1, 2)]


PLACE = "struct<null:boolean,doc:long,th:long,tc:long,lo:int>"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each text and different gram among its anchors, with the first and last starts of the strings of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ths, tcs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2)
            for k in range(0, len(ths), 1024):
                grams, sizes, counts, los, his = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for t in texts.slice(k, 1024).to_pylist():
                    gram, lo, hi = anchors(t.encode("utf-8", "surrogatepass"))
                    order = np.argsort(gram, kind="stable")
                    gram = gram[order]
                    first = np.flatnonzero(np.diff(gram, prepend=~gram[:1])) if len(gram) else np.zeros(0, np.int64)
                    grams.append(gram[first])
                    sizes.append(len(first))
                    counts.append(np.diff(np.append(first, len(gram))))
                    los.append(lo[order])
                    his.append(hi[order])
                ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (los, his)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(ths[k : k + 1024], sizes)), pa.array(np.repeat(tcs[k : k + 1024], sizes)), *lists], names=["gram", "th", "tc", "los", "his"])

    return docs.mapInArrow(run, "gram long, th long, tc long, los array<int>, his array<int>")


def cut_rows(marked: DataFrame) -> DataFrame:
    """gram, ch (digest of the cut), doc, th, tc, los (where it starts), cut: the different cuts around each text's marked anchors."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
    names = ["gram", "ch", "doc", "th", "tc", "los", "cut"]

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in names]
            for doc, th, tc, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for m in marks:
                    found: dict[bytes, list[int]] = {}
                    for lo, hi in zip(m["los"], m["his"], strict=True):
                        found.setdefault(data[lo : hi + LENGTH], []).append(lo)
                    for cut, los in found.items():
                        for column, value in zip(out, (m["gram"], hashlib.blake2b(cut, digest_size=16).digest(), doc, th, tc, sorted(los), cut), strict=True):
                            column.append(value)
                if len(out[0]) >= 20_000:
                    yield made(out)
                    out = [[] for _ in names]
            yield made(out)

    return marked.mapInArrow(run, "gram long, ch binary, doc long, th long, tc long, los array<int>, cut binary")


FOUND = "gram long, ch binary, anywhere array<array<int>>, later array<array<int>>"


def resolved(cuts: DataFrame) -> DataFrame:
    """Of different cuts (gram, ch, place, cut) that come sorted by gram: gram, ch, anywhere and later, the first and last
    bytes within the cut of what has an equal string in another cut (or again in this one), and of what has one earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        gram = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != gram:
                    if size >= BATCH:
                        yield solve(held)
                        held, size = [], 0
                    gram = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[2]["null"], r[2]["doc"] or 0, r[2]["th"], r[2]["tc"], r[2]["lo"]))
        whole, earlier, after = repeats([r[3] for r in held])
        owner = np.searchsorted(np.cumsum([len(r[3]) for r in held]), whole, side="right")
        bounds = np.searchsorted(owner, np.arange(len(held) + 1))
        spans = lambda flags: [[[x, y + LENGTH - 1] for x, y in runs(flags[a:b])] for a, b in zip(bounds, bounds[1:], strict=False)]
        kinds = pa.list_(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary()), pa.array(spans(earlier | after), kinds), pa.array(spans(earlier), kinds)], names=["gram", "ch", "anywhere", "later"])

    return cuts.select("gram", "ch", "place", "cut").mapInArrow(run, FOUND)


def spread(cuts: DataFrame) -> DataFrame:
    """What resolved() gives, for grams with very many different cuts: equal strings meet by a 128-bit digest each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                strings, rows, ats = [], [], []
                for row, cut in enumerate(part.column(3).to_pylist()):
                    n = len(cut) - LENGTH + 1
                    strings += [hashlib.blake2b(cut[at : at + LENGTH], digest_size=16).digest() for at in range(n)]
                    rows += [row] * n
                    ats += range(n)
                taken = part.select(["gram", "ch", "place"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(strings, pa.binary()), pa.array(ats, pa.int32())], names=["gram", "ch", "place", "string", "at"])

    strings = durable(cuts.select("gram", "ch", "place", "cut").mapInArrow(run, f"gram long, ch binary, place {PLACE}, string binary, at int"), "strings")
    where = F.struct("place", "at", "ch")
    known = strings.groupBy("string").agg(F.min(where).alias("least"), F.max(where).alias("most")).where(F.col("least") != F.col("most")).select("string", "least")
    span = F.array(F.col("at"), F.col("at") + LENGTH - 1)
    each = strings.join(known, "string").select("gram", "ch", span.alias("span"), F.when(where != F.col("least"), span).alias("after"))
    return each.groupBy("gram", "ch").agg(F.collect_list("span").alias("anywhere"), F.collect_list("after").alias("later"))


def digests(docs: DataFrame, text_col: str) -> list:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("th"), F.crc32(text.cast("binary")).alias("tc"), text.alias("_text")]


def passages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """th, tc (digests of a text), n (rows with this text), first (their smallest doc_id), spans and later: bytes of the
    text, first and last, covered by strings of LENGTH bytes that occur anywhere else, and that occur earlier.

    Only texts that have any, or several rows. A text with several rows recurs as a whole; its spans do not say so.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), *digests(docs, text_col))
    copies = base.groupBy("th", "tc").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
    rows = durable(anchor_rows(base.select("th", "tc", "_text")), "anchors")
    # Grams of several texts, or at several places of one.
    text = F.xxhash64("th", "tc")
    grams = rows.groupBy("gram").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.max(F.size("los")).alias("places"), F.count(F.lit(1)).alias("n"))
    grams = durable(grams.where("lo != hi or places > 1").select("gram", "n"), "grams")
    shared = split_join(rows, grams, "gram", "n", grams.agg(F.sum("n")).first()[0] or 0, "th")
    marks = durable(shared.groupBy("th", "tc").agg(F.collect_set(F.struct("gram", "los", "his")).alias("marks")), "marks")
    marked = base.join(marks.join(copies, ["th", "tc"]).withColumnRenamed("th", "_th").withColumnRenamed("tc", "_tc"), (F.col("th") == F.col("_th")) & (F.col("tc") == F.col("_tc")) & F.col("doc").eqNullSafe(F.col("first")))
    cuts = durable(cut_rows(marked.select("doc", "th", "tc", "_text", "marks")), "cuts")
    place = F.struct(F.col("doc").isNull().alias("null"), "doc", "th", "tc", F.col("los")[0].alias("lo"))
    # Several starts in one text, or several texts, make a cut recur as a whole.
    different = durable(cuts.groupBy("gram", "ch").agg(F.first("cut").alias("cut"), F.min(place).alias("place"), F.max(place).alias("_last"), F.max(F.size("los")).alias("_most")), "different")
    sizes = different.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    sized = split_join(different, sizes, "gram", "_n", different.count(), "ch")
    solved = resolved(sized.where(F.col("_n") <= HEAVY).repartition("gram").sortWithinPartitions("gram"))
    if sizes.where(F.col("_n") > HEAVY).take(1):
        solved = solved.unionByName(spread(sized.where(F.col("_n") > HEAVY)))
    known = different.select("gram", "ch", "place", ((F.col("place") != F.col("_last")) | (F.col("_most") > 1)).alias("again"), (F.octet_length("cut") - 1).alias("_end")).join(solved, ["gram", "ch"])
    known = known.where(F.col("again") | (F.size("anywhere") > 0))
    back = cuts.select("gram", "ch", "doc", "th", "tc", "los").join(known, ["gram", "ch"])
    moved = lambda spans, los: f"flatten(transform({los}, lo -> transform({spans}, x -> array(lo + x[0], lo + x[1]))))"
    full = "transform({0}, lo -> array(lo, lo + _end))"
    spans = back.select("th", "tc", F.expr(f"case when again then {full.format('los')} else {moved('anywhere', 'los')} end").alias("spans"), F.when(place == F.col("place"), F.expr(f"concat({moved('later', 'slice(los, 1, 1)')}, {full.format('slice(los, 2, size(los))')})")).otherwise(F.expr(full.format("los"))).alias("later"))
    some = durable(spans, "passages").groupBy("th", "tc").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("later")).alias("later"))
    return copies.join(some, ["th", "tc"], "left").where((F.col("n") > 1) | F.col("spans").isNotNull())


def removed(n: int, spans: list[list[int]]) -> np.ndarray:
    """[first, end] of the maximal runs that spans, first and last bytes, cover of n bytes."""
    change = np.zeros(n + 1, np.int32)
    if spans:
        edges = np.array(spans)
        np.add.at(change, edges[:, 0], 1)
        np.add.at(change, edges[:, 1] + 1, -1)
    covered = np.cumsum(change[:n]) > 0
    return np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).reshape(-1, 2)


def whole_characters(data: bytes, first: int, end: int) -> tuple[int, int]:
    """The span without the bytes of characters that it only holds a part of."""
    while first < end and data[first] & 0xC0 == 0x80:
        first += 1
    while first < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return first, max(first, end)


def with_spans(docs: DataFrame, text_col: str, keep_first: bool) -> DataFrame:
    """_row (all columns of docs), _text and _spans to remove."""
    found = passages(docs, text_col).withColumnRenamed("th", "_th").withColumnRenamed("tc", "_tc")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    base = docs.select(row, F.col("doc_id").cast("long").alias("_doc"), *digests(docs, text_col))
    joined = base.join(found, (F.col("th") == F.col("_th")) & (F.col("tc") == F.col("_tc")), "left")
    n = F.octet_length("_text")
    again = (F.col("n") > 1) & (n >= LENGTH) & (~F.col("_doc").eqNullSafe(F.col("first")) if keep_first else F.lit(True))
    part = F.col("later" if keep_first else "spans")
    return joined.select("_row", "_text", F.when(again, F.array(F.array(F.lit(0), n - 1))).otherwise(part).alias("_spans"))


def repeated_bytes(docs: DataFrame, text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each text without what recurs (or recurs of what came earlier).

    Earlier is by doc_id, nulls last; rows of equal doc_id and text are one document then. Null texts are empty, and
    texts under LENGTH bytes lose nothing. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = removed(len(data), spans or []).tolist() if spans else []
                kept = b"".join([data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(f for f, _ in gone), len(data)], strict=True)]) if gone else data
                for column, value in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = with_spans(docs.select("doc_id", text_col), text_col, keep_first)
    return spans.select(F.col("_row.doc_id").cast("long").alias("doc_id"), "_text", "_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, text_col: str = "text", keep_first: bool = True) -> DataFrame:
    """docs with later copies of passages (or all copies) cut out of the text, other columns as they were.

    Characters are cut whole. A null text stays null.
    """
    schema = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if spans:
                    data, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
                    for a, b in removed(len(data), spans).tolist():
                        a, b = whole_characters(data, a, b)
                        parts.append(data[at:a])
                        at = b
                    text = b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    cut = with_spans(docs, text_col, keep_first).mapInArrow(run, schema)
    text = F.when(F.col("_row")[text_col].isNotNull(), F.col("_text"))
    return cut.select(*((text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns))


def op6_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir))
