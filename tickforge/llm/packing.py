"""Packing documents into as few sequences of bounded length as possible.

Documents are encoded, closed with id 0, and only those that are longer than a sequence are cut. The pieces are
packed in groups of bounded size: best-fit decreasing first, then a swap-based local search that exchanges one for
one, two for one, or moves documents between underfull bins. Each step raises the sum of squared fills, so it
ends; bins that run empty are dropped.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, durable, small
from ._words import Remembered, Spec, byte_symbols

SEQUENCE = 2048
#: Pieces in one packing task. A group wastes less than a bin against packing all of them at once, or so.
GROUP = 16384


class TextIds(Remembered[bytes]):
    """Token ids of whole texts by the tokenizers library, as little-endian 32-bit bytes.

    Words are split into pieces here, each of which goes through the library's model once. A word that a special
    token could stand in goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, spec = Tokenizer.from_file(path), Spec(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special, self.shown = tuple(spec.special), byte_symbols()
        super().__init__(spec, self.modelled, b"".join, self.alone, self.with_special, 400_000)

    def alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def modelled(self, pieces: list[str]) -> list[bytes]:
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        found = [[t.id for t in tokenize(p if p.isascii() and p.isprintable() else "".join([shown[b] for b in p.encode()]))] for p in pieces]
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def with_special(self, word: str) -> bool:
        return "<" in word and any(s in word for s in self.special)

    def encode(self, text: str) -> bytes:
        return b"".join(next(self([text])))


@functools.cache
def text_ids(path: str) -> TextIds:
    """One for each worker process and file, so that later tasks find the words known."""
    return TextIds(path)


def pieces(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids (little-endian 32-bit) of every document.

    A null or empty text is the one id 0. Documents of more than most ids are cut into pieces of that length; the
    last may be shorter. Rows with null or repeated doc_id are kept as they are. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(tokenizer)
        step = 4 * most
        for batch in small(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, values in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = b"".join(values) + b"\0\0\0\0"
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(rows, (doc, i, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that still takes it."""
    free: list[list[int]] = [[] for _ in range(most + 1)]  # by room left: bins
    mask, bins = 0, []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        if fits := mask >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            bins[b].append(item)
        else:
            room, b = most, len(bins)
            bins.append([item])
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], most: int) -> list[list[int]]:
    """Try to empty the least filled bins into the others by moves and swaps that raise the sum of squared fills.

    A step takes from the source bin one item into a target with room for it, or one item for a smaller one of the
    target, or two items for one that is smaller than both together. It ends where no step is left between any two
    bins, or at as many bins as the total needs. A pair of bins is tried again only after one of them has changed.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // most)
    live = {b for b in range(len(bins)) if bins[b]}
    rooms = sorted((most - fill[b], b) for b in live if fill[b] < most)
    clock, changed, tried = 0, [0] * len(bins), [-1] * len(bins)  # tried: the clock when no step from a bin was left

    def room_changes(b: int, by: int) -> None:
        if fill[b] < most:
            rooms.pop(bisect_left(rooms, (most - fill[b], b)))
        fill[b] += by
        changed[b] = clock
        if fill[b] < most and bins[b]:
            insort(rooms, (most - fill[b], b))

    def step(source: int) -> bool:
        nonlocal clock
        since = tried[source] if changed[source] <= tried[source] else -1
        for x in sorted(bins[source], key=lambda i: -lengths[i]):
            at = next((k for k in range(bisect_left(rooms, (lengths[x], -1)), len(rooms)) if rooms[k][1] != source and fill[rooms[k][1]] > fill[source] - lengths[x]), None)
            if at is not None:
                clock += 1
                target = rooms[at][1]
                bins[source].remove(x)
                bins[target].append(x)
                room_changes(target, lengths[x])
                room_changes(source, -lengths[x])
                return True
        for room, target in reversed(rooms):  # the most room first
            if target == source or fill[target] < fill[source] or changed[target] <= since:
                continue
            swap = best_swap(bins[source], bins[target], room, lengths)
            if swap:
                clock += 1
                give, take = swap
                for i in give:
                    bins[source].remove(i)
                    bins[target].append(i)
                bins[target].remove(take)
                bins[source].append(take)
                by = sum(lengths[i] for i in give) - lengths[take]
                room_changes(target, by)
                room_changes(source, -by)
                return True
        tried[source] = clock
        return False

    moved = True
    while moved and len(live) > least:
        moved = False
        for source in sorted(live, key=lambda b: fill[b]):
            if len(live) <= least:
                break
            while bins[source] and step(source):
                moved = True
            if not bins[source]:
                live.discard(source)
    return [b for b in bins if b]


def best_swap(source: list[int], target: list[int], room: int, lengths: list[int]) -> tuple[list[int], int] | None:
    """What of source (one item or two) to give for which item of target, so that target gains most; None if nothing does."""
    best, found = 0, None
    held = sorted(source, key=lambda i: lengths[i])
    sizes = [lengths[i] for i in held]
    for y in {lengths[i]: i for i in target}.values():
        bound = room + lengths[y]
        k = bisect_right(sizes, bound) - 1
        if k >= 0 and sizes[k] - lengths[y] > best:
            best, found = sizes[k] - lengths[y], ([held[k]], y)
        i, j = 0, len(sizes) - 1
        while i < j:  # the largest sum of two within the bound
            both = sizes[i] + sizes[j]
            if both > bound:
                j -= 1
                continue
            if both - lengths[y] > best:
                best, found = both - lengths[y], ([held[i], held[j]], y)
            i += 1
        if best == room:
            break
    return found


def pack(parts: DataFrame, most: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """parts with sequence_id and offset: no sequence over most ids, offsets gapless from 0.

    parts needs a column length, from 1 to most; other columns are carried along, those named sequence_id or
    offset are replaced. Full pieces are sequences of their own; the others are packed in groups of about that many
    pieces, drawn by a hash of the row's number, so that no key can make a group large.
    """
    kept = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    fixed = durable(parts.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*kept).alias("_part")), "pieces")
    short = fixed.where(F.col("_part.length") < most).select("_rid", F.col("_part.length").alias("_length"))
    groups = max(1, math.ceil(short.count() / group))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_rid")
        lengths, rids = frame["_length"].tolist(), frame["_rid"].to_numpy()
        rows = []
        for b, items in enumerate(local_search(best_fit(lengths, most), lengths, most)):
            at = 0
            for i in items:
                rows.append((rids[i], b, at))
                at += lengths[i]
        out = pd.DataFrame(rows, columns=["_rid", "sequence_id", "offset"])
        out["sequence_id"] += int(frame["_group"].iloc[0]) << 32
        return out

    # Twice as many hash values as groups' numbers would leave some empty; a range of the hash fills them alike.
    dealt = short.withColumn("_group", F.pmod(F.xxhash64(F.lit(29), "_rid"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInPandas(one, "_rid long, sequence_id long, offset long")
    whole = fixed.where(F.col("_part.length") >= most).select("_rid", (-F.col("_rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return fixed.join(packed.unionByName(whole), "_rid").select(*(F.col("_part")[c].alias(c) for c in kept), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, from pieces that carry their ids. A sequence has a bounded length."""
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.size(whole).alias("n_pieces"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return pack(parts.drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
