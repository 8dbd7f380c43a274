"""GIF as media columns: an encoder and a decoder of LZW code streams, palettes, disposal, transparency, timed frames.

Bytes are stored losslessly as palette indices, 64 to a row, in frames of at most FRAME_ROWS rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents

WIDTH, FRAME_ROWS, DELAY = 64, 1024, 10
MOST_BITS = 12


def widths(least: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a minimum code size: as many as the decoder's next entry needs."""
    entry = (1 << least) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.clip(np.floor(np.log2(entry)).astype(np.int64) + 1, least + 1, MOST_BITS)


#: Data codes between two clear codes of the encoder: then the table is full.
RUN = (1 << MOST_BITS) - 258
RUN_WIDTHS = widths(8, RUN + 1)


def lzw_encode(data: bytes) -> bytes:
    """The packed code stream of 8-bit samples: clear, codes, clear, ..., end."""
    runs: list[list[int]] = [[256]]
    known: dict[int, int] = {}
    codes: list[int] = []
    emit = codes.append
    find = known.get
    last, following = data[0] if data else -1, 258
    for b in memoryview(data)[1:]:
        key = last << 8 | b
        code = find(key)
        if code is not None:
            last = code
            continue
        emit(last)
        known[key] = following
        following += 1
        last = b
        if following == 258 + RUN:
            emit(256)
            runs.append(codes)
            codes = []
            emit = codes.append
            known.clear()
            following = 258
    if last >= 0:
        emit(last)
    emit(257)
    runs.append(codes)
    values = np.array([c for run in runs for c in run], dtype=np.uint16)
    bits = np.concatenate([[9], *(RUN_WIDTHS[: len(run)] for run in runs[1:])])
    spread = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(spread[np.arange(16) < bits[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int) -> bytes:
    """The samples of a packed code stream. Tolerates a missing end code; a code that can't occur ends the image."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    n_bits, at = 8 * len(stream), 0
    fresh = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    emit = out.append
    table, prev, first = list(fresh), b"", True
    add = table.append
    size = 1 << MOST_BITS
    pattern = widths(least, size + 1)
    done = 0  # codes since the last clear
    while at < n_bits:
        bits = pattern[done : done + size] if done < size else np.full(size, MOST_BITS)
        ends = at + np.cumsum(bits)
        bits = bits[: int(np.searchsorted(ends, n_bits, side="right"))]
        if not len(bits):
            break
        ends = ends[: len(bits)]
        starts = ends - bits
        byte = starts >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7) & ((1 << bits) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        told = codes[:n].tolist()
        if first and told:
            if told[0] >= clear:
                break
            prev, first = fresh[told[0]], False
            emit(prev)
            del told[0]
        room = size - len(table)
        for code in told[:room]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    return b"".join(out)
                entry = prev + prev[:1]
            add(prev + entry[:1])
            emit(entry)
            prev = entry
        if len(told) > room:  # the table is full
            out += [table[code] for code in told[room:]]
            prev = out[-1]
        if n == len(codes):
            at, done = int(ends[-1]), done + n
        elif codes[n] == end:
            break
        else:
            at, done, table, first = int(ends[n]), 0, list(fresh), True
            add = table.append
    return b"".join(out)


class Frame(NamedTuple):
    delay: int  # hundredths of a second
    disposal: int
    transparent: int  # palette index, or -1
    left: int
    top: int
    indices: np.ndarray  # height x width
    colours: np.ndarray  # palette, n x 3


def rgb332() -> np.ndarray:
    """The palette of stored bytes: three bits of red, three of green, two of blue."""
    k = np.arange(256)
    return np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 85], axis=1).astype(np.uint8)


PALETTE = rgb332()


def blocks(data: bytes) -> bytes:
    return b"".join([bytes([len(part := data[k : k + 255])]) + part for k in range(0, len(data), 255)]) + b"\0"


def encode_gif(frames: list[Frame], width: int, height: int) -> bytes:
    """GIF89a with the first frame's palette as the global one; frames that differ from it bring their own. 8-bit indices."""
    table = frames[0].colours
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), table.tobytes().ljust(768, b"\0")]
    for f in frames:
        own = f.colours is not table
        h, w = f.indices.shape
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | (f.transparent >= 0), f.delay, max(0, f.transparent), 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, 0x87 if own else 0))
        if own:
            out.append(f.colours.tobytes().ljust(768, b"\0"))
        out.append(b"\x08" + blocks(lzw_encode(f.indices.tobytes())))
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF file. Raises ValueError if it is none; a file that breaks off gives what it has."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, table = 13, np.zeros((0, 3), np.uint8)

    def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 3 * (2 << (flags & 7))
        part = data[at : at + n].ljust(n, b"\0")
        return np.frombuffer(part, np.uint8).reshape(-1, 3), at + n

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    if flags & 0x80:
        table, at = palette(at, flags)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = joined(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, key = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, key if packed & 1 else -1
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = table
            if packed & 0x80:
                colours, at = palette(at, packed)
            least = data[at] if at < len(data) else 8
            stream, at = joined(at + 1)
            samples = lzw_decode(stream, min(max(least, 1), 11))[: w * h].ljust(w * h, b"\0")
            indices = np.frombuffer(samples, np.uint8).reshape(h, w)
            if packed & 0x40:  # interlaced: rows come in four passes
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                placed = np.empty_like(indices)
                placed[order] = indices
                indices = placed
            frames.append(Frame(delay, disposal, transparent, left, top, indices, colours))
            delay, disposal, transparent = 0, 0, -1
        else:
            break
    return width, height, frames


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas that each frame shows, height x width x 4 (RGBA), after the disposal rules of the frames before it."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        rows, cols = slice(f.top, min(height, f.top + f.indices.shape[0])), slice(f.left, min(width, f.left + f.indices.shape[1]))
        area = canvas[rows, cols]
        indices = f.indices[: area.shape[0], : area.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.colours), :3] = f.colours
        colours[:, 3] = 255
        painted = colours[indices]
        if f.transparent >= 0:
            painted = np.where((indices == f.transparent)[..., None], area, painted)
        canvas[rows, cols] = painted
        yield canvas
        if f.disposal == 2:
            canvas[rows, cols] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colours: the two high bits of red, green and blue. Pixels never painted do not count."""
    flat = canvas.reshape(-1, 4)
    bins = (flat[:, 0] >> 6).astype(np.int64) << 4 | flat[:, 1] >> 6 << 2 | flat[:, 2] >> 6
    return np.bincount(bins, weights=flat[:, 3] > 0, minlength=64).astype(np.int64)


def payload(text: str) -> bytes:
    """The UTF-8 bytes of text with bytes 0 up to a positive multiple of 64."""
    raw = text.encode()
    return raw + b"\0" * (WIDTH - len(raw) if not raw else -len(raw) % WIDTH)


def store(samples: bytes) -> bytes:
    """A GIF file of samples, a multiple of 64 bytes, as rows of 64 palette indices."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    return encode_gif([Frame(DELAY, 1, -1, 0, 0, rows[k : k + FRAME_ROWS], PALETTE) for k in range(0, len(rows), FRAME_ROWS)], WIDTH, min(len(rows), FRAME_ROWS))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text as a GIF file. A null text is as an empty one: 64 bytes 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # media of a bounded number of texts at a time
                texts = [t or "" for t in batch.column(1).slice(k, 512).to_pylist()]
                kept = [store(payload(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 512), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAMES = "array<struct<delay:int, disposal:int, transparent:int, left:int, top:int, width:int, height:int, histogram:array<long>>>"


def media_columns(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and what decoding it gives: samples, width, height, timed frames with colour histograms.

    Null media give nulls; bytes that are no GIF give nulls as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data in batch.column(2).to_pylist():
                try:
                    width, height, frames = decode_gif(data or b"")
                except ValueError:
                    for column in out:
                        column.append(None)
                    continue
                shown = [histogram(c).tolist() for c in composed(width, height, frames)]
                timed = [{"delay": f.delay, "disposal": f.disposal, "transparent": f.transparent, "left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": h} for f, h in zip(frames, shown, strict=True)]
                for column, value in zip(out, (b"".join([f.indices.tobytes() for f in frames]), width, height, timed), strict=True):
                    column.append(value)
            timed_type = pa.list_(pa.struct([*((n, pa.int32()) for n in ("delay", "disposal", "transparent", "left", "top", "width", "height")), ("histogram", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], timed_type)], names=["doc_id", "n_bytes", "media", "samples", "width", "height", "frames"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media binary, samples binary, width int, height int, frames {FRAMES}")


def op7_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media columns of all texts, as digests taken from the stored file and from what was read back of it."""
    stored = media_columns(store_texts(documents(spark, sf_dir)))
    pixels = F.expr("transform(sequence(0, 63), b -> aggregate(frames, 0L, (t, f) -> t + f.histogram[b]))")
    told = F.concat_ws(";", F.format_string("%dx%d", "width", "height"), F.expr("concat('frames=', size(frames))"), F.expr("concat('ticks=', aggregate(frames, 0, (t, f) -> t + f.delay))"), F.concat(F.lit("colours="), F.array_join(pixels, ",")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        told.alias("feature"),
    )
