"""GIF images as columns: writing, decoding, and frames with colour histograms.

The decoder reads LZW code streams, local and global palettes, transparency, disposal (keep, clear, restore) and
delays, and composes every frame on the canvas. The writer stores bytes losslessly as 8-bit palette indices in frames
of WIDTH columns and up to ROWS rows over a grey palette, one second apart; a byte string whose length is a multiple
of WIDTH comes back from the frames' indices unchanged.

Defined cases: a null text is an empty one, stored as WIDTH blanks; very long texts become many frames; equal texts
give equal values; a null doc_id is kept; an empty table gives an empty result; columns beyond doc_id and text are
not read. decode() raises ValueError for a broken image, of which frames() gives one row with an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import table

WIDTH = 192
ROWS = 256
BINS = 8
_TOP = 4096  # codes have 12 bits at most


# Width of the n-th code after a clear: the table grows by a code each, from the second on.
def _widths(low: int) -> np.ndarray:
    first = (1 << low) + 2
    entries = first + np.arange(_TOP - first + 1)
    return np.array([max(low + 1, min(12, int(n - 1).bit_length())) for n in entries.tolist()], np.int64)


_WIDTHS = {low: _widths(low) for low in range(2, 9)}


def lzw_encode(data: bytes, low: int = 8) -> bytes:
    """The code stream of palette indices below 2**low; the table is cleared whenever it is full."""
    clear, end = 1 << low, (1 << low) + 1
    codes, runs = [], []  # runs: how many codes follow each clear, the clear included
    codes.append(clear)
    start, table_, free = 0, {}, end + 1
    it = iter(data)
    prefix = next(it, None)
    if prefix is not None:
        get, push = table_.get, codes.append
        for b in it:
            key = prefix << 8 | b
            known = get(key)
            if known is not None:
                prefix = known
                continue
            push(prefix)
            table_[key] = free
            free += 1
            prefix = b
            if free == _TOP:
                push(clear)
                runs.append(len(codes) - start)
                start = len(codes)
                table_.clear()
                free = end + 1
        push(prefix)
    codes.append(end)
    runs.append(len(codes) - start)
    by_run = _WIDTHS[low]
    # The first code of all is a clear, written at the starting width; then each run has the widths of a fresh table.
    widths = [np.array([low + 1])]
    for i, n in enumerate(runs):
        n = n - 1 if i == 0 else n
        widths.append(by_run[np.minimum(np.arange(n), len(by_run) - 1)])
    return _pack(np.array(codes, np.uint16), np.concatenate(widths))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, low: int, size: int) -> bytes:
    """The palette indices of a code stream, at most size of them."""
    clear, end = 1 << low, (1 << low) + 1
    padded = np.frombuffer(stream + b"\x00\x00\x00", np.uint8).astype(np.int32)
    total = 8 * len(stream)
    widths = _WIDTHS[low]
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made, at = 0, 0
    while made < size:  # each turn reads the codes between two clears, whose widths are known beforehand
        first = len(out)
        offsets = at + np.concatenate(([0], np.cumsum(widths)))
        n = int(np.searchsorted(offsets, total, side="right")) - 1
        n = min(n, len(widths))
        if n <= 0:
            break
        byte, masks = offsets[:n] >> 3, (1 << widths[:n]) - 1
        three = padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16
        codes = three >> (offsets[:n] & 7) & masks
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        table_, last = roots.copy(), b""
        push = table_.append
        for code in codes[:stop].tolist():
            if last:
                if code < len(table_):
                    word = table_[code]
                    if len(table_) < _TOP:
                        push(last + word[:1])
                elif code == len(table_):
                    word = last + last[:1]
                    push(word)
                else:
                    raise ValueError("a code beyond the table")
            else:
                if code >= clear:
                    raise ValueError("a code beyond the table")
                word = table_[code]
            out.append(word)
            last = word
        if stop == n and n == len(widths):  # a full table that isn't cleared: 12 bits each until a clear
            at = int(offsets[n])
            while at + 12 <= total:
                i = at >> 3
                code = (int(padded[i]) | int(padded[i + 1]) << 8 | int(padded[i + 2]) << 16) >> (at & 7) & 0xFFF
                at += 12
                if code in (clear, end):
                    break
                out.append(table_[code])
            else:
                code = end
        else:
            at = int(offsets[min(stop + 1, n)])
            code = int(codes[stop]) if stop < n else end
        made += sum(map(len, out[first:]))
        if code == end:
            break
    return b"".join(out)[:size]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int | None
    palette: np.ndarray
    indices: np.ndarray  # height x width


@dataclass
class Image:
    width: int
    height: int
    frames: list[Frame]

    def canvases(self) -> Iterator[np.ndarray]:
        """The RGBA canvas at the time of every frame; the next frame is drawn on the same array."""
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        for f in self.frames:
            before = canvas.copy() if f.disposal == 3 else None
            box = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
            shown = f.indices[: box.shape[0], : box.shape[1]]
            colours = np.column_stack((f.palette, np.full(256, 255, np.uint8)))[shown]
            if f.transparent is None:
                box[:] = colours
            else:
                np.copyto(box, colours, where=(shown != f.transparent)[:, :, None])
            yield canvas
            if f.disposal == 2:
                box[:] = 0
            elif before is not None:
                canvas = before


def decode(raw: bytes) -> Image:
    """An image with all its frames."""
    try:
        return _decode(raw)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("a broken image") from e


def _decode(raw: bytes) -> Image:
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", raw[6:13])
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(raw, at, flags)
    frames, delay, disposal, transparent = [], 0, 0, None
    while at < len(raw):
        kind = raw[at]
        if kind == 0x3B:
            return Image(width, height, frames)
        if kind == 0x21:
            body, end = _blocks(raw, at + 2)
            if raw[at + 1] == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
            at = end
        elif kind == 0x2C:
            left, top, w, h, own = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
            at += 10
            palette = shared
            if own & 0x80:
                palette, at = _palette(raw, at, own)
            if palette is None:
                raise ValueError("no palette")
            low = raw[at]
            body, at = _blocks(raw, at + 1)
            flat = np.frombuffer(lzw_decode(body, low, w * h), np.uint8)
            if len(flat) < w * h:
                raise ValueError("a short frame")
            flat = flat.reshape(h, w)
            if own & 0x40:  # four passes over the rows
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                flat = flat[np.argsort(order)]
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, flat))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind}")
    raise ValueError("no end")


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    full = np.zeros((256, 3), np.uint8)
    full[:n] = np.frombuffer(raw[at : at + 3 * n], np.uint8).reshape(n, 3)
    return full, at + 3 * n


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := raw[at]:
        parts.append(raw[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def encode(payload: bytes) -> bytes:
    """An image whose frames' indices are the payload, of a multiple of WIDTH bytes."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"not a multiple of {WIDTH} bytes")
    rows = len(payload) // WIDTH
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), grey]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        body = lzw_encode(part)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, 100, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)]
        out.append(b"\x00")
    out.append(b"\x3b")
    return b"".join(out)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of a canvas by BINS ranges (of 32 values) of each of red, green and blue."""
    return np.stack([np.bincount(canvas[:, :, c].ravel() >> 5, minlength=BINS) for c in range(3)])


def timed(image: Image) -> Iterator[tuple[int, int, Frame, np.ndarray]]:
    """(number, start in ms, frame, colour histogram of the canvas) of every frame."""
    start = 0
    for i, (f, canvas) in enumerate(zip(image.frames, image.canvases(), strict=True)):
        yield i, start * 10, f, histogram(canvas)
        start += f.delay


_FRAME = {"id": pa.int64(), "error": pa.string(), "frame": pa.int32(), "start_ms": pa.int64(), "width": pa.int32(), "height": pa.int32(), "disposal": pa.int32(), "histogram": pa.list_(pa.int64())}


def frames(media: DataFrame) -> DataFrame:
    """A row for each frame of (id, gif): its number, start in ms, size, disposal and colour histogram (red, green, blue).

    An image that is broken, or null, has one row with an error and no frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, raw in zip(b.column("id").to_pylist(), b.column("gif"), strict=True):
                try:
                    rows += [(key, None, i, at, f.width, f.height, f.disposal, h.ravel().tolist()) for i, at, f, h in timed(decode(raw.as_py() or b""))]
                except ValueError as e:
                    rows.append((key, str(e), None, None, None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * len(_FRAME)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _FRAME.values(), strict=True)], names=list(_FRAME))

    return media.select(F.col("id").cast("long"), "gif").mapInArrow(run, "id long, error string, frame int, start_ms long, width int, height int, disposal int, histogram array<long>")


def digest(text: str | None) -> tuple:
    """What op8 returns of a text, from the image it is stored in and read back from: its frames' indices and histograms."""
    raw = (text or "").encode()
    stored = encode(raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)))
    image = decode(stored)
    payload = b"".join(f.indices.tobytes() for f in image.frames)
    total = sum(h[0] for _, _, _, h in timed(image))  # the palette is grey: all three colours have the same
    feature = f"{len(image.frames)}f/" + ".".join(map(str, total.tolist()))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(image.frames)


_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "frames": pa.int64()}


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image and read back; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*[digest(t.as_py()) for t in b.column("text")], strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, _FIELDS.values(), strict=True)]], names=["doc_id", *_FIELDS])

    kinds = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in _FIELDS.items())
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {kinds}")
