"""GIF: frames against a plain decoder, broken images, and the query against its contract."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lexiform.llm import gif

RNG = random.Random(11)


def _palette(n):
    return [(RNG.randrange(256), RNG.randrange(256), RNG.randrange(256)) for _ in range(n)]


def _blocks(body):
    return b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\x00"


def _image(width, height, shared, frames):
    """A GIF of frames (left, top, w, h, own palette or None, transparent, disposal, delay, interlaced, indices by rows)."""
    bits = lambda p: (len(p) - 1).bit_length() - 1
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | bits(shared), 0, 0) + bytes(v for c in shared for v in c)
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00\x21\xfe\x02hi\x00"
    for left, top, w, h, own, clear, disposal, delay, interlaced, rows in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x80 | bits(own) if own else 0) | 0x40 * interlaced)
        out += bytes(v for c in own or () for v in c)
        order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)] if interlaced else range(h)
        low = max(2, bits(own or shared) + 1)
        out += bytes([low]) + _blocks(gif.lzw_encode(bytes(x for y in order for x in rows[y]), low))
    return out + b"\x3b"


def _plain(width, height, shared, frames):
    """(start in ms, canvas of RGBA pixels) by loops over pixels."""
    canvas, out, at = {(x, y): (0, 0, 0, 0) for x in range(width) for y in range(height)}, [], 0
    for left, top, w, h, own, clear, disposal, delay, _, rows in frames:
        before = dict(canvas)
        box = [(x, y) for x in range(w) for y in range(h) if left + x < width and top + y < height]
        for x, y in box:
            if rows[y][x] != clear:
                canvas[left + x, top + y] = (*(own or shared)[rows[y][x]], 255)
        out.append((at, dict(canvas)))
        at += delay * 10
        if disposal == 2:
            canvas |= {(left + x, top + y): (0, 0, 0, 0) for x, y in box}
        elif disposal == 3:
            canvas = before
    return out


def _film(seed):
    rng = random.Random(seed)
    width, height, shared = rng.randrange(1, 40), rng.randrange(1, 40), _palette(rng.choice([4, 16, 256]))
    frames = []
    for n in range(6):
        w, h = rng.randrange(1, width + 1), rng.randrange(1, height + 1)
        left, top = rng.randrange(width - w + 1), rng.randrange(height - h + 1)
        own = _palette(rng.choice([4, 32])) if rng.random() < 0.5 else None
        size = len(own or shared)
        rows = [[rng.randrange(size) if rng.random() < 0.5 else 1 for _ in range(w)] for _ in range(h)]
        frames.append((left, top, w, h, own, rng.choice([None, 0, 1]), n % 4, rng.randrange(200), rng.random() < 0.5, rows))
    return width, height, shared, frames


@pytest.mark.parametrize("seed", range(12))
def test_films_as_a_plain_decoder_shows_them(seed):
    film = _film(seed)
    image = gif.decode(_image(*film))
    want = _plain(*film)
    for (start, canvas), (i, at, f, h), shown in zip(want, gif.timed(image), [c.copy() for c in image.canvases()], strict=True):
        assert at == start and f.disposal == i % 4
        assert {(x, y): tuple(shown[y, x].tolist()) for y in range(film[1]) for x in range(film[0])} == canvas
        assert h.tolist() == [[sum(p[c] >> 5 == k for p in canvas.values()) for k in range(8)] for c in range(3)]


def test_broken_images_are_errors_and_do_not_end_the_job(spark):
    good = _image(*_film(3))
    broken = [good[:n] for n in range(0, len(good) - 1, 7)] + [b"", b"GIF89a", good.replace(b"\x2c", b"\x2d"), b"x" * 50]
    at = good.index(b"\x2c")
    broken.append(good[: at + 10] + b"\x0c" + good[at + 11 :])
    for raw in broken[:-1]:
        with pytest.raises(ValueError):
            gif.decode(raw)
    rows = [(i, raw) for i, raw in enumerate(broken[:-1])] + [(-1, good), (-1, good), (-2, None), (None, good)]
    got = gif.frames(spark.createDataFrame([(*r, "x") for r in rows], "id long, gif binary, frame string")).collect()
    assert {r.id for r in got if r.error} == {*range(len(broken) - 1), -2} and all(r.frame is None for r in got if r.error)
    assert sorted(r.frame for r in got if r.id == -1) == sorted([*range(6)] * 2) and sum(r.id is None for r in got) == 6
    assert gif.frames(spark.createDataFrame([], "id long, gif binary")).collect() == []


def test_the_query(spark, tmp_path):
    texts = ["", None, "a", "é" * 96, "x" * 192, "x" * 193, "long text " * 60_000, "same", "same", "".join(chr(c) for c in range(1, 0x3000))]
    rows = [(i, t, "f", 1) for i, t in enumerate(texts)] + [(None, "null id", "f", 1)]
    for name, part in (("all", rows), ("none", [])):
        spark.createDataFrame(part, "doc_id long, text string, feature string, n_bytes int").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert gif.op8_gif(spark, f"{tmp_path}/none").collect() == []
    got = gif.op8_gif(spark, f"{tmp_path}/all").collect()
    assert len(got) == len(rows)
    text_of = dict(r[:2] for r in rows)
    for r in got:
        raw = (text_of[r.doc_id] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        frames, canvas, want = [payload[i : i + 192 * 256] for i in range(0, len(payload), 192 * 256)], b"", np.zeros(8, int)
        for f in frames:  # a shorter last frame leaves the rows below as they were
            canvas = f + canvas[len(f) :]
            want += np.bincount(np.frombuffer(canvas, np.uint8) >> 5, minlength=8)
        assert r.feature == f"{len(frames)}f/" + ".".join(map(str, want))
    assert len({r[1:] for r in got if r.doc_id in (7, 8)}) == 1
