"""IO16, M8, V16: PNG pictures decoded with guards and reason codes, shrunk, cropped, and as grey features."""

from __future__ import annotations

import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type, and the bit depths that it may have.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
MOST_BYTES, MOST_PIXELS, LONGEST = 64 << 20, 80_000_000, 2048
SCANNED = "path string, reason string, retries int, width int, height int, pixels binary"


class Unreadable(Exception):
    """A picture that gives no pixels; the argument is its reason code."""


def _chunks(content: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(content):
            raise Unreadable("decode_failed")
        if zlib.crc32(kind + data) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise Unreadable("decode_failed")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise Unreadable("decode_failed")


def _nearest(a: int, b: int, c: int) -> int:
    p = a + b - c
    x, y, z = abs(p - a), abs(p - b), abs(p - c)
    return a if x <= y and x <= z else b if y <= z else c


def _unfiltered(raw: bytes, height: int, width_bytes: int, step: int) -> np.ndarray:
    """The rows' bytes: each row begins with the number of its filter; a filter adds what the left, upper and upper left bytes foretell."""
    lines = np.frombuffer(raw, np.uint8, height * (width_bytes + 1)).reshape(height, width_bytes + 1)
    out = np.zeros((height, width_bytes), np.uint8)
    above = np.zeros(width_bytes, np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            padded = np.zeros(-(-width_bytes // step) * step, np.uint8)
            padded[:width_bytes] = line
            out[y] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width_bytes]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            row, up, left = line.tolist(), above.tolist(), [0] * step
            upper = [0] * step
            done = left[:]
            for i, v in enumerate(row):
                a, b = done[i], up[i]
                done.append((v + ((a + b) >> 1 if kind == 3 else _nearest(a, b, upper[i] if i < step else up[i - step]))) & 255)
            out[y] = done[step:]
        else:
            raise Unreadable("decode_failed")
        above = out[y]
    return out


def decode_png(content: bytes, most_pixels: int = MOST_PIXELS) -> np.ndarray:
    """Height x width x 3 bytes of a PNG. Grey is spread, palettes are looked up, of 16 bits the upper 8 stay, transparency goes.

    Raises Unreadable: `unsupported_format` (no PNG, or an interlaced one), `invalid_size`, `too_many_pixels` (told by the header,
    before anything is unpacked), `decode_failed`."""
    if content[:8] != SIGNATURE:
        raise Unreadable("unsupported_format")
    head, palette, packed = None, None, []
    for kind, data in _chunks(content):
        if kind == b"IHDR":
            if len(data) != 13:
                raise Unreadable("decode_failed")
            width, height, depth, colour, method, filters, interlaced = head = struct.unpack(">IIBBBBB", data)
            if not width or not height:
                raise Unreadable("invalid_size")
            if width * height > most_pixels:
                raise Unreadable("too_many_pixels")
            if colour not in CHANNELS or depth not in DEPTHS[colour] or method or filters:
                raise Unreadable("decode_failed")
            if interlaced:
                raise Unreadable("unsupported_format")
        elif kind == b"PLTE":
            palette = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(data)
    if head is None:
        raise Unreadable("decode_failed")
    channels = CHANNELS[colour]
    width_bytes = (width * channels * depth + 7) // 8
    want = height * (width_bytes + 1)
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), want)
    except zlib.error:
        raise Unreadable("decode_failed") from None
    if len(raw) < want:
        raise Unreadable("decode_failed")
    rows = _unfiltered(raw, height, width_bytes, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        parts = 8 // depth
        shifts = np.arange(parts - 1, -1, -1, dtype=np.uint8) * np.uint8(depth)
        rows = ((rows[:, :, None] >> shifts) & np.uint8((1 << depth) - 1)).reshape(height, -1)[:, : width * channels]
        if colour == 0:
            rows = (rows.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = rows.reshape(height, width, channels)
    if colour == 3:
        if palette is None or int(pixels.max()) >= len(palette):
            raise Unreadable("decode_failed")
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def encode_png(pixels: np.ndarray, kind: int = 0) -> bytes:
    """A PNG of height x width (grey) or height x width x 3 bytes; `kind` is the filter of all rows."""
    x = np.asarray(pixels, np.uint8)
    x = x[:, :, None] if x.ndim == 2 else x
    height, width, channels = x.shape
    flat = x.reshape(height, -1).astype(np.int64)
    left, up = np.pad(flat, ((0, 0), (channels, 0)))[:, : flat.shape[1]], np.pad(flat, ((1, 0), (0, 0)))[:height]
    corner = np.pad(flat, ((1, 0), (channels, 0)))[:height, : flat.shape[1]]
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    told = {0: 0 * flat, 1: left, 2: up, 3: (left + up) >> 1, 4: np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))}[kind]
    raw = np.hstack([np.full((height, 1), kind, np.uint8), ((flat - told) & 255).astype(np.uint8)]).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def area_resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers: running sums, read between their places."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, len(x), n + 1)
        whole = np.minimum(edges.astype(np.int64), len(x) - 1)
        sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        at = sums[whole] + (edges - whole).reshape(-1, *[1] * (x.ndim - 1)) * x[whole]
        return np.diff(at, axis=0) / (len(x) / n)

    x = along(np.asarray(pixels, np.float64), height)
    return np.moveaxis(along(np.moveaxis(x, 1, 0), width), 0, 1)


def shrunk_pixels(pixels: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """IO16: the longest side at most `longest`; smaller pictures stay."""
    height, width = pixels.shape[:2]
    if max(height, width) <= longest:
        return pixels
    scale = longest / max(height, width)
    return np.clip(np.rint(area_resized(pixels, max(1, int(height * scale)), max(1, int(width * scale)))), 0, 255).astype(np.uint8)


def center_crop(pixels: np.ndarray, ratio: float = 0.7) -> np.ndarray:
    """M8: the middle part, `ratio` of either side, one pixel at least."""
    height, width = pixels.shape[:2]
    h, w = max(1, int(height * ratio)), max(1, int(width * ratio))
    top, left = (height - h) // 2, (width - w) // 2
    return pixels[top : top + h, left : left + w]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Brightness by the weights of red, green and blue, in thousandths, rounded."""
    r, g, b = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def scan_images(files: DataFrame, most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS, longest: int = LONGEST, attempts: int = 3, wait_s: float = 0.0) -> DataFrame:
    """IO16: files(path, length, content) to path, reason, retries, width, height and pixels (red, green, blue by rows), one row each.

    reason: `ok`, or why there are no pixels: `missing` (no content and no length), `empty`, `oversize_bytes`, and those of
    decode_png. A decoding that fails in an unforeseen way is tried `attempts` times and then `unexpected_error`; what a file's
    bytes rule out is not tried again. Oversize contents don't leave the JVM."""

    def one(content: bytes) -> tuple:
        for n in range(attempts):
            try:
                x = shrunk_pixels(decode_png(content, most_pixels), longest)
                return "ok", n, x.shape[1], x.shape[0], x.tobytes()
            except Unreadable as e:
                return str(e), n, None, None, None
            except Exception:  # noqa: BLE001  the row says so
                if n + 1 < attempts:
                    time.sleep(wait_s)
        return "unexpected_error", attempts - 1, None, None, None

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, reason, content = (batch.column(j)[i].as_py() for j in range(3))
                row = (reason, 0, None, None, None) if reason != "ok" else one(content)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, *row), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["path", "reason", "retries", "width", "height", "pixels"])

    n = F.coalesce("length", F.octet_length("content"))
    reason = F.when(n.isNull(), "missing").when(n == 0, "empty").when(n > most_bytes, "oversize_bytes").when(F.col("content").isNull(), "missing").otherwise("ok")
    return files.select("path", reason.alias("reason"), F.when(reason == "ok", F.col("content")).alias("content")).mapInArrow(run, SCANNED)


def scan_counts(scanned: DataFrame) -> DataFrame:
    """IO16: (reason, n, retried) of a scan."""
    return scanned.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("retries") > 0).alias("retried"))


def grey_features(scanned: DataFrame, side: int = 64, crop: float | None = None) -> DataFrame:
    """(path, features): side x side grey pixels from 0 to 1, of the picture or of its middle; null without pixels."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, width, height, raw = (batch.column(j)[i].as_py() for j in range(4))
                x = None
                if raw is not None:
                    pixels = np.frombuffer(raw, np.uint8).reshape(height, width, 3)
                    pixels = pixels if crop is None else center_crop(pixels, crop)
                    x = (area_resized(grey(pixels), side, side) / 255.0).astype(np.float32).ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([x], pa.list_(pa.float32()))], names=["path", "features"])

    return scanned.select("path", "width", "height", "pixels").mapInArrow(run, "path string, features array<float>")
