"""Pixels without an image library: PNG and BMP pictures decoded, turned, cropped, shrunk and written as PNG.

Each function works on one picture; Spark deals them out (see crop_picture). JPEG, WebP and TIFF need
a library (see images).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.photos import picture_turn
from .images import CROP, MISSING, crop_frame, shrunk_size
from .scalars import LONGEST, SHORTEST

PNG = b"\x89PNG\r\n\x1a\n"
SUMS = StructType([StructField(n, k) for n, k in (("width", IntegerType()), ("height", IntegerType()), ("red", LongType()), ("green", LongType()), ("blue", LongType()), ("corner", IntegerType()))])
#: Samples of a pixel by PNG's colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A PNG's bytes (height, width, bytes of a pixel) without its row filters. Pixels of one antidiagonal depend on earlier ones alone, so each antidiagonal is one step."""
    if not kinds.any():
        return rows
    height, width, n = rows.shape
    out = np.zeros((height + 1, width + 1, n), np.int32)  # with a row above and a column before
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x, kind = d - y, kinds[y, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        to_left, to_up, to_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        filled = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[y + 1, x + 1] = (rows[y, x] + filled) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(content: bytes) -> np.ndarray:
    """Height x width x RGB; alpha is left out, of 16 bits the upper ones count."""
    at, data, palette, header = 8, [], None, None
    while at + 12 <= len(content):
        (size,) = struct.unpack_from(">I", content, at)
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = header
    if interlaced:
        raise ValueError("an interlaced PNG")
    samples = SAMPLES[colour]
    line = (width * samples * depth + 7) // 8
    packed = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, line + 1)
    pixel = max(1, samples * depth // 8)
    flat = unfiltered(packed[:, 1:].reshape(height, line // pixel, pixel), packed[:, 0].astype(int)).reshape(height, line)
    if depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)[:, :width]
        flat = bits @ (1 << np.arange(depth)[::-1])
        if colour == 0:
            flat = flat * (255 // ((1 << depth) - 1))
    elif depth == 16:
        flat = flat[:, ::2]
    values = flat.reshape(height, width, samples)
    if colour == 3:
        return palette[values[:, :, 0]]
    return (np.repeat(values[:, :, :1], 3, 2) if samples < 3 else values[:, :, :3]).astype(np.uint8)


def decode_bmp(content: bytes) -> np.ndarray:
    """Height x width x RGB of an uncompressed BMP of 8, 24 or 32 bits a pixel."""
    start, size, width, height, _, depth, how = struct.unpack_from("<IIiiHHI", content, 10)
    if how not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("a BMP of an uncommon kind")
    line = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows  # from the bottom, unless the height is negative
    if depth == 8:
        colours = np.frombuffer(content, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)
        return colours[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]


def decode(content: bytes) -> np.ndarray:
    """The picture as its EXIF says that it stands. Raises ValueError for what can't be read here."""
    try:
        if content.startswith(PNG):
            picture = decode_png(content)
        elif content.startswith(b"BM"):
            picture = decode_bmp(content)
        else:
            raise ValueError("needs an image library")
    except (struct.error, zlib.error, KeyError, TypeError, IndexError) as wrong:
        raise ValueError(f"not an image: {wrong}") from wrong
    return upright(picture, picture_turn(content))


def upright(picture: np.ndarray, turn: int) -> np.ndarray:
    """Undo what EXIF's orientation says: mirrored, or standing on another side."""
    if turn in (5, 6, 7, 8):
        picture = picture.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        picture = picture[:, ::-1]
    if turn in (3, 4, 7, 8):
        picture = picture[::-1]
    return picture


def shrunk(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture at a smaller size, by Lanczos windows of three lobes over the pixels that fall on a new one, first across, then down."""
    for axis, size in ((1, width), (0, height)):
        picture = picture.swapaxes(0, axis).astype(float)
        scale = picture.shape[0] / size
        reach = 3 * max(scale, 1.0)
        out = np.empty((size, *picture.shape[1:]))
        for i in range(size):
            centre = (i + 0.5) * scale
            first, last = max(0, int(centre - reach + 0.5)), min(picture.shape[0], int(centre + reach + 0.5))
            x = (np.arange(first, last) + 0.5 - centre) / max(scale, 1.0)
            weight = np.where(abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
            out[i] = np.tensordot(weight / weight.sum(), picture[first:last], 1)
        picture = np.clip(np.floor(out + 0.5), 0, 255).swapaxes(0, axis)
    return picture.astype(np.uint8)


def encode_png(picture: np.ndarray) -> bytes:
    """A PNG of RGB pixels, without filters."""
    height, width, _ = picture.shape
    rows = np.hstack([np.zeros((height, 1), np.uint8), np.ascontiguousarray(picture, np.uint8).reshape(height, width * 3)])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def cropped(content: bytes, bbox: list[int] | None) -> dict:
    """Crop to the box, shrink to the longest side and write as PNG; the error says why there is no picture."""
    try:
        picture = decode(content)
    except ValueError as wrong:
        return {"error": str(wrong)}
    if bbox:
        if len(bbox) != 4 or min(bbox[2:]) <= 0 or min(bbox[:2]) < 0 or bbox[0] + bbox[2] > picture.shape[1] or bbox[1] + bbox[3] > picture.shape[0]:
            return {"error": "bad box"}
        if min(bbox[2:]) < SHORTEST:
            return {"error": "box is too small"}
        picture = picture[bbox[1] : bbox[1] + bbox[3], bbox[0] : bbox[0] + bbox[2]]
    height, width = picture.shape[:2]
    if max(width, height) > LONGEST:
        width, height = shrunk_size(width, height)
        if not min(width, height):
            return {"error": "too narrow to shrink"}
        picture = shrunk(picture, width, height)
    return {"content": encode_png(picture), "width": width, "height": height}


@F.pandas_udf(CROP)
def crop_picture(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for contents, boxes in batches:
        yield crop_frame([cropped(bytes(c), None if b is None else list(b)) if c is not None else MISSING for c, b in zip(contents, boxes, strict=True)])


@F.pandas_udf(SUMS)
def pixel_sums(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A picture's size, the sum of each colour, and the red of its last pixel; nulls for what can't be read."""
    for contents in batches:
        rows = []
        for c in contents:
            try:
                p = decode(bytes(c))
                rows.append((p.shape[1], p.shape[0], *p.reshape(-1, 3).sum(0, dtype=np.int64).tolist(), int(p[-1, -1, 0])))
            except ValueError:
                rows.append((None,) * 6)
        frame = pd.DataFrame(rows, columns=["width", "height", "red", "green", "blue", "corner"])
        yield frame.astype({c: "Int64" for c in ("red", "green", "blue")} | {c: "Int32" for c in ("width", "height", "corner")})
