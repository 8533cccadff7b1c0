"""Pictures against plain arrays: filters, depths, turns, boxes and sizes."""

import struct
import zlib

import numpy as np
import pytest

from tallyframe.functions import pixels


def filtered(rows, kinds):
    """A PNG's rows with a filter each, byte by byte as the format describes it."""
    height, width, n = rows.shape
    out = []
    for y in range(height):
        line = [kinds[y]]
        for x in range(width):
            for k in range(n):
                a = int(rows[y, x - 1, k]) if x else 0
                b = int(rows[y - 1, x, k]) if y else 0
                c = int(rows[y - 1, x - 1, k]) if x and y else 0
                near = min((a, b, c), key=lambda v: abs(a + b - c - v))
                line.append((int(rows[y, x, k]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
        out.append(bytes(line))
    return b"".join(out)


def png(width, height, depth, colour, data, *chunks, interlaced=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(data)
    return pixels.PNG + b"".join(chunk(k, b) for k, b in [(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)), *chunks, (b"IDAT", packed[:9]), (b"IDAT", packed[9:]), (b"IEND", b"")])


@pytest.mark.parametrize(("colour", "samples"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(colour, samples):
    r = np.random.default_rng(colour)
    rows = r.integers(0, 256, (17, 11, samples), np.uint8)
    got = pixels.decode(png(11, 17, 8, colour, filtered(rows, r.integers(0, 5, 17).tolist())))
    want = np.repeat(rows[:, :, :1], 3, 2) if samples < 3 else rows[:, :, :3]
    assert (got == want).all() and got.dtype == np.uint8


def test_png_depths_and_palettes():
    r = np.random.default_rng(5)
    palette = r.integers(0, 256, (16, 3), np.uint8)
    values = r.integers(0, 16, (6, 7), np.uint8)
    bits = np.unpackbits(np.pad(values, ((0, 0), (0, 1)))[:, :, None], axis=2)[:, :, 4:].reshape(6, -1)
    data = b"".join(b"\0" + np.packbits(row).tobytes() for row in bits)
    assert (pixels.decode(png(7, 6, 4, 3, data, (b"PLTE", palette.tobytes()))) == palette[values]).all()
    assert (pixels.decode(png(7, 6, 4, 0, data))[:, :, 1] == values * 17).all()
    ones = r.integers(0, 2, (5, 9), np.uint8)
    data = b"".join(b"\0" + np.packbits(row).tobytes() for row in ones)
    assert (pixels.decode(png(9, 5, 1, 0, data))[:, :, 0] == ones * 255).all()
    deep = r.integers(0, 65536, (4, 3, 3)).astype(">u2")
    data = filtered(np.frombuffer(deep.tobytes(), np.uint8).reshape(4, 3, 6), [1, 2, 3, 4])
    assert (pixels.decode(png(3, 4, 16, 2, data)) == deep >> 8).all()


def bmp(picture, depth=24, top_down=False):
    height, width, _ = picture.shape
    rows = picture[:, :, ::-1] if depth == 24 else np.dstack([picture[:, :, ::-1], np.zeros((height, width), np.uint8)])
    line = (width * depth // 8 + 3) // 4 * 4
    body = b"".join(row.tobytes().ljust(line, b"\0") for row in (rows if top_down else rows[::-1]))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, -height if top_down else height, 1, depth, 0, len(body), 0, 0, 0, 0) + body


def test_bmp():
    picture = np.random.default_rng(2).integers(0, 256, (5, 7, 3), np.uint8)
    for depth in (24, 32):
        for top_down in (False, True):
            if not top_down:
                assert (pixels.decode(bmp(picture, depth)) == picture).all()
            assert (pixels.decode_bmp(bmp(picture, depth, top_down)) == picture).all()


def test_turns():
    picture = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    exif = lambda turn: b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, turn, 0) + b"\0\0\0\0"
    data = filtered(picture, [0, 0])
    want = {1: picture, 2: np.fliplr(picture), 3: np.rot90(picture, 2), 4: np.flipud(picture), 5: picture.swapaxes(0, 1), 6: np.rot90(picture, -1), 7: np.rot90(picture, 2).swapaxes(0, 1), 8: np.rot90(picture)}
    for turn, standing in want.items():
        assert (pixels.decode(png(3, 2, 8, 2, data, (b"eXIf", exif(turn)))) == standing).all(), turn


def test_boxes_and_sizes():
    picture = np.random.default_rng(3).integers(0, 256, (40, 60, 3), np.uint8)
    file = pixels.encode_png(picture)
    assert (pixels.decode(file) == picture).all()
    out = pixels.cropped(file, [5, 6, 20, 30])
    assert (out["width"], out["height"]) == (20, 30) and (pixels.decode(out["content"]) == picture[6:36, 5:25]).all()
    assert pixels.cropped(file, None)["content"] == pixels.cropped(file, [])["content"] == file
    for box, said in (([1, 2, 3], "bad box"), ([0, 0, 0, 9], "bad box"), ([50, 0, 20, 9], "bad box"), ([0, 0, 7, 30], "box is too small")):
        assert pixels.cropped(file, box) == {"error": said}
    assert "library" in pixels.cropped(b"\xff\xd8\xff", None)["error"] and "not an image" in pixels.cropped(file[:60], None)["error"] and "interlaced" in pixels.cropped(png(1, 1, 8, 0, b"\0\0", interlaced=1), None)["error"]
    wide = pixels.cropped(pixels.encode_png(np.zeros((30, 3000, 3), np.uint8)), None)
    assert (wide["width"], wide["height"]) == (1024, int(30 * (1024 / 3000)))
    assert "error" in pixels.cropped(pixels.encode_png(np.zeros((1, 1100 * 2, 3), np.uint8)), None)


def test_shrinking():
    flat = pixels.shrunk(np.full((50, 70, 3), 77, np.uint8), 30, 20)
    assert flat.shape == (20, 30, 3) and (flat == 77).all()
    # A ramp stays a ramp, but for the edges; a checkerboard becomes its mean; an edge rings, but stays an edge.
    ramp = np.repeat(np.linspace(0, 255, 400)[None, :, None], 3, 2).repeat(8, 0)
    small = pixels.shrunk(np.rint(ramp).astype(np.uint8), 100, 8)[0, :, 0].astype(float)
    assert abs(small[5:-5] - np.linspace(0, 255, 400).reshape(100, 4).mean(1)[5:-5]).max() <= 1
    board = np.indices((200, 200)).sum(0)[:, :, None].repeat(3, 2) % 2 * 255
    assert abs(pixels.shrunk(board.astype(np.uint8), 25, 25).astype(float)[4:-4, 4:-4] - 127.5).max() <= 3
    edge = np.zeros((16, 200, 3), np.uint8)
    edge[:, 100:] = 200
    line = pixels.shrunk(edge, 50, 4)[1, :, 0].astype(int)
    assert line[:20].max() <= 2 and abs(line[-20:] - 200).max() <= 2 and line[24] < 100 < line[25]


@pytest.mark.parametrize(("width", "height", "want"), [(1122, 132, (1024, 120)), (132, 1122, (120, 1024)), (1122, 1122, (1024, 1024)), (1183, 96, (1024, 83)), (1030, 40, (1024, 39))])
def test_longest_side_is_whole(width, height, want):
    # In double precision 1122 * (1024 / 1122) and 1183 * (1024 / 1183) are below 1024.
    out = pixels.cropped(pixels.encode_png(np.full((height, width, 3), 92, np.uint8)), None)
    picture = pixels.decode(out["content"])
    assert (out["width"], out["height"]) == (picture.shape[1], picture.shape[0]) == want and (picture == 92).all()
