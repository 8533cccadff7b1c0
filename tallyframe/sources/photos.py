"""Photo directories: a listing in three classes, and dimensions from header bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..schemas import READABLE, RECOGNISED

CLASSES = ("readable", "unreadable", "ignored")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def classify(name: Column, decodable: Column | None = None) -> Column:
    """readable, unreadable (recognised formats without a decoder, and what can't be decoded) or ignored."""
    ext = extension(name)
    ok = F.lit(True) if decodable is None else F.coalesce(decodable, F.lit(False))
    return F.when(name.startswith(".") | (name == "manifest.json"), "ignored").when(ext.isin(*RECOGNISED), "unreadable").when(~ext.isin(*READABLE), "ignored").when(ok, "readable").otherwise("unreadable")


def header_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a JPEG, PNG, BMP, WebP or TIFF after the turn that its EXIF asks for; None for what isn't one.

    It is also what makes a photo readable: PNG files must be whole, chunk by chunk with right check
    sums, WebP files as long as they say, and the others' headers must be there.
    """
    if found := _header(bytes(content or b"")):
        width, height, turn = found
        return ((height, width) if turn in (5, 6, 7, 8) else (width, height)) if width > 0 and height > 0 else None
    return None


def picture_turn(content: bytes) -> int:
    """The orientation that EXIF gives a picture; 1 if it gives none."""
    found = _header(content)
    return found[2] if found else 1


def _header(b: bytes) -> tuple[int, int, int] | None:
    """Width, height and orientation as the file has them."""
    try:
        for begins, reader in ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"BM", _bmp), (b"RIFF", _webp), (b"II*\0", _tiff), (b"MM\0*", _tiff)):
            if b.startswith(begins) and (found := reader(b)):
                return found
    except struct.error:  # cut off within a header
        pass
    return None


def _png(b: bytes) -> tuple[int, int, int] | None:
    at, size, turn = 8, None, 1
    while at + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, at)
        kind, body = b[at + 4 : at + 8], b[at + 8 : at + 8 + n]
        if at + 12 + n > len(b) or zlib.crc32(kind + body) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            turn = _directory(body).get(ORIENTATION, 1)
        elif kind == b"IEND":
            return (*size, turn) if size else None
        at += 12 + n
    return None


def _bmp(b: bytes) -> tuple[int, int, int]:
    width, height = struct.unpack_from("<ii", b, 18) if struct.unpack_from("<I", b, 14)[0] >= 40 else struct.unpack_from("<HH", b, 18)
    return abs(width), abs(height), 1


def _webp(b: bytes) -> tuple[int, int, int] | None:
    if b[8:12] != b"WEBP" or struct.unpack_from("<I", b, 4)[0] + 8 > len(b):
        return None
    at, size, turn = 12, None, 1
    while at + 8 <= len(b):
        kind, (n,) = b[at : at + 4], struct.unpack_from("<I", b, at + 4)
        body = b[at + 8 : at + 8 + n]
        if kind == b"VP8X":
            size = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        elif kind == b"VP8L" and not size:
            bits = struct.unpack_from("<I", body, 1)[0]
            size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif kind == b"VP8 " and not size:
            width, height = struct.unpack_from("<HH", body, 6)
            size = width & 0x3FFF, height & 0x3FFF
        elif kind == b"EXIF":
            turn = _directory(body.removeprefix(b"Exif\0\0")).get(ORIENTATION, 1)
        at += 8 + n + n % 2
    return (*size, turn) if size else None


def _jpeg(b: bytes) -> tuple[int, int, int] | None:
    at, turn = 2, 1
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD9 or kind == 1:
            at += 1 if kind == 0xFF else 2
            continue
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        body = b[at + 4 : at + 2 + size]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            turn = _directory(body[6:]).get(ORIENTATION, 1)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1)
            return width, height, turn
        at += 2 + size
    return None


def _tiff(b: bytes) -> tuple[int, int, int] | None:
    tags = _directory(b)
    return (tags[WIDTH], tags[HEIGHT], tags.get(ORIENTATION, 1)) if WIDTH in tags and HEIGHT in tags else None


#: Tags of a TIFF directory, which EXIF is, too; and its integer types with their formats.
WIDTH, HEIGHT, ORIENTATION = 0x0100, 0x0101, 0x0112
INTEGERS = {1: "B", 3: "H", 4: "I"}


def _directory(tiff: bytes) -> dict[int, int]:
    """Tag -> first value, for the integer tags of the first directory; nothing of what isn't one."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 10:
        return {}
    (at,) = struct.unpack_from(f"{order}I", tiff, 4)
    if at + 2 > len(tiff):
        return {}
    (n,) = struct.unpack_from(f"{order}H", tiff, at)
    out = {}
    for entry in range(at + 2, min(at + 2 + 12 * n, len(tiff) - 11), 12):
        tag, kind = struct.unpack_from(f"{order}HH", tiff, entry)
        if kind in INTEGERS:
            out[tag] = struct.unpack_from(f"{order}{INTEGERS[kind]}", tiff, entry + 8)[0]
    return out


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in contents:
        sizes = [header_size(c) for c in batch]
        yield pd.DataFrame({"width": pd.array([s and s[0] for s in sizes], "Int32"), "height": pd.array([s and s[1] for s in sizes], "Int32")})


def scan_photos(spark: SparkSession, directory: str) -> DataFrame:
    """file, class, width, height of every file right in the directory. A missing directory raises.

    The class filter runs on the lower-cased name before any content is decoded. Spark's reader
    leaves out names that start with '_' even where they are given; the few there are get read
    one by one through the same file system.
    """
    files = spark.read.format("binaryFile").load(directory).select(base_name(F.col("path")).alias("file"), "content")
    if odd := _underscored(spark, directory):
        files = files.unionByName(spark.createDataFrame(odd, "file string, content binary"))
    sized = files.withColumn("size", F.when(extension(F.col("file")).isin(*READABLE), image_size("content")))
    return sized.select("file", classify(F.col("file"), F.col("size.width").isNotNull()).alias("class"), F.col("size.width").alias("width"), F.col("size.height").alias("height"))


def _underscored(spark: SparkSession, directory: str) -> list[tuple[str, bytes]]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{directory}/[_]*")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for status in fs.globStatus(path) or []:
        if status.isFile():
            stream = fs.open(status.getPath())
            out.append((status.getPath().getName(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
    return out


def list_names(spark: SparkSession, directory: str) -> DataFrame:
    """file names alone: the content column is never read."""
    return spark.read.format("binaryFile").load(directory).select(base_name(F.col("path")).alias("file"))


def first_unreadable(scan: DataFrame, n: int = 10) -> DataFrame:
    return scan.where("class = 'unreadable'").select("file").orderBy("file").limit(n)
