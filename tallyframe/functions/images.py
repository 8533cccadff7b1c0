"""Pixels: decoding, cropping and encoding. They need an image library, and say so where there is none."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from .scalars import LONGEST, SHORTEST

QUALITY = 90
#: What there is of a photo without content: Python functions see such rows, too, whatever a condition around them says.
MISSING = {"error": "no such photo"}
CROP = StructType([StructField("content", BinaryType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("error", StringType())])


def _library():  # noqa: ANN202
    try:
        from PIL import Image, ImageOps
    except ImportError as missing:
        raise RuntimeError("cropping photos needs Pillow on the executors") from missing
    return Image, ImageOps


def open_upright(content: bytes):  # noqa: ANN201
    """The image in RGB, turned as its EXIF says."""
    image, ops = _library()
    return ops.exif_transpose(image.open(io.BytesIO(content))).convert("RGB")


def shrunk_size(width: int, height: int) -> tuple[int, int]:
    """Width and height with LONGEST as the longest side, the other cut to whole pixels. The longest isn't multiplied: 1122 * (1024 / 1122) is below 1024 in double precision."""
    side = max(width, height)
    return tuple(LONGEST if v == side else int(v * (LONGEST / side)) for v in (width, height))


def crop_jpeg(content: bytes, bbox: list[int] | None) -> dict:
    """Crop to the box, shrink to the longest side and encode; the error says why there is no picture."""
    image, _ = _library()
    try:
        picture = open_upright(content)
    except OSError as e:
        return {"error": f"not an image: {e}"}
    if bbox is not None and len(bbox):
        if len(bbox) != 4 or min(bbox[2:]) <= 0 or min(bbox[:2]) < 0 or bbox[0] + bbox[2] > picture.width or bbox[1] + bbox[3] > picture.height:
            return {"error": "bad box"}
        picture = picture.crop((bbox[0], bbox[1], bbox[0] + bbox[2], bbox[1] + bbox[3]))
        if min(picture.size) < SHORTEST:
            return {"error": "box is too small"}
    if max(picture.size) > LONGEST:
        picture = picture.resize(shrunk_size(*picture.size), image.Resampling.LANCZOS)
    out = io.BytesIO()
    picture.save(out, "JPEG", quality=QUALITY)
    return {"content": out.getvalue(), "width": picture.width, "height": picture.height}


@F.pandas_udf(CROP)
def crop_photo(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for contents, boxes in batches:
        yield crop_frame([crop_jpeg(bytes(c), None if b is None else list(b)) if c is not None else MISSING for c, b in zip(contents, boxes, strict=True)])


def crop_frame(rows: list[dict]) -> pd.DataFrame:
    """Crops as the frame that CROP describes; what a row lacks is null."""
    kinds = {"content": object, "width": "Int32", "height": "Int32", "error": object}
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=kind) for name, kind in kinds.items()})
