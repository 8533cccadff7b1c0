"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cropped images: the longest side at most, and the shortest at least, in pixels.
LONGEST, SHORTEST = 1024, 8


def sha16(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks that Spark puts in."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def scaled(width: Column, height: Column, longest: int = LONGEST) -> Column:
    """struct<w, h> after shrinking to the longest side: the ratio's product cut to whole pixels; smaller images stay."""
    side = F.greatest(width, height)
    ratio = F.lit(float(longest)) / side
    cut = lambda v: F.when(side > longest, (v * ratio).cast("int")).otherwise(v.cast("int"))
    return F.struct(cut(width).alias("w"), cut(height).alias("h"))


def crop_error(bbox: Column, width: Column, height: Column, shortest: int = SHORTEST) -> Column:
    """Why a box can't be cropped; null if it can, or there is none. Parts of a box outside the image don't count."""
    from ..operators.validate import box_findings

    rule = box_findings(bbox, width, height)
    small = F.least(F.get(bbox, F.lit(2)), F.get(bbox, F.lit(3))) < shortest
    return F.when(rule.isNotNull(), F.concat(F.lit("bad box "), rule)).when(F.coalesce(F.size(bbox), F.lit(0)) > 0, F.when(small, "box is too small"))


def kilobytes(size: Column) -> Column:
    return F.floor(size / 1024).cast("long")


def shown(text: Column, missing: str = "-") -> Column:
    """A value for display, with a sign for missing ones."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(missing))


def listed(array: Column) -> Column:
    return F.array_join(F.coalesce(array, F.array().cast("array<string>")), ", ")


def joined_parts(parts: Column) -> Column:
    """The texts of all parts of a reply in a row; a part without text adds nothing."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def strip_fences(text: Column) -> Column:
    """Text without Markdown fences at line starts and ends, and without white space around it."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?md)^```(?:json)?[ \t]*", ""), r"(?md)```[ \t]*$", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")
