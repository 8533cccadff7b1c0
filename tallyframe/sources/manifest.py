"""The sample manifest: one JSON array of items, read in order and replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, last_wins
from .json_array import DocumentError, elements, write_array


class ManifestError(ValueError):
    """The manifest is missing, corrupt or empty."""


def _struct(ddl: str) -> str:
    """Top-level 'name TYPE' pairs as the fields of a STRUCT."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(f"{ddl},"):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"`{name.strip('`')}`: {kind}")
            start = i + 1
    return ", ".join(out)


def _elements(spark: SparkSession, path: str) -> DataFrame:
    try:
        return elements(spark, path)[1]
    except DocumentError as wrong:
        raise ManifestError(f"{path} is not a manifest; it was left as it is") from wrong


def read_manifest(spark: SparkSession, path: str, must_have_rows: bool = False) -> DataFrame:
    """All items with their position (pos), read by byte ranges. Text that isn't a JSON array of objects raises; so does an empty one, if rows are asked for."""
    rows = _elements(spark, path).select("pos", "raw", F.from_json("raw", f"STRUCT<{_struct(MANIFEST)}>").alias("item"))
    if rows.where(~F.coalesce(F.col("raw").startswith("{"), F.lit(False))).limit(1).count():
        raise ManifestError(f"{path} is not a manifest; it was left as it is")
    if must_have_rows and rows.isEmpty():
        raise ManifestError(f"{path} has no items")
    return rows.select("pos", "item.*")


def read_loosely(spark: SparkSession, path: str) -> DataFrame:
    """Items for validation, with pos and raw, each item's own JSON: a field of a wrong type is null, and an item that is no object has nulls alone, so that rules can report them."""
    rows = _elements(spark, path).select("pos", "raw", F.from_json("raw", f"STRUCT<{_struct(MANIFEST)}>").alias("item"))
    return rows.select("pos", "item.*", "raw")


def only(items: DataFrame, id_: str | None) -> DataFrame:
    """The items of one id, all without one. An id that no item has raises."""
    if id_ is None:
        return items
    chosen = items.where(F.col("id") == id_)
    if chosen.isEmpty():
        raise ManifestError(f"no item has the id {id_!r}")
    return chosen


def manifest_by(df: DataFrame, key: str) -> DataFrame:
    """The manifest as a lookup by file or id: the last of several items with one key counts."""
    return last_wins(df.where(F.col(key).isNotNull()), key)


def write_manifest(df: DataFrame, path: str) -> None:
    """Replace the manifest in one step, written by all tasks and joined (see write_array), so that it may have been read from the same path."""
    item = F.to_json(F.struct(*[c for c in df.columns if c != "pos"]), {"ignoreNullFields": "false"})
    write_array(df.select("pos", item.alias("value")), path)
