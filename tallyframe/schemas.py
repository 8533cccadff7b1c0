"""Schemas of the datasets, and the null rules that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MANIFEST = (
    "id STRING, file STRING, _size ARRAY<INT>, bbox ARRAY<INT>, difficulty STRING, "
    "truth STRUCT<brand: STRING, model: STRING, url: STRING>, manual_search STRUCT<seconds: DOUBLE, success: BOOLEAN>"
)
PROVENANCE = "STRUCT<prompt_sha: STRING, manifest_sha: STRING, subset: STRING, prereg_tag: STRING, smoke: BOOLEAN>"
HEADER = f"model STRING, grounding BOOLEAN, timestamp STRING, n INT, provenance {PROVENANCE}"
RESULT = (
    "id STRING, file STRING, difficulty STRING, photo_sha STRING, bbox ARRAY<INT>, crop_px ARRAY<INT>, crop_bytes BIGINT, "
    "ok BOOLEAN, http INT, error STRING, latency_s DOUBLE, parsed STRING, raw_text STRING, grounding_used BOOLEAN, "
    "grounding_queries ARRAY<STRING>, tokens STRUCT<`in`: INT, `out`: INT, total: INT>"
)
VERDICT = "run_id STRING, id STRING, verdict STRING"
REPLY = "category STRING, attributes ARRAY<STRING>, visible_text STRING, brand STRING, model STRING, links ARRAY<STRING>, confidence STRING, reasoning STRING"
ENVELOPE = (
    "candidates ARRAY<STRUCT<content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>, groundingMetadata: STRUCT<webSearchQueries: ARRAY<STRING>>>>, "
    "usageMetadata STRUCT<promptTokenCount: INT, candidatesTokenCount: INT, totalTokenCount: INT>"
)
CATALOGUE = "models ARRAY<STRUCT<name: STRING, displayName: STRING, supportedGenerationMethods: ARRAY<STRING>>>"
FINDING = "severity STRING, id STRING, rule STRING, message STRING"

# Enumerations of the data model.
VERDICTS = ("hit", "partial", "miss")
DIFFICULTIES = ("easy", "hard")
READABLE = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
RECOGNISED = ("heic", "heif")


def blank(text: Column) -> Column:
    """Null and '' are both missing."""
    return F.nullif(text, F.lit("")).isNull()


def empty(array: Column) -> Column:
    """A null array is an empty one."""
    return F.coalesce(F.size(array), F.lit(0)) == 0


def no_keys(json: Column) -> Column:
    """No JSON object, or one without keys."""
    return F.coalesce(F.size(F.json_object_keys(json)), F.lit(0)) == 0


def numbered(df: DataFrame, key: str, name: str, parts: int = 200) -> DataFrame:
    """Rows with their 1-based place in the order of key (its ties in any order), without one task that sorts all of them.

    Rows are ranged by bounds from the data: the values of at most parts - 1 keys, the first by a hash,
    which come to the driver. Ranges are counted, and a row's place is its range's offset and its place within it.
    """
    bounds = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(parts - 1).collect())
    span, offset = f"{name}__range", f"{name}__offset"
    ranged = df.withColumn(span, F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0))
    sizes = ranged.groupBy(span).agg(F.count(F.lit(1)).alias(offset))
    before = Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows at most
    offsets = sizes.select(F.col(span).alias(f"{span}_"), F.coalesce(F.sum(offset).over(before), F.lit(0)).alias(offset))
    placed = ranged.join(F.broadcast(offsets), F.col(span) == F.col(f"{span}_"))
    return placed.withColumn(name, F.col(offset) + F.row_number().over(Window.partitionBy(span).orderBy(key))).drop(span, f"{span}_", offset)


def last_wins(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row for each key: the last by position, as a dictionary built in order would keep it."""
    newest = Window.partitionBy(key).orderBy(F.col(pos).desc())
    return df.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")
