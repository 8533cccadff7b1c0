"""Validation: declarative rules over a manifest, as rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import DIFFICULTIES, blank, empty

SUGGESTED = 10


def box_findings(bbox: Column, width: Column, height: Column) -> Column:
    """Which box rule a row breaks: 'V3' not four numbers, 'V4' no area, 'V5' outside the image; null if none, or no box."""
    x, y, w, h = (F.get(bbox, F.lit(i)) for i in range(4))
    return (
        F.when(empty(bbox), None)
        .when(F.size(bbox) != 4, "V3")
        .when((w <= 0) | (h <= 0), "V4")
        .when((x < 0) | (y < 0) | (x + w > width) | (y + h > height), "V5")
    )


def repeated(items: DataFrame) -> DataFrame:
    """Items (id, pos, ...) with again: whether the id was there before, in the order of pos. Missing ids are one id, '?'.

    Missing ids may be many, so they are compared with the first of them, and not brought together.
    """
    tag = F.coalesce("id", F.lit("?"))
    first = items.where(tag == "?").agg(F.min("pos").alias("first_missing"))
    apart = F.when(tag == "?", F.pmod(F.xxhash64("pos"), F.lit(1024)))
    nth = F.row_number().over(Window.partitionBy(tag, apart).orderBy("pos"))
    again = F.when(tag == "?", F.col("pos") > F.col("first_missing")).otherwise(F.col("nth") > 1)
    return items.withColumn("nth", nth).crossJoin(F.broadcast(first)).withColumn("again", again).drop("nth", "first_missing")


def validate(manifest: DataFrame, files: DataFrame, smoke: bool = False) -> DataFrame:
    """Findings (severity, id, rule, message) as a multiset; an error makes a manifest unusable, a warning doesn't.

    manifest: items with pos; files: file, width, height of the photos there are. A missing photo
    (V2) hides what else could be said about its item, but for a repeated id (V1). An item without a
    file name is taken to have one that exists, as no file is missing under that name. In smoke mode
    a missing truth is a warning and the baseline's absence says nothing.
    """
    tag = F.coalesce("id", F.lit("?"))
    there = files.select(F.col("file").alias("__file"), "width", "height")
    rows = repeated(manifest).join(there, F.col("file") == F.col("__file"), "left")
    missing = F.col("file").isNotNull() & F.col("__file").isNull()

    def finding(when: Column, rule: Column | str, severity: str, message: Column | str) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(when, F.struct(F.lit(severity).alias("severity"), tag.alias("id"), as_column(rule).alias("rule"), as_column(message).alias("message")))

    box = box_findings(F.col("bbox"), F.col("width"), F.col("height"))
    no_truth = blank(F.col("truth.brand")) & blank(F.col("truth.model"))
    rules = [
        finding(F.col("again"), "V1", "error", "repeated id"),
        finding(missing, "V2", "error", F.concat(F.lit("no such file: "), F.col("file"))),
        finding(~missing & box.isNotNull(), box, "error", F.concat(F.lit("bad box: "), F.to_json("bbox"))),
        finding(~missing & ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), "V6", "error", "difficulty is neither easy nor hard"),
        finding(~missing & no_truth, "V7", "warning" if smoke else "error", "neither brand nor model is known"),
        *([] if smoke else [finding(~missing & F.col("manual_search.success").isNull(), "V8", "warning", "the manual baseline wasn't measured")]),
    ]
    found = rows.select(F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull())).alias("f")).select("f.*")
    if smoke:
        return found
    sizes = strata_sizes(manifest)
    few = sizes.where((F.col("easy") < SUGGESTED) | (F.col("hard") < SUGGESTED))
    return found.unionByName(few.select(F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("id"), F.lit("V9").alias("rule"), F.format_string("few rows: %d easy, %d hard", "easy", "hard").alias("message")))


def strata_sizes(manifest: DataFrame) -> DataFrame:
    """Easy and hard rows, those with missing photos included."""
    return manifest.agg(*[F.count_if(F.col("difficulty") == d).alias(d) for d in DIFFICULTIES])


def summary(findings: DataFrame) -> DataFrame:
    """Errors, warnings and the exit code: 1 if and only if there is an error."""
    counted = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counted.withColumn("exit_code", (F.col("errors") > 0).cast("int"))
