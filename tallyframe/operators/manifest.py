"""Building a manifest: keep what is known, number what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import last_wins, numbered


def used_ids(manifest: DataFrame) -> DataFrame:
    return manifest.select("id").where(F.col("id").isNotNull()).distinct()


def item_id(n: F.Column) -> F.Column:
    """p01 ... p99, p100: two digits at least, never cut."""
    return F.format_string("p%02d", n)


def allocate_ids(files: DataFrame, used: DataFrame) -> DataFrame:
    """file -> id: each file by name gets the next number whose id isn't used, gaps first.

    Candidates are as many numbers as files and used ids together, so enough are left after the
    anti-join. Both sides are numbered by ranges, so no task sorts all files.
    """
    ranked = numbered(files.select("file"), "file", "place")
    most = files.count() + used.count()
    free = files.sparkSession.range(1, most + 1).select(item_id(F.col("id")).alias("new_id"), F.col("id").alias("n"))
    free = numbered(free.join(used, free["new_id"] == used["id"], "left_anti"), "n", "place")
    return ranked.join(free, "place").select("file", F.col("new_id").alias("id"))


def skeleton(file: F.Column, id_: F.Column, size: F.Column) -> list[F.Column]:
    """The columns of a new item: everything that people fill in is null, difficulty is easy."""
    return [
        id_.alias("id"),
        file.alias("file"),
        size.alias("_size"),
        F.lit(None).cast("array<int>").alias("bbox"),
        F.lit("easy").alias("difficulty"),
        F.struct(*[F.lit(None).cast("string").alias(k) for k in ("brand", "model", "url")]).alias("truth"),
        F.struct(F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("boolean").alias("success")).alias("manual_search"),
    ]


def refresh(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Readable files left-joined with the manifest: known items stay as they are, new files get an item (is_new).

    Items whose photo isn't readable any more are dropped, but their ids stay taken in this run.
    scanned: file, width, height of readable files.
    """
    known = last_wins(manifest.where(F.col("file").isNotNull()), "file").drop("pos")
    new = scanned.join(known, "file", "left_anti")
    ids = allocate_ids(new.select("file"), used_ids(manifest))
    fresh = new.join(ids, "file").select(*skeleton(F.col("file"), F.col("id"), F.array("width", "height")), F.lit(True).alias("is_new"))
    kept = scanned.select("file").join(known, "file").withColumn("is_new", F.lit(False)).select(*fresh.columns)
    rows = kept.unionByName(fresh)
    return numbered(rows, "file", "pos").withColumn("pos", F.col("pos") - 1)


def refresh_counts(refreshed: DataFrame) -> DataFrame:
    return refreshed.agg(F.count_if("is_new").alias("added"), F.count_if(~F.col("is_new")).alias("preserved"))
