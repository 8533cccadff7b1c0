"""Mixing sources to target weights, in column expressions only.

Every row has a hash-random key. Rows are ranged by it within their source, prefix sums of the
sizes are computed in two levels (key ranges, then rows of a range), and each source is cut at its
exact budget, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, count_words, stored, table

#: The weights of the sources in code point order, repeating; a source's target is at most this many times its size.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows of a key range, about.
ROWS_PER_RANGE = 4_000
#: Hexadecimal digits of md5 that make the key.
KEY_DIGITS = 15


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Targets share the sum of all sizes by weight; a target stops at max_epochs times its source's
    size, and the excess goes to the others by weight until none is above. That is one level of
    words per weight for all that aren't stopped: sources are stopped in the order of their limit
    per weight, and the level is the first that no later source's limit is under. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    rows = rows.withColumn("limit", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "level": (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
            "place": F.row_number().over(by_limit),
        }
    )
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    level = F.coalesce(F.min(F.when(fits, F.struct("place", "level"))).over(everything)["level"], F.lit(0.0))
    return rows.select("source", "source_size", F.least("limit", level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """How many words of every row the mix takes, repeats counted: mix_rows() without its row_key."""
    return mix_rows(docs, F.lit(0), weights, max_epochs, seed).drop("row_key")


def mix_rows(docs: DataFrame, row_key: Column, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """How many words of every row the mix takes, repeats counted.

    docs: doc_id, text, source; other columns are ignored. Returns doc_id, size (white-space words;
    null: 0), source_size, target (the source's, in words), taken and row_key as given (long). taken sums to the source's
    rounded target: whole epochs first, then rows in key order, the row at the cut in part. Null
    sources are one source, last in order; rows without words take nothing; texts of any
    length count whole; repeated rows tie and give equal results in either order; an empty table gives an empty one; without any word every
    target is 0.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, KEY_DIGITS)
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            count_words(F.col("text"), SPACE).alias("size"),
            row_key.cast("long").alias("row_key"),
            F.conv(digits, 16, 10).cast("long").alias("key"),
        ),
        "mix",
    )
    # One key range is about ROWS_PER_RANGE rows of the largest source, so the hot source is in many ranges.
    ranges = max(1, rows.count() // ROWS_PER_RANGE)
    width = -(-(16**KEY_DIGITS) // ranges)
    rows = rows.withColumn("range", F.floor(F.col("key") / F.lit(width)).cast("long"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    cuts = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "range", "offset", "source_size", "target")
    joined = rows.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.range") == F.col("c.range")))
    joined = joined.select("r.doc_id", "r.row_key", "r.source", "r.range", "r.key", "r.size", "c.offset", "c.source_size", "c.target")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("offset") + F.sum("size").over(within) - F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(budget.cast("double"), F.col("source_size").cast("double"))).cast("long"), F.lit(0))
    joined = joined.select("doc_id", "row_key", "size", "source_size", "target", budget.alias("budget"), epochs.alias("epochs"), start.alias("start"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "row_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents", seed: str = "mix") -> str:
    """DuckDB SQL with the same key order, whose targets come from resharing the excess again and again."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substring(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, {KEY_DIGITS}))::BIGINT AS key
  FROM {documents}),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1)::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT 0 AS step, source, source_size, weight, false AS stopped,
         weight * (sum(source_size) OVER ())::DOUBLE / sum(weight) OVER () AS target
  FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight, stopped OR target > {MAX_EPOCHS} * source_size,
         CASE WHEN stopped OR target > {MAX_EPOCHS} * source_size THEN ({MAX_EPOCHS} * source_size)::DOUBLE
              ELSE weight * ((sum(source_size) OVER ())::DOUBLE - sum(CASE WHEN stopped OR target > {MAX_EPOCHS} * source_size THEN {MAX_EPOCHS} * source_size ELSE 0 END) OVER ())
                   / sum(CASE WHEN stopped OR target > {MAX_EPOCHS} * source_size THEN 0 ELSE weight END) OVER () END
  FROM r WHERE step <= (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, target, round(target)::BIGINT AS budget FROM r WHERE step = (SELECT max(step) FROM r)),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.budget,
         CASE WHEN t.source_size = 0 THEN 0 ELSE t.budget // t.source_size END AS epochs,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM p"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_mixing": op7_mixing}
ORACLE_SQL: dict[str, str] = {"op7_mixing": oracle()}
