"""Sharding by jump consistent hashing, in column expressions only.

A key's walk over shard numbers starts at 0 and jumps forward by draws that depend on the key and
the number of the jump alone; the last stop below the number of shards is its shard. Appending a
shard lengthens some walks by a stop at the new shard and changes no other, so rows move only into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

SHARDS = 24
#: Jumps that are tried for every key; the mean is about ln(shards). Keys that need more get all of them.
USUAL_JUMPS = 48
#: Rows that one numbering task sorts, about.
ROWS_PER_RUN = 50_000


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a string key among so many shards, without a ring or a table. A null key counts as ''."""
    key = F.coalesce(key, F.lit(""))

    def walk(steps: int) -> Column:
        def step(state: Column, n: Column) -> Column:
            draw = F.conv(F.substring(F.md5(F.concat_ws(":", key, n.cast("string"))), 1, 8), 16, 10).cast("double")
            ahead = F.floor((state["stop"] + F.lit(1)) * F.lit(4294967296.0) / (draw + F.lit(1.0))).cast("long")
            to = F.greatest(ahead, state["stop"] + F.lit(1))
            return F.when(state["done"], state).otherwise(F.struct(F.when(to < shards, to).otherwise(state["stop"]).alias("stop"), (to >= shards).alias("done")))

        start = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(shards <= 1).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), start, step)

    if shards - 1 <= USUAL_JUMPS:
        return walk(shards)["stop"].cast("int")
    usual = walk(USUAL_JUMPS)
    return F.when(usual["done"], usual["stop"]).otherwise(walk(shards)["stop"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A shard and a gapless slot in it for every row of docs.

    Returns the key, size (UTF-8 bytes of the text plus 8), text_crc32 (unsigned), law ('key'), shard,
    slot (0, 1, ... in each shard) and grown_shard (the shard with one shard more). Null texts have no
    bytes and crc32 0, very long ones count whole; null keys count as ''; rows with equal keys share a
    shard and get slots of their own; an empty table gives an empty one; other columns are ignored,
    whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body).cast("long") + 8).alias("size"),
            F.crc32(body).alias("text_crc32"),
            jump_shard(F.col(key).cast("string"), shards).alias("shard"),
            jump_shard(F.col(key).cast("string"), shards + 1).alias("grown_shard"),
        ),
        "shards",
    )
    runs = max(1, rows.count() // (shards * ROWS_PER_RUN))
    # Rows are dealt to runs by all that their order depends on, so not even rows of one key are bound to meet.
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size")
    rows = rows.withColumn("run", F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(runs)))
    # Slots without one task for each shard: runs of a shard are numbered apart, after a prefix sum of the runs' lengths.
    lengths = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("length"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("shard", "run", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return rows.join(offsets, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.row_number().over(within) - 1).alias("slot"), "grown_shard"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents", shards: int = SHARDS) -> str:
    """DuckDB SQL: walks by a recursive query, CRC-32 byte by byte with a table made by its rule (polynomial 0xEDB88320, reflected)."""
    return f"""
WITH RECURSIVE c AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, {0xEDB88320}::BIGINT) ELSE x >> 1 END) AS v FROM range(256) r(i))),
d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM {documents}),
t AS (
  SELECT k, doc_id, key, length(h) // 2 + 8 AS size,
         xor(list_reduce(list_concat([{0xFFFFFFFF}::BIGINT], list_transform(range(0, length(h) // 2), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::BIGINT)),
                         lambda x, b: xor(x >> 8, crc[(xor(x, b) & 255) + 1])), {0xFFFFFFFF}::BIGINT) AS text_crc32
  FROM d, c),
w AS (
  SELECT DISTINCT key, 0::BIGINT AS stop, 1 AS n FROM d
  UNION ALL
  SELECT key, greatest(floor((stop + 1) * 4294967296.0::DOUBLE / (('0x' || substring(md5(key || ':' || n), 1, 8))::BIGINT + 1.0::DOUBLE))::BIGINT, stop + 1) AS stop, n + 1 FROM w WHERE stop < {shards + 1}),
j AS (SELECT key, max(stop) FILTER (stop < {shards})::INT AS shard, max(stop) FILTER (stop < {shards + 1})::INT AS grown_shard FROM w GROUP BY key),
r AS (
  SELECT t.*, shard, grown_shard, ('0x' || substring(md5(key || ':' || text_crc32 || ':' || size), 1, 8))::BIGINT % (SELECT greatest(1, count(*) // {shards * ROWS_PER_RUN}) FROM d) AS run
  FROM t JOIN j USING (key))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY run, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM r"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_sharding": op10_sharding}
ORACLE_SQL: dict[str, str] = {"op10_sharding": oracle()}
