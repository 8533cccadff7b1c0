"""Inference that keeps what it has: items are asked about in small batches, and each batch's results are written before the next begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.infer import INPUTS, Transport, http_post, infer, measured_view

#: What infer() needs of an item.
STAGED = "id STRING, file STRING, difficulty STRING, photo_sha STRING, bbox ARRAY<INT>, crop_px ARRAY<INT>, crop_bytes BIGINT, jpeg BINARY"


def stage_items(items: DataFrame, path: str, rows_at_once: int = 20) -> None:
    """Write items (INPUTS and jpeg) as files of at most so many rows, without their answers. A file is what a crash may cost: its calls are made again."""
    measured_view(items).select(*INPUTS, "jpeg").write.option("maxRecordsPerFile", rows_at_once).parquet(path)


def infer_durably(spark: SparkSession, staged: str, run: str, prompt: str, endpoint: str, key: str, grounding: bool, transport: Transport = http_post, files_at_once: int = 1) -> StreamingQuery:
    """Ask about staged items, a batch of files at a time, and keep each batch's results as a part of the run (see open_run).

    A run that was broken off goes on with the batch that it was in: items of earlier batches aren't
    asked about again, and that batch's part is replaced as a whole. Started again after its end, it
    only takes what was staged since.
    """

    def ask(batch: DataFrame, number: int) -> None:
        infer(batch, prompt, endpoint, key, grounding, transport).write.mode("overwrite").json(f"{run}/results/batch={number}")

    items = spark.readStream.schema(STAGED).option("maxFilesPerTrigger", files_at_once).parquet(staged)
    return items.writeStream.foreachBatch(ask).option("checkpointLocation", f"{run}/offsets").trigger(availableNow=True).start()


def in_order(results: DataFrame, items: DataFrame) -> DataFrame:
    """A run's results with pos: the place that their item has in the manifest."""
    places = items.groupBy(F.col("id").alias("item_id")).agg(F.min("pos").alias("pos"))
    return results.join(places, F.col("id").eqNullSafe(F.col("item_id")), "left").drop("item_id")
