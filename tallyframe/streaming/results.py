"""Results as a stream of files: each micro-batch is written once, and forced verdicts follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.judge import forced_reason, to_judge
from ..schemas import RESULT, VERDICT


def result_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Result parts as they appear in a folder."""
    return spark.readStream.schema(RESULT).option("maxFilesPerTrigger", files_at_once).json(path)


def append_durably(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep every batch as soon as it is there. A batch that runs again after a crash replaces its own part, so that none is lost or doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forced_stream(results: DataFrame, grounding: bool) -> DataFrame:
    """Forced misses of a stream, without state: each result is looked at on its own."""
    reason = forced_reason(F.col("ok"), F.col("parsed"), F.lit(grounding))
    return results.select("id", F.lit("miss").alias("verdict"), reason.alias("reason")).where("reason is not null")


def verdict_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Verdicts of sessions as their files appear in a folder, oldest first."""
    return spark.readStream.schema(VERDICT).option("maxFilesPerTrigger", files_at_once).json(path)


def first_verdicts(verdicts: DataFrame) -> DataFrame:
    """The verdict of each id that came first; later ones are dropped, also those that come after a restart.

    The ids are the stream's state, which its checkpoint keeps. A session judges an id once, so that a
    batch of one file has no two verdicts of it; of several in one batch any one counts.
    """
    return verdicts.select("id", "verdict").dropDuplicates(["id"])


def unjudged_stream(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Results of a stream that have no verdict in a table: what is left to judge when a batch comes."""
    return to_judge(results, verdicts)
