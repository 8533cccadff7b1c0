"""The rubric, and the continue / redesign / stop rule on a run's rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each verdict means, by whether the run was grounded.
RUBRIC = [
    (True, "hit", "the same product"),
    (True, "partial", "merely similar"),
    (True, "miss", "not supported"),
    (False, "hit", "enough to search by"),
    (False, "partial", "in part"),
    (False, "miss", "of no use"),
]


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUBRIC, "grounding boolean, verdict string, meaning string")


def with_meaning(verdicts: DataFrame, header: DataFrame) -> DataFrame:
    """Each verdict with its meaning in a run of this kind; the rubric has six rows, the header one."""
    terms = rubric(verdicts.sparkSession).join(F.broadcast(header.select("grounding")), "grounding")
    return verdicts.join(F.broadcast(terms.select("verdict", "meaning")), "verdict", "left")


def decide(grounding: Column, easy: Column, overall: Column, manual: Column) -> Column:
    """The stage's outcome from percentages; manual may be null. Where the rule is silent the outcome is undetermined; stop wins over continue (our choice for both)."""
    text_only = F.when(overall < 30, "stop").when((easy >= 70) & (overall >= 50), "continue")
    searched = F.when((overall < 10) | F.coalesce(overall < manual, F.lit(False)), "stop").when(overall < 30, "redesign").when(easy >= 50, "continue")
    return F.coalesce(F.when(grounding, searched).otherwise(text_only), F.lit("undetermined"))
