"""Verdicts: what is forced, what people said before, and what is still to be judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VERDICTS, no_keys


def has_links(parsed: Column) -> Column:
    """Whether a raw reply has links: anything but null, '', [], {} and false, so that a bare string counts."""
    links = F.get_json_object(parsed, "$.links")
    return links.isNotNull() & ~F.trim(links).isin("", "[]", "{}", "null", "false", "0")


def forced_reason(ok: Column, parsed: Column, grounding: Column) -> Column:
    """Why a result is a miss without being judged; null if it isn't. The first that holds counts."""
    return (
        F.when(~F.coalesce(ok, F.lit(False)), "call failed")
        .when(no_keys(parsed), "no answer could be read")
        .when(F.coalesce(grounding, F.lit(False)) & ~has_links(parsed), "no supporting link")
    )


def merge(prior: DataFrame, new: DataFrame) -> DataFrame:
    """id, verdict: prior and new together; a prior verdict is never replaced."""
    return prior.select("id", "verdict").unionByName(new.select("id", "verdict").join(prior.select("id"), "id", "left_anti"))


def to_judge(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Results without a verdict, in whatever order they came; repeated rows stay."""
    return results.join(verdicts.select("id"), "id", "left_anti")


def judged(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    return results.join(verdicts.select("id"), "id", "left_semi")


def force(results: DataFrame, verdicts: DataFrame, grounding: Column) -> DataFrame:
    """id, verdict, reason of results that are still to be judged and needn't be."""
    reason = forced_reason(F.col("ok"), F.col("parsed"), grounding)
    return to_judge(results, verdicts).select("id", F.lit("miss").alias("verdict"), reason.alias("reason")).where("reason is not null").dropDuplicates(["id"])


def with_verdicts(results: DataFrame, verdicts: DataFrame, grounding: Column) -> DataFrame:
    """Results with their verdict (null: unjudged); verdict_forced tells what is forced even where an earlier verdict says otherwise."""
    forced = forced_reason(F.col("ok"), F.col("parsed"), grounding)
    return results.withColumn("verdict_forced", forced.isNotNull()).join(verdicts.select("id", "verdict"), "id", "left")


def unknown_verdicts(verdicts: DataFrame) -> DataFrame:
    """Rows that break the enumeration; a report on them would be wrong."""
    return verdicts.where(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)))


def assert_known(verdicts: DataFrame) -> DataFrame:
    """The same rows, but a job over a verdict outside the enumeration fails."""
    fine = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    checked = F.when(fine, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("null")))))
    return verdicts.withColumn("verdict", checked)
