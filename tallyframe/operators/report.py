"""The report: coverage, strata, latency and tokens, and the comparison with a manual baseline.

All are aggregates over results (id, difficulty, ok, latency_s, tokens, grounding_used), verdicts
(id, verdict) and the manifest (id, manual_search). Unjudged is never counted as missed, and
unmeasured never as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import DIFFICULTIES, VERDICTS
from .judge import judged


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def coverage(results: DataFrame, verdicts: DataFrame, smoke: bool = False) -> DataFrame:
    """One row: n, judged, unjudged, a count and a share of n for each verdict, hit_rate (of all rows), is_lower_bound, smoke.

    The denominator is the whole run, also while rows are unjudged; the rate is a lower bound then.
    """
    joined = results.select("id").join(verdicts.select("id", "verdict"), "id", "left")
    counted = joined.agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("judged"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    shares = {f"{v}_share": percent(F.col(v), F.col("n")) for v in VERDICTS}
    return counted.withColumns({"unjudged": F.col("n") - F.col("judged"), **shares, "hit_rate": percent(F.col("hit"), F.col("n")), "is_lower_bound": F.col("judged") < F.col("n"), "smoke": F.lit(smoke)})


def verdict_counts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row for each verdict, with 0 for those that never came, and a bar of 30 for all rows."""
    spark = results.sparkSession
    names = spark.createDataFrame([(i, v) for i, v in enumerate(VERDICTS)], "place int, verdict string")
    found = results.select("id").join(verdicts.select("id", "verdict"), "id").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    total = results.agg(F.count(F.lit(1)).alias("total"))
    rows = names.join(found, "verdict", "left").crossJoin(F.broadcast(total)).select("place", "verdict", F.coalesce("n", F.lit(0)).alias("n"), "total")
    return rows.withColumns({"share": percent(F.col("n"), F.col("total")), "bar": F.bround(F.try_divide(F.col("n") * 30.0, F.col("total"))).cast("int")})


def strata(results: DataFrame, verdicts: DataFrame, by: str = "difficulty", values: tuple[str, ...] | None = DIFFICULTIES) -> DataFrame:
    """Hits by stratum: hit_rate is of the judged rows; hit_rate_stratum_full is of all rows of the stratum."""
    rows = results if values is None else results.where(F.col(by).isin(*values))
    joined = rows.select("id", by).join(verdicts.select("id", "verdict"), "id", "left").groupBy(by)
    counted = joined.agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("judged"), F.count_if(F.col("verdict") == "hit").alias("hit"))
    return counted.withColumns({"hit_rate": percent(F.col("hit"), F.col("judged")), "hit_rate_stratum_full": percent(F.col("hit"), F.col("n"))})


#: Distinct values that are looked through at once, at most, and how exactly ranks of values are known before (as a share of the rows, the other way up).
AT_ONCE, ACCURACY = 50_000, 10_000


def exact_ranks(rows: DataFrame, value: str, ranks: dict[int, int] | None = None) -> dict[int, float]:
    """The values at some ranks (from 1) of all rows' values, nulls left out; without ranks, those of the middle two (one, if they are one).

    Bounds around each rank are taken from a sketch of quantiles and narrowed, pass by pass, by exact
    counts, until so few rows lie between them that their values are counted. A value that a bound
    hits is settled by its own count, so values that repeat very often don't hold it up. Each pass is
    one aggregation; no more than AT_ONCE values come to the driver.
    """
    v = F.col("v")
    values = rows.select(F.col(value).cast("double").alias("v")).where(v.isNotNull())
    few = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).limit(AT_ONCE + 1).collect()
    if len(few) <= AT_ONCE:
        return _picked(few, 0, ranks)
    n = values.count()
    wanted, found = set(ranks or {(n + 1) // 2, (n + 2) // 2}), {}
    for rank in sorted(wanted):
        between, below, inside = values, 0, n
        while rank not in found:
            if inside <= AT_ONCE:
                found |= _picked(between.groupBy("v").agg(F.count(F.lit(1)).alias("c")).collect(), below, {rank})
                break
            share = (rank - below) / inside
            low, high = between.agg(F.percentile_approx("v", [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)], ACCURACY)).first()[0]
            counts = between.agg(*[F.count_if(c) for x in (low, high) for c in (v < F.lit(x), v <= F.lit(x))]).first()
            less_low, to_low, less_high, to_high = (below + c for c in counts)
            if less_low < rank <= to_low or less_high < rank <= to_high:
                found[rank] = low if rank <= to_low else high
            elif rank <= less_low:
                between, inside = between.where(v < F.lit(low)), less_low - below
            elif rank > to_high:
                between, inside, below = between.where(v > F.lit(high)), inside - (to_high - below), to_high
            else:
                between, inside, below = between.where((v > F.lit(low)) & (v < F.lit(high))), less_high - to_low, to_low
    return found


def _picked(counted: list, below: int, ranks: set[int] | None) -> dict[int, float]:
    """The values at ranks, of all values with their counts; `below` rows are less than all of them."""
    n = sum(r.c for r in counted)
    wanted = ranks or ({(n + 1) // 2, (n + 2) // 2} if n else set())
    found, so_far = {}, below
    for r in sorted(counted, key=lambda r: (r.v != r.v, r.v)):  # NaN last, as Spark orders it
        found |= {k: r.v for k in wanted if so_far < k <= so_far + r.c}
        so_far += r.c
    return found


def exact_median(rows: DataFrame, value: str) -> DataFrame:
    """One row with median: of all rows' values, nulls left out, the mean of the middle two; null without values."""
    middle = exact_ranks(rows, value).values()
    return rows.sparkSession.createDataFrame([((min(middle) + max(middle)) / 2 if middle else None,)], "median double")


def latency_and_tokens(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of judged rows that succeeded: exact median and largest latency, mean tokens (missing ones are 0), rows that were grounded."""
    rows = judged(results, verdicts).where(F.coalesce("ok", F.lit(False)))
    median = exact_median(rows, "latency_s").first().median
    return rows.agg(
        F.count(F.lit(1)).alias("n_ok"),
        F.max("latency_s").alias("latency_max"),
        F.avg(F.coalesce("tokens.total", F.lit(0))).alias("tokens_mean"),
        F.count_if(F.coalesce("grounding_used", F.lit(False))).alias("grounded"),
        F.lit(median).cast("double").alias("latency_median"),
    )


def one_pass(results: DataFrame, verdicts: DataFrame, by: str = "difficulty") -> DataFrame:
    """A1-A6 of one scan: rows of the run (level run), of each stratum and of each verdict, with both denominators kept apart.

    n and judged count the level's rows and those with a verdict; rate_of_all is hits of all rows,
    rate_of_judged of the judged ones, share the level's part of the run, whether or not judged. Strata
    that are null are one stratum; rows without a verdict are the verdict null. Verdicts that never
    came have no row here (see verdict_counts). The run's row is there for an empty run, too.
    """
    joined = results.select("id", F.col(by).alias("stratum")).join(verdicts.select("id", "verdict"), "id", "left")
    verdict, stratum = F.col("verdict"), F.col("stratum")
    # The judged rows are counted from a column that isn't grouped by, which grouping sets would set to null.
    joined = joined.select("stratum", "verdict", verdict.isNotNull().alias("is_judged"), F.coalesce(verdict == "hit", F.lit(False)).alias("is_hit"))
    level = F.when(F.grouping("stratum") == 0, "stratum").when(F.grouping("verdict") == 0, "verdict").otherwise("run")
    counted = joined.groupingSets([[stratum], [verdict], []], stratum, verdict).agg(
        level.alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("is_judged").alias("judged"), F.count_if("is_hit").alias("hit")
    )
    total = Window.partitionBy()  # over a row for each stratum and verdict
    run = F.max(F.when(F.col("level") == "run", F.col("n"))).over(total)
    named = counted.withColumn("key", F.when(F.col("level") == "stratum", stratum.cast("string")).when(F.col("level") == "verdict", verdict))
    rates = {"rate_of_all": percent(F.col("hit"), F.col("n")), "rate_of_judged": percent(F.col("hit"), F.col("judged")), "share": percent(F.col("n"), run)}
    return named.select("level", "key", "n", "judged", "hit").withColumns(rates)


def baseline(results: DataFrame, verdicts: DataFrame, manifest: DataFrame) -> DataFrame:
    """The paired comparison with the manual baseline over judged rows; manifest: one row for each id (see manifest_by)."""
    rows = results.select("id").join(verdicts.select("id", "verdict"), "id").join(manifest.select("id", "manual_search"), "id", "left")
    success, seconds = F.col("manual_search.success"), F.col("manual_search.seconds")
    measured, hit = success.isNotNull(), F.col("verdict") == "hit"
    counted = rows.agg(
        F.count_if(measured).alias("measured"),
        F.count_if(~measured).alias("missing"),
        F.count_if(success).alias("manual_successes"),
        F.avg(F.when(measured, F.nullif(seconds, F.lit(0.0)))).alias("manual_seconds_mean"),
        F.count_if(measured & hit).alias("model_hits"),
        F.count_if(hit & ~success).alias("win"),
        F.count_if(~hit & success).alias("lose"),
    )
    return counted.withColumns({"tie": F.col("measured") - F.col("win") - F.col("lose"), "comparable": F.col("measured") > 0})


def worse_than_manual(compared: DataFrame, grounding: bool) -> DataFrame:
    """Whether the run falls behind the manual search: only grounded runs with a measured baseline can."""
    return compared.withColumn("worse_than_manual", F.lit(grounding) & (F.col("measured") > 0) & (F.col("model_hits") < F.col("manual_successes")))


def run_outcome(results: DataFrame) -> DataFrame:
    """Successes and failures of a run; exit code 2 if every call failed."""
    ok = F.coalesce("ok", F.lit(False))
    counted = results.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return counted.withColumn("exit_code", F.when((F.col("succeeded") == 0) & (F.col("failed") > 0), 2).otherwise(0))
