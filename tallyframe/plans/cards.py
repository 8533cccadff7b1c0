"""What a judge sees of a result: a projection, printed by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import listed, shown
from ..schemas import REPLY, blank
from ..sources.manifest import _struct


def cards(results: DataFrame, manifest: DataFrame, grounding: bool = True) -> DataFrame:
    """One row for each result: its file and stratum, the reply's fields for display, at most five links and four queries, latency and tokens, the answer, or a failed call's status and error."""
    reply = F.from_json("parsed", f"STRUCT<{_struct(REPLY)}>")
    rows = results.withColumn("reply", reply).join(manifest.select("id", "truth"), "id", "left")
    missing = {"brand": "null", "model": "null"}
    fields = [shown(F.col(f"reply.{k}"), missing.get(k, "-")).alias(k) for k in ("category", "visible_text", "brand", "model", "confidence", "reasoning")]
    links = F.coalesce("reply.links", F.array().cast("array<string>"))
    return rows.select(
        "id",
        "file",
        shown(F.col("difficulty"), "?").alias("difficulty"),
        "http",
        F.left(F.col("error"), F.lit(400)).alias("error"),
        *fields,
        shown(listed(F.col("reply.attributes"))).alias("attributes"),
        F.size(links).alias("n_links"),
        F.slice(links, 1, 5).alias("links"),
        listed(F.slice(F.coalesce("grounding_queries", F.array().cast("array<string>")), 1, 4)).alias("queries"),
        F.left(F.col("raw_text"), F.lit(400)).alias("raw_text"),
        "latency_s",
        F.col("tokens.total").alias("tokens"),
        (F.lit(grounding) & ~(blank(F.col("reply.brand")) & blank(F.col("reply.model"))) & (F.size(links) == 0)).alias("unsupported"),
        shown(F.col("truth.brand"), "?").alias("true_brand"),
        shown(F.col("truth.model"), "?").alias("true_model"),
        F.nullif("truth.url", F.lit("")).alias("true_url"),
    )


def render(card: dict) -> str:
    """A card as text, for the driver to print."""
    return "\n".join(f"{k:>12}: {v}" for k, v in card.items() if v not in (None, "", []))


def render_report(coverage: dict, verdicts: list[dict] = (), strata: list[dict] = (), calls: dict | None = None, manual: dict | None = None) -> str:
    """A report as text, from the rows of the report's operators; rounding is for display alone.

    coverage: its one row; verdicts: rows of verdict_counts; strata: rows by difficulty, of which those
    with judged rows are shown; calls: latency_and_tokens; manual: baseline with worse_than_manual.
    """
    sign = ">= " if coverage["is_lower_bound"] else ""
    smoke = " (smoke run: not a measurement)" if coverage["smoke"] else ""
    lines = [f"hit rate {sign}{coverage['hit_rate']:.1f}% of {coverage['n']}, unjudged {coverage['unjudged']}{smoke}"]
    lines += [f"{r['verdict']:>12} {r['n']:>6} {r['share']:5.1f}% {'#' * r['bar']}" for r in sorted(verdicts, key=lambda r: r["place"])]
    lines += [f"{r['difficulty']:>12} {r['hit']}/{r['judged']} ({r['hit_rate']:.0f}%)" for r in sorted(strata, key=lambda r: r["difficulty"]) if r["judged"]]
    if calls and calls["n_ok"]:
        lines.append(f"latency median {calls['latency_median']:.1f} s, largest {calls['latency_max']:.1f} s; {calls['tokens_mean']:.0f} tokens a call; grounded {calls['grounded']}/{calls['n_ok']}")
    if manual and manual["comparable"]:
        seconds = "" if manual["manual_seconds_mean"] is None else f", {manual['manual_seconds_mean']:.0f} s each"
        lines.append(f"manual search {manual['manual_successes']}/{manual['measured']}{seconds}; model {manual['model_hits']}/{manual['measured']}")
        lines.append(f"pairs: {manual['win']} won, {manual['lose']} lost, {manual['tie']} tied" + (" - worse than manual search" if manual.get("worse_than_manual") else ""))
    elif manual:
        lines.append("manual search: 0 measured, nothing to compare with")
    if manual and manual["missing"]:
        lines.append(f"{manual['missing']} rows without a measured baseline are excluded")
    return "\n".join(lines)
