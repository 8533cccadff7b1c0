"""Counts that come with the job that writes a result, not from another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that has the counts once a job has gone through all of them.

    A job that stops early, as one behind a limit, observes what it has seen; write the rows.
    """
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def finding_counts() -> dict[str, Column]:
    """Errors and warnings among findings."""
    return {f"{s}s": F.count_if(F.col("severity") == s) for s in ("error", "warning")}


def refresh_counts() -> dict[str, Column]:
    """Added and preserved items of a refreshed manifest."""
    return {"added": F.count_if("is_new"), "preserved": F.count_if(~F.col("is_new"))}


def outcome_counts() -> dict[str, Column]:
    """Succeeded and failed calls."""
    ok = F.coalesce("ok", F.lit(False))
    return {"succeeded": F.count_if(ok), "failed": F.count_if(~ok)}


def exit_code(counts: dict[str, int]) -> int:
    """Of a validation 1 if there is any error; of a run 2 if every call failed."""
    if counts.get("errors"):
        return 1
    return 2 if counts.get("failed") and not counts.get("succeeded") else 0


def written(rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
    """Write rows by the given function and say what was counted on the way."""
    seen_rows, seen = observed(rows, "counts", **counts)
    write(seen_rows)
    return dict(seen.get)
