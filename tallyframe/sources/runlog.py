"""Run logs, verdicts and the model catalogue."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATALOGUE, HEADER, RESULT, VERDICT
from .json_array import elements, write_array
from .manifest import _struct


def run_name(path: str) -> str:
    """A run is named by its file's base name, without the prefix and the ending."""
    return os.path.basename(path).removeprefix("run-").removesuffix(".json")


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, results) of a run log in one document, read by byte ranges: one row, and one row for each result with its position. `parsed` stays raw JSON. A cut-off document raises."""
    outer, rows = elements(spark, path, "results")
    header = outer.select(F.from_json("value", f"STRUCT<{_struct(HEADER)}>").alias("run")).select("run.*")
    return header, rows.select("pos", F.from_json("raw", f"STRUCT<{_struct(RESULT)}>").alias("r")).select("pos", "r.*")


def write_run(header: DataFrame, results: DataFrame, path: str) -> None:
    """A run log in one document, written by all tasks and joined: a one-row header, the number of results, and the results (with pos) in their order.

    `parsed` is raw JSON and is written as it is; a field that is null is left out, as the log has it for failures, but for `parsed` of a call that succeeded.
    """
    fields = [c for c in results.columns if c not in ("pos", "parsed")]
    row = F.to_json(F.struct(*fields))
    parsed = F.when(F.col("parsed").isNotNull(), F.col("parsed")).when(F.col("ok"), "null")
    value = F.when(parsed.isNotNull(), F.concat(F.regexp_replace(row, r"\}$", ""), F.when(row != "{}", ",").otherwise(""), F.lit('"parsed":'), parsed, F.lit("}"))).otherwise(row)
    (head,) = header.drop("n").select(F.to_json(F.struct("*"))).first()
    write_array(results.select("pos", value.alias("value")), path, f'{head[:-1]},"n":{results.count()},"results":[', "]}")


def append_results(results: DataFrame, path: str) -> None:
    """Add finished results to a run's parts; earlier parts are never written again."""
    results.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results that a run has so far; n of its header is their count."""
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").json(path)


def start_run(header: DataFrame, path: str) -> None:
    """Open a run: its one-row header is written once, beside the parts that results are appended to. A run that is there raises."""
    header.drop("n").coalesce(1).write.mode("errorifexists").json(f"{path}/header")


def extend_run(results: DataFrame, path: str) -> None:
    """Add finished results to an open run."""
    append_results(results, f"{path}/results")


def open_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, results) of a run in parts, at any time; the header's n is the number of results so far."""
    parts = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/results")
    some = parts.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(parts)
    results = read_results(spark, f"{path}/results") if some else spark.createDataFrame([], RESULT)
    header = spark.read.schema(HEADER).json(f"{path}/header").drop("n")
    n = results.agg(F.count(F.lit(1)).cast("int").alias("n"))
    return header.crossJoin(F.broadcast(n)).select("model", "grounding", "timestamp", "n", "provenance"), results


def read_verdicts(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A JSON object id -> verdict as rows; a missing file has none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path):
        return spark.createDataFrame([], VERDICT)
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("id", "verdict"))
    return pairs.select(F.lit(run_id).alias("run_id"), "id", "verdict")


def append_verdicts(new: DataFrame, path: str) -> None:
    """Verdicts as a table grow by rows; unchanged ones aren't written."""
    new.write.mode("append").parquet(path)


def generating_models(catalogue: DataFrame) -> DataFrame:
    """name (without its prefix) and displayName of the models that can generate content, by name, of a catalogue in one row or as the data source gives it."""
    model = catalogue.select(F.inline("models")) if "models" in catalogue.columns else catalogue
    able = F.array_contains(F.coalesce("supportedGenerationMethods", F.array().cast("array<string>")), "generateContent")
    # A catalogue is a short list. Sorting it in one task asks for it once; a sort by ranges would look at it twice.
    return model.where(able).repartition(1).sortWithinPartitions("name").select(strip_prefix(F.col("name"), "models/").alias("name"), "displayName")


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def fetch(url: str, timeout: float = 30) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
        return reply.read().decode()


def read_catalogue(spark: SparkSession, url: str, get: Callable[[str], str] = fetch) -> DataFrame:
    """The remote catalogue as one row: a small document, fetched once by the driver."""
    return spark.createDataFrame([(get(url),)], "value string").select(F.from_json("value", f"STRUCT<{_struct(CATALOGUE)}>").alias("c")).select("c.*")


def settings(text: str) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and lines without '=' are left out, quotes around a value are dropped."""
    pairs = (line.strip().split("=", 1) for line in text.splitlines() if "=" in line and not line.strip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def find_key(name: str, files: list[str], environ: dict[str, str] | None = None) -> str | None:
    """A key from the environment, else from the first of the files that has it. It is configuration: never a column, never logged."""
    environ = dict(os.environ) if environ is None else environ
    if environ.get(name):
        return environ[name]
    for file in map(Path, files):
        if file.is_file() and (found := settings(file.read_text()).get(name)):
            return found
    return None


def provenance(prompt: str, manifest: str, subset: str | None, tag: str, smoke: bool) -> Column:
    """The provenance struct of a run's header; prompt and manifest by the first 16 digits of their hash."""
    sha = lambda text: F.substring(F.sha2(F.lit(text), 256), 1, 16)
    return F.struct(sha(prompt).alias("prompt_sha"), sha(manifest).alias("manifest_sha"), F.lit(subset).alias("subset"), F.lit(tag).alias("prereg_tag"), F.lit(smoke).alias("smoke"))


def to_record(header: dict, results: list[dict]) -> str:
    """A run log as one JSON document, for export."""
    return json.dumps(header | {"n": len(results), "results": results}, ensure_ascii=False)
