"""Queries that write what the library writes, and read it back: manifests, run logs, verdicts, photos and streams.

Files go to the folder that driver and executors share, as spark.checkpoint.dir names it, and to the
local one of a session in one process.
"""

from __future__ import annotations

import contextlib
import re
import struct
import time
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .functions import pixels
from .functions.rounding import python_round
from .operators import judge, manifest, metrics, report
from .plans import cards, infer
from .queries import BASELINE, R, V, file_list, known_items, manual_of, query, results_of, t, verdicts_of
from .schemas import RESULT
from .sources import catalogue, json_array, photos, runlog
from .sources import manifest as manifests
from .streaming import inference as asking
from .streaming import results as streams


def folder(spark: SparkSession) -> str:
    """A new folder for one query's files; it goes with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base or 'file:///tmp/checkpoints/tallyframe'}/round-trip-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


@query("SELECT 'p' || lpad((item_id + 2)::VARCHAR, greatest(2, length((item_id + 2)::VARCHAR))::INTEGER, '0') AS id, 'f' || lpad(item_id::VARCHAR, 5, '0') || '.jpg' AS file, item_id % 6 = 0 AS replaced FROM benchmark WHERE item_id % 3 = 0")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written, read, replaced in place by itself with some items again, and read by file, where the last one counts."""
    path = f"{folder(spark)}/manifest.json"
    manifests.write_manifest(known_items(spark, d), path)
    once = manifests.read_manifest(spark, path, must_have_rows=True)
    again = once.where("cast(substring(file, 2, 5) as int) % 6 = 0").withColumns({"difficulty": F.lit("hard"), "pos": F.col("pos") + 1_000_000})
    manifests.write_manifest(once.unionByName(again), path)
    rows = manifests.manifest_by(manifests.read_loosely(spark, path).drop("raw"), "file")
    return rows.select("id", "file", (F.col("difficulty") == "hard").alias("replaced"))


@query("SELECT 'p' || lpad((item_id + 2)::VARCHAR, greatest(2, length((item_id + 2)::VARCHAR))::INTEGER, '0') AS id FROM benchmark WHERE item_id = 3")
def one_item(spark: SparkSession, d: str) -> DataFrame:
    """the items of one id, of a manifest that must have it."""
    return manifests.only(known_items(spark, d), "p05").select("id")


@query("SELECT doc_id::VARCHAR AS id, n_chars::DOUBLE / 100 AS latency_s, 'm' AS model, (SELECT count(*) FROM documents)::INTEGER AS n FROM documents")
def run_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """A run's header, results appended in two steps, and n as their count."""
    path = folder(spark)
    header = spark.createDataFrame([("m", False, "20240101-000000")], "model string, grounding boolean, timestamp string")
    runlog.start_run(header.withColumns({"n": F.lit(0), "provenance": runlog.provenance("a prompt", "[]", None, "unknown", False)}), path)
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") / 100.0).alias("latency_s"), (F.col("doc_id") % 2).alias("half"))
    for half in (0, 1):
        runlog.extend_run(rows.where(F.col("half") == half).drop("half"), path)
    header, results = runlog.open_run(spark, path)
    return results.select("id", "latency_s").crossJoin(F.broadcast(header.select("model", "n")))  # a one-row header


@query("""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id::VARCHAR AS id, doc_id % 5 > 0 AS ok, CASE WHEN doc_id % 5 = 0 THEN 503 END AS http, CASE WHEN doc_id % 5 > 0 THEN '{"links":["}"],"n":' || n_chars || '}' END AS parsed,
  text AS raw_text, n_chars::INTEGER AS total, 'm' AS model, (SELECT count(*) FROM documents)::INTEGER AS n, '"results": [' AS tag FROM documents""")
def run_document(spark: SparkSession, d: str) -> DataFrame:
    """All documents as the results of a run log in one JSON document, written by all tasks and read by byte ranges."""
    path = f"{folder(spark)}/run-all.json"
    header = spark.createDataFrame([("m", False, "20240101-000000")], "model string, grounding boolean, timestamp string")
    header = header.withColumn("provenance", runlog.provenance("a prompt", "[]", None, '"results": [', False))
    ok = F.col("doc_id") % 5 > 0
    results = t(spark, d, "documents").select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), ok.alias("ok"), F.when(~ok, 503).alias("http"), F.when(ok, F.format_string('{"links":["}"],"n":%d}', "n_chars")).alias("parsed"), F.col("text").alias("raw_text"), F.struct(F.col("n_chars").cast("int").alias("total")).alias("tokens")
    )
    runlog.write_run(header, results, path)
    head, rows = runlog.read_run(spark, path)
    head = head.select("model", "n", F.col("provenance.prereg_tag").alias("tag"))  # one row
    return rows.select("pos", "id", "ok", "http", "parsed", "raw_text", F.col("tokens.total").alias("total")).crossJoin(F.broadcast(head))


@query("SELECT item_id::VARCHAR AS id, item_id * 10 + 1 AS pos, left(text, 20) AS brand FROM benchmark")
def manifest_by_id(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by id of a manifest in which every id stands twice; the later item counts."""
    path = f"{folder(spark)}/manifest.json"
    rows = t(spark, d, "benchmark").crossJoin(spark.range(2).withColumnRenamed("id", "again"))  # two rows of each
    truth = F.struct(F.when(F.col("again") == 1, F.left("text", F.lit(20))).alias("brand"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("url"))
    items = rows.select((F.col("again") * 1_000_000 + F.col("item_id")).alias("pos"), F.col("item_id").cast("string").alias("id"), truth.alias("truth"), F.struct((F.col("item_id") * 10 + F.col("again")).cast("double").alias("seconds"), F.lit(None).cast("boolean").alias("success")).alias("manual_search"))
    manifests.write_manifest(items, path)
    known = manifests.manifest_by(manifests.read_manifest(spark, path), "id")
    return known.select("id", F.col("manual_search.seconds").cast("long").alias("pos"), F.col("truth.brand").alias("brand"))


@query("""
SELECT (SELECT count(*) FROM documents WHERE source <> 'src0') AS succeeded, (SELECT count(*) FROM documents WHERE source = 'src0' OR source IS NULL) AS failed, 0 AS exit_code,
  (SELECT count(*) FROM benchmark WHERE item_id % 3 <> 0) AS added, (SELECT count(*) FROM benchmark WHERE item_id % 3 = 0 AND item_id % 2 = 0) AS preserved""")
def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts that come with the jobs that write a run's results and a refreshed manifest."""
    path = folder(spark)
    results = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("source") != "src0").alias("ok"))
    run = metrics.written(results, lambda rows: runlog.append_results(rows, f"{path}/results"), **metrics.outcome_counts())
    files = file_list(spark, d).where("item_id % 3 <> 0 OR item_id % 2 = 0").select("file", F.lit(4).alias("width"), F.lit(3).alias("height"))
    items = metrics.written(manifest.refresh(files, known_items(spark, d)), lambda rows: rows.write.parquet(f"{path}/items"), **metrics.refresh_counts())
    counts = run | {"exit_code": metrics.exit_code(run)} | items
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} {'int' if k == 'exit_code' else 'long'}" for k in counts))


@query(f"""
SELECT id::VARCHAR AS id, verdict FROM {V} WHERE id % 2 = 0 UNION ALL
SELECT id::VARCHAR, 'miss' FROM {V} v WHERE id NOT IN (SELECT id FROM {V} WHERE id % 2 = 0)""")
def verdict_stream(spark: SparkSession, d: str) -> DataFrame:
    """T2, J3 on a stream: sessions' verdicts as they come, earlier ones winning, also over a restart."""
    path, rows = folder(spark), verdicts_of(spark, d).select(F.lit("run").alias("run_id"), F.col("id").cast("string").alias("id"), "verdict")
    sessions = rows.where("cast(id as long) % 2 = 0"), rows.withColumn("verdict", F.lit("miss"))
    for session in sessions:
        session.write.mode("append").json(f"{path}/in")
        streams.append_durably(streams.first_verdicts(streams.verdict_stream(spark, f"{path}/in", 1000)), f"{path}/kept", f"{path}/offsets").awaitTermination()
    return spark.read.schema("id string, verdict string").json(f"{path}/kept").select("id", "verdict")


@query("SELECT n_name AS name, n_name AS \"displayName\" FROM nation WHERE n_regionkey % 2 = 0")
def catalogue_source(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue for each region through the data source, fetched by tasks."""
    regions = t(spark, d, "nation").groupBy("n_regionkey").agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("models/"), "n_name").alias("name"), F.col("n_name").alias("displayName"), F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("generateContent"))).alias("supportedGenerationMethods"))).alias("models"))).alias("text")
    )
    texts = {f"http://region/{r.n_regionkey}": r.text for r in regions.collect()}  # five regions
    catalogue.register(spark, texts.__getitem__, "region_catalogues")
    return runlog.generating_models(spark.read.format("region_catalogues").option("url", "\n".join(sorted(texts))).load())


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'miss' WHEN toxic = 1 THEN 'partial' ELSE 'hit' END AS verdict FROM labels")
def verdict_document(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts in one JSON object, as people's tools leave them."""
    path = f"{folder(spark)}/verdicts"
    rows = verdicts_of(spark, d).select(F.to_json(F.create_map(F.col("id").cast("string"), "verdict")).alias("value"), F.col("id").alias("pos"))
    json_array.write_array(rows.select("pos", F.expr("substring(value, 2, length(value) - 2)").alias("value")), path, "{", "}")
    return runlog.read_verdicts(spark, path, "run").select("id", "verdict")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'miss' WHEN toxic = 1 THEN 'partial' ELSE 'hit' END AS verdict FROM labels")
def verdict_table(spark: SparkSession, d: str) -> DataFrame:
    """Half of the verdicts are there; a resumed session adds those that are still to judge."""
    path, all_ = f"{folder(spark)}/verdicts", verdicts_of(spark, d).select(F.lit("run").alias("run_id"), F.col("id").cast("string").alias("id"), "verdict")
    runlog.append_verdicts(all_.where("cast(id as long) % 2 = 0"), path)
    runlog.append_verdicts(judge.to_judge(all_, spark.read.parquet(path)), path)
    return spark.read.parquet(path).select("id", "verdict")


def stub_png(width: int, height: int) -> bytes:
    """A whole PNG file, by its chunks, without pixels that matter."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"") + chunk(b"IEND", b"")


@query("""
SELECT n_name || '.' || CASE n_nationkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'PNG' WHEN 2 THEN 'heic' ELSE 'txt' END AS file,
  CASE WHEN n_nationkey % 4 = 2 OR n_nationkey IN (4, 5) THEN 'unreadable' WHEN n_nationkey % 4 = 3 THEN 'ignored' ELSE 'readable' END AS class,
  CASE WHEN n_nationkey % 4 < 2 AND n_nationkey NOT IN (4, 5) THEN (n_nationkey + 1)::INTEGER END AS width, CASE WHEN n_nationkey % 4 < 2 AND n_nationkey NOT IN (4, 5) THEN (n_regionkey + 1)::INTEGER END AS height FROM nation""")
def photo_directory(spark: SparkSession, d: str) -> DataFrame:
    """A directory of pictures, one for each of the 25 nations, two of them cut off."""
    path = folder(spark)
    jvm = spark._jvm
    for key, name, region in t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.{('png', 'PNG', 'heic', 'txt')[key % 4]}")
        out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target)
        whole = stub_png(key + 1, region + 1)
        out.write(bytearray(whole[:-8] if key in (4, 5) else whole))
        out.close()
    return photos.scan_photos(spark, path)


#: Pictures of w x h pixels, of which that at (x, y) is x + y, 2x and y + k, modulo 256; cut to the box (3, 2, w - 5, h - 4).
PIXELS = """
SELECT item_id, (w - 5)::INTEGER AS width, (h - 4)::INTEGER AS height, sum((x + y) % 256)::BIGINT AS red, sum(2 * x % 256)::BIGINT AS green, sum((y + item_id) % 256)::BIGINT AS blue,
  max(CASE WHEN x = w - 3 AND y = h - 3 THEN (x + y) % 256 END)::INTEGER AS corner
FROM (SELECT item_id, 20 + item_id % 40 AS w, 15 + item_id % 23 AS h FROM benchmark), range(3, 58) a(x), range(2, 36) b(y) WHERE x < w - 2 AND y < h - 2 GROUP BY item_id, w, h"""


@F.pandas_udf(BinaryType())
def drawn(keys: pd.Series) -> pd.Series:
    """A PNG for each key, as PIXELS says."""

    def draw(k: int) -> bytes:
        y, x = np.mgrid[: 15 + k % 23, : 20 + k % 40]
        return pixels.encode_png(np.dstack([x + y, 2 * x, y + k]) % 256)

    return keys.map(draw)


@query(PIXELS)
def cropped_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures drawn from a formula, written, read, cropped and read again; their pixels are added up."""
    path, size = f"{folder(spark)}/pictures", [F.col("item_id") % 40 + 20, F.col("item_id") % 23 + 15]
    t(spark, d, "benchmark").select("item_id", drawn("item_id").alias("content")).write.parquet(path)
    box = F.array(F.lit(3), F.lit(2), (size[0] - 5).cast("int"), (size[1] - 4).cast("int"))
    crop = spark.read.parquet(path).select("item_id", pixels.crop_picture("content", box).alias("crop"))
    return crop.select("item_id", pixels.pixel_sums("crop.content").alias("p")).select("item_id", "p.*")


@query("SELECT item_id, 1024 AS width, trunc(h * (1024.0::DOUBLE / w))::INTEGER AS height, item_id % 256 AS grey FROM (SELECT item_id, 1030 + item_id % 300 AS w, 40 + item_id % 97 AS h FROM benchmark)")
def shrunk_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of one grey stay that grey at 1024 pixels of the longest side, the other side cut to whole pixels."""
    crop = t(spark, d, "benchmark").select("item_id", pixels.crop_picture(greyed("item_id"), F.lit(None).cast("array<int>")).alias("crop"))
    found = crop.select("item_id", pixels.pixel_sums("crop.content").alias("p"))
    return found.select("item_id", "p.width", "p.height", ((F.col("p.red") + F.col("p.green") + F.col("p.blue")) / (F.col("p.width") * F.col("p.height") * 3)).cast("long").alias("grey"))


@F.pandas_udf(BinaryType())
def greyed(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: pixels.encode_png(np.full((40 + k % 97, 1030 + k % 300, 3), k % 256, np.uint8)))


@query("SELECT doc_id::VARCHAR AS id, source <> 'src0' AS ok FROM documents")
def durable_stream(spark: SparkSession, d: str) -> DataFrame:
    """Results as a stream of parts, kept batch by batch; a second start goes on where the first ended."""
    path = folder(spark)
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("source") != "src0").alias("ok"))
    for odd in (0, 1):
        runlog.append_results(rows.where(F.col("id").cast("long") % 2 == odd), f"{path}/in")
        streams.append_durably(streams.result_stream(spark, f"{path}/in", 1000), f"{path}/kept", f"{path}/offsets").awaitTermination()
    return spark.read.schema(RESULT).json(f"{path}/kept").select("id", "ok")


def echo(url: str, body: str, timeout: float) -> tuple[int, str]:
    """A transport without a network: replies with the length of what it was asked, and fails for some."""
    n = len(body)
    if n % 5 == 0:
        return 503, "busy"
    return 200, '{"candidates": [{"content": {"parts": [{"text": "{\\"brand\\": \\"b\\"}"}]}}], "usageMetadata": {"totalTokenCount": %d}}' % n


PLAIN = """length('{"contents":[{"parts":[{"text":"what is it"},{"inline_data":{"mime_type":"image/jpeg","data":"' || base64(encode(text)) || '"}}]}],"generationConfig":{"temperature":0.0}}')"""


CALLS = f"""
SELECT item_id::VARCHAR AS id, n % 5 <> 0 AS ok, CASE WHEN n % 5 = 0 THEN 503 END AS http, CASE WHEN n % 5 = 0 THEN 'busy' END AS error,
  CASE WHEN n % 5 <> 0 THEN '{{"brand": "b"}}' END AS parsed, CASE WHEN n % 5 <> 0 THEN n::INTEGER END AS total FROM (SELECT item_id, {PLAIN} AS n FROM benchmark)"""


def asked_items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as what a model is asked about; their texts stand for pictures."""
    none = F.lit(None)
    return t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("f").alias("file"), F.lit("easy").alias("difficulty"), F.lit("s").alias("photo_sha"), none.cast("array<int>").alias("bbox"), none.cast("array<int>").alias("crop_px"), F.lit(1).cast("long").alias("crop_bytes"), F.col("text").cast("binary").alias("jpeg"))


def asked_fields(results: DataFrame) -> DataFrame:
    return results.select("id", "ok", "http", "error", "parsed", F.col("tokens.total").alias("total"))


@query(CALLS)
def inference(spark: SparkSession, d: str) -> DataFrame:
    """One call for each item through an injected transport; a failure is a result."""
    return asked_fields(infer.infer(asked_items(spark, d), "what is it", "http://host/model", "", False, echo))


def breaking(url: str, body: str, timeout: float) -> tuple[int, str]:
    """A transport that takes its task down with it for some."""
    if len(body) % 7 == 3:
        raise RuntimeError("broken off")
    return echo(url, body, timeout)


@query(CALLS)
def resumed_inference(spark: SparkSession, d: str) -> DataFrame:
    """A run that is broken off in one of its batches goes on there when it is started again, and its parts are read as one run."""
    path = folder(spark)
    asking.stage_items(asked_items(spark, d).repartition(4), f"{path}/staged", rows_at_once=10)
    start = lambda transport: asking.infer_durably(spark, f"{path}/staged", f"{path}/run", "what is it", "http://host/model", "", False, transport, files_at_once=4).awaitTermination()
    with contextlib.suppress(StreamingQueryException):
        start(breaking)
    start(echo)
    return asked_fields(runlog.read_results(spark, f"{path}/run/results"))


@query("SELECT item_id::VARCHAR AS id, true AS timed, true AS in_hundredths FROM benchmark")
def inference_times(spark: SparkSession, d: str) -> DataFrame:
    """Elapsed seconds of each call, by a clock that doesn't go back, in hundredths."""
    found = infer.infer(asked_items(spark, d), "what is it", "http://host/model", "", False, late)
    return found.select("id", (F.col("latency_s") >= 0.02).alias("timed"), (python_round(F.col("latency_s"), 2) == F.col("latency_s")).alias("in_hundredths"))


def late(url: str, body: str, timeout: float) -> tuple[int, str]:
    """A transport that takes its time."""
    time.sleep(0.021)
    return echo(url, body, timeout)


@query(f"""
WITH j AS (SELECT * FROM {R} LEFT JOIN {V} USING (id)), c AS (SELECT count(*) AS n, count(*) - count(verdict) AS unjudged, count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(*) AS rate FROM j),
l AS (SELECT count(*) AS n_ok, median(latency_s) AS mid, max(latency_s) AS most, avg(coalesce(total, 0)) AS tokens, count(*) FILTER (grounding_used) AS grounded FROM {R} WHERE ok AND id IN (SELECT id FROM {V})),
m AS ({BASELINE})
SELECT 0 AS place, 'hit rate ' || CASE WHEN unjudged > 0 THEN '>= ' ELSE '' END || printf('%.1f', rate) || '% of ' || n || ', unjudged ' || unjudged AS line FROM c UNION ALL
SELECT 1 + place, lpad(k.verdict, 12, ' ') || ' ' || lpad(count(j.id)::VARCHAR, 6, ' ') || ' ' || lpad(printf('%.1f', count(j.id) * 100.0::DOUBLE / any_value(c.n)), 5, ' ') || '% ' || repeat('#', round_even(count(j.id) * 30.0::DOUBLE / any_value(c.n), 0)::INTEGER)
  FROM (VALUES (0, 'hit'), (1, 'partial'), (2, 'miss')) k(place, verdict) CROSS JOIN c LEFT JOIN j ON j.verdict = k.verdict GROUP BY place, k.verdict UNION ALL
SELECT CASE difficulty WHEN 'easy' THEN 4 ELSE 5 END, lpad(difficulty, 12, ' ') || ' ' || count(*) FILTER (verdict = 'hit') || '/' || count(verdict) || ' (' || printf('%.0f', count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(verdict)) || '%)' FROM j GROUP BY difficulty UNION ALL
SELECT 6, 'latency median ' || printf('%.1f', mid) || ' s, largest ' || printf('%.1f', most) || ' s; ' || printf('%.0f', tokens) || ' tokens a call; grounded ' || grounded || '/' || n_ok FROM l UNION ALL
SELECT 7, 'manual search ' || manual_successes || '/' || measured || ', ' || printf('%.0f', manual_seconds_mean) || ' s each; model ' || model_hits || '/' || measured FROM m UNION ALL
SELECT 8, 'pairs: ' || win || ' won, ' || lose || ' lost, ' || tie || ' tied' || CASE WHEN worse_than_manual THEN ' - worse than manual search' ELSE '' END FROM m UNION ALL
SELECT 9, missing || ' rows without a measured baseline are excluded' FROM m""")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The report's lines, which the driver makes of the report's few rows."""
    results, verdicts = results_of(spark, d), verdicts_of(spark, d)
    rows = lambda df: [r.asDict() for r in df.collect()]
    one = lambda df: rows(df)[0]
    manual = report.worse_than_manual(report.baseline(results, verdicts, manual_of(spark, d)), grounding=True)
    text = cards.render_report(one(report.coverage(results, verdicts)), rows(report.verdict_counts(results, verdicts)), rows(report.strata(results, verdicts)), one(report.latency_and_tokens(results, verdicts)), one(manual))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "place int, line string")


@query("SELECT item_id, 'p' || lpad(item_id::VARCHAR, greatest(2, length(item_id::VARCHAR))::INTEGER, '0') AS id FROM benchmark")
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    """C9."""
    return t(spark, d, "benchmark").select("item_id", manifest.item_id(F.col("item_id")).alias("id"))
