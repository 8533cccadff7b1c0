"""The three jobs end to end: prepare a manifest, ask a model about its photos, and report what people judged.

A photo directory holds the photos and manifest.json; a results directory the runs, each one JSON
document, and each one's verdicts beside it. Jobs return an exit code and say what they did through `out`.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.images import crop_photo
from .functions.pixels import crop_picture
from .functions.scalars import kilobytes, sha16
from .operators import judge, manifest, report, validate
from .plans import cards
from .plans.infer import Transport, http_post
from .sources import json_array, photos, runlog
from .sources import manifest as manifests
from .streaming import inference

Out = Callable[[str], None]
ENDPOINT = "https://generativelanguage.googleapis.com/v1beta"
PROMPT = (
    "Which product does this picture show? Use web search if you have it, and name only links that you found there. Answer with one JSON object: "
    "category (text), attributes (list of texts), visible_text (text), brand (text or null), model (text or null), links (list of texts), confidence (high, medium or low), reasoning (text)."
)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path's file system and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = hadoop_path(spark, path)
    return files.exists(where)


def scan(spark: SparkSession, directory: str, out: Out) -> DataFrame:
    """The photos that can be read; the first of those that can't be are told."""
    found = photos.scan_photos(spark, directory)
    if bad := found.where("class = 'unreadable'").count():
        names = [r.file for r in photos.first_unreadable(found).collect()]
        out(f"{bad} files can't be read: {', '.join(names)}")
    return found.where("class = 'readable'").select("file", "width", "height")


def prepare(spark: SparkSession, directory: str, out: Out = print) -> int:
    """Build or refresh the manifest: items that are known stay, photos without one get one. Code 1 if there is no photo, or the manifest can't be read, which leaves it as it is."""
    readable, path = scan(spark, directory, out), f"{directory}/manifest.json"
    if readable.isEmpty():
        out(f"{directory} has no photos that can be read")
        return 1
    try:
        before = manifests.read_manifest(spark, path) if exists(spark, path) else spark.createDataFrame([], f"pos long, {manifests.MANIFEST}")
    except manifests.ManifestError as wrong:
        out(str(wrong))
        return 1
    refreshed = manifest.refresh(readable, before)
    counts = manifest.refresh_counts(refreshed).first()
    manifests.write_manifest(refreshed.drop("is_new"), path)
    out(f"{path}: {counts.added} items added, {counts.preserved} preserved")
    return 0


def check(spark: SparkSession, directory: str, smoke: bool = False, out: Out = print) -> int:
    """Validate the manifest; code 1 if there are errors."""
    readable = scan(spark, directory, out)
    try:
        items = manifests.read_loosely(spark, f"{directory}/manifest.json")
    except manifests.ManifestError as wrong:
        out(str(wrong))
        return 1
    findings = validate.validate(items, readable, smoke)
    for f in findings.orderBy(F.col("severity"), F.col("id").asc_nulls_last(), "rule").limit(1000).toLocalIterator():
        out(f"{f.severity} {f.rule} {f.id or ''}: {f.message}")
    counts = validate.summary(findings).first()
    out(f"{counts.errors} errors, {counts.warnings} warnings")
    return counts.exit_code


def models(spark: SparkSession, key: str, endpoint: str = ENDPOINT, get: Callable[[str], str] = runlog.fetch, out: Out = print) -> int:
    """List the models that can generate content."""
    for m in runlog.generating_models(runlog.read_catalogue(spark, f"{endpoint}/models?key={key}", get)).collect():
        out(f"{m.name}  {m.displayName or ''}".rstrip())
    return 0


def default_crop() -> Callable[[Column, Column], Column]:
    """By an image library, where there is one; else PNG and BMP photos can be cropped, and others say that they need one."""
    if find_spec("PIL"):
        return crop_photo
    return crop_picture


def identify(
    spark: SparkSession, directory: str, results: str, model: str, key: str, stamp: str, grounding: bool = True, only: str | None = None, smoke: bool = False, tag: str = "unknown",
    prompt: str = PROMPT, endpoint: str = ENDPOINT, transport: Transport = http_post, crop: Callable[[Column, Column], Column] | None = None, out: Out = print,
) -> int:
    """Ask a model about each photo and write the run as run-{stamp}.json.

    Photos are cropped before anything is asked, and a missing photo or a box that can't be cropped
    ends the job with code 1 before the first call. Results are kept batch by batch in
    run-{stamp}.parts, so a job of the same stamp goes on where one was broken off. Code 2 if every call failed.
    """
    crop = crop or default_crop()
    path = f"{directory}/manifest.json"
    try:
        items = manifests.only(manifests.read_manifest(spark, path, must_have_rows=True), only)
    except manifests.ManifestError as wrong:
        out(str(wrong))
        return 1
    parts, run = f"{results}/run-{stamp}.parts", f"{results}/run-{stamp}.json"
    if not exists(spark, f"{parts}/staged/_SUCCESS"):
        files = spark.read.format("binaryFile").load(directory).select(photos.base_name(F.col("path")).alias("name"), "content")
        pictures = items.join(files, F.col("file") == F.col("name"), "left").withColumn("crop", crop(F.col("content"), F.col("bbox")))
        staged = pictures.select("id", "file", "difficulty", sha16(F.col("content")).alias("photo_sha"), "bbox", F.array("crop.width", "crop.height").alias("crop_px"), F.octet_length("crop.content").cast("long").alias("crop_bytes"), F.col("crop.content").alias("jpeg"), F.col("crop.error").alias("wrong"))
        if bad := staged.where("wrong is not null").select("id", "file", "wrong").limit(10).collect():
            out("; ".join(f"{b.id} ({b.file}): {b.wrong}" for b in bad))
            return 1
        text = spark.read.text(path, wholetext=True).select(sha16(F.col("value").cast("binary")).alias("sha")).first().sha  # a file that people edit
        provenance = F.struct(sha16(F.lit(prompt).cast("binary")).alias("prompt_sha"), F.lit(text).alias("manifest_sha"), F.lit(only or "all").alias("subset"), F.lit(tag).alias("prereg_tag"), F.lit(smoke).alias("smoke"))
        header = spark.range(1).select(F.lit(model).alias("model"), F.lit(grounding).alias("grounding"), F.lit(stamp).alias("timestamp"), provenance.alias("provenance"))
        header.write.mode("overwrite").json(f"{parts}/header")
        inference.stage_items(staged, f"{parts}/staged")
    inference.infer_durably(spark, f"{parts}/staged", parts, prompt, f"{endpoint}/models/{model}:generateContent", key, grounding, transport).awaitTermination()
    header, found = runlog.open_run(spark, parts)
    runlog.write_run(header, inference.in_order(found, items), run)
    outcome = report.run_outcome(found).first()
    size = found.agg(F.sum(kilobytes(F.col("crop_bytes"))).alias("kb")).first().kb
    out(f"{run}: {outcome.succeeded} of {outcome.succeeded + outcome.failed} calls succeeded, {size or 0} KB sent")
    files, where = hadoop_path(spark, parts)
    files.delete(where, True)
    return outcome.exit_code


def score(spark: SparkSession, run: str, directory: str, judged: str | None = None, report_only: bool = False, out: Out = print) -> int:
    """Force the verdicts that need nobody, take people's new ones from a JSON object (judged), keep both beside the run, and report.

    Earlier verdicts are never replaced. With report_only nothing is forced, taken or written. Code 1
    if nothing is judged, or a verdict is none of the known.
    """
    header, results = runlog.read_run(spark, run)
    about, name = header.first(), runlog.run_name(run)
    kept = f"{run.rsplit('/', 1)[0]}/score-{name}.json"
    verdicts = runlog.read_verdicts(spark, kept, name)
    if not report_only:
        # Forced ones come first, as nobody is asked about what has a verdict.
        new = judge.force(results, verdicts, F.lit(bool(about.grounding))).select("id", "verdict")
        if judged:
            told = runlog.read_verdicts(spark, judged, name).join(results.select("id").distinct(), "id", "left_semi")
            new = judge.merge(new, judge.to_judge(told, verdicts))
        if not new.isEmpty():
            pairs = judge.merge(verdicts, new).select(F.col("id").alias("pos"), F.to_json(F.create_map("id", "verdict")).alias("value"))
            json_array.write_array(pairs.select("pos", F.expr("substring(value, 2, length(value) - 2)").alias("value")), kept, "{", "}")
            verdicts = runlog.read_verdicts(spark, kept, name)
    if wrong := judge.unknown_verdicts(verdicts).limit(10).collect():
        out(f"unknown verdicts: {', '.join(f'{w.id}: {w.verdict}' for w in wrong)}")
        return 1
    if judge.judged(results, verdicts).isEmpty():
        out("nothing is judged yet")
        return 1
    known = manifests.manifest_by(manifests.read_manifest(spark, f"{directory}/manifest.json"), "id")
    manual = report.worse_than_manual(report.baseline(results, verdicts, known), bool(about.grounding))
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  each has a few rows
    smoke = bool(about.provenance and about.provenance.smoke)
    coverage, calls = rows(report.coverage(results, verdicts, smoke))[0], rows(report.latency_and_tokens(results, verdicts))[0]
    out(cards.render_report(coverage, rows(report.verdict_counts(results, verdicts)), rows(report.strata(results, verdicts)), calls, rows(manual)[0]))
    return 0


def show(spark: SparkSession, run: str, directory: str, out: Out = print) -> int:
    """What a judge sees of the results that have no verdict yet."""
    header, results = runlog.read_run(spark, run)
    name = runlog.run_name(run)
    verdicts = runlog.read_verdicts(spark, f"{run.rsplit('/', 1)[0]}/score-{name}.json", name)
    known = manifests.manifest_by(manifests.read_manifest(spark, f"{directory}/manifest.json"), "id")
    left = judge.to_judge(results, verdicts)
    order = left.select("id", "pos").withColumnRenamed("id", "card_id")
    shown = cards.cards(left, known, bool(header.first().grounding)).join(order, F.col("id").eqNullSafe(F.col("card_id"))).orderBy("pos")
    for card in shown.drop("card_id", "pos").toLocalIterator():
        out(cards.render(card.asDict()) + "\n")
    return 0
