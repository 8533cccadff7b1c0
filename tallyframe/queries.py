"""The library's operators on the driver's tables, which stand in for runs, verdicts and manifests, with DuckDB SQL for each.

documents are a run's results (lang is the stratum, n_chars the latency), labels the verdicts and the
baseline of some of them, events carry JSON, benchmark stands for photos and other short lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.extract import extract_json
from .functions.rounding import python_fixed, python_round
from .operators import judge, manifest, report, validate
from .plans import cards as card_plans
from .plans import decision, infer
from .schemas import last_wins
from .sources import photos, runlog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results_of(spark: SparkSession, d: str) -> DataFrame:
    labels = t(spark, d, "labels").select("doc_id", "toxic")
    return t(spark, d, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "lang",
        F.when(F.col("lang") == "en", "easy").otherwise("hard").alias("difficulty"),
        (F.col("source") != "src0").alias("ok"),
        F.col("n_chars").cast("double").alias("latency_s"),
        F.struct(F.col("toxic").alias("total")).alias("tokens"),
        (F.col("lang") == "fr").alias("grounding_used"),
    )


def verdicts_of(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("quality") == 0, "miss").when(F.col("toxic") == 1, "partial").otherwise("hit")
    return t(spark, d, "labels").select(F.col("doc_id").alias("id"), v.alias("verdict"))


def manual_of(spark: SparkSession, d: str) -> DataFrame:
    success = F.when(F.col("doc_id") % 3 == 0, None).otherwise((F.col("toxic") == 0))
    return t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.struct((F.col("doc_id") % 4).cast("double").alias("seconds"), success.alias("success")).alias("manual_search"))


R = "(SELECT d.doc_id AS id, lang, CASE WHEN lang = 'en' THEN 'easy' ELSE 'hard' END AS difficulty, source <> 'src0' AS ok, n_chars::DOUBLE AS latency_s, toxic AS total, lang = 'fr' AS grounding_used FROM documents d LEFT JOIN labels l USING (doc_id))"
V = "(SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'miss' WHEN toxic = 1 THEN 'partial' ELSE 'hit' END AS verdict FROM labels)"
M = "(SELECT doc_id AS id, (doc_id % 4)::DOUBLE AS seconds, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic = 0 END AS success FROM labels)"


@query(f"""
SELECT count(*) AS n, count(verdict) AS judged, count(*) FILTER (verdict = 'hit') AS hit, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'miss') AS miss,
  count(*) - count(verdict) AS unjudged, count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(*) AS hit_share, count(*) FILTER (verdict = 'partial') * 100.0::DOUBLE / count(*) AS partial_share,
  count(*) FILTER (verdict = 'miss') * 100.0::DOUBLE / count(*) AS miss_share, count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(*) AS hit_rate, count(verdict) < count(*) AS is_lower_bound, false AS smoke
FROM {R} r LEFT JOIN {V} v USING (id)""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A1-A5, J6."""
    return report.coverage(results_of(spark, d), verdicts_of(spark, d))


@query(f"""
SELECT place, n.verdict, coalesce(c, 0) AS n, total, coalesce(c, 0) * 100.0::DOUBLE / total AS share, round_even(coalesce(c, 0) * 30.0::DOUBLE / total, 0)::INTEGER AS bar
FROM (VALUES (0, 'hit'), (1, 'partial'), (2, 'miss')) n(place, verdict)
LEFT JOIN (SELECT verdict, count(*) AS c FROM {R} JOIN {V} USING (id) GROUP BY verdict) c ON c.verdict = n.verdict, (SELECT count(*) AS total FROM {R})""")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2, A4, C17: zero-filled over the enumeration."""
    return report.verdict_counts(results_of(spark, d), verdicts_of(spark, d))


@query(f"""
SELECT lang, count(*) AS n, count(verdict) AS judged, count(*) FILTER (verdict = 'hit') AS hit,
  CASE WHEN count(verdict) > 0 THEN count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(verdict) END AS hit_rate, count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(*) AS hit_rate_stratum_full
FROM {R} LEFT JOIN {V} USING (id) GROUP BY lang""")
def strata_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Judged and full denominators."""
    return report.strata(results_of(spark, d), verdicts_of(spark, d), "lang", None)


@query(f"""
WITH j AS (SELECT * FROM {R} LEFT JOIN {V} USING (id)), g AS (
  SELECT 'run' AS level, NULL AS key, count(*) AS n, count(verdict) AS judged, count(*) FILTER (verdict = 'hit') AS hit FROM j UNION ALL
  SELECT 'stratum', difficulty, count(*), count(verdict), count(*) FILTER (verdict = 'hit') FROM j GROUP BY difficulty UNION ALL
  SELECT 'verdict', verdict, count(*), count(verdict), count(*) FILTER (verdict = 'hit') FROM j GROUP BY verdict)
SELECT *, hit * 100.0::DOUBLE / n AS rate_of_all, CASE WHEN judged > 0 THEN hit * 100.0::DOUBLE / judged END AS rate_of_judged, n * 100.0::DOUBLE / (SELECT count(*) FROM j) AS share FROM g""")
def one_pass_report(spark: SparkSession, d: str) -> DataFrame:
    """A1-A6 of one scan by grouping sets."""
    return report.one_pass(results_of(spark, d), verdicts_of(spark, d))


@query(f"""
SELECT difficulty, count(*) AS n, count(verdict) AS judged, count(*) FILTER (verdict = 'hit') AS hit,
  count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(verdict) AS hit_rate, count(*) FILTER (verdict = 'hit') * 100.0::DOUBLE / count(*) AS hit_rate_stratum_full
FROM {R} LEFT JOIN {V} USING (id) GROUP BY difficulty""")
def strata_by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """A6 over the literal strata."""
    return report.strata(results_of(spark, d), verdicts_of(spark, d))


@query(f"""
SELECT count(*) AS n_ok, median(latency_s) AS latency_median, max(latency_s) AS latency_max, avg(coalesce(total, 0)) AS tokens_mean, count(*) FILTER (grounding_used) AS grounded
FROM {R} WHERE ok AND id IN (SELECT id FROM {V})""")
def latency_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A7-A10, F4, J2."""
    return report.latency_and_tokens(results_of(spark, d), verdicts_of(spark, d))


BASELINE = f"""
SELECT count(*) FILTER (success IS NOT NULL) AS measured, count(*) FILTER (success IS NULL) AS missing, count(*) FILTER (success) AS manual_successes,
  avg(CASE WHEN success IS NOT NULL THEN nullif(seconds, 0) END) AS manual_seconds_mean, count(*) FILTER (success IS NOT NULL AND verdict = 'hit') AS model_hits,
  count(*) FILTER (verdict = 'hit' AND NOT success) AS win, count(*) FILTER (verdict <> 'hit' AND success) AS lose,
  count(*) FILTER (success IS NOT NULL) - count(*) FILTER (verdict = 'hit' AND NOT success) - count(*) FILTER (verdict <> 'hit' AND success) AS tie, count(*) FILTER (success IS NOT NULL) > 0 AS comparable,
  count(*) FILTER (success IS NOT NULL) > 0 AND count(*) FILTER (success IS NOT NULL AND verdict = 'hit') < count(*) FILTER (success) AS worse_than_manual
FROM {R} JOIN {V} USING (id) LEFT JOIN {M} USING (id)"""


@query(BASELINE)
def paired_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued success, zero seconds left out."""
    compared = report.baseline(results_of(spark, d), verdicts_of(spark, d), manual_of(spark, d))
    return report.worse_than_manual(compared, grounding=True)


@query(f"SELECT id, lang FROM {R} WHERE id IN (SELECT id FROM {V})")
def judged_semi(spark: SparkSession, d: str) -> DataFrame:
    """J2."""
    return judge.judged(results_of(spark, d).select("id", "lang"), verdicts_of(spark, d))


@query(f"SELECT id, lang FROM {R} WHERE id NOT IN (SELECT id FROM {V})")
def to_judge_anti(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed session has to judge."""
    return judge.to_judge(results_of(spark, d).select("id", "lang"), verdicts_of(spark, d))


@query(f"""
SELECT id, verdict FROM {V} WHERE id % 2 = 0 UNION ALL
SELECT id, 'miss' FROM {V} v WHERE id NOT IN (SELECT id FROM {V} WHERE id % 2 = 0)""")
def verdict_merge(spark: SparkSession, d: str) -> DataFrame:
    """Prior and new verdicts together, prior ones winning."""
    v = verdicts_of(spark, d)
    return judge.merge(v.where("id % 2 = 0"), v.select("id", F.lit("miss").alias("verdict")))


@query("""
SELECT event_id, CASE WHEN NOT (value > 10) OR value IS NULL THEN 'call failed' WHEN parsed IS NULL OR parsed = '{}' THEN 'no answer could be read'
  WHEN user_id % 2 = 0 AND (json_extract(parsed, '$.links') IS NULL OR json_array_length(parsed, '$.links') = 0) THEN 'no supporting link' END AS reason
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{}' WHEN 2 THEN '{"links": []}' ELSE '{"links": ["http://a"]}' END AS parsed FROM events)""")
def forced_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """V10-V12 in their order."""
    parsed = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, "{}").when(F.col("event_id") % 4 == 2, '{"links": []}').otherwise('{"links": ["http://a"]}')
    return t(spark, d, "events").select("event_id", judge.forced_reason(F.col("value") > 10, parsed, F.col("user_id") % 2 == 0).alias("reason"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Second and later occurrences."""
    rows = t(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("pos"))
    return validate.repeated(rows).where("again").select(F.col("pos").alias("event_id"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY CASE WHEN user_id % 3 > 0 THEN user_id END ORDER BY event_id) AS nth FROM events) WHERE nth > 1")
def repeated_missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """V1 where a third of the ids is missing: missing ids are one id."""
    rows = t(spark, d, "events").select(F.when(F.col("user_id") % 3 > 0, F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("pos"))
    return validate.repeated(rows).where("again").select(F.col("pos").alias("event_id"))


@query("SELECT user_id, event_id AS pos, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1")
def last_of_key(spark: SparkSession, d: str) -> DataFrame:
    """A lookup's build side: the last of several rows with a key."""
    return last_wins(t(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), "event_type"), "user_id")


FILES = "(SELECT 'f' || lpad(item_id::VARCHAR, 5, '0') || '.jpg' AS file, item_id FROM benchmark)"
KNOWN = f"(SELECT file, 'p' || lpad((item_id + 2)::VARCHAR, greatest(2, length((item_id + 2)::VARCHAR))::INTEGER, '0') AS id, item_id FROM {FILES} WHERE item_id % 3 = 0)"


def file_list(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select(F.format_string("f%05d.jpg", "item_id").alias("file"), "item_id")


def known_items(spark: SparkSession, d: str) -> DataFrame:
    rows = file_list(spark, d).where("item_id % 3 = 0")
    size = F.array(F.lit(4), F.lit(3))
    return rows.select(*manifest.skeleton(F.col("file"), manifest.item_id(F.col("item_id") + 2), size), F.col("item_id").alias("pos"))


GAPS = f"""
SELECT f.file, c.id FROM (SELECT file, row_number() OVER (ORDER BY file) AS place FROM {FILES} WHERE item_id % 3 <> 0) f JOIN
  (SELECT id, row_number() OVER (ORDER BY n) AS place FROM
    (SELECT n, 'p' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INTEGER, '0') AS id FROM range(1, (SELECT count(*) FROM benchmark)::BIGINT * 2 + 1) r(n)) WHERE id NOT IN (SELECT id FROM {KNOWN})) c USING (place)"""


@query(GAPS)
def gap_filling_ids(spark: SparkSession, d: str) -> DataFrame:
    """New files get the first numbers that aren't used."""
    return manifest.allocate_ids(file_list(spark, d).where("item_id % 3 <> 0").select("file"), manifest.used_ids(known_items(spark, d)))


@query(f"SELECT file, id, is_new FROM (SELECT file, id, false AS is_new FROM {KNOWN} WHERE item_id % 2 = 0 UNION ALL SELECT g.file, g.id, true FROM ({GAPS}) g)")
def refreshed_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Known items stay, those without a photo go, new photos get items. Every second known photo is gone here."""
    files = file_list(spark, d).where("item_id % 3 <> 0 OR item_id % 2 = 0").select("file", F.lit(4).alias("width"), F.lit(3).alias("height"))
    return manifest.refresh(files, known_items(spark, d)).select("file", "id", "is_new")


@query("SELECT count(*) FILTER (item_id % 3 <> 0) AS added, count(*) FILTER (item_id % 3 = 0 AND item_id % 2 = 0) AS preserved FROM benchmark")
def refresh_counts(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    files = file_list(spark, d).where("item_id % 3 <> 0 OR item_id % 2 = 0").select("file", F.lit(4).alias("width"), F.lit(3).alias("height"))
    return manifest.refresh_counts(manifest.refresh(files, known_items(spark, d)))


BOXES = "(SELECT doc_id, [n_chars % 7 - 1, n_chars % 5 - 1, n_chars % 11 - 1, n_chars % 13 - 1][1:CASE WHEN doc_id % 10 = 0 THEN 3 WHEN doc_id % 10 = 1 THEN 0 ELSE 4 END] AS b FROM documents)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    whole = F.array(*[(F.col("n_chars") % m - 1).cast("int") for m in (7, 5, 11, 13)])
    n = F.when(F.col("doc_id") % 10 == 0, 3).when(F.col("doc_id") % 10 == 1, 0).otherwise(4)
    return t(spark, d, "documents").select("doc_id", F.slice(whole, F.lit(1), n).alias("b"))


@query(f"""
SELECT doc_id, CASE WHEN len(b) = 0 THEN NULL WHEN len(b) <> 4 THEN 'V3' WHEN b[3] <= 0 OR b[4] <= 0 THEN 'V4'
  WHEN b[1] < 0 OR b[2] < 0 OR b[1] + b[3] > 10 OR b[2] + b[4] > 12 THEN 'V5' END AS rule FROM {BOXES}""")
def box_rules(spark: SparkSession, d: str) -> DataFrame:
    """V3-V5, C4."""
    return boxes(spark, d).select("doc_id", validate.box_findings(F.col("b"), F.lit(10), F.lit(12)).alias("rule"))


ITEMS = f"(SELECT doc_id, 'p' || (doc_id % 900) AS id, lang, source, b, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS brand, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE true END AS success FROM documents JOIN {BOXES} USING (doc_id))"
FINDINGS = f"""
SELECT severity, id, rule FROM (
  SELECT 'error' AS severity, id, 'V1' AS rule FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS nth FROM {ITEMS}) WHERE nth > 1
  UNION ALL SELECT 'error', id, 'V2' FROM {ITEMS} WHERE source = 'src1'
  UNION ALL SELECT 'error', id, CASE WHEN len(b) <> 4 THEN 'V3' WHEN b[3] <= 0 OR b[4] <= 0 THEN 'V4' WHEN b[1] < 0 OR b[2] < 0 OR b[1] + b[3] > 10 OR b[2] + b[4] > 12 THEN 'V5' END FROM {ITEMS} WHERE source <> 'src1' AND len(b) > 0
  UNION ALL SELECT 'error', id, 'V6' FROM {ITEMS} WHERE source <> 'src1' AND lang NOT IN ('en', 'fr')
  UNION ALL SELECT 'error', id, 'V7' FROM {ITEMS} WHERE source <> 'src1' AND brand = ''
  UNION ALL SELECT 'warning', id, 'V8' FROM {ITEMS} WHERE source <> 'src1' AND success IS NULL
  UNION ALL SELECT 'warning', NULL, 'V9' FROM (SELECT count(*) FILTER (lang = 'en') AS easy, count(*) FILTER (lang = 'fr') AS hard FROM {ITEMS}) WHERE easy < 10 OR hard < 10) WHERE rule IS NOT NULL"""


def validated(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").join(boxes(spark, d), "doc_id")
    difficulty = F.when(F.col("lang") == "en", "easy").when(F.col("lang") == "fr", "hard").otherwise(F.col("lang"))
    items = docs.select(
        F.concat(F.lit("p"), F.col("doc_id") % 900).alias("id"),
        F.col("doc_id").alias("pos"),
        F.col("source").alias("file"),
        F.col("b").alias("bbox"),
        difficulty.alias("difficulty"),
        F.struct(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")).alias("brand"), F.lit(None).cast("string").alias("model")).alias("truth"),
        F.struct(F.when(F.col("doc_id") % 3 != 0, True).alias("success")).alias("manual_search"),
    )
    files = docs.select(F.col("source").alias("file")).where("source <> 'src1'").distinct().select("file", F.lit(10).alias("width"), F.lit(12).alias("height"))
    return validate.validate(items, files)


@query(FINDINGS)
def validation_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings as a multiset."""
    return validated(spark, d).select("severity", "id", "rule")


@query(f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, (count(*) FILTER (severity = 'error') > 0)::INTEGER AS exit_code FROM ({FINDINGS})")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return validate.summary(validated(spark, d))


@query(f"SELECT count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'hard') AS hard FROM {R}")
def strata_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return validate.strata_sizes(results_of(spark, d))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def extracted_json(spark: SparkSession, d: str) -> DataFrame:
    """The object in a fenced, chatty reply around each event's properties."""
    said = F.concat(F.lit('Here it is:\n```json\n{"a": }\n'), F.col("props"), F.lit("\n```\nthat {is} all"))
    return t(spark, d, "events").select("event_id", F.get_json_object(extract_json(said), "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 6 NOT IN (1, 2) THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """An odd quote or an open brace before an object hide it; of an array, or after what only looks like an object, the first object counts."""
    props, kind = F.col("props"), F.col("event_id") % 6
    said = F.when(kind == 0, F.concat(F.lit("so: "), props, F.lit(" or "), F.lit('{"k": -1}')))
    for n, (before, after) in enumerate((('he said " ', ""), ("{ open ", ""), ("[", ', {"k": -1}]'), ("{not json} ", ""), ("} ", " {")), 1):
        said = said.when(kind == n, F.concat(F.lit(before), props, F.lit(after)))
    return t(spark, d, "events").select("event_id", F.get_json_object(extract_json(said), "$.k").cast("long").alias("k"))


TIES = "(VALUES (0, 2.675::DOUBLE), (1, 0.25), (2, 0.125), (3, 0.375), (4, 2.5), (5, 0.5), (6, 1.005), (7, -0.125), (8, 1e-9), (9, -0.004))"


@query(f"""
SELECT event_id, printf('%.2f', v)::DOUBLE AS two, printf('%.1f', v)::DOUBLE AS one, printf('%.1f', v) AS shown, printf('%.0f', v) AS whole
FROM (SELECT event_id, CASE WHEN event_id % 20 < 10 THEN t.v WHEN event_id % 3 = 0 THEN floor(value * 8) / 8 ELSE value END AS v FROM events LEFT JOIN {TIES} t(k, v) ON event_id % 20 = k)""")
def python_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Of values as they are, of eighths, which are ties, and of those that differ from their shortest decimal."""
    v, k = F.col("value"), F.col("event_id") % 20
    v = F.when(k < 10, F.get(F.array(*[F.lit(x) for x in (2.675, 0.25, 0.125, 0.375, 2.5, 0.5, 1.005, -0.125, 1e-9, -0.004)]), k.cast("int"))).when(F.col("event_id") % 3 == 0, F.floor(v * 8) / 8.0).otherwise(v)
    return t(spark, d, "events").select("event_id", python_round(v, 2).alias("two"), python_round(v, 1).alias("one"), python_fixed(v, 1).alias("shown"), python_fixed(v, 0).alias("whole"))


@query(r"SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM documents")
def stripped_fences(spark: SparkSession, d: str) -> DataFrame:
    """Documents in Markdown fences, with and without a language."""
    text = F.trim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fenced = F.concat(F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "```json\n").otherwise("``` \n"), text, F.lit("\n```  \n"))
    return t(spark, d, "documents").select("doc_id", S.strip_fences(fenced).alias("bare"))


@query("SELECT item_id, substring(sha256(text), 1, 16) AS sha, base64(encode(text)) AS line, left(text, 15) AS head, text[1:40] AS cut FROM benchmark")
def hashes_and_cuts(spark: SparkSession, d: str) -> DataFrame:
    """C2, C3, C11."""
    text = F.col("text")
    return t(spark, d, "benchmark").select("item_id", S.sha16(text).alias("sha"), S.base64_line(text.cast("binary")).alias("line"), F.left(text, F.lit(15)).alias("head"), F.left(text, F.lit(40)).alias("cut"))


@query("""
SELECT doc_id, CASE WHEN greatest(w, h) > 1024 THEN trunc(w * (1024.0::DOUBLE / greatest(w, h)))::INTEGER ELSE w END AS w, CASE WHEN greatest(w, h) > 1024 THEN trunc(h * (1024.0::DOUBLE / greatest(w, h)))::INTEGER ELSE h END AS h,
  (n_chars // 1024)::BIGINT AS kb FROM (SELECT doc_id, n_chars::INTEGER AS w, (doc_id % 3000 + 1)::INTEGER AS h, n_chars FROM documents)""")
def scaled_sizes(spark: SparkSession, d: str) -> DataFrame:
    """C6 (sizes), C20."""
    size = S.scaled(F.col("n_chars").cast("int"), (F.col("doc_id") % 3000 + 1).cast("int"))
    return t(spark, d, "documents").select("doc_id", size["w"].alias("w"), size["h"].alias("h"), S.kilobytes(F.col("n_chars")).alias("kb"))


@query("""
SELECT doc_id, text || lang AS raw_text, doc_id % 3 = 1 AS grounding_used, CASE WHEN doc_id % 3 = 1 THEN source END AS query, n_chars::INTEGER AS total FROM documents""")
def flattened_replies(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes built from documents, flattened again."""
    ground = F.when(F.col("doc_id") % 3 == 1, F.struct(F.array("source").alias("webSearchQueries"))).when(F.col("doc_id") % 3 == 2, F.struct(F.lit(None).cast("array<string>").alias("webSearchQueries")))
    parts = F.array(F.struct(F.col("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.col("lang").alias("text")))
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"), ground.alias("groundingMetadata"))).alias("candidates"), F.struct(F.col("n_chars").alias("totalTokenCount")).alias("usageMetadata")))
    flat = t(spark, d, "documents").select("doc_id", infer.flatten_envelope(envelope).alias("r"))
    return flat.select("doc_id", "r.raw_text", "r.grounding_used", F.get("r.grounding_queries", F.lit(0)).alias("query"), F.col("r.tokens.total").alias("total"))


@query("""
SELECT item_id, '{"contents":[{"parts":[{"text":"what is it"},{"inline_data":{"mime_type":"image/jpeg","data":"' || base64(encode(text)) || '"}}]}],"generationConfig":{"temperature":0.0},"tools":[{"google_search":{}}]}' AS grounded,
  '{"contents":[{"parts":[{"text":"what is it"},{"inline_data":{"mime_type":"image/jpeg","data":"' || base64(encode(text)) || '"}}]}],"generationConfig":{"temperature":0.0}}' AS plain FROM benchmark""")
def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The tools key is there only in grounded runs."""
    body = lambda g: infer.request_body(F.lit("what is it"), F.col("text").cast("binary"), g)
    return t(spark, d, "benchmark").select("item_id", body(True).alias("grounded"), body(False).alias("plain"))


@query("""
SELECT source, CASE WHEN source < 'src5' THEN CASE WHEN overall < 10 OR overall < 60 THEN 'stop' WHEN overall < 30 THEN 'redesign' WHEN easy >= 50 THEN 'continue' ELSE 'undetermined' END
  ELSE CASE WHEN overall < 30 THEN 'stop' WHEN easy >= 70 AND overall >= 50 THEN 'continue' ELSE 'undetermined' END END AS outcome
FROM (SELECT source, count(*) FILTER (lang = 'en') * 100.0::DOUBLE / count(*) AS easy, count(*) FILTER (n_chars > 1400) * 100.0::DOUBLE / count(*) AS overall FROM documents GROUP BY source)""")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    """The pre-registered rule, by source."""
    share = lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1))
    rates = t(spark, d, "documents").groupBy("source").agg(share(F.col("lang") == "en").alias("easy"), share(F.col("n_chars") > 1400).alias("overall"))
    return rates.select("source", decision.decide(F.col("source") < "src5", F.col("easy"), F.col("overall"), F.lit(60.0)).alias("outcome"))


@query("""
SELECT conv_id::VARCHAR || ':' || turn AS id, 'f' || conv_id AS file, CASE WHEN turn % 3 = 0 THEN 'hard' ELSE '?' END AS difficulty, CASE WHEN turn % 2 = 1 THEN 503 END AS http, turn / 8.0::DOUBLE AS latency_s, turn::INTEGER AS tokens,
  role = 'user' AND turn % 5 = 0 AS unsupported, CASE WHEN turn % 2 = 1 THEN left(text, 400) END AS error, '-' AS category, '-' AS visible_text, CASE WHEN role = 'user' THEN role ELSE 'null' END AS brand, 'null' AS model, '-' AS confidence, '-' AS reasoning,
  CASE WHEN turn % 2 = 0 THEN 'a, b' ELSE '-' END AS attributes, CASE WHEN turn % 5 = 0 THEN 0 ELSE 7 END AS n_links, CASE WHEN turn % 5 = 0 THEN '' ELSE 'l1|l2|l3|l4|l5' END AS links, 'q1, q2, q3, q4' AS queries, left(text, 400) AS raw_text,
  CASE WHEN turn % 2 = 0 THEN role ELSE '?' END AS true_brand, '?' AS true_model, CASE WHEN turn % 2 = 0 THEN 'http://' || role END AS true_url FROM conversations""")
def judge_cards(spark: SparkSession, d: str) -> DataFrame:
    """What a judge sees."""
    rows = t(spark, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    brand = F.when(F.col("role") == "user", F.col("role")).otherwise("")
    reply = F.to_json(F.struct(brand.alias("brand"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("attributes"), F.when(F.col("turn") % 5 > 0, F.array(*[F.lit(f"l{i}") for i in range(1, 8)])).alias("links")))
    call = [F.concat(F.lit("f"), "conv_id").alias("file"), F.when(F.col("turn") % 3 == 0, "hard").alias("difficulty"), F.when(F.col("turn") % 2 == 1, 503).alias("http"), (F.col("turn") / 8.0).alias("latency_s"), F.struct(F.col("turn").cast("int").alias("total")).alias("tokens")]
    results = rows.select("id", *call, F.when(F.col("turn") % 2 == 1, F.col("text")).alias("error"), reply.alias("parsed"), F.array(*[F.lit(f"q{i}") for i in range(1, 7)]).alias("grounding_queries"), F.col("text").alias("raw_text"))
    truth = rows.where("turn % 2 = 0").select("id", F.struct(F.col("role").alias("brand"), F.lit("").alias("model"), F.concat(F.lit("http://"), "role").alias("url")).alias("truth"))
    return card_plans.cards(results, truth).withColumn("links", F.array_join("links", "|"))


@query("SELECT n_name AS name, n_name AS \"displayName\" FROM nation WHERE n_regionkey % 2 = 0")
def generating_models(spark: SparkSession, d: str) -> DataFrame:
    """Models that can generate, by name, without their prefix. One catalogue entry for each nation."""
    methods = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("generateContent"), F.lit("countTokens"))).when(F.col("n_regionkey") == 1, F.array(F.lit("embedContent")))
    entry = F.struct(F.concat(F.lit("models/"), "n_name").alias("name"), F.col("n_name").alias("displayName"), methods.alias("supportedGenerationMethods"))
    return runlog.generating_models(t(spark, d, "nation").agg(F.collect_list(entry).alias("models")))


@query(f"SELECT id, verdict, CASE verdict WHEN 'hit' THEN 'enough to search by' WHEN 'partial' THEN 'in part' ELSE 'of no use' END AS meaning FROM {V}")
def verdict_meanings(spark: SparkSession, d: str) -> DataFrame:
    """The rubric of an ungrounded run."""
    return decision.with_meaning(verdicts_of(spark, d), spark.createDataFrame([(False,)], "grounding boolean"))


@query(f"SELECT count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CASE WHEN count(*) FILTER (ok) = 0 AND count(*) > 0 THEN 2 ELSE 0 END AS exit_code FROM {R}")
def run_outcome(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    return report.run_outcome(results_of(spark, d))


@query("""
SELECT page_id, file, CASE WHEN ext IN ('heic', 'heif') THEN 'unreadable' WHEN ext NOT IN ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'tif', 'tiff') THEN 'ignored' ELSE 'readable' END AS class
FROM (SELECT page_id, page_id || e AS file, lower(e[2:]) AS ext FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.heic' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' ELSE '.Tiff' END AS e FROM pages))""")
def photo_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes by case-folded ending."""
    ending = F.element_at(F.array(*map(F.lit, (".JPG", ".heic", ".txt", ".png", ".Tiff"))), (F.col("page_id") % 5 + 1).cast("int"))
    named = t(spark, d, "pages").select("page_id", photos.base_name(F.concat(F.lit("/photos/"), "page_id", ending)).alias("file"))
    return named.withColumn("class", photos.classify(F.col("file")))


@query("SELECT page_id || '.heic' AS file FROM pages WHERE page_id % 5 = 1 ORDER BY file LIMIT 10")
def first_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return photos.first_unreadable(photo_classes(spark, d))


@query("SELECT doc_id, substring(sha256('a prompt'), 1, 16) AS prompt_sha, substring(sha256(text), 1, 16) AS photo_sha FROM documents")
def provenance_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Result inputs without the answers, with the run's provenance."""
    docs = t(spark, d, "documents").withColumns({"truth": F.lit("secret"), "manual_search": F.lit(1)})
    seen = infer.measured_view(docs)
    about = runlog.provenance("a prompt", "[]", None, "unknown", False)
    return seen.select("doc_id", about["prompt_sha"].alias("prompt_sha"), S.sha16(F.col("text")).alias("photo_sha"))
