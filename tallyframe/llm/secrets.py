"""Secret scans by an incremental blob ledger.

Every version of every path is known by its content's SHA-256, its blob. The ledger is a folder of
batches; a batch names the (blob, rule, rule version) triples that it scanned and the findings that it
made, and counts once its last file is there. A scan reads only the texts of blobs that some rule
version hasn't seen, one text for each blob however many paths and versions have it, with just the
rules that are missing; findings are joined back to all paths. Positions are code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_name, scratch_dir, stored, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern whose matches, leftmost and not overlapping, count if the group has `least` characters. A changed rule needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


def either_case(word: str) -> str:
    """Letters of either case, without the folding beyond ASCII that regular expressions' flags may bring."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The rules' patterns, in the order in which findings at one place are listed.
NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", 1, rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 27),
)
BASE = ("assign", "access", "hex")

#: Missing blobs are sent to all tasks, to leave other texts where they are, only if their table is smaller than this.
BROADCAST_BYTES = 8 << 20

SCANNED = "blob string, rules array<string>"
FINDINGS = "blob string, kind string, version int, start int, end int"


def matches(text: Column, rule: Rule) -> Column:
    """Each match as (gap before it, its length, whether it counts)."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), F.length)
    found = F.arrays_zip(between.alias("gap"), F.transform(whole, F.length).alias("length"), F.transform(measured, lambda m: F.length(m) >= rule.least).alias("counts"))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found)


def findings_of(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of texts (blob, text, rules: the keys of the rules to scan by), a row for each."""
    kinds = F.array(
        *[F.struct(F.lit(n).alias("nth_rule"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("rules", r.key), matches(F.col("text"), r)).alias("matches")) for n, r in enumerate(rules)]
    )
    each = texts.select("blob", F.explode(kinds).alias("k")).where("k.matches is not null")
    one = each.select("blob", "k.nth_rule", "k.kind", "k.version", F.posexplode("k.matches").alias("nth", "m"))
    # A match ends where all gaps and matches so far end; only one text's matches of one rule are ordered together.
    so_far = Window.partitionBy("blob", "nth_rule").orderBy("nth")
    ended = one.withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(so_far).cast("int"))
    return ended.where("m.counts").select("blob", "kind", "version", (F.col("end") - F.col("m.length")).alias("start"), "end")


class Ledger:
    """A folder of committed batches. A path's history is the caller's: rows of path columns and a text, as many versions as there are."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def batches(self) -> list[str]:
        """The names of batches that were committed; what a lost driver left half-written isn't among them."""
        if not self.files.exists(self._path("batches")):
            return []
        return sorted(s.getPath().getName() for s in self.files.listStatus(self._path("batches")) if self.files.exists(self._path(f"batches/{s.getPath().getName()}/committed")))

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/batches/{b}/{name}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        """The rules, as kind/version, that each blob was scanned by; a blob of several batches has several rows."""
        return self._read("scanned", SCANNED)

    def findings(self, rules: Sequence[Rule] | None = None) -> DataFrame:
        """Findings of all rule versions, or of these."""
        found = self._read("findings", FINDINGS)
        return found if rules is None else found.where(F.concat_ws("/", "kind", "version").isin([r.key for r in rules]))

    def unseen(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """blob and the keys of the rules that it wasn't scanned by, for each distinct blob that lacks any."""
        wanted = F.array(*[F.lit(r.key) for r in rules]) if rules else F.array().cast("array<string>")
        seen = self.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        once = blobs.select("blob").distinct()
        if self.batches():
            once = once.join(seen, "blob", "left")
            lacking = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        else:
            lacking = wanted
        return once.select("blob", lacking.alias("rules")).where(F.size("rules") > 0)

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Scan what is unseen among versions (blob, text) and commit it as one batch; a batch without rows is none.

        The texts of one blob are brought together by a partial aggregation that keeps one for each
        task, so copies of a text, however many, are neither shuffled nor scanned again.
        """
        batch = f"{self.folder}/batches/{uuid.uuid4().hex}"
        first = not self.batches()
        self.unseen(versions, rules).write.parquet(f"{batch}/scanned")
        lacking = self.spark.read.schema(SCANNED).parquet(f"{batch}/scanned")
        if lacking.isEmpty():
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(batch), True)
            return
        texts = versions.select("blob", "text")
        if not first and self.files.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(f"{batch}/scanned")).getLength() < BROADCAST_BYTES:
            texts = texts.join(F.broadcast(lacking.select("blob")), "blob", "left_semi")
        texts = texts.groupBy("blob").agg(F.first("text").alias("text")).join(lacking, "blob")
        findings_of(texts, rules).write.parquet(f"{batch}/findings")
        self.files.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{batch}/committed")).close()


def content_addressed(docs: DataFrame, *paths: str) -> DataFrame:
    """The path columns, the text (null as empty) and its blob."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*paths, F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_paths(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, path: str = "doc_id") -> DataFrame:
    """path, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs, scanned through the ledger.

    docs: the path column and text; other columns don't matter, whatever their names. Each row is a
    version of its path, so a path with several versions, and repeated rows, are returned each; null
    paths like others. Null texts count as empty; empty texts have no findings and the empty list's hash.
    Texts of any length are scanned whole. An empty table gives an empty one.
    """
    versions = content_addressed(docs, path)
    ledger.scan(versions, rules)
    kinds = [r.kind for r in rules]
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")
    one = F.struct("start", rank.alias("rank"), "kind", "end")
    joined = lambda base: F.array_join(F.transform(F.filter("found", lambda s: s["kind"].isin(*BASE)) if base else F.col("found"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    per_blob = ledger.findings(rules).groupBy("blob").agg(F.array_sort(F.collect_list(one)).alias("found"))
    of_kind = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counted = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    # Written before it is joined, so that Spark can split the rows of a text that very many paths have.
    per_blob = stored(per_blob.select("blob", *counted, F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans")), "blob-findings")
    key = free_name([path], "blob")
    rows = versions.select(path, F.col("blob").alias(key)).join(per_blob.withColumnRenamed("blob", key), key, "left")
    none = {f"n_{k}": F.lit(0).cast("long") for k in BASE} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    result = stored(rows.select(path, *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()]), "secret-scans")
    discard(per_blob)
    return result


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a ledger that begins empty and goes when they are scanned."""
    ledger = Ledger(spark, f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}")
    result = scan_paths(table(spark, sf_dir, "documents"), ledger)
    ledger.files.delete(ledger._path(""), True)
    return result


def oracle(documents: str = "documents") -> str:
    """The same spans by DuckDB: matches and the pieces between them, added up."""

    def of(rank: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        whole, measured = (f"regexp_extract_all(text, '{pattern}', {g})" for g in (0, rule.group))
        return f"""
SELECT row_id, {rank} AS rank, '{rule.kind}' AS kind, ends[i] - length(whole[i]) AS start, ends[i] AS "end" FROM (
  SELECT row_id, whole, measured, list_transform(whole, lambda w, i: list_sum(list_transform(whole[1:i], lambda x: length(x))) + list_sum(list_transform(between[1:i], lambda x: length(x)))) AS ends,
    unnest(range(1, len(whole) + 1)) AS i
  FROM (SELECT row_id, {whole} AS whole, {measured} AS measured, string_split_regex(text, '{pattern}') AS between FROM d WHERE regexp_matches(text, '{pattern}')))
WHERE length(measured[i]) >= {rule.least}"""

    base = ", ".join(f"'{k}'" for k in BASE)
    counted = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    one = "kind || ':' || start::BIGINT || ':' || \"end\"::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM {documents}),
f AS ({" UNION ALL ".join(of(n, r) for n, r in enumerate(RULES))}),
b AS (SELECT row_id, {counted}, sha256(coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
  string_agg({one}, ',' ORDER BY start, rank) AS spans FROM f GROUP BY row_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (row_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_secret_scans": op12_secret_scans}
ORACLE_SQL: dict[str, str] = {"op12_secret_scans": oracle()}
