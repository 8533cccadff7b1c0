"""Benchmark decontamination by a positional inverted index, in column expressions only.

The index stores postings (term, document, position) of training tokens for the terms that the
benchmark's windows are searched by: the rarest few of each window, by how often each occurs in
the training texts. A window's lists are shifted by the terms' offsets in it and intersected from
the rarest on; the few candidates that all lists have are then spelled out in their document, so a
match is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM_WORD, NOT_ALNUM, ascii_lower, count_words, discard, stored, table

WINDOW = 10
#: Lists that are intersected for each window: its rarest terms, as far as a list is at most so many times as long as the rarest one's.
LISTS, LONGER = 3, 8
#: A set of test terms or windows of at most so many rows is broadcast (some tens of MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Where terms are joined by a shuffle: those with more than one in so many of all postings are hot, so there are at most so many of them; and postings of one term that a task takes.
HOT_TERMS, POSTINGS_PER_TASK = 10_000, 1_000_000

NOT_WORD = ALNUM_WORD.replace("[^", "[", 1)


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; a null or empty text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def split_text(text: Column) -> Column:
    """A text between its runs of other characters; before the first and after the last of them there may be nothing."""
    return F.split(F.coalesce(text, F.lit("")), NOT_ALNUM)


def tokens_of(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep, pos and term of every token; positions count from 0, or from 1 where a text begins with other characters."""
    term = F.col("term")
    lower = F.when(F.octet_length(term) == F.length(term), F.lower(term)).otherwise(ascii_lower(term))
    return rows.select(*keep, F.posexplode(split_text(F.col("text"))).alias("pos", "term")).where("term <> ''").select(*keep, "pos", lower.alias("term"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def phrase_id(words: Column) -> Column:
    """A sequence of words by its SHA-256: words have no space, so equal ids mean equal words."""
    return F.unhex(F.sha2(F.array_join(words, " "), 256))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows: wid, words) and (uses: wid, item_id). Equal windows are one; an item shorter than the window is a window itself."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    uses = words.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start"), window).alias("words"))
    uses = uses.withColumn("wid", phrase_id(F.col("words")))
    return uses.select("wid", "words").dropDuplicates(["wid"]), uses.select("wid", "item_id").distinct()


def index_terms(windows: DataFrame, frequencies: DataFrame, lists: int = LISTS, longer: float = LONGER) -> DataFrame:
    """(wid, length, term, offset, place, lists): each window's rarest positions, from place 1 on; windows with a word that no training text has are out."""
    spread = windows.select("wid", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
    known = spread.join(frequencies, "term")
    by = Window.partitionBy("wid")
    known = known.withColumns({"found": F.count(F.lit(1)).over(by), "least": F.min("frequency").over(by), "place": F.row_number().over(by.orderBy("frequency", "term", "offset"))})
    chosen = known.where((F.col("found") == F.col("length")) & (F.col("place") <= lists) & (F.col("frequency") <= F.col("least") * longer))
    return chosen.select("wid", "length", "term", "offset", "place", F.count(F.lit(1)).over(by).cast("int").alias("lists"))


def phrase_matches(rows: DataFrame, windows: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """Exact occurrences (doc_id, text_key, start, length, wid) of the windows in texts, written; those of repeated rows are repeated.

    rows: doc_id, text_key, text. Candidates come from the intersection of the index's lists, never from pairs of documents and windows.
    """
    n = windows.count() * window
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    counted = F.count(F.lit(1)).alias("frequency")
    if n <= BROADCAST_ROWS:
        frequencies = tokens_of(rows).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(counted)
    else:  # counted before they are shuffled, so no term is hot
        frequencies = tokens_of(rows).groupBy("term").agg(counted).join(vocabulary, "term", "left_semi")
    frequencies = stored(frequencies, "term-frequencies")
    terms = stored(index_terms(windows, frequencies, lists), "index-terms")
    wanted = terms.select("term").distinct()
    tokens = tokens_of(rows, "doc_id", "text_key")
    if n <= BROADCAST_ROWS:
        index = stored(tokens.join(F.broadcast(wanted), "term"), "postings")
        shifted = index.join(F.broadcast(terms), "term")
    else:
        index, shifted = hot_postings(tokens, wanted, terms, frequencies)
    shifted = shifted.withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    # The intersection: a start is kept if all the window's lists have it. Rows with one id and text count once, as each list is a bit.
    have = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("place") - 1))
    met = shifted.groupBy("doc_id", "text_key", "wid", "start").agg(have.alias("have"), F.first("lists").alias("lists"), F.first("length").alias("length"))
    met = met.where(F.col("have") == F.call_function("shiftleft", F.lit(1), F.col("lists")) - 1)
    # Spelling: a document's candidates come to it together, and only documents with candidates are cut into words again.
    asked = met.groupBy(F.col("doc_id").alias("asked_id"), F.col("text_key").alias("asked_key")).agg(F.collect_list(F.struct("start", "length", "wid")).alias("asked"))
    asked = stored(asked, "candidates")
    discard(frequencies, terms, index)
    told = rows.join(asked.hint("merge"), rows["doc_id"].eqNullSafe(asked["asked_id"]) & (rows["text_key"] == asked["asked_key"]))
    told = told.select("doc_id", "text_key", "asked", split_text(ascii_lower(F.col("text"))).alias("words"))
    lead = (F.element_at("words", 1) == "").cast("int")
    right = F.filter("asked", lambda a: phrase_id(F.slice("words", a["start"] + 1, a["length"])) == a["wid"])
    spelled = F.transform(right, lambda a: a.withField("start", a["start"] - lead))
    matches = stored(told.select("doc_id", "text_key", F.inline(spelled)), "matches")
    discard(asked)
    return matches


def hot_postings(tokens: DataFrame, wanted: DataFrame, terms: DataFrame, frequencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index and its join with the windows' terms, where both are too large to broadcast and some terms are very common.

    Postings of hot terms are found by a broadcast, which holds HOT_TERMS rows at most. Each term's
    postings are dealt to as many parts as they fill, and the windows' terms go to each of the parts.
    """
    total = frequencies.agg(F.coalesce(F.sum("frequency"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("frequency") / POSTINGS_PER_TASK).cast("int").alias("parts")
    sized = wanted.join(frequencies, "term").select("term", parts, (F.col("frequency") * HOT_TERMS > total).alias("hot"))
    found = [tokens.join(F.broadcast(sized.where("hot").drop("hot")), "term"), tokens.join(sized.where("not hot").drop("hot").hint("merge"), "term")]
    part = F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.col("parts")).cast("int").alias("part")
    index = stored(found[0].unionByName(found[1]).select("doc_id", "text_key", "pos", "term", part), "postings")
    dealt = terms.join(sized.drop("hot"), "term").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return index, index.join(dealt, ["term", "part"])


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 5, lists: int = LISTS) -> DataFrame:
    """(doc_id, wid, first): where a benchmark window's rarest terms stand, in any order, within so many words more than in the window.

    docs: doc_id, text. The general form of the index's lists, beside exact phrases: the terms'
    shifted positions may differ by at most slop.
    """
    rows = keyed(docs).withColumn("words", words_of(F.col("text")))
    windows, _ = benchmark_windows(items)
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    frequencies = rows.select(F.explode("words").alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    terms = index_terms(windows, frequencies, lists, float("inf"))
    shifted = rows.select("doc_id", "text_key", F.posexplode("words").alias("pos", "term")).join(terms, "term").withColumn("start", F.col("pos") - F.col("offset"))
    near = Window.partitionBy("doc_id", "text_key", "wid").orderBy("start").rangeBetween(0, slop)
    met = shifted.withColumn("places", F.size(F.collect_set("place").over(near))).where(F.col("places") == F.col("lists"))
    return met.groupBy("doc_id", "wid").agg(F.min("start").alias("first"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: rows with the same id and text are alike in all results, so that is what they are known by."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs, item_ids (the items found in it) and text_key (its text's hash).

    docs: doc_id, text; items: item_id, text; other columns don't matter. A document word inside any
    occurrence of a window is hit. Null, empty and wordless texts have no words, hit nothing and are
    not contaminated; items without words have no windows; repeated rows give equal results; empty
    tables give no hits. Texts are read whole, whatever their length: their tokens are rows. Of equal
    windows one is searched. items_sha256 of no items is that of an empty text.
    """
    rows = keyed(docs)
    windows, uses = benchmark_windows(items.select("item_id", "text"), window)
    windows, uses = stored(windows, "windows"), stored(uses, "window-items")
    matches = phrase_matches(rows, windows, window, lists)
    key = ["doc_id", "text_key"]
    # One document's occurrences are at most its words times the windows that start there; each start counts once.
    starts = matches.groupBy(*key, "start").agg(F.max("length").alias("length")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("starts"))

    def cover(state: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct((state["n"] + F.greatest(F.lit(0), end - F.greatest(state["end"], s["start"]))).cast("long").alias("n"), F.greatest(state["end"], end).alias("end"))

    hit = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), cover)["n"]
    found = matches.select(*key, "wid").distinct().join(small(uses, uses.count()), "wid").groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    by_doc = starts.select(*key, hit.alias("n_hit")).join(found, (starts["doc_id"].eqNullSafe(found["doc_id"])) & (starts["text_key"] == found["text_key"])).select(starts["doc_id"].alias("hit_id"), starts["text_key"].alias("hit_key"), "n_hit", "item_ids")
    flat = rows.select("doc_id", "text_key", count_words(F.col("text"), NOT_ALNUM).alias("n_words"))
    joined = flat.join(by_doc, flat["doc_id"].eqNullSafe(by_doc["hit_id"]) & (flat["text_key"] == by_doc["hit_key"]), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        ids.alias("item_ids"),
        "text_key",
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "text_key")


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    def words(name: str, key: str) -> str:
        return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS words FROM {name}"

    return rf"""
WITH d AS ({words(documents, 'doc_id')}), b AS ({words(benchmark, 'item_id')}),
w AS (SELECT DISTINCT item_id, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS phrase, least(len(words), {WINDOW}) AS length
      FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
l AS (SELECT DISTINCT length FROM w),
g AS (SELECT doc_id, i, length, array_to_string(words[i:i + length - 1], ' ') AS phrase
      FROM (SELECT doc_id, words, length, unnest(range(1, len(words) - length + 2)) AS i FROM d, l WHERE len(words) >= length)),
m AS (SELECT g.doc_id, g.i, g.length, w.item_id FROM g JOIN w USING (phrase, length)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + length)) AS at FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_decontamination": op3_decontamination}
ORACLE_SQL: dict[str, str] = {"op3_decontamination": oracle()}
