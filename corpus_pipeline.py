"""The corpus pipeline: documents go through STAGES one after another, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All stages but
the last return the columns that docs has; the last returns each row's place in the shards. Empty
tables go through all stages; null and empty texts stay (they are neither toxic, copies nor
contaminated, and take no words of a source's target); rows without an id stay, too. Texts of any
length are read whole. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import SPACE_WORD, discard, free_name, stored, table
from tallyframe.llm.decontamination import find_contamination
from tallyframe.llm.mixing import mix_rows
from tallyframe.llm.ngram_join import row_classes
from tallyframe.llm.sharding import assign_shards
from tallyframe.llm.toxicity import THRESHOLD, fit_grammar, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the grammar, learned from docs and labels, doesn't reject."""
    model = fit_grammar(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "toxicity")
    return score_toxicity(docs, model, tuple(docs.columns), score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest doc_id (null last), among those with one id any one text of the group.

    Rows are known by their id and text, so rows of one id and different texts are judged apart, and
    rows without an id like others. Of rows that are equal in both, the first by a hash of their other
    columns stays. Texts without words belong to no group and stay.
    """
    row_key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    groups = row_classes(docs, row_key).where("class is not null")
    kept = groups.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))["row_key"].alias("kept_key")).select("kept_key").distinct()
    worded = F.coalesce(F.col("text").rlike(SPACE_WORD), F.lit(False))
    # Rows are carried whole, so that no column of theirs can have the name of one of these.
    rows = docs.select(whole(docs), row_key.alias("row_key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), other_columns(docs).alias("others"), worded.alias("worded"))
    named = rows.where("worded").join(kept, F.col("row_key") == F.col("kept_key"), "left_semi")
    # One of equal rows, which tasks choose from their own rows first: very many of them meet nowhere.
    once = named.groupBy("row_key", "sha").agg(F.min_by("row", "others").alias("row"))
    return once.select("row").unionByName(rows.where("not worded").select("row")).select("row.*")


def whole(docs: DataFrame) -> Column:
    return F.struct(*[docs[c] for c in docs.columns]).alias("row")


def other_columns(docs: DataFrame) -> Column:
    """A hash of all columns but the text."""
    return F.xxhash64(F.to_json(F.struct(F.lit(0).alias("0"), *[docs[c] for c in docs.columns if c != "text"])))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; they are known by their id and their text's hash."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    keyed = docs.select(whole(docs), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_key"))
    return keyed.join(bad, (F.col("row_key") == F.col("bad_key")) & F.col("row_id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, the row at a source's cut if at least half of it is taken; rows without words once."""
    row_key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "text")
    taken = mix_rows(docs, row_key)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.try_divide("taken", "size"))).cast("int")
    # Rows that stand several times are told apart by a number, in the order of their other columns' hash.
    counted = taken.select(F.col("row_key").alias("taken_key"), copies.alias("times"), F.row_number().over(Window.partitionBy("row_key").orderBy(F.desc("taken"))).alias("taken_nth"))
    keyed = docs.select(whole(docs), row_key.alias("row_key"), other_columns(docs).alias("others"))
    numbered = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy("others")))
    joined = numbered.join(counted, (F.col("row_key") == F.col("taken_key")) & (F.col("nth") == F.col("taken_nth")))
    return joined.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot."""
    return assign_shards(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the toxicity stage's learned grammar; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
