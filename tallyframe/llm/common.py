"""Helpers that several operators share: the shared scratch folder and vectorised tokenising."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split on ASCII white space, and of those that split on anything but digits, letters and non-ASCII.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts the words; of the second kind, where A-Z are not lower-cased yet.
SPACE, NOT_ALNUM = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Used only by local sessions that name no spark.checkpoint.dir, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/tallyframe"

#: Spark's setting by which shuffle files go when the step that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of how many rows go to Python together; messages of many kilobytes need fewer.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a session in one process can do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or LOCAL_DIR


def stored(df: DataFrame, tag: str, arrow_rows: int | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: later steps don't recompute it, and lost executors take nothing with them.

    What the step shuffled isn't needed any more then, so Spark is told to delete it at the step's end.
    A table that discard() hasn't deleted by then, such as an operator's result, goes with the driver.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | ({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    where, folder = folder_of(back)
    where.deleteOnExit(folder)
    return back


def folder_of(df: DataFrame) -> tuple:
    """A stored table's file system and path."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    return path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), path


def discard(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        where, folder = folder_of(df)
        where.delete(folder, True)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """The wanted column name, lengthened until no column of that name is there."""
    names = {x.lower() for x in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column, between: str) -> Column:
    """How many words a text has, where `between` matches what parts them; null has none. Much faster than counting a pattern's matches."""
    parts = F.split(F.coalesce(text, F.lit("")), between)
    blank = lambda at: (F.element_at(parts, at) == "").cast("long")
    return F.greatest(F.lit(0).cast("long"), F.size(parts).cast("long") - blank(1) - blank(-1))


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on and, after the last, give memory that is free back to the system: Python workers live on and wait for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that no slice has much more than max_bytes of text, but for a longer single text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def gathered(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Put small Arrow batches together, up to max_bytes of text, but for a larger single batch."""
    some: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if some and total + n > max_bytes:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, total = [], 0
        some.append(batch)
        total += n
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased white-space words of each text: the distinct words, each occurrence's index in them, and each text's number of words."""
    if texts.offset:  # splitting goes wrong on arrays that begin within their buffers
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    parent, words = pc.list_parent_indices(lists), lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    words, parent = words.filter(some), parent.filter(some)
    coded = words.dictionary_encode()
    counts = np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(texts))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts
