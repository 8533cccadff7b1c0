"""One large JSON document as rows: an array, or an object that has an array under a key at its top.

The file is read by byte ranges, as pieces that end at closing braces, so no row is larger than an
item. Whether a piece begins within a string and how deep it stands depend on all that comes before
it. A first pass says of each range what it does to quoting and depth, whether or not it begins within
a string; the ranges, one short row each, are added up in their order, and then every range knows its
state without having seen the others. A second pass finds the array and counts its elements, and a
third puts pieces together to items; only what crosses the border of two ranges is shuffled.

Writing goes the other way: tasks write parts of items in order, and a commit joins them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a piece. Items of a document are objects, so every item ends with it.
END = "}"
ESCAPE, SIGN, ANY_SIGN = re.compile(r"\\.", re.S), re.compile(r"[\[\]{,]"), re.compile(r'["\\\[\]{}]')


class DocumentError(ValueError):
    """The document is cut off, or isn't of the expected form."""


def apart(value: str, quoted: bool) -> tuple[str, str, bool]:
    """A piece's text outside and within strings, and whether it ends within one. Escapes, which only strings have, are left out."""
    cut = ESCAPE.sub("", value).split('"')
    return "".join(cut[quoted::2]), "".join(cut[1 - quoted :: 2]), quoted ^ (len(cut) % 2 == 0)


def rise(outside: str) -> int:
    return outside.count("[") + outside.count("{") - outside.count("]")


def walk(outside: str, depth: int, level: int) -> tuple[int, int, int]:
    """The depth after a text, the lowest on the way, and the commas that stood at a level before it was left."""
    low, commas = depth, 0
    for c in SIGN.findall(outside):
        if c == ",":
            commas += depth == level <= low
        else:
            depth += 1 if c != "]" else -1
            low = min(low, depth)
    return depth, low, commas


def closing_at(value: str, depth: int, quoted: bool, level: int) -> int:
    """Where the bracket stands that closes an array at a level."""
    at = 0
    while sign := ANY_SIGN.search(value, at):
        at, c = sign.end(), sign.group()
        if c == "\\":
            at += quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if c in "[{" else -1
            if depth < level:
                return sign.start()
    return -1


@dataclass
class Piece:
    block: int
    nth: int
    value: str
    #: Whether it begins within a string, and how deep.
    quoted: bool
    depth: int
    outside: str
    odd_end: bool


@dataclass
class Document:
    """A document's ranges with the state that each begins in, and where its array begins and ends, as (range, number of the piece in it)."""

    raw: DataFrame
    starts: dict[int, tuple[bool, int]]
    level: int
    last_ended: bool
    pattern: str
    opening: tuple[int, int] | None = None
    closing: tuple[int, int] | None = None
    #: Of each range, how many items ended and commas of the array stood before it.
    before: dict[int, tuple[int, int]] = field(default_factory=dict)

    def scan(self, each: Callable[[Iterator[Piece]], Iterator[tuple]], schema: str) -> DataFrame:
        """What `each` makes of every range's pieces, as rows."""
        starts = self.starts

        def pieces(block: int, values: Iterator[str]) -> Iterator[Piece]:
            if block not in starts:
                raise DocumentError("the file, or how it is split, has changed since it was looked through")
            quoted, depth = starts[block]
            for nth, value in enumerate(values):
                outside, _, odd_end = apart(value, quoted)
                yield Piece(block, nth, value, quoted, depth, outside, odd_end)
                depth, quoted = depth + rise(outside) - (not odd_end), odd_end

        return by_range(self.raw, lambda block, values: each(pieces(block, values)), schema)

    def rows(self) -> DataFrame:
        """kind (0: an item with what stands before it, 1: a part of one that a range's border cuts, 2: what stands around the array), chunk, commas before it, block, nth, text."""
        level, opening, closing, before, pattern = self.level, self.opening, self.closing, self.before, re.compile(self.pattern)

        def each(pieces: Iterator[Piece]) -> Iterator[tuple]:
            some: list[str] = []
            chunk = commas = at = 0
            cut = True  # by the range's beginning
            p = None
            for p in pieces:
                place = (p.block, p.nth)
                if opening is None or place < opening or place > closing:
                    yield 2, 0, 0, p.block, p.nth, p.value + END
                    continue
                if p.nth == 0 or place == opening:
                    chunk, commas = before[p.block] if place != opening else (0, 0)
                    at, cut = commas, place != opening
                value, depth, quoted, outside = p.value, p.depth, p.quoted, p.outside
                if place == opening:
                    begin = pattern.search(value).end()
                    yield 2, 0, 0, p.block, p.nth, value[:begin] + "]"
                    value, depth, quoted = value[begin:], level, False
                    outside = apart(value, False)[0]
                if place == closing:
                    end = closing_at(value, depth, quoted, level)
                    yield int(cut), chunk, at, p.block, p.nth, "".join(some) + value[:end]
                    yield 2, 0, 0, p.block, p.nth, value[end + 1 :] + END
                    some = []
                    continue
                depth, _, more = walk(outside, depth, level)
                some.append(value + END)
                commas += more
                if not p.odd_end and depth == level + 1:
                    yield int(cut), chunk, at, p.block, p.nth, "".join(some)
                    some, chunk, at, cut = [], chunk + 1, commas, False
            if some:
                yield 1, chunk, at, p.block, p.nth, "".join(some)

        return self.scan(each, "kind int, chunk long, commas long, block long, nth long, text string")

    def chunks(self) -> DataFrame:
        """A row for each item with what scalars and arrays stand before it: first (the number of its first element), listed (the elements as an array), bad."""
        rows = self.rows()
        placed = rows.where("kind = 0").select("chunk", "commas", "text")
        parts = F.array_sort(F.collect_list(F.struct("block", "nth", "text")))
        joined = rows.where("kind = 1").groupBy("chunk").agg(F.min("commas").alias("commas"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
        if len(self.starts) > 1:  # else no border cuts anything
            placed = placed.unionByName(joined)
        comma, stripped = F.col("text").rlike(r"^\s*,"), F.regexp_replace("text", r"^\s*,", "")
        placed = placed.select("chunk", "commas", comma.alias("comma"), stripped.alias("body")).withColumn("listed", F.concat(F.lit("["), "body", F.lit("]")))
        unread = F.from_json("listed", "ARRAY<STRING>", {"allowSingleQuotes": "false"}).isNull()
        bad = F.when(F.col("body").rlike(r"^\s*$"), F.col("comma")).otherwise((F.col("comma") != (F.col("chunk") > 0)) | unread)
        return placed.select((F.col("commas") + F.col("comma").cast("int")).alias("first"), "listed", bad.alias("bad"))

    def around(self) -> DataFrame:
        """Pieces of what stands around the array, which stands there as []: block, nth, text."""
        return self.rows().where("kind = 2").select("block", "nth", "text")

    def outer(self) -> DataFrame:
        """One row, value: the document without the array's elements. It is as long as what stands around the array."""
        # Of one piece, the text before the array ends with its brackets and stands before the text after it.
        parts = F.array_sort(F.collect_list(F.struct("block", "nth", (~F.col("text").endswith("]")).alias("after"), "text")))
        text = self.around().agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("value"))
        return text if self.last_ended else text.select(F.regexp_replace("value", r"\}$", "").alias("value"))


def by_range(raw: DataFrame, each: Callable[[int, Iterator[str]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of a function of each byte range and its pieces in their order."""

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((block, value) for b in batches for block, value in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))
        ahead = next(pairs, None)

        def values(block: int) -> Iterator[str]:
            nonlocal ahead
            while ahead and ahead[0] == block:
                yield ahead[1]
                ahead = next(pairs, None)

        names = [c.split()[0] for c in schema.split(", ")]
        while ahead:
            some, size = [], 0
            for row in each(ahead[0], values(ahead[0])):
                some.append(row)
                size += len(row[-1]) if isinstance(row[-1], str) else 0
                if len(some) >= 1000 or size >= 4 << 20:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*some, strict=True), strict=True)), schema=arrow)
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*some, strict=True), strict=True)), schema=arrow)

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return raw.mapInArrow(of_task, schema)


def open_document(spark: SparkSession, path: str, key: str | None = None) -> Document:
    """Look through a document: an array, or, with a key, an object whose last array of that name at its top counts.

    Documents that are cut off or whose brackets don't match raise, and without a key those that are no array.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(file).getLen()
    raw = spark.read.option("lineSep", END).text(path).select("value", F.col("_metadata.file_block_start").alias("block"))

    def total(block: int, values: Iterator[str]) -> Iterator[tuple]:
        odd, rises, length = False, [0, 0], 0
        for value in values:
            out, within, odd = apart(value, odd)
            # If the range begins within a string, what seems within strings is outside. The brace that ends a piece closes something, unless it stands in a string.
            rises[0] += rise(out) - (not odd)
            rises[1] += rise(within) - odd
            length += len(value.encode()) + 1
        yield block, odd, rises[0], rises[1], length

    blocks = sorted(by_range(raw, total, "block long, odd boolean, rise_0 long, rise_1 long, bytes long").collect())
    if not blocks:
        raise DocumentError(f"{path} is empty")
    # Every piece was counted with its brace; the last one may have ended with the file. A byte order mark isn't part of any piece.
    last_ended = sum(b.bytes for b in blocks) in (size, size - 3)
    starts: dict[int, tuple[bool, int]] = {}
    quoted, depth = False, 0
    for b in blocks:
        starts[b.block] = quoted, depth
        depth += b.rise_1 if quoted else b.rise_0
        quoted ^= b.odd
    if quoted or depth + (not last_ended):
        raise DocumentError(f"{path} is cut off or isn't JSON")
    document = Document(raw, starts, 1 if key is None else 2, last_ended, r"^\s*\[" if key is None else rf'(?<!\\)"{re.escape(key)}"\s*:\s*\[')
    _find_array(document, path, key is None)
    return document


def _find_array(document: Document, path: str, alone: bool) -> None:
    """Set where the array opens and closes, and what of it stands before each range."""
    level, pattern = document.level, re.compile(document.pattern)

    def each(pieces: Iterator[Piece]) -> Iterator[tuple]:
        # Items, commas and the closing piece if the array is open where the range begins, and of the last array that opens in the range.
        counts = [[0, 0, -1], [0, 0, -1]]
        opening, block, blank = -1, 0, True
        for p in pieces:
            block, depth, outside = p.block, p.depth, p.outside
            opens = [False, False]
            if (m := pattern.search(p.value)) and (blank or not alone):
                # A key of an inner object ends before that object does, so the first match of a piece is the one at the top, if any is.
                if depth + rise(apart(m.group() if alone else p.value[: m.end()], p.quoted)[0]) == level:
                    opening, opens[1], counts[1] = p.nth, True, [0, 0, -1]
            blank = blank and not p.value.strip()
            for k, found in enumerate(counts):
                if found[2] < 0 and (k == 0 or opening >= 0):
                    text, deep = (apart(p.value[m.end() :], False)[0], level) if opens[k] else (outside, depth)
                    after, low, commas = walk(text, deep, level)
                    found[1] += commas
                    if low < level:
                        found[2] = p.nth
                    elif not p.odd_end and after == level + 1:
                        found[0] += 1
        yield block, opening, blank, *counts[0], *counts[1]

    found = sorted(document.scan(each, "block long, opening long, blank boolean, ended_0 long, commas_0 long, closes_0 long, ended_1 long, commas_1 long, closes_1 long").collect())
    opened = [b for b in found if b.opening >= 0]
    if alone and (not opened or any(not b.blank for b in found if b.block < opened[0].block)):
        raise DocumentError(f"{path} isn't an array")
    if not opened:
        return
    first = opened[0] if alone else opened[-1]
    document.opening = first.block, first.opening
    ended, commas, closes = first.ended_1, first.commas_1, first.closes_1
    document.before[first.block] = 0, 0
    for b in [first, *(b for b in found if b.block > first.block)]:
        if b is not first:
            document.before[b.block] = ended, commas
            ended, commas, closes = ended + b.ended_0, commas + b.commas_0, b.closes_0
        if closes >= 0:
            document.closing = b.block, closes
            return
    raise DocumentError(f"the array of {path} is not closed")


def elements(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(outer, elements): one row with the document around the array (value), and pos and raw, the JSON text of each element; of strings their value.

    Elements that can't be read, commas without elements, and anything but white space around an array
    without a key raise. Without the key in the document, there are no elements.
    """
    document = open_document(spark, path, key)
    if document.opening is None:
        return document.outer(), spark.createDataFrame([], "pos long, raw string")
    chunks = document.chunks()
    wrong = chunks.where("bad").select(F.lit(1).alias("wrong"))
    if key is None:  # what is left around the array is its brackets, and the brace that no piece ended with
        wrong = wrong.unionByName(document.around().where(~F.col("text").rlike(r"^\s*(\[\]|\s*\}?)$")).select(F.lit(1).alias("wrong")))
    if wrong.limit(1).count():
        raise DocumentError(f"{path} isn't a JSON document of the expected form")
    each = chunks.select("first", F.posexplode(F.from_json("listed", "ARRAY<STRING>")).alias("nth", "raw"))
    return document.outer(), each.select((F.col("first") + F.col("nth")).cast("long").alias("pos"), "raw")


def write_array(rows: DataFrame, path: str, before: str = "[", after: str = "]") -> None:
    """Replace a file by a JSON array of rows (pos, value: an element's JSON text), in the order of pos, with the text around it.

    Tasks write ranges of pos as parts of a folder beside the file, element by element. The commit
    joins the parts, whose offsets in the file follow from their lengths, and renames the result over
    the file, so that rows may have been read from it. Until then the old file is whole; what a lost
    driver leaves is a folder that nothing reads.
    """
    spark = rows.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target = hadoop.Path(path).getFileSystem(conf).makeQualified(hadoop.Path(path))
    files = hadoop.FileContext.getFileContext(target.toUri(), conf)
    folder = files.makeQualified(hadoop.Path(beside))
    try:
        # Each element begins with its comma; the first one's is left out when parts are joined.
        ordered = rows.select("pos", F.concat(F.lit(","), "value").alias("value")).repartitionByRange("pos").sortWithinPartitions("pos")
        ordered.select("value").write.text(f"{beside}/parts")
        joined = join_parts(spark, f"{beside}/parts", f"{beside}/joined", before, after)
        over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        files.rename(joined, target, over)
        # Local files have check sums beside them, which would be wrong as soon as somebody edits the document.
        target.getFileSystem(conf).delete(hadoop.Path(target.getParent(), f".{target.getName()}.crc"), False)
    finally:
        files.delete(folder, True)


def join_parts(spark: SparkSession, parts: str, to: str, before: str, after: str) -> object:
    """Write one file of the parts' bytes in the order of their names, without the first byte, between two texts. Bytes go from stream to stream, never a part as a whole."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(to)
    fs = folder.getFileSystem(conf)
    if not fs.exists(hadoop.fs.Path(folder, "_SUCCESS")):
        raise DocumentError(f"{parts} was not written to its end")
    some = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
    out = fs.create(target)
    try:
        out.write(bytearray(before.encode()))
        for n, (name, _) in enumerate(some):
            part = fs.open(hadoop.fs.Path(folder, name))
            try:
                part.seek(0 if n else 1)
                hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
        out.write(bytearray(after.encode()))
    finally:
        out.close()
    wanted = len(before.encode()) + len(after.encode()) + sum(length for _, length in some) - bool(some)
    if fs.getFileStatus(target).getLen() != wanted:
        raise DocumentError(f"{to} has not the length of its parts")
    return fs.makeQualified(target)
