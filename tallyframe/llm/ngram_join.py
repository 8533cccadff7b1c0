"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

Columns of one document alone add to no overlap, so the product begins by finding, over all
documents, the columns that at least two have; a document for which too few are left can't reach
the similarity with any other and is out (a bound by its size). For the rest, columns are ordered
from the rarest; two documents that are similar enough share one of the first few of each (again a
bound by size), so only rows of one such column are multiplied, block by block: rows in chunks,
columns in strips, and pairs are discarded once what is left of either row can't lift the overlap to
what their sizes ask for. Links are verified before they are followed: a column's rows first meet
the first of them and one chunk of the others, and only columns whose rows aren't all connected by
then have all their chunks meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, gathered, space_words, stored, table, text_slices, trimmed
from .components import connected_components

WORDS = 5
#: Similarity of a link, in hundredths.
PERCENT = 80
#: Documents for each task of the first product, about, bytes of text that are cut up at once, and rows of a chunk of a group.
DOCS_PER_TASK, PIECE_BYTES, CHUNK = 3000, 4 << 20, 1024
#: Messages, and rows of the matrix, that go to Python together: some megabytes, as the JVM and Python both hold them.
ARROW_MESSAGES, ARROW_SETS = 100, 500
#: Columns of a strip, and rows of a column that adds to its pairs one by one.
STRIP, FEW = 4096, 4

PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, a text without words has none."""
    vocabulary, ids, counts = space_words(texts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary.cast(pa.large_binary()).to_pylist()], np.uint64)[ids] if len(ids) else np.empty(0, np.uint64)
    # A shingle's hash is a polynomial in its words' hashes; whole short texts have their length in it, too.
    full = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        full = full * PRIME + hashes[k : k + len(full)]
    full = mixed(full)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= words:
            sets.append(np.unique(full[at : at + n - words + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for k in range(n):
                h = h * PRIME + hashes[at + k]
            sets.append(mixed(h + np.uint64(n)))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets


def signature(shingles: np.ndarray) -> int:
    """A set's 63-bit name; documents with equal sets are one row of the matrix."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


ROWS = ("names", "sizes", "lengths", "hashes")  # packed rows of the matrix: 64-bit names, 32-bit set sizes and numbers of columns, 64-bit columns
DOCS = "doc_ids array<long>, doc_keys array<long>, doc_sigs array<long>, doc_sizes array<int>"
PARTS = f"bucket int, columns binary, owners binary, owner_names binary, owner_sizes binary, names binary, sizes binary, lengths binary, hashes binary, {DOCS}"
FOUND = f"bucket int, names binary, sizes binary, lengths binary, hashes binary, {DOCS}"
DOCS_ARROW = [("doc_ids", pa.list_(pa.int64())), ("doc_keys", pa.list_(pa.int64())), ("doc_sigs", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32()))]
FOUND_ARROW = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ROWS], *DOCS_ARROW])
PARTS_ARROW = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("columns", "owners", "owner_names", "owner_sizes", *ROWS)], *DOCS_ARROW])
ABLE_ARROW = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary())])

#: Owner of a column that several documents of one part have; they know it without asking.
SEVERAL = 2**31 - 1


def grouped(names: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Hashes by name, with the name's size."""
    order = np.argsort(names, kind="stable")
    names, sizes, hashes = names[order], sizes[order], hashes[order]
    edge = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]])) if len(names) else np.zeros(1, int)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(names[a]), int(sizes[a]), hashes[a:b]


def edges_of(tasks: int) -> np.ndarray:
    """Where each task's range of hashes begins."""
    return np.array([-(-(t << 64) // tasks) for t in range(tasks)], np.uint64)


def packed(names: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, tasks: int) -> dict[int, dict[str, bytes]]:
    """One message for each task that names belong to, however many documents it is about."""
    bucket = names % tasks
    order = np.lexsort((names, bucket))
    names, sizes, hashes, bucket = names[order], sizes[order], hashes[order], bucket[order]
    new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
    lengths = np.diff(np.append(new, len(names))).astype(np.int32)
    out = {}
    for b in np.unique(bucket).tolist():
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        i, j = np.searchsorted(new, [lo, hi])
        out[b] = {"names": names[new[i:j]].tobytes(), "sizes": sizes[new[i:j]].astype(np.int32).tobytes(), "lengths": lengths[i:j].tobytes(), "hashes": hashes[lo:hi].tobytes()}
    return out


def ascending(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers by their gaps, in as few bytes each as the widest needs; the number of bytes comes first."""
    gaps = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def ascended(b: bytes, start: np.uint64) -> np.ndarray:
    """The numbers that ascending() has packed, from a start on."""
    wide = np.zeros(((len(b) - 1) // b[0], 8), np.uint8)
    wide[:, : b[0]] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + start


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A message's names, sizes and hashes, one entry for each hash."""
    lengths = np.frombuffer(row["lengths"], np.int32)
    return np.repeat(np.frombuffer(row["names"], np.int64), lengths), np.repeat(np.frombuffer(row["sizes"], np.int32), lengths), np.frombuffer(row["hashes"], np.uint64)


def parts_of(batches: Iterable[pa.RecordBatch], tasks: int, words: int) -> Iterator[pa.RecordBatch]:
    """Cut the incidence matrix of some documents into a range of columns for each task: each column with the one document that has it, or SEVERAL."""
    starts = edges_of(tasks)
    for batch in gathered(batches, max_bytes=PIECE_BYTES):
        for piece in text_slices(batch, max_bytes=PIECE_BYTES):
            sets = shingle_sets(piece["text"], words)
            rows: dict[int, np.ndarray] = {}
            sigs = []
            for s in sets:
                sigs.append(signature(s) if len(s) else None)
                if len(s):
                    rows.setdefault(sigs[-1], s)
            out: dict[int, dict] = {}
            if rows:
                names, sizes = np.fromiter(rows, np.int64, len(rows)), np.fromiter(map(len, rows.values()), np.int32, len(rows))
                owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
                hashes = np.concatenate(list(rows.values()))
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                length = np.diff(np.append(first, len(hashes)))
                # Pre-aggregation: a column of several documents is sent once, and those documents get it back at once.
                known = np.repeat(length > 1, length)
                out = packed(names[owner[known]], sizes[owner[known]], hashes[known], tasks)
                hashes, owner = hashes[first], np.where(length > 1, SEVERAL, owner[first])
                edge = np.append(np.searchsorted(hashes, starts), len(hashes))
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    h, o = hashes[edge[b] : edge[b + 1]], owner[edge[b] : edge[b + 1]]
                    used = np.unique(o[o != SEVERAL])
                    o = np.where(o == SEVERAL, len(used), np.searchsorted(used, o))
                    o = o.astype(np.uint16 if len(used) < 2**16 else np.uint32)
                    out.setdefault(b, {}).update({"columns": ascending(h - starts[b]), "owners": o.tobytes(), "owner_names": names[used].tobytes(), "owner_sizes": sizes[used].tobytes()})
            listed = {"doc_ids": piece["doc_id"].to_pylist(), "doc_keys": piece["row_key"].to_pylist(), "doc_sigs": sigs, "doc_sizes": [len(s) for s in sets]}
            out.setdefault((sigs[0] or 0) % tasks if sigs else 0, {}).update(listed)
            rows_out = [{"bucket": b, **r} for b, r in out.items()]
            for i in range(0, len(rows_out), ARROW_MESSAGES // 4):
                yield pa.RecordBatch.from_pylist(rows_out[i : i + ARROW_MESSAGES // 4], schema=PARTS_ARROW)


def shared_columns(batches: Iterable[pa.RecordBatch], tasks: int) -> Iterator[pa.RecordBatch]:
    """From all parts of a range of columns: the columns that two documents have at least, a message for each task of rows. What else comes is passed on."""
    starts = edges_of(tasks)
    hashes, names, sizes, known = [], [], [], []
    for batch in batches:
        through = []
        for r in batch.to_pylist():
            if r["doc_ids"] is not None:
                through.append({k: r[k] for k in ("doc_ids", "doc_keys", "doc_sigs", "doc_sizes")})
            if r["names"] is not None:
                known.append(unpacked(r))
            if r["columns"] is not None:
                h = ascended(r["columns"], starts[r["bucket"]])
                o = np.frombuffer(r["owners"], np.uint16 if len(r["owners"]) == 2 * len(h) else np.uint32)
                hashes.append(h)
                names.append(np.append(np.frombuffer(r["owner_names"], np.int64), -1)[o])
                sizes.append(np.append(np.frombuffer(r["owner_sizes"], np.int32), 0)[o])
        yield pa.RecordBatch.from_pylist(through, schema=FOUND_ARROW)
    if hashes:
        h, name, size = np.concatenate(hashes), np.concatenate(names), np.concatenate(sizes)
        del hashes, names, sizes
        order = np.lexsort((name, h))
        h, name, size = h[order], name[order], size[order]
        several = name == -1
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (name[1:] != name[:-1])])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        owners = np.add.reduceat(new.astype(np.int64) + (new & several), first)
        shared = np.repeat(owners >= 2, np.diff(np.append(first, len(h)))) & new & ~several
        known.append((name[shared], size[shared], h[shared]))
    if known:
        for b, message in packed(*(np.concatenate(x) for x in zip(*known, strict=True)), tasks).items():
            yield pa.RecordBatch.from_pylist([{"bucket": b, **message}], schema=FOUND_ARROW)


def merged(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """One row for each document that has enough shared columns to reach the similarity with any other."""
    parts = [unpacked(r) for b in batches for r in b.to_pylist()]
    if not parts:
        return
    out = []
    for sig, n, h in grouped(*(np.concatenate(x) for x in zip(*parts, strict=True))):
        h = np.unique(h)
        if 100 * len(h) >= percent * n:
            out.append({"sig": sig, "n": n, "hashes": h.tobytes()})
    for i in range(0, len(out), 1000):
        yield pa.RecordBatch.from_pylist(out[i : i + 1000], schema=ABLE_ARROW)


def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            lists = [np.frombuffer(h, np.int64) for h in part["hashes"].to_pylist()]
            lengths = [len(x) for x in lists]
            yield pa.RecordBatch.from_pydict({"h": np.concatenate(lists), "sig": np.repeat(part["sig"].to_numpy(), lengths), "n": np.repeat(part["n"].to_numpy(), lengths)})


def overlaps(rows: list[np.ndarray], sizes: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a block are linked: their sparse product in strips of columns, with pairs discarded as soon as they can't be.

    Columns of few rows add to the pairs that they hold and to no others; columns of many rows are
    multiplied as strips. Rows of one class are known to be connected and aren't compared.
    """
    m = len(rows)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(m), [len(r) for r in rows])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    length = np.diff(np.append(first, len(flat)))
    # Columns that the same rows have are one column with a weight.
    names = mixed(np.arange(1, m + 1, dtype=np.uint64) * PRIME)
    pattern = np.add.reduceat(names[owner], first)
    pattern[length < 2] = 0
    kinds, which, weight = np.unique(pattern, return_index=True, return_counts=True)
    which, weight = which[kinds != 0], weight[kinds != 0]
    need = (percent * (sizes[:, None] + sizes[None, :]) + 99 + percent) // (100 + percent)
    possible = (100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])) & (classes[:, None] != classes[None, :])
    total = np.zeros((m, m), np.float32)
    for k in range(2, FEW + 1):
        cols = length[which] == k
        held, w = owner[first[which[cols]][:, None] + np.arange(k)], weight[cols]
        for x, y in combinations(range(k), 2):
            np.add.at(total, (held[:, x], held[:, y]), w)
            np.add.at(total, (held[:, y], held[:, x]), w)
    which, weight = which[length[which] > FEW], weight[length[which] > FEW]
    rest = np.zeros(m, np.int64)
    np.add.at(rest, owner[ranges(first[which], length[which])], np.repeat(weight, length[which]))
    possible &= total + np.minimum(rest[:, None], rest[None, :]) >= need
    for a in range(0, len(which), STRIP):
        live = np.flatnonzero(possible.any(1))
        if not len(live):
            break
        cols, w = which[a : a + STRIP], weight[a : a + STRIP]
        strip = np.zeros((m, len(cols)), np.float32)
        strip[owner[ranges(first[cols], length[cols])], np.repeat(np.arange(len(cols)), length[cols])] = 1
        rest -= (strip @ w.astype(np.float64)).astype(np.int64)
        part = strip[live]
        total[np.ix_(live, live)] += (part * w.astype(np.float32)) @ part.T
        possible &= total + np.minimum(rest[:, None], rest[None, :]) >= need
    return possible & (total >= need)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def linked(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> for each row of a block the first row that it is linked with by way of rows of the block."""

    def ends(sigs: list[int], sizes: list[int], classes: list[int], rows: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        if len(set(classes)) < 2:
            return
        link = overlaps(rows, np.array(sizes, np.int64), np.array(classes, np.int64), percent)
        label = np.arange(len(sigs))
        while True:
            low = np.minimum(label, np.where(link, label[None, :], len(sigs)).min(1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        for i in np.flatnonzero(label != np.arange(len(sigs))).tolist():
            yield sigs[i], sigs[label[i]]

    key, group = None, ([], [], [], [])
    for b in batches:
        out = []
        for r in b.to_pylist():
            if (now := (r["block"], r["i"], r["j"])) != key:
                out += ends(*group)
                key, group = now, ([], [], [], [])
            group[0].append(r["sig"])
            group[1].append(r["n"])
            group[2].append(r["class"])
            group[3].append(np.frombuffer(r["hashes"], np.uint64))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    last = list(ends(*group))
    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in last], pa.int64()), "b": pa.array([y for _, y in last], pa.int64())})


def products(rows: DataFrame, able: DataFrame, tasks: int, percent: int) -> DataFrame:
    """(a, b) links within each (block, i, j) of rows, each of which brings its columns along; written."""
    rows = rows.join(able, "sig").repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j", "sig")
    return stored(rows.mapInArrow(lambda it: trimmed(linked(it, percent)), "a long, b long"), "links", ARROW_SETS)


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, docs_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to, its own included) for every row of docs.

    docs: doc_id (long), text; other columns don't matter. Null, empty and blank texts have no shingles
    and link with nothing; repeated rows link with each other; a null doc_id counts for no component's
    smallest one; an empty table gives an empty one. Texts of any length are taken whole.
    """
    return row_classes(docs, F.lit(0), words, percent, chunk, docs_per_task).select("doc_id", "n_shingles", "component_id")


def row_classes(docs: DataFrame, row_key: Column, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, docs_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """As ngram_components, with row_key (long) as given and class, the group's own name, for rows with null or repeated ids; it is null without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key.cast("long").alias("row_key"))
    tasks = max(12, docs.count() // docs_per_task)
    parts = docs.mapInArrow(lambda it: trimmed(parts_of(it, tasks, words)), PARTS)
    found = stored(parts.repartitionById(tasks, "bucket").mapInArrow(lambda it: trimmed(shared_columns(it, tasks)), FOUND), "shared-columns", ARROW_MESSAGES)
    listed = found.where("doc_sizes is not null").select(F.inline(F.arrays_zip("doc_ids", "doc_keys", "doc_sigs", "doc_sizes"))).toDF("doc_id", "row_key", "sig", "n_shingles")
    able = found.where("names is not null").select("bucket", *ROWS).repartitionById(tasks, "bucket")
    able = stored(able.mapInArrow(lambda it: trimmed(merged(it, percent)), "sig long, n int, hashes binary"), "able-rows", ARROW_MESSAGES)

    columns = able.mapInArrow(exploded, "h long, sig long, n int")
    # What columns are joined with is written first: neither side is bound to tasks by its key then, and Spark can split a column of very many rows.
    often = stored(columns.groupBy("h").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1"), "shared-often", ARROW_SETS)
    ranked = columns.join(often, "h")
    by_sig = Window.partitionBy("sig")
    alone = F.col("n") - F.count(F.lit(1)).over(by_sig)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = ranked.withColumns({"place": F.row_number().over(by_sig.orderBy("owners", "h")), "alone": alone}).where(F.col("place") + F.col("alone") <= prefix).select("h", "sig")
    ranked = stored(ranked, "rare-columns", ARROW_SETS)
    discard(often)

    # First each column's rows are multiplied with the column's first row and with the rest of their own chunk: as many rows as the columns have.
    first = ranked.groupBy("h").agg(F.min("sig").alias("block"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h", "block")
    first = stored(first, "first-rows")
    members = stored(ranked.join(first, "h").where("sig <> block").select("block", "sig").distinct(), "blocks")
    large = members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")).where("chunks > 1")
    large = stored(large, "large-blocks")  # at most a row for each chunk of rows
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("sig"), chunks).cast("int")
    spread = members.join(large, "block", "left").select("block", "sig", mine.alias("i"))
    leads = members.select("block").distinct().join(large, "block", "left").select("block", F.col("block").alias("sig"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("i"))
    links = products(spread.unionByName(leads).withColumns({"j": F.col("i"), "class": F.col("sig")}), able, tasks, percent)
    classes = stored(connected_components(links), "classes")

    # What is left are columns of several chunks whose rows are not all connected by then: their chunks are multiplied with each other.
    made = [found, able, ranked, first, links, classes, members, large]
    groups = classes
    if not large.isEmpty():
        classed = ranked.join(first.join(large, "block"), "h").join(classes, F.col("sig") == F.col("node"), "left").select("h", "block", "chunks", "sig", F.coalesce("component", "sig").alias("class"))
        split = classed.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("h")
        apart = stored(classed.join(split, "h", "left_semi").select("block", "chunks", "sig", "class").distinct(), "split-blocks")
        met = apart.select("block", "sig", "class", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).where("mine <> other")
        more = products(met.select("block", "sig", "class", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")), able, tasks, percent)
        groups = connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        made += [apart, more]
    groups = groups.withColumnRenamed("node", "sig")
    named = listed.join(groups, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    smallest = named.where("sig is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = named.join(smallest, "component", "left").select("doc_id", "row_key", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("component").alias("class"))
    result = stored(result, "ngram-components")
    discard(*made)
    return result


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents") -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM {documents}),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_ngram_join": op4_ngram_join}
ORACLE_SQL: dict[str, str] = {"op4_ngram_join": oracle()}
