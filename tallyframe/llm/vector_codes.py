"""Vector code compression: product codes whose codebooks are learned by Lloyd's rounds with Hamerly's bounds.

Vectors are cut into parts, and each part position has a codebook of its own. The first assignment
scans the whole codebook and keeps, for each part, an upper bound on the distance to its entry and a
lower bound on the distance to the second nearest. A round moves the entries, so the bounds move by at
most that much; a later assignment scans a part in full only if its upper bound isn't strictly below
the lower one or half its entry's distance to the next entry. Where bounds settle a part, its entry is
strictly nearer than all others, so ties go to the lower index as in a full scan. Distances are
integers, and bounds are rounded outwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table, trimmed
from .whitening import finite

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are floor(SCALE * x); beyond the bound they count as it, so that a part's squared distance stays a long.
SCALE, BOUND = 256, 1 << 26
#: Parts that are scanned at once.
SCANNED_AT_ONCE = 1 << 15


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim and x, the integers of every vector that is there and finite."""
    v = F.col("embedding").cast("array<double>")
    held = lambda e: F.greatest(F.lit(-BOUND).cast("double"), F.least(F.lit(BOUND).cast("double"), F.floor(e * SCALE).cast("double")))
    rows = vectors.select("vec_id", "label", v.alias("v")).where(finite(F.col("v")))
    return rows.select("vec_id", "label", F.size("v").alias("dim"), F.transform("v", lambda e: held(e).cast("int")).alias("x"))


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of equal width; where the length can't be divided, the first ones are wider by one."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(dim), parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, as exact integers."""
    out = np.zeros((len(rows), len(book)), np.int64)
    for k in range(rows.shape[1]):
        out += np.square(rows[:, k, None] - book[None, :, k])
    return out


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf))


class Codebook:
    """One part position's entries, with half of each one's distance to the nearest other and how far each has moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None) -> None:
        self.entries = entries
        apart = distances(entries, entries).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = below(np.sqrt(apart.min(1)) / 2)
        self.moved = above(np.sqrt(np.square(entries - (entries if before is None else before)).sum(1)))
        if before is None:
            self.moved = np.zeros_like(self.moved)
        # The entry that moved farthest, and how far the others did at most: a part's own entry takes no part in its lower bound.
        order = np.argsort(-self.moved, kind="stable")
        self.farthest, self.most = int(order[0]), self.moved[order[0]]
        self.next_most = self.moved[order[1]] if len(order) > 1 else np.float32(0)

    def assign(self, rows: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry of each row, its bounds, and how many rows were scanned in full; without an earlier code all are."""
        if code is None:
            code, upper, lower = np.zeros(len(rows), np.uint8), np.full(len(rows), np.inf, np.float32), np.full(len(rows), -np.inf, np.float32)
        else:
            code = code.copy()
            upper = above(upper + self.moved[code])
            lower = below(lower - np.where(code == self.farthest, self.next_most, self.most))
        open_ = np.flatnonzero(~(upper < np.maximum(lower, self.half[code])))
        if len(open_) and np.isfinite(upper[open_]).any():  # the exact distance may do
            upper[open_] = above(np.sqrt(np.square(rows[open_] - self.entries[code[open_]]).sum(1)))
            open_ = open_[~(upper[open_] < np.maximum(lower[open_], self.half[code[open_]]))]
        for s in range(0, len(open_), SCANNED_AT_ONCE):
            at = open_[s : s + SCANNED_AT_ONCE]
            d = distances(rows[at], self.entries)
            code[at] = d.argmin(1)  # the lowest of several
            two = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else np.hstack([d, np.full((len(d), 1), np.iinfo(np.int64).max)])
            upper[at], lower[at] = above(np.sqrt(two[:, 0])), below(np.sqrt(two[:, 1]))
        return code, upper, lower, len(open_)


def matrix(b: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
    """A column of packed rows, or of lists, as a matrix."""
    column = b[name]
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, width)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(b.num_rows, width)


def packed(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())


STATE = "code binary, upper binary, lower binary, error decimal(38,0), scanned int"


def assigned(rows: DataFrame, dim: int, books: list[Codebook]) -> DataFrame:
    """vec_id, label, x, and the state after an assignment: code, bounds, error and how many parts were scanned in full. Rows that have a state begin with it."""
    parts, resumed = cuts(dim, len(books)), "code" in rows.columns

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x = b.num_rows, matrix(b, "x", dim, np.int64)
            if not n:
                continue
            code, scanned = np.empty((n, len(books)), np.uint8), np.zeros(n, np.int32)
            upper, lower = np.empty((n, len(books)), np.float32), np.empty((n, len(books)), np.float32)
            error = np.zeros(n, np.int64)
            had = [matrix(b, c, len(books), k) for c, k in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32))] if resumed else None
            for p, (cut, book) in enumerate(zip(parts, books, strict=True)):
                state = [m[:, p] for m in had] if had else [None] * 3
                code[:, p], upper[:, p], lower[:, p], full = book.assign(x[:, cut], *state)
                scanned[0] += full
                error += np.square(x[:, cut] - book.entries[code[:, p]]).sum(1)
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], b["label"], b["x"], packed(code), packed(upper), packed(lower), pa.array(error).cast(pa.decimal128(38, 0)), pa.array(scanned)],
                names=["vec_id", "label", "x", "code", "upper", "lower", "error", "scanned"],
            )

    kinds = dict(rows.dtypes)
    return rows.drop("dim", "error", "scanned").mapInArrow(lambda it: trimmed(of(it)), f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<int>, {STATE}")


def first_entries(rows: DataFrame, dim: int, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, which the codebooks begin with; null ids come last, equal ids by their vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return np.array([r.x for r in first], np.int64).reshape(len(first), dim)


def moved(rows: DataFrame, dim: int, books: list[Codebook]) -> list[Codebook]:
    """Each entry replaced by its parts' mean, rounded down component by component; an entry without parts stays."""
    parts = cuts(dim, len(books))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(k.entries), np.int64) for k in books]
        sums = [np.zeros(k.entries.shape, np.int64) for k in books]
        for b in batches:
            if b.num_rows:
                x, code = matrix(b, "x", dim, np.int64), matrix(b, "code", len(books), np.uint8)
                for p, cut in enumerate(parts):
                    counts[p] += np.bincount(code[:, p], minlength=len(counts[p]))
                    np.add.at(sums[p], code[:, p], x[:, cut])
        for p, (n, s) in enumerate(zip(counts, sums, strict=True)):
            used = np.flatnonzero(n)
            flat = np.hstack([n[used, None], s[used]])  # the count stands first
            where = np.repeat(used, flat.shape[1]).astype(np.int32)
            place = np.tile(np.arange(flat.shape[1], dtype=np.int32), len(used))
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(flat.size, p, np.int32)), "entry": pa.array(where), "place": pa.array(place), "v": pa.array(flat.ravel())})

    sums = rows.select("x", "code").mapInArrow(lambda it: trimmed(of(it)), "part int, entry int, place int, v long")
    total: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # a codebook's size, whatever the input's
        total.setdefault((r.part, r.entry), {})[r.place] = int(r.v)
    after = []
    for p, book in enumerate(books):
        entries = book.entries.copy()
        for k in range(len(entries)):
            if found := total.get((p, k)):
                entries[k] = [found[1 + j] // found[0] for j in range(entries.shape[1])]
        after.append(Codebook(entries, book.entries))
    return after


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def learn_codes(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """The rows with their final state, stored, and the codebooks."""
    first = first_entries(rows, dim, entries)
    books = [Codebook(first[:, cut]) for cut in cuts(dim, parts)]
    state = stored(assigned(rows, dim, books), "codes")
    for _ in range(rounds):
        books = moved(state, dim, books)
        before, state = state, stored(assigned(state, dim, books), "codes")
        discard(before)
    return state, books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector.

    vectors: vec_id, embedding (array of float or double), label (any type that can be grouped); other
    columns don't matter, whatever their names. Vectors that are null or hold null or non-finite
    components are dropped. Vectors of each length have codebooks of their own; a length that can't be
    divided has its first parts wider by one, and a part of no width has code 0 and no error, as has an
    empty vector. With fewer vectors than entries the codebooks are that small. Repeated rows and null
    vec_ids count and are returned like others; null labels are one label, whose errors add up over all
    lengths, as other labels' do. Components beyond 2**26 count as that. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors)
    kinds = dict(rows.dtypes)
    kept = stored(rows, "kept-vectors")
    found, stores = spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error decimal(38,0), codebooks_sha256 string"), [kept]
    for (dim,) in kept.groupBy("dim").count().select("dim").orderBy("dim").collect():
        state, books = learn_codes(kept.where(F.col("dim") == dim), dim, parts, entries, rounds)
        stores.append(state)
        found = found.unionByName(state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", F.lit(digest(books)).alias("codebooks_sha256")))
    sums = stored(found.groupBy(F.col("label").alias("sum_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    named = found.join(sums, F.col("label").eqNullSafe(F.col("sum_label")))
    result = stored(named.select("vec_id", "code", "error", "label_error", "codebooks_sha256"), "vector-codes")
    discard(*stores, sums)
    return result


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"))
    return found.withColumns({c: F.expr(f"try_cast({c} as bigint)") for c in ("error", "label_error")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_vector_codes": op13_vector_codes}
ORACLE_SQL: dict[str, str] = {}
