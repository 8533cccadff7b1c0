"""Embedding whitening by a matrix-free block Lanczos iteration.

The covariance of the integer vectors is never built. A pass over the stored vectors multiplies it
with a block of a few columns: each task centres its rows exactly, multiplies them with the block and
their transpose with the product, and Spark adds up the tasks' sums. Each new block is orthogonalised
against all earlier ones, twice; directions in which nothing is left (a breakdown) go on from new
random ones. The iteration ends when the wanted pairs' residuals, which earlier products give without
another pass, are at rounding level and a block that begins anew doesn't change them, or when the
basis spans the whole space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table, trimmed

COMPONENTS = 8
#: x = floor(SCALE * c) + SHIFT; entries beyond the bound count as it, so that n * x stays a long.
SCALE, SHIFT, BOUND = 1024, 100_000, 1 << 28
#: Columns of a block.
BLOCK = 8
#: Residuals, relative to the largest eigenvalue, at which a pair counts as converged.
CONVERGED = 1e-15
#: Eigenvalues below this share of the largest one are rounding: the vectors have no such direction.
NO_VARIANCE = 1e-12
#: Length, relative to the largest eigenvalue, under which what is left of a new direction is nothing.
BREAKDOWN = 1e-12

SUMS = "i int, v double"


def finite(v: Column) -> Column:
    """Whether a vector is there, and all of its entries are there and finite."""
    return F.coalesce(~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False))


def fit_list(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x, the integers of every vector that is there and finite."""
    v = F.col("embedding").cast("array<double>")
    held = lambda e: F.greatest(F.lit(-BOUND).cast("double"), F.least(F.lit(BOUND).cast("double"), F.floor(e * SCALE).cast("double")))
    x = F.transform("v", lambda e: held(e).cast("long") + SHIFT)
    rows = vectors.select(F.col("vec_id"), v.alias("v")).where(finite(F.col("v")))
    return rows.select("vec_id", F.size("v").alias("dim"), x.alias("x"))


def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch that has rows, and its integers as a matrix."""
    for b in batches:
        if b.num_rows:
            yield b, b["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)


def added_up(rows: DataFrame, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what `each` gives for a batch, an array of this shape; a task sends one array, and Spark adds them up."""

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in matrices(batches):
            total += each(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total.size, dtype=np.int32)), "v": pa.array(total.ravel())})

    out = np.zeros(int(np.prod(shape)))
    for r in rows.select("x").mapInArrow(lambda it: trimmed(of_task(it)), SUMS).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out.reshape(shape)


class Centred:
    """n, the exact sums S of x, and the rows' deviations (n * x - S) / n, whose numerators are exact."""

    def __init__(self, rows: DataFrame, dim: int) -> None:
        def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dim + 1, np.int64)  # the last one counts the rows
            for _, x in matrices(batches):
                total += np.append(x.sum(0), len(x))
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dim + 1, dtype=np.int32)), "v": pa.array(total)})

        self.rows, self.dim, self.sums = rows, dim, np.zeros(dim + 1, np.int64)
        for r in rows.select("x").mapInArrow(lambda it: trimmed(of_task(it)), "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
            self.sums[r.i] = r.v
        self.n, self.sums, self.trace = int(self.sums[-1]), self.sums[:-1], 0.0

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block, by one pass, which gives the trace as well: the deviations' squares."""
        n, sums = self.n, self.sums

        def each(x: np.ndarray) -> np.ndarray:
            d = (n * x - sums) / n
            squares = np.zeros((1, block.shape[1]))
            squares[0, 0] = np.square(d).sum()
            return np.vstack([d.T @ (d @ block), squares])

        found = added_up(self.rows, each, (self.dim + 1, block.shape[1])) / n
        self.trace = float(found[-1, 0])
        return found[:-1]


def orthonormal(block: np.ndarray, basis: np.ndarray, least: float, random: np.random.Generator) -> np.ndarray:
    """A basis of what the block adds to an orthonormal basis, filled up with random directions where that is less than its columns, as far as the space has any."""
    dim, columns = block.shape
    new = np.empty((dim, 0))
    for v in block.T:
        for renewed in range(9):
            before = np.hstack([basis, new])
            for _ in range(2):  # once more, as the first time leaves what rounding has left
                v = v - before @ (before.T @ v)
            if np.linalg.norm(v) > (1e-3 if renewed else least):
                new = np.hstack([new, (v / np.linalg.norm(v))[:, None]])
                v = new[:, -1] - before @ (before.T @ new[:, -1])
                new[:, -1] = v / np.linalg.norm(v)
                break
            if basis.shape[1] + new.shape[1] >= dim:
                return new
            v = random.standard_normal(dim) / np.sqrt(dim)
    return new


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues of a symmetric matrix that is known by its products, falling; their unit eigenvectors as columns; the passes it took."""
    random = np.random.default_rng(dim)
    basis, images = np.empty((dim, 0)), np.empty((dim, 0))
    new = orthonormal(random.standard_normal((dim, min(block, dim))), basis, 0.0, random)
    passes, known, probed = 0, None, False
    while True:
        image = product(new)
        passes += 1
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        projected = basis.T @ images
        values, inner = np.linalg.eigh((projected + projected.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        vectors = basis @ inner
        scale = max(float(values[0]), np.finfo(float).tiny)
        residuals = np.linalg.norm(images @ inner - vectors * values, axis=0)
        converged = basis.shape[1] >= wanted and residuals.max() <= CONVERGED * scale
        # A block that began at random shows whether the space has more of these values than an invariant part of it.
        if basis.shape[1] >= dim or converged and probed and np.abs(values - known).max() <= BREAKDOWN * scale:
            return values, vectors, passes
        known, probed = values, converged
        new = orthonormal(random.standard_normal((dim, block)) / np.sqrt(dim) if converged else image, basis, BREAKDOWN * scale, random)


class Whitening:
    """What was learned from a fit list: n, sums, the trace, and the components with their eigenvalues."""

    def __init__(self, rows: DataFrame, dim: int, components: int) -> None:
        self.centred = Centred(rows, dim)
        values, vectors, self.passes = block_lanczos(self.centred.product, dim, min(components, dim))
        self.trace = self.centred.trace
        some = values > NO_VARIANCE * max(values[0], 0)
        # Either sign is right; the entry of largest size is positive, so that reruns agree.
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        self.values, self.vectors = values[some], (vectors * sign)[:, some]
        self.identity_error = self._identity_error() if len(self.values) else None

    def _identity_error(self) -> float:
        """How far the whitened vectors' covariance, centred on their own mean, is from the identity."""
        n, sums, scaled = self.centred.n, self.centred.sums, self.vectors / np.sqrt(self.values)

        def each(x: np.ndarray) -> np.ndarray:
            w = (n * x - sums) / n @ scaled
            return np.vstack([w.T @ w, w.sum(0)])

        k = len(self.values)
        found = added_up(self.centred.rows, each, (k + 1, k)) / n
        return float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(k)).max())


def exact_squares(d: np.ndarray) -> pa.Array:
    """The sum of squares of each row of longs, as decimals of 38 digits; null beyond them."""
    if (np.square(d.astype(np.float64)).sum(1) < 2.0**62).all():
        return pa.array(np.square(d).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
    sums = [int(s) for s in np.square(d.astype(object)).sum(1)]
    return pa.array([s if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each vector and component.

    vectors: vec_id, embedding (array of float or double); other columns don't matter, whatever their
    names. Vectors that are null or hold null or non-finite entries are dropped. Vectors of each length
    are a fit list of their own, since vectors of different length have no common covariance. A direction
    without variance has no whitened value: there are as many components as the vectors' rank where that
    is less than asked for, so equal vectors, a single one, empty ones and an empty table give no rows.
    Repeated rows and null vec_ids count and are returned like others. deviation is null beyond 38
    digits; entries beyond 2**31 times the scale's step count as that.
    """
    spark = vectors.sparkSession
    rows = fit_list(vectors)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    kept = stored(rows, "fit-list")
    parts = []
    for (dim,) in kept.where("dim > 0").groupBy("dim").count().select("dim").orderBy("dim").collect():
        model = Whitening(kept.where(F.col("dim") == dim), dim, components)
        if len(model.values):
            parts.append(_whitened(model, schema))
    result = stored(_union(parts) if parts else spark.createDataFrame([], schema), "whitened")
    discard(kept)
    return result


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _whitened(model: Whitening, schema: str) -> DataFrame:
    rows, k, n = model.centred.rows, len(model.values), model.centred.n
    values, vectors, sums, trace, error = model.values, model.vectors, model.centred.sums, model.trace, model.identity_error

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches):
            d = n * x - sums
            w = (d / n) @ vectors / np.sqrt(values)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b["vec_id"].take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    exact_squares(d).take(at),
                    pa.array(w.ravel()),
                    pa.array(np.tile(values / trace, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(lambda it: trimmed(of(it)), schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_whitening": op11_whitening}
ORACLE_SQL: dict[str, str] = {}
