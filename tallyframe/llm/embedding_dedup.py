"""Embedding near-dedup as a subspace pigeonhole join.

Unit vectors with cosine c are apart by 2 - 2c in squared distance. Rotated and split into blocks,
two vectors that near have at least one block whose part of the distance is within its share of the
whole budget, in proportion to its width. Rows are dealt to chunks of bounded size by their slabs
along the blocks' first axes. Two chunks meet unless all blocks' slabs are apart; there each block
is joined by range along its first axis. A pair counts only in the first block that has it, and is
verified by its cosine in double precision. Only counts and spanning edges leave a task, never pairs.
Pairs of chunks are worked off in passes, each of which shuffles a bounded multiple of the vectors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table, trimmed
from .components import connected_components

COSINE = 0.9
BLOCKS = 4
#: Rows of a chunk of 64 dimensions at most, fewer of more; a task has two chunks at a time. Small tables get CHUNKS chunks of LEAST rows or more, so that many tasks have work.
CHUNK, TILE, PAIRS_AT_ONCE = 32768, 1024, 1 << 16
CHUNKS, LEAST = 16, 256
#: Cells of so many chunks are dealt together, by hash.
DEALT = 4
#: Slabs along an axis, and axes that cells are made of: a grid of 4,096 cells at most for each number of dimensions.
SLABS, AXES = 8, 4
#: What a pass shuffles: so many times all vectors, or so many bytes if that is more.
TIMES, PASS_BYTES = 1.5, 256 << 20
#: Bytes of a row beside its vector.
ROW_BYTES = 64
#: Room for rounding: relative in double precision, absolute for the single precision in which candidates are looked for.
DOUBLE_SLACK, SINGLE_SLACK = 1e-9, 1e-4


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, blocks: int) -> list[np.ndarray]:
    return [b for b in np.array_split(np.arange(dim), blocks) if len(b)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    kind = np.float32 if len(packed[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(packed), kind).reshape(-1, dim).astype(np.float64)


def reach_of(dim: int, axes: np.ndarray, cosine: float) -> float:
    """How far apart two linked vectors can be along one axis of a block that has them."""
    return np.sqrt((2 - 2 * cosine) * len(axes) / dim) * (1 + 1e-6)


PLACED = "dim int, cell int, node long, weight long, vector binary"


def placed(batches: Iterable[pa.RecordBatch], cosine: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """Each vector with its cell: its slabs along the first axes of the first blocks, as the digits of a number."""
    for batch in batches:
        lengths = np.array([len(v) for v in batch["embedding"]])
        for dim in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == dim))
            x = part["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            y = unit(x.astype(np.float64)) @ rotation(dim)
            cell = np.zeros(len(x), np.int32)
            for axes in blocks_of(dim, blocks)[:AXES]:
                width = max(reach_of(dim, axes, cosine), 2 / SLABS)
                cell = cell * SLABS + np.clip(np.floor(y[:, axes[0]] / width) + SLABS // 2, 0, SLABS - 1).astype(np.int32)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(len(x), dim, np.int32)), "cell": pa.array(cell), "node": part["node"], "weight": part["weight"], "vector": packed})


def dealt(cells: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[dict]]:
    """(dim, cell, rows) -> each cell's first chunk and number of chunks, over which a hash deals its rows; and of each chunk its dim, rows and slabs."""
    total: dict[int, int] = defaultdict(int)
    for dim, _, n in cells:
        total[dim] += n
    places, chunks, group, rows = [], [], [], 0
    for (dim, cell, n), (later, _, _) in pairwise([*sorted(cells), (-1, 0, 0)]):
        size = max(1, min(CHUNK, CHUNK * 64 // dim, max(LEAST, -(-total[dim] // CHUNKS))))
        group, rows = [*group, cell], rows + n
        if rows >= DEALT * size or later != dim:
            k = -(-rows // size)
            places += [(dim, c, len(chunks), k) for c in group]
            digits = np.array([[c // SLABS**a % SLABS for a in range(AXES)] for c in group])
            chunks += [{"dim": dim, "rows": -(-rows // k), "low": digits.min(0), "high": digits.max(0)}] * k
            group, rows = [], 0
    return places, chunks


def meetings(chunks: list[dict], blocks: int) -> Iterator[tuple[int, int]]:
    """Pairs of chunks that may have linked rows, each chunk as often as any other among those that come one after another."""
    for far in range(len(chunks)):
        for i in range(len(chunks) - far):
            a, b = chunks[i], chunks[i + far]
            axes = min(blocks, a["dim"])
            apart = np.maximum(b["low"] - a["high"], a["low"] - b["high"])[: min(axes, AXES)] > 1
            if a["dim"] == b["dim"] and not (axes <= AXES and apart.all()):
                yield i, i + far


def passes(chunks: list[dict], blocks: int, item: int) -> Iterator[list[tuple[int, int]]]:
    """Pairs of chunks, as many at a time as a pass may shuffle."""
    size = [c["rows"] * (c["dim"] * item + ROW_BYTES) for c in chunks]
    room = max(PASS_BYTES, TIMES * sum(size))
    some, used = [], 0
    for i, j in meetings(chunks, blocks):
        n = size[i] + (size[j] if i != j else 0)
        if some and used + n > room:
            yield some
            some, used = [], 0
        some.append((i, j))
        used += n
    if some:
        yield some


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Put the sets of each i and j together under the smallest root."""
    while True:
        parent = roots(parent)
        a, b = parent[i], parent[j]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def tiles(rows: np.ndarray, cols: np.ndarray, along: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of pieces of rows and columns, both in order along an axis, that are within reach; of the same rows each pair of pieces once."""
    for a in range(0, len(rows), TILE):
        r = rows[a : a + TILE]
        for b in range(a if rows is cols else 0, len(cols), TILE):
            c = cols[b : b + TILE]
            if along[c[0]] - along[r[-1]] > reach:
                break
            if along[r[0]] - along[c[-1]] <= reach:
                yield r, c


def joined(x: np.ndarray, some: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, cosine: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (weighted) and its set's root, among the pairs of left and right rows that count in this block. Only some rows take part."""
    dim = x.shape[1]
    axes = blocks_of(dim, blocks)
    budget = [(2 - 2 * cosine) * len(a) / dim * (1 + DOUBLE_SLACK) for a in axes]
    u = unit(x)
    y = u @ rotation(dim)
    # One matrix product gives squared distances: the cross term, and either norm times one.
    z = y[:, axes[block]]
    square, one = (z * z).sum(1, keepdims=True), np.ones((len(x), 1))
    ours, theirs = np.hstack([-2 * z, square, one]).astype(np.float32), np.hstack([z, one, square]).astype(np.float32)
    links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
    ordered = lambda side: (kept := side[some[side]])[np.argsort(z[kept, 0], kind="stable")]
    a = ordered(left)
    b = a if left is right else ordered(right)
    for rows, cols in tiles(a, b, z[:, 0], reach_of(dim, axes[block], cosine)):
        near = ours[rows] @ theirs[cols].T <= budget[block] + SINGLE_SLACK
        i, j = np.divmod(np.flatnonzero(near), len(cols))
        if rows[0] == cols[0]:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), PAIRS_AT_ONCE):
            p, q = rows[i[s : s + PAIRS_AT_ONCE]], cols[j[s : s + PAIRS_AT_ONCE]]
            gaps = (y[p] - y[q]) ** 2
            fits = np.stack([gaps[:, k].sum(1) <= m for k, m in zip(axes, budget, strict=True)])
            good = fits[block] & ~fits[:block].any(0) & ((u[p] * u[q]).sum(1) >= cosine)
            p, q = p[good], q[good]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            parent = unite(parent, p, q)
    return links, roots(parent)


FOUND = "node long, links long, root long"
#: Sides of a row in its pair of chunks: the pair is of one chunk, or the row is of the first or of the second.
BOTH, LEFT, RIGHT = 0, 1, 2


def links_of(batches: Iterable[pa.RecordBatch], cosine: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair of chunks -> node, links, root."""

    def ended(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        dim = rows["dim"][0].as_py()
        x = unpacked(rows["vector"].to_pylist(), dim)
        side, node, weight = (rows[c].to_numpy() for c in ("side", "node", "weight"))
        left = np.flatnonzero(side != RIGHT)
        right = left if side[0] == BOTH else np.flatnonzero(side == RIGHT)
        links, parent, everyone = np.zeros(len(x), np.int64), np.arange(len(x)), np.ones(len(x), bool)
        for block in range(len(blocks_of(dim, blocks))):
            more, root = joined(x, everyone, weight, left, right, block, cosine, blocks)
            links += more
            parent = unite(parent, np.arange(len(x)), root)
        some = links > 0
        return pa.RecordBatch.from_pydict({"node": node[some], "links": links[some], "root": node[roots(parent)[some]]})

    key, parts = None, []
    for batch in batches:
        pair = batch["pair"].to_numpy()
        for start, end in pairwise([0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]):
            if start == end:
                continue
            if pair[start] != key:
                if parts:
                    yield ended(parts)
                key, parts = pair[start], []
            parts.append(batch.slice(start, end - start))
    if parts:
        yield ended(parts)


def embedding_components(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors.

    vectors: vec_id (long), embedding (array of float or double); other columns don't matter. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, and neither do
    vectors of different length. Equal vectors are one node with a weight, so a group of copies of any
    size costs as much as one. Repeated rows link with each other; a null vec_id counts for no
    component's smallest one; an empty table gives an empty one.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.xxhash64(v)).alias("node"), F.when(good, v).alias("embedding"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    nodes = stored(nodes.mapInArrow(lambda it: placed(it, cosine, blocks), PLACED), "vectors")
    spark = vectors.sparkSession
    places, chunks = dealt([tuple(r) for r in nodes.groupBy("dim", "cell").count().collect()])
    of_cell = F.broadcast(spark.createDataFrame(places, "dim int, cell int, first int, chunks int"))
    chunk = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int")
    in_chunks = nodes.join(of_cell, ["dim", "cell"]).select("dim", "node", "weight", "vector", chunk.alias("chunk"))
    done = []
    for pairs in passes(chunks, blocks, 4 if kind == "array<float>" else 8):
        sides = [(c, k, side) for k, (i, j) in enumerate(pairs) for c, side in ([(i, BOTH)] if i == j else [(i, LEFT), (j, RIGHT)])]
        tasks = in_chunks.join(F.broadcast(spark.createDataFrame(sides, "chunk int, pair int, side int")), "chunk").drop("chunk")
        tasks = tasks.repartitionById(len(pairs), F.col("pair")).sortWithinPartitions("pair")
        done.append(stored(tasks.mapInArrow(lambda it: trimmed(links_of(it, cosine, blocks)), FOUND), "vector-links"))
    found = spark.read.schema(FOUND).parquet(*[df.stored_path for df in done]) if done else spark.createDataFrame([], FOUND)
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "weight").join(counts, "node", "left").join(classes, "node", "left").select("node", "weight", "links", F.coalesce("component", "node").alias("component"))
    named = rows.select("vec_id", "node").join(known, "node", "left")
    smallest = named.where("node is not null").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(smallest, "component", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    result = stored(named.select("vec_id", links.cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")), "vector-components")
    discard(nodes, *done)
    return result


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def oracle(embeddings: str = "embeddings") -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))
                      THEN embedding::DOUBLE[] END AS x FROM {embeddings}),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_embedding_dedup": op5_embedding_dedup}
ORACLE_SQL: dict[str, str] = {"op5_embedding_dedup": oracle()}
