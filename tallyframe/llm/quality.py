"""Quality: a generalised additive model with pairwise interactions.

Each feature of a text is binned; a lookup table per feature is learned by boosting shallow trees
on it, one feature after the other in cycles, and then tables over pairs of features in the same
way. A score is the sum of the looked-up entries, added for whole batches at once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table

#: Labelled rows that the model learns from, at most, for each label; they are the first in the order of a hash of their id.
MAX_ROWS_PER_LABEL = 8000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 150, 40, 0.1, 5.0

FEATURES = (
    "log_bytes log_words mean_word spread_word upper lower digit space newline end_marks inner_marks symbols pipes non_ascii control "
    "distinct_words top_word distinct_lines longest_line short_lines compressed marked_words shouted_words distinct_pairs entropy"
).split()

CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".!?", b",;:'\"()-", b"#$%&*@^~+=<>_\\/[]{}`", b"|", bytes(range(128, 256)))):
    CLASSES[list(_chars)] = _k + 1


def features(text: str | None) -> list[float]:
    """The FEATURES of one whole text; of an empty or null one, zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(CLASSES, weights=chars, minlength=11) / n
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = [len(x) for x in lines] or [0]
    p = chars[chars > 0] / n
    marked = sum(c for w, c in seen.items() if len(w) > 2 and not w[-2:].isalnum() and w[-2] < 128 and not w[-2:-1].isalnum())
    shouted = sum(c for w, c in seen.items() if len(w) > 2 and w[:3].isupper())
    return [
        math.log1p(n), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), *share[[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0]].tolist(),
        len(seen) / m, max(seen.values(), default=0) / m, len(set(lines)) / max(1, len(lines)), math.log1p(max(sizes)), sum(x < 20 for x in sizes) / len(sizes),
        len(zlib.compress(raw, 1)) / n, marked / m, shouted / m, len(set(zip(words, words[1:], strict=False))) / m, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; pairs use coarser bins of the same features."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at quantiles of the distinct values' mass."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(column) else np.empty(0)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values for each bin from a tree of depth two over gradients and curvatures by bin."""
    values = np.zeros(len(g))
    spans = [(0, len(g))]
    for _ in range(2):
        nxt = []
        for a, b in spans:
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a < 2:
                nxt.append((a, b))
                continue
            at = int(np.argmax(gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]))) + 1
            nxt += [(a, a + at), (a + at, b)]
        spans = nxt
    for a, b in spans:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return values


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a grid into four quadrants: its gain and its values."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def four(c: np.ndarray) -> list[np.ndarray]:
        inner, right, below, whole = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [inner, right - inner, below - inner, whole - right - below + inner]

    sums = list(zip(four(cg), four(ch), strict=True))
    total = sum(gain(a, b) for a, b in sums)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    values = np.empty_like(g)
    for (a, b), (rows, cols) in zip(sums, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        values[rows, cols] = a[i, j] / (b[i, j] + SMOOTH)
    return float(total[i, j] - gain(g.sum(), h.sum())), values


def fit_additive(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> AdditiveModel:
    """Without rows of both labels the model is a constant: the label there is, or 0.5."""
    n, d = x.shape
    rate = float((w * y).sum() / w.sum()) if n else 0.5
    rate = min(0.99, max(0.01, rate))
    edges, coarse = ([cuts(x[:, j], b) for j in range(d)] for b in (BINS, PAIR_BINS))
    model = AdditiveModel(math.log(rate / (1 - rate)), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if n == 0 or len(np.unique(y)) < 2:
        return model
    fine = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)]
    wide = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(d)]
    z = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return w * (y - p), w * p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(fine[j], g, size), np.bincount(fine[j], h, size))
            model.tables[j] += step
            z += step[fine[j]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(wide[i] * shape[1] + wide[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(d), 2)))
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * quadrants(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            z += step[wide[i], wide[j]]
    return model


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS_PER_LABEL) -> AdditiveModel:
    """Learn from labelled rows that aren't held out, at most max_rows of each label; their features, not their texts, come to the driver.

    Of several texts of one id the least counts. Without labelled rows, or with one label alone, every score is what the fit of those rows gives.
    """
    known = labels.where(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max(label).alias("y"))
    truth = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["text"].to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "y": b["y"], "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    rows = rows.groupBy("doc_id", F.col("y").cast("int").alias("y")).agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    got = sorted(rows.mapInArrow(measure, "doc_id long, y int, x array<double>").collect())
    y = np.array([r.y for r in got], float)
    x = np.array([r.x for r in got], float).reshape(len(got), len(FEATURES))
    share = [truth.get(v, 0) / max(1, int((y == v).sum())) for v in (0, 1)]
    w = np.where(y == 1, share[1], share[0])
    return fit_additive(x, y, w * len(y) / max(1.0, float(w.sum())))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and quality (0 to 1) of every row.

    Null texts are empty ones; texts of any length are measured whole; repeated rows get equal scores;
    an empty table gives an empty one; other columns don't matter, whatever their names.
    """

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b["text"]], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "quality": pa.array(model.score(x), pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, quality double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
