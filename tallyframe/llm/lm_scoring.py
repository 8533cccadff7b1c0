"""LM scoring with sharded Elias-Fano n-gram tries.

Texts are encoded slice by slice. Each slice sends its distinct bigrams, with their counts in
training texts, to the shards that own their contexts (or parts of hot contexts' successors); a shard builds its trie from what all slices
send and answers each slice's queries in order. No machine ever holds the model or the vocabulary.

A trie has two levels in one memory-mapped buffer. The first has the contexts with their counts,
the second all contexts' successors, as one monotone sequence of (context's rank, successor): its
Elias-Fano upper bits are the ranks in unary, so that they are the pointers between the levels, and
its lower bits are the successors, among which a query searches relative to its context. Each
successor has a quantised, absolutely discounted probability; what is discounted goes to the
unigrams, whose probabilities are the base's.
"""

from __future__ import annotations

import math
import mmap
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, space_words, stored, table, text_slices, trimmed

DISCOUNT = 0.75
ADDED = 0.1
#: Text of a slice and documents for each shard, about.
SLICE_BYTES, DOCS_PER_SHARD = 5 << 18, 1000
#: Messages that go to Python together.
ARROW_MESSAGES = 500
#: Texts in which hot contexts are looked for, about. They only tell which contexts to split over shards; no result depends on them.
HOT_SAMPLE = 4000
#: Bits of a successor's hash; within one context, that many tell its successors apart.
WORD_BITS = 40
#: Steps of a halving of a quantised probability, and bigrams that are looked up together.
STEPS, LOOKUPS = 2048, 1 << 17
#: Hashes of the start before a text's first token and of the end after its last: no word has white space.
START, END = (xxhash.xxh3_64_intdigest(x) for x in (b" start", b" end"))


#: Bytes of a block of the unary bits; for each byte, how many zeros it has and where each of them is, from the highest bit on.
BLOCK = 16
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
ZEROS_IN = (8 - BITS.sum(1)).astype(np.uint8)
ZERO_AT = np.argsort(BITS, axis=1, kind="stable")


class EliasFano:
    """A monotone sequence of integers: `low` bits of each as bytes, the rest in unary."""

    def __init__(self, n: int, buckets: int, low_bits: int, memory: memoryview) -> None:
        """The sequence that lies in memory; build() writes one there."""
        self.n, self.buckets = n, buckets
        a, b, c = self.sizes(n, buckets, low_bits)
        self.zeros = np.frombuffer(memory, np.int64, c // 8, 0)
        self.lows = np.frombuffer(memory, np.uint8, a, c).reshape(n, low_bits // 8)
        self.highs = np.frombuffer(memory, np.uint8, b, c + a)

    @staticmethod
    def sizes(n: int, buckets: int, low_bits: int) -> tuple[int, int, int]:
        """Bytes of the lower and the upper part, and of the directory into the upper one: for each block, the zeros before it."""
        high = (n + buckets + 7) // 8
        return n * (low_bits // 8), high, 8 * max(1, -(-high // BLOCK))

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, buckets: int, low_bits: int, into: memoryview) -> EliasFano:
        n = len(high)
        self = cls(n, buckets, low_bits, into)
        self.lows[:] = np.ascontiguousarray(low.astype("<u8")).view(np.uint8).reshape(n, 8)[:, : low_bits // 8]
        bits = np.zeros(n + buckets, np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        self.highs[:] = np.packbits(bits)
        sums = np.concatenate([[0], np.cumsum(ZEROS_IN[self.highs], dtype=np.int64)])
        self.zeros[:] = sums[:-1][::BLOCK] if len(self.highs) else 0
        return self

    def begins(self, k: np.ndarray) -> np.ndarray:
        """Where the buckets of these numbers begin, found in the unary bits: bucket k begins behind the k-th zero, which has k zeros up to it."""
        block = np.searchsorted(self.zeros, k, "left") - 1  # zeros before each block of bytes
        left = np.where(k > 0, k - self.zeros[np.maximum(block, 0)], 0)
        at = np.maximum(block, 0) * BLOCK
        # The byte that has the zero, then the bit in it.
        wide = np.minimum(at[:, None] + np.arange(BLOCK), len(self.highs) - 1)
        before = np.cumsum(ZEROS_IN[self.highs[wide]], 1, dtype=np.int32)
        byte = np.minimum((before < left[:, None]).sum(1), BLOCK - 1)
        row = np.arange(len(k))
        left = left - np.where(byte > 0, before[row, byte - 1], 0)
        bit = ZERO_AT[self.highs[np.minimum(at + byte, len(self.highs) - 1)], np.maximum(left - 1, 0)]
        return np.where(k > 0, (at + byte) * 8 + bit + 1 - k, 0)

    def low(self, at: np.ndarray) -> np.ndarray:
        """The lower parts at these places."""
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, : self.lows.shape[1]] = self.lows[at]
        return wide.view("<u8").ravel()


class Trie:
    """Contexts (hash, count, number of successors) and their successors (hash, quantised probability)."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, rank: np.ndarray, words: np.ndarray, times: np.ndarray) -> None:
        """rank, words, times: a training bigram's context's rank, its word's hash and its count, sorted and distinct."""
        n, c = len(rank), len(contexts)
        behind = 16 + c * 16 + -(-n // 4) * 8
        self._levels(mmap.mmap(-1, behind + sum(EliasFano.sizes(n, c, WORD_BITS))), n, c)
        self.contexts[:], self.counts[:] = contexts, counts
        self.codes[:] = quantised((times - DISCOUNT) / counts[rank]) if n else 0
        self.successors = EliasFano.build(rank, words, c, WORD_BITS, memoryview(self.buffer)[behind:])

    def _levels(self, buffer: mmap.mmap, n: int, c: int) -> None:
        """Lay the levels over a buffer: two sizes, contexts, counts, codes, and the successors' sequence."""
        self.buffer = buffer
        view = memoryview(buffer)
        np.frombuffer(view, np.int64, 2, 0)[:] = n, c
        self.contexts = np.frombuffer(view, np.uint64, c, 16)
        self.counts = np.frombuffer(view, np.int64, c, 16 + c * 8)
        self.codes = np.frombuffer(view, np.uint16, n, 16 + c * 16)

    @classmethod
    def open(cls, path: str) -> Trie:
        """Map a file that save() wrote; pages are read as queries need them."""
        self = cls.__new__(cls)
        with open(path, "r+b") as f:
            buffer = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_COPY)
        n, c = np.frombuffer(buffer, np.int64, 2).tolist()
        self._levels(buffer, n, c)
        self.successors = EliasFano(n, c, WORD_BITS, memoryview(buffer)[16 + c * 16 + -(-n // 4) * 8 :])
        return self

    def lookup(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each bigram (context's rank, word's hash), 0 if there is none: a search among the context's successors, as they are encoded, for all at once."""
        out = np.zeros(len(rank), np.uint16)
        for a in range(0, len(rank) if self.successors.n else 0, LOOKUPS):
            out[a : a + LOOKUPS] = self._search(rank[a : a + LOOKUPS], words[a : a + LOOKUPS])
        return out

    def _search(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        asked, which = np.unique(rank, return_inverse=True)
        edges = self.successors.begins(np.concatenate([asked, asked + 1]))
        lo, end = edges[: len(asked)][which], edges[len(asked) :][which]
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.successors.low(middle) < words[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        at = np.minimum(lo, self.successors.n - 1)
        return np.where((lo < end) & (self.successors.low(at) == words), self.codes[at], 0).astype(np.uint16)

    def save(self, path: str) -> None:
        """Write the levels as they are; open() maps them again."""
        Path(path).write_bytes(self.buffer[:])


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log2(p) * STEPS) + 1, 1, 65535).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2(-(codes.astype(np.float64) - 1) / STEPS), 0.0)


def narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs; the number of bytes comes first."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[b[0]], offset=1).astype(np.int64)


class Layout:
    """A slice's distinct bigrams in the order in which shards get and answer them."""

    def __init__(self, token: np.ndarray, lengths: np.ndarray, start: int, width: int, shard: np.ndarray, shards: int, split: np.ndarray | None, hot: np.ndarray, split_bits: int) -> None:
        """shard: of each local id as a context; hot: the local ids of split contexts; split: the part of such a context's successors that a word is in. Parts go to shards at even distances."""
        before = np.concatenate([[start], token[:-1]]) if len(token) else token
        before[np.cumsum(lengths)[:-1]] = start
        self.before = before
        pairs, self.which = np.unique(before * width + token, return_inverse=True)
        context, word = pairs // width, pairs % width
        bucket = shard[context]
        if split_bits:
            divided = np.zeros(width, np.int64)
            divided[hot] = 1
            bucket = (bucket + (split[word].astype(np.int64) * shards >> split_bits) * divided[context]) % shards
            order = np.argsort(bucket, kind="stable")
            context, word, bucket = context[order], word[order], bucket[order]
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            self.which = back[self.which]
        self.context, self.word, self.bucket = context, word, bucket
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])]) if len(context) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.append(self.first, len(context)))


MESSAGE = "bucket long, slice long, contexts binary, counts binary, lengths binary, words binary, times binary, shard binary, split binary, tokens binary, rare binary, sizes binary, hot binary, hot_words binary, doc_ids array<long>, held array<boolean>, start int, width int"
BINARY = ("contexts", "counts", "lengths", "words", "times", "shard", "split", "tokens", "rare", "sizes", "hot", "hot_words")
TYPES = {"bucket": pa.int64(), "slice": pa.int64(), **dict.fromkeys(BINARY, pa.binary()), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "start": pa.int32(), "width": pa.int32()}
#: A slice's text as it passes on, and a shard's answer: counts and numbers of successors for its contexts, codes for its bigrams.
ANSWER = "slice long, bucket long, counts binary, kinds binary, codes binary, shard binary, split binary, tokens binary, rare binary, sizes binary, hot binary, hot_words binary, doc_ids array<long>, held array<boolean>, start int, width int, n long, v long"
PASSED = ("shard", "split", "tokens", "rare", "sizes", "hot", "hot_words", "doc_ids", "held", "start", "width")
ANSWER_TYPES = {"slice": pa.int64(), "bucket": pa.int64(), **dict.fromkeys(("counts", "kinds", "codes"), pa.binary()), **{k: TYPES[k] for k in PASSED}, "n": pa.int64(), "v": pa.int64()}


def encoded(batches: Iterable[pa.RecordBatch], shards: int, hot: np.ndarray, split_bits: int) -> Iterator[pa.RecordBatch]:
    """Slices: their tokens in few bytes, and their bigrams by shard."""
    starts = np.array([-(-(t << 64) // shards) for t in range(shards)], np.uint64)
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in text_slices(batch, max_bytes=SLICE_BYTES):
            vocabulary, ids, counts = space_words(piece["text"])
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary.cast(pa.large_binary()).to_pylist()] + [START, END], np.uint64)
            order = np.argsort(hashes)
            local = np.empty_like(order)
            local[order] = np.arange(len(order))
            hashes = hashes[order]
            start, end = int(local[-2]), int(local[-1])
            lengths = counts + 1
            token = np.full(len(ids) + len(lengths), end, np.int64)
            inner = np.ones(len(token), bool)
            inner[np.cumsum(lengths) - 1] = False
            token[inner] = local[ids]
            del ids, vocabulary, order, local
            name, serial = (part << 32) + serial, serial + 1
            shard = np.searchsorted(starts, hashes, "right") - 1
            split = (hashes >> np.uint64(64 - split_bits)).astype(np.uint32) if split_bits else None
            mine = np.flatnonzero(np.isin(hashes, hot))
            layout = Layout(token, lengths, start, len(hashes), shard, shards, split, mine, split_bits)
            held = piece["held"].to_pylist()
            train = np.repeat(~np.array(held, bool), lengths)
            times = np.bincount(layout.which[train], minlength=len(layout.context))
            # The commonest 255 tokens in one byte each, the others in the bytes their number needs.
            seen = np.bincount(token, minlength=len(hashes))
            common = np.sort(np.argsort(-seen, kind="stable")[:255])
            short = np.full(len(hashes), 255, np.uint8)
            short[common] = np.arange(len(common))
            code = short[token]
            rest = token[code == 255]
            kind = next(k for k in (2, 3, 4) if len(hashes) <= 1 << 8 * k)
            rest = np.ascontiguousarray(rest.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :kind].tobytes()
            rows = [{"bucket": name % shards, "slice": name, "shard": narrow(np.diff(shard, prepend=0)), "split": None if split is None else narrow(split), "tokens": code.tobytes(), "rare": narrow(common) + bytes([kind]) + rest, "sizes": narrow(lengths), "hot": narrow(mine), "hot_words": hashes[mine].tobytes(), "doc_ids": piece["doc_id"].to_pylist(), "held": held, "start": start, "width": len(hashes)}]
            border = np.flatnonzero(np.concatenate([[True], np.diff(layout.bucket) != 0, [True]])) if len(layout.bucket) else np.zeros(1, int)
            runs = np.searchsorted(layout.first, border)
            words = np.ascontiguousarray(hashes >> np.uint64(64 - WORD_BITS)).view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8]
            for k in range(len(border) - 1):
                own, contexts = slice(border[k], border[k + 1]), slice(runs[k], runs[k + 1])
                bucket = int(layout.bucket[border[k]])
                rows.append({"bucket": bucket, "slice": name, "contexts": hashes[layout.context[layout.first[contexts]]].tobytes(), "lengths": narrow(layout.length[contexts]), "words": words[layout.word[own]].tobytes(), "times": narrow(times[own])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(TYPES.items())))
            del rows, layout, words, hashes
            pa.default_memory_pool().release_unused()  # executors' memory is scarce, and workers live on


def answered(batches: Iterable[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Build the trie of each bucket from its messages and answer them; slices' texts pass on."""
    schema = pa.schema(list(ANSWER_TYPES.items()))
    buckets: dict[int, list[tuple]] = {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["contexts"] is None:
                out.append({"slice": r["slice"], **{k: r[k] for k in PASSED}})
            else:
                w = np.zeros((len(r["words"]) // (WORD_BITS // 8), 8), np.uint8)
                w[:, : WORD_BITS // 8] = np.frombuffer(r["words"], np.uint8).reshape(len(w), WORD_BITS // 8)
                buckets.setdefault(r["bucket"], []).append((r["slice"], np.frombuffer(r["contexts"], np.uint64), r["lengths"], w.view("<u8").ravel(), r["times"]))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    while buckets:
        bucket, messages = buckets.popitem()
        contexts = np.unique(np.concatenate([m[1] for m in messages]))
        keys, owned = [], []
        for k, (_, own, lengths, words, _) in enumerate(messages):
            owned.append(np.searchsorted(contexts, own))
            keys.append((np.repeat(owned[-1], wide(lengths)).astype(np.uint64) << np.uint64(WORD_BITS)) | words)
            messages[k] = (messages[k][0], messages[k][4])
        # Training bigrams alone go into the trie; what slices have in common is summed.
        times = [wide(t).astype(np.uint32) for _, t in messages]
        key, times = np.concatenate([x[t > 0] for x, t in zip(keys, times, strict=True)]), np.concatenate([t[t > 0] for t in times])
        order = np.argsort(key)
        key, times = key[order], times[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        times = np.add.reduceat(times, first, dtype=np.int64) if len(key) else times.astype(np.int64)
        key = key[first]
        rank = (key >> np.uint64(WORD_BITS)).astype(np.int64)
        counts = np.bincount(rank, times, len(contexts)).astype(np.int64)
        kinds = np.bincount(rank, minlength=len(contexts))
        low = np.uint64((1 << WORD_BITS) - 1)
        trie = Trie(contexts, counts, rank, key & low, times)
        del key, times, rank
        # Totals of the bucket, and those of hot contexts, which several buckets have, one by one.
        split = np.isin(contexts, hot)
        real = (contexts != np.uint64(START)) & ~split
        sums = {"n": int(counts[real].sum()), "v": int((counts[real] > 0).sum())}
        apart = {"codes": contexts[split].tobytes(), "counts": narrow(counts[split]), "kinds": narrow(kinds[split])} if split.any() else {}
        yield pa.RecordBatch.from_pylist([{"slice": -1, "bucket": bucket, **sums, **apart}], schema=schema)
        # All slices' bigrams are looked up together; each slice gets its part.
        asked = np.concatenate(keys)
        codes = trie.lookup((asked >> np.uint64(WORD_BITS)).astype(np.int64), asked & low)
        parts = np.split(codes, np.cumsum([len(x) for x in keys])[:-1])
        out = [{"slice": name, "bucket": bucket, "counts": narrow(counts[at]), "kinds": narrow(kinds[at]), "codes": part.tobytes()} for (name, _), at, part in zip(messages, owned, parts, strict=True)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        del keys, owned, trie, asked, codes, parts, out
        pa.default_memory_pool().release_unused()


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(batches: Iterable[pa.RecordBatch], n: int, v: int, texts: int, totals: dict[int, tuple[int, int]], shards: int, split_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice and bucket, a slice's text first -> its documents' scores."""

    def ended(text: dict, answers: list[dict]) -> pa.RecordBatch:
        width, start = text["width"], text["start"]
        code = np.frombuffer(text["tokens"], np.uint8)
        size = 1 + text["rare"][0] * min(255, width)
        common, kind = wide(text["rare"][:size]), text["rare"][size]
        rest = np.zeros(((len(text["rare"]) - size - 1) // kind, 4), np.uint8)
        rest[:, :kind] = np.frombuffer(text["rare"], np.uint8, offset=size + 1).reshape(len(rest), kind)
        token = np.empty(len(code), np.int64)
        token[code == 255] = rest.view("<u4").ravel()
        token[code < 255] = common[code[code < 255]]
        lengths = wide(text["sizes"])
        layout = Layout(token, lengths, start, width, np.cumsum(wide(text["shard"])), shards, wide(text["split"]) if split_bits else None, wide(text["hot"]), split_bits)
        part, kinds = (np.concatenate([wide(a[k]) for a in answers]) for k in ("counts", "kinds"))
        codes = np.concatenate([np.frombuffer(a["codes"], np.uint16) for a in answers])
        owner = layout.context[layout.first]
        count = np.bincount(owner, part, width)
        successors = np.bincount(owner, kinds, width)
        for i, word in zip(wide(text["hot"]).tolist(), np.frombuffer(text["hot_words"], np.uint64).tolist(), strict=True):
            count[i], successors[i] = totals.get(word, (0, 0))
        # A context's answers from several shards are in proportion to their shares of its count.
        found = probability(codes) * np.repeat(part, layout.length)
        total = np.maximum(count, 1)
        unigram = count.copy()
        unigram[start] = 0
        ending = int(token[-1])
        unigram[ending] = texts
        base = (unigram + ADDED) / (n + ADDED * (v + 1))
        left = np.where(count > 0, DISCOUNT * successors / total, 1.0)
        pair = found / total[layout.context] + left[layout.context] * base[layout.word]
        first = np.cumsum(lengths) - lengths
        sums = lambda x: np.add.reduceat(x, first)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(text["doc_ids"], pa.int64()),
                "held_out": pa.array(text["held"], pa.bool_()),
                "n_tokens": lengths,
                "n_known": sums((unigram > 0)[token].astype(np.int64)),
                "train_tokens": np.full(len(lengths), n, np.int64),
                "base_score": sums(np.log10(base)[token]),
                "score": sums(np.log10(pair)[layout.which]),
            }
        )

    text, answers = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["tokens"] is not None:
                if text:
                    yield ended(text, answers)
                text, answers = r, []
            else:
                answers.append(r)
    if text:
        yield ended(text, answers)


def score_texts(docs: DataFrame, held_out: object) -> DataFrame:
    """Log10 probabilities of every text under a bigram model of those that aren't held out.

    docs: doc_id (long), text; held_out: a boolean column of it; other columns don't matter. Null and
    empty texts are an end alone; texts of any length are scored whole; repeated rows count and are scored each time; without training
    texts every token is unknown and both scores are the smoothed base's; an empty table gives an
    empty one. Words are known by a 64-bit hash, and by 40 bits of it among one context's successors.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    totals = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("held")).alias("texts")).first()
    shards = max(12, totals.rows // DOCS_PER_SHARD)
    hot, split_bits = hot_contexts(docs, totals.rows, shards)
    messages = docs.mapInArrow(lambda it: trimmed(encoded(it, shards, hot, split_bits)), MESSAGE)
    answers = stored(messages.repartitionById(shards, F.col("bucket").cast("int")).mapInArrow(lambda it: trimmed(answered(it, hot)), ANSWER), "answers", ARROW_MESSAGES)
    sums = answers.where("slice < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    apart: dict[int, tuple[int, int]] = {}
    for r in answers.where("slice < 0 AND codes IS NOT NULL").select("codes", "counts", "kinds").collect():  # at most the hot contexts times their parts
        for word, c, k in zip(np.frombuffer(r.codes, np.uint64).tolist(), wide(r.counts).tolist(), wide(r.kinds).tolist(), strict=True):
            apart[word] = (apart.get(word, (0, 0))[0] + c, apart.get(word, (0, 0))[1] + k)
    known = [c for word, (c, _) in apart.items() if word != START]
    texts = int(totals.texts)
    n, v = int(sums.n) + sum(known) + texts, int(sums.v) + sum(c > 0 for c in known) + bool(texts)
    slices = answers.where("slice >= 0").repartition(shards, "slice").sortWithinPartitions("slice", F.col("bucket").asc_nulls_first())
    result = stored(slices.mapInArrow(lambda it: trimmed(scored(it, n, v, texts, apart, shards, split_bits)), SCORES), "scores", ARROW_MESSAGES)
    discard(answers)
    return result


def hot_contexts(docs: DataFrame, rows: int, shards: int) -> tuple[np.ndarray, int]:
    """Hashes of contexts that would fill more than half a shard, at most two for each shard, and in how many parts (as bits) they are split."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ids, counts = space_words(b["text"])
            seen = np.bincount(ids, minlength=len(words))
            often = np.flatnonzero(seen * 4 * shards >= len(ids) + len(counts))
            hashes = [xxhash.xxh3_64_intdigest(words[i].as_py().encode()) for i in often.tolist()]
            both = np.array([*hashes, START, 0], np.uint64).view(np.int64), np.array([*seen[often].tolist(), len(counts), len(ids) + len(counts)], np.int64)
            yield pa.RecordBatch.from_pydict({"word": both[0], "n": both[1]})

    some = docs.select("text").sample(False, min(1.0, HOT_SAMPLE / max(1, rows)), 1)
    found = {r.word: r.n for r in some.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(0, 0)
    share = {w: n / total for w, n in found.items() if n * 2 * shards >= total}
    return np.array(sorted(share), np.int64).view(np.uint64), max(0, math.ceil(math.log2(2 * shards * max(share.values())))) if share else 0


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, crc_mod(F.col("doc_id"), 10) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_lm_scoring": op1_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
