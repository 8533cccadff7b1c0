"""Suffix-array dedup: bytes of strings that start at two places, from merged positional Burrows-Wheeler transforms.

Which suffixes must be compared follows from their content: each 400-byte string has one canonical
anchor, the leftmost of its 32-byte grams with the least hash. Strings are equal only if their
anchors are, so the texts around anchors that occur once never meet others. Of the others, pieces
of text around an anchor that are equal as a whole are counted by their hash; one of each kind is
cut out and aligned at the anchor, and each shard's pieces are rows of one transform: rows start in
the shards' order within an anchor, and at each column the interleave is refined by a stable
partition on the column's symbols, so that rows are sorted by what stands before the column,
without sorting any suffix anew. Common lengths of neighbours are derived along with it (range
maxima of where matches start); a string is repeated if a neighbour's match is 400 bytes long.
Anchors with more kinds of pieces than one task should hold have their strings counted one by one.

The same is done over words for passages that several texts have: a text's symbols are then the
hashes of its words, and a string of `passage` words counts if another text has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, space_words, stored, table, text_slices, trimmed

LENGTH = 400
GRAM = 32
#: Words of a passage that texts share, and of the grams that are its anchors.
PASSAGE, WORD_GRAM = 50, 8
#: Symbols by their bytes: bytes themselves, and words by 32 bits of their hash.
SYMBOLS = {1: np.uint8, 4: np.uint32}
#: Starts that are handled at once, and bytes of text around anchors for each task, about.
AT_ONCE, BYTES_PER_TASK = 1 << 21, 12 << 20
#: Kinds of pieces around one anchor that one task takes together.
KINDS = 40_000

#: Odd base and byte values of the rolling hash, made by a rule.
BASE = 0x9E3779B97F4A7C15
VALUES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
POSITION_BITS = 24


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, gram: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The hash of each gram of raw, from prefix sums modulo 2**64."""
    values = VALUES[raw] if raw.dtype == np.uint8 else raw.astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(raw)], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive entries."""
    n = len(x) - width + 1
    blocks = np.pad(x, (0, -len(x) % width), constant_values=np.iinfo(x.dtype).max).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int, width: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text's index, anchor's hash, its place, first and last start) of runs of starts with the same canonical anchor."""
    base_down = pow(BASE, -1, 2**64)
    most = min(AT_ONCE + length, sum(map(len, texts)) // width or 1)
    up, down = powers(BASE, most), powers(base_down, most)
    offsets = np.concatenate([[0], np.cumsum([len(t) // width for t in texts])])
    flat = np.frombuffer(b"".join(texts), SYMBOLS[width])
    for lo in range(0, max(0, len(flat) - length + 1), AT_ONCE):
        raw = flat[lo : lo + AT_ONCE + length - 1]
        n = len(raw) - length + 1
        valid = np.zeros(n, bool)
        for k in range(int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, lo + n, "left"))):
            valid[max(0, offsets[k] - lo) : max(0, min(n, offsets[k + 1] - length + 1 - lo))] = True
        h = gram_hashes(raw, gram, up, down)
        mask = np.uint64((1 << POSITION_BITS) - 1)
        least = window_minima((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        at = (least[starts] & mask).astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        which = np.searchsorted(offsets, starts[first] + lo, "right") - 1
        shift = lo - offsets[which]
        yield which, h[at[first]].view(np.int64), at[first] + shift, starts[first] + shift, starts[last] + shift


SPOTS = "h long, key long, at long, first long, last long, content long"


def word_codes(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The words of each text that has `least` of them, 32 bits of hash each."""
    for batch in batches:
        for piece in text_slices(batch):
            vocabulary, ids, counts = space_words(piece["text"])
            codes = np.array([xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF for w in vocabulary.cast(pa.large_binary()).to_pylist()], np.uint32)[ids] if len(ids) else np.empty(0, np.uint32)
            ends = np.cumsum(counts)
            some = np.flatnonzero(counts >= least)
            texts = [codes[ends[i] - counts[i] : ends[i]].tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_pydict({"key": piece["key"].take(pa.array(some)), "text": pa.array(texts, pa.binary())})


def spots_of(batches: Iterable[pa.RecordBatch], length: int, gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """Every anchor's runs of starts, with a hash of the piece of text that the run's strings span."""
    for batch in batches:
        keys, texts, size = [], [], 0

        def found() -> Iterator[pa.RecordBatch]:
            for which, *columns in anchors(texts, length, gram, width):
                h, at, first, last = columns
                content = [xxhash.xxh3_64_intdigest(texts[w][f * width : (e + length) * width]) for w, f, e in zip(which.tolist(), first.tolist(), last.tolist(), strict=True)]
                names = np.array(keys, np.int64)[which]
                yield pa.RecordBatch.from_pydict({"h": h, "key": names, "at": at, "first": first, "last": last, "content": np.array(content, np.uint64).view(np.int64)})

        seen = set()
        for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if len(raw) >= length * width and key not in seen:
                seen.add(key)
                keys.append(key)
                texts.append(raw)
                size += len(raw)
            if size >= AT_ONCE:
                yield from found()
                keys, texts, size = [], [], 0
        yield from found()


PIECES = "h long, before int, piece binary, key long, first long, whole boolean"


def pieces_of(batches: Iterable[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """The text that the strings of each leading spot span, aligned at the anchor."""
    schema = pa.schema([("h", pa.int64()), ("before", pa.int32()), ("piece", pa.binary()), ("key", pa.int64()), ("first", pa.int64()), ("whole", pa.bool_())])
    for batch in batches:
        rows = []
        for key, text, spots in zip(batch["key"].to_pylist(), batch["text"], batch["spots"].to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for s in spots:
                if s["lead"] and not s["hot"]:
                    rows.append({"h": s["h"], "before": s["at"] - s["first"], "piece": raw[s["first"] * width : (s["last"] + length) * width], "key": key, "first": s["first"], "whole": s["whole"]})
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


STRINGS = "a long, b long, key long, first long, whole boolean, start long"


def strings_of(batches: Iterable[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Each string of the leading spots of hot anchors by a 128-bit hash."""
    for batch in batches:
        for key, text, spots in zip(batch["key"].to_pylist(), batch["text"], batch["spots"].to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            hot = [s for s in spots if s["lead"] and s["hot"]]
            if hot:
                sizes = [s["last"] + 1 - s["first"] for s in hot]
                starts = [i for s in hot for i in range(s["first"], s["last"] + 1)]
                pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i * width : (i + length) * width]) for i in starts), np.int64).reshape(-1, 2)
                first, whole = np.repeat([s["first"] for s in hot], sizes), np.repeat([s["whole"] for s in hot], sizes)
                yield pa.RecordBatch.from_pydict({"a": pair[:, 0], "b": pair[:, 1], "key": np.full(len(starts), key, np.int64), "first": first, "whole": whole, "start": np.array(starts, np.int64)})


def repeated_starts(groups: np.ndarray, before: np.ndarray, pieces: list[bytes], length: int, width: int = 1, texts: np.ndarray | None = None, shared: np.ndarray | None = None) -> np.ndarray:
    """For each piece (rows sorted by group) and start column: whether another row has the same string there.

    With texts, the name of each row's text, only rows of another text count; shared tells which
    rows stand for pieces that several texts have.

    The merged transform of all shards: `order` is the interleave, `since` the column from which a
    row and the one before it in the order are equal.
    """
    n, left = len(pieces), int(before.max())
    begin = left - before
    sizes = np.fromiter(map(len, pieces), np.int64, n) // width
    end = begin + sizes
    across = int(end.max())
    flat, blank = np.frombuffer(b"".join(pieces), SYMBOLS[width]), 256
    if width > 1:
        known, flat = np.unique(flat, return_inverse=True)
        blank = len(known)
    symbols = np.full((n, across), blank, np.uint16 if width == 1 else np.int32)
    for i, (a, b) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True)):
        symbols[i, begin[i] : end[i]] = flat[a : a + b]
    columns = np.ascontiguousarray(symbols.T)
    del symbols
    repeated = np.zeros((max(0, across - length + 1), n), bool)
    order = np.arange(n)
    same_group = np.concatenate([[False], groups[1:] == groups[:-1]])
    rank = np.cumsum(~same_group) * (blank + 1)
    since = np.zeros(n + 1, np.int32)
    never = across + 1
    since[:n][~same_group] = never
    since[n] = never
    for c in range(across):
        s = columns[c][order].astype(np.int64) + rank
        equal = s[1:] == s[:-1]
        if (s[1:] >= s[:-1]).all():
            # The interleave holds; only matches of different symbols end here.
            since[1:n][~equal & same_group[1:]] = c + 1
        else:
            move = np.argsort(s, kind="stable")
            s = s[move]
            equal = s[1:] == s[:-1]
            a, b = move[:-1], move[1:]
            fresh = np.where(same_group[1:], c + 1, never).astype(np.int32)
            near = equal & (b == a + 1)
            fresh[near] = since[b[near]]
            apart = np.flatnonzero(equal & (b != a + 1))
            if len(apart):
                pairs = np.empty(2 * len(apart), np.int64)
                pairs[0::2], pairs[1::2] = a[apart] + 1, b[apart] + 1
                fresh[apart] = np.maximum.reduceat(since, pairs)[::2]
            since[1:n] = fresh
            order = order[move]
        start = c + 1 - length
        if start >= 0:
            with_last = since[:n] <= start
            if texts is None:
                hit = with_last | np.append(with_last[1:], False)
            else:  # rows of one string follow each other
                names, several = texts[order], shared[order].copy()
                several[1:] |= with_last[1:] & (names[1:] != names[:-1])
                runs = np.flatnonzero(~with_last)
                hit = np.repeat(np.logical_or.reduceat(several, runs), np.diff(np.append(runs, n)))
            rows = order[hit]
            repeated[start, rows[(begin[rows] <= start) & (end[rows] > c)]] = True
    return repeated


REPEATS = "key long, first long, start long, end long"


def repeats_of(batches: Iterable[pa.RecordBatch], length: int, width: int, across: bool) -> Iterator[pa.RecordBatch]:
    """All pieces of some anchors -> the piece's key and first, start and end of strings that are repeated, joined where they follow each other."""
    names, rows = [], []
    for b in batches:
        names += b["h"].to_pylist()
        rows += zip(*(b[k].to_pylist() for k in ("before", "piece", "key", "first", "whole")), strict=True)
    names = np.array(names, np.int64)
    order = np.argsort(names, kind="stable").tolist()
    edge = 0
    while edge < len(order):
        # Whole anchors together, so many that the columns fit well into memory.
        stop, size = edge, 0
        while stop < len(order) and (size < 8 << 20 or names[order[stop]] == names[order[stop - 1]]):
            size += len(rows[order[stop]][1])
            stop += 1
        part = order[edge:stop]
        edge = stop
        before = np.array([rows[i][0] for i in part], np.int64)
        texts, shared = np.array([rows[i][2] for i in part], np.int64), np.array([rows[i][4] for i in part])
        found = repeated_starts(names[part], before, [rows[i][1] for i in part], length, width, *([texts, shared] if across else []))
        begin = before.max() - before
        out: list[tuple[int, int, int, int]] = []
        for k, i in enumerate(part):
            _, piece, key, first, whole = rows[i]
            hits = found[begin[k] : begin[k] + len(piece) // width - length + 1, k]
            if whole or not hits.any():
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[0], hits.view(np.int8), [0]])))
            out += [(key, first, first + a, first + b - 1 + length) for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist(), strict=True)]
        key, first, start, end = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), (), (), ())))
        yield pa.RecordBatch.from_pydict({"key": key, "first": first, "start": start, "end": end})


def repeated(texts: DataFrame, length: int, gram: int, width: int = 1, across: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts with their spots, and what is repeated of those that don't count as a whole; both written.

    texts: key (long), text (binary) of symbols of `width` bytes. With `across`, a string must be in
    several texts to count; what one of a text's equal pieces shares, all of them do.
    """
    spots = stored(texts.mapInArrow(lambda it: spots_of(it, length, gram, width), SPOTS), "spots")
    place = F.xxhash64("key", "at", "first")
    of = F.col("key") if across else place
    # Equal pieces around an anchor: all of them are repeated as a whole, and one of them leads the others on.
    kinds = spots.groupBy("h", "content").agg(F.min(place).alias("a"), (F.min(of) != F.max(of)).alias("whole"))
    anchors_ = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max("whole").alias("some"))
    # Written, so that neither side of the next join is bound to a task by its key, and Spark can split hot ones.
    kinds = stored(kinds.join(anchors_.where("kinds > 1 OR some").drop("some"), "h"), "kinds")
    marks = F.struct("h", "at", "first", "last", "whole", ((place == F.col("a")) & (F.col("kinds") > 1)).alias("lead"), (F.col("kinds") > KINDS).alias("hot"), *["content"] * across)
    marked = stored(spots.join(kinds, ["h", "content"]).select("key", marks.alias("spot")), "marked")
    discard(spots, kinds)
    lists = marked.groupBy("key").agg(F.collect_set("spot").alias("spots"))
    distinct = texts.where(F.octet_length("text") >= length * width).groupBy("key").agg(F.first("text").alias("text"))
    suspects = stored(distinct.join(lists, "key"), "suspects")
    leads = marked.where("spot.lead").agg(F.count_if(~F.col("spot.hot")).alias("cool"), F.count_if("spot.hot").alias("hot")).first()
    discard(marked)
    tasks = max(12, int(leads.cool * 1.5 * length * width // BYTES_PER_TASK))
    pieces = suspects.mapInArrow(lambda it: pieces_of(it, length, width), PIECES).repartition(tasks, "h")
    repeats = pieces.mapInArrow(lambda it: trimmed(repeats_of(it, length, width, across)), REPEATS)
    made = []
    if leads.hot:
        strings = stored(suspects.mapInArrow(lambda it: strings_of(it, length, width), STRINGS), "strings")
        made.append(strings)
        of = F.col("key") if across else F.xxhash64("key", "start")
        often = strings.groupBy("a", "b").agg(((F.min(of) != F.max(of)) | (F.lit(across) & F.max("whole"))).alias("often")).where("often").select("a", "b")
        repeats = repeats.unionByName(strings.join(often, ["a", "b"]).select("key", "first", "start", (F.col("start") + length).alias("end")))
    ranges = stored(repeats.groupBy("key").agg(F.collect_list(F.struct("first", "start", "end")).alias("ranges")), "repeats")
    discard(*made)
    return suspects, ranges


def covered(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """How many symbols of a text what is repeated covers, and how many runs they are."""
    for b in batches:
        out = []
        for key, spots, ranges in zip(b["key"].to_pylist(), b["spots"].to_pylist(), b["ranges"].to_pylist(), strict=True):
            equal: dict[tuple[int, int], list[int]] = {}
            for s in spots:
                equal.setdefault((s["h"], s["content"]), []).append(s["first"])
            kind = {s["first"]: (s["h"], s["content"]) for s in spots}
            found = [(s["first"], s["last"] + length) for s in spots if s["whole"]]
            found += [(f + r["start"] - r["first"], f + r["end"] - r["first"]) for r in ranges or [] for f in equal[kind[r["first"]]]]
            n = runs = at = 0
            for start, end in sorted(found):
                runs += start > at or not runs
                n += max(0, end - max(at, start))
                at = max(at, end)
            out.append({"key": key, "n_shared_words": n, "n_passages": runs})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("n_shared_words", pa.int64()), ("n_passages", pa.int64())]))


def shared_passages(keyed: DataFrame, passage: int = PASSAGE, gram: int = WORD_GRAM) -> DataFrame:
    """key, n_words, n_shared_words and n_passages of each text of `passage` words or more; written.

    keyed: key (long), text (string). Words are lower-cased and part at white space; a word is shared
    if `passage` consecutive words around it are in a text of another key.
    """
    codes = stored(keyed.mapInArrow(lambda it: trimmed(word_codes(it, passage)), "key long, text binary"), "word-codes")
    suspects, ranges = repeated(codes, passage, gram, 4, across=True)
    some = suspects.select("key", "spots").join(ranges, "key", "left").where(F.col("ranges").isNotNull() | F.exists("spots", lambda s: s["whole"]))
    found = some.mapInArrow(lambda it: covered(it, passage), "key long, n_shared_words long, n_passages long")
    lengths = codes.groupBy("key").agg(F.first(F.octet_length("text") / 4).cast("long").alias("n_words"))
    result = stored(lengths.join(found, "key", "left"), "passages")
    discard(codes, suspects, ranges)
    return result


def cut_out(batches: Iterable[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for key, text, ranges, wholes in zip(b["key"].to_pylist(), b["text"], b["ranges"].to_pylist(), b["wholes"].to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            kept, at, spans = [], 0, 0
            for r in sorted((r["start"], r["end"]) for r in [*(ranges or []), *wholes]):
                if r[0] > at or not spans:
                    kept.append(raw[at : r[0]])
                    spans += 1
                at = max(at, r[1])
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append({"key": key, "n_removed": len(raw) - len(rest), "n_spans": spans, "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept_text": rest.decode("utf-8", "replace") if with_text else None})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, passage: int = PASSAGE, word_gram: int = WORD_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text), n_shared_words and n_passages for every row of docs.

    Each byte goes that a string of `length` bytes covers which starts anywhere else, too, in the
    same text or another. Matches don't cross texts; strings are judged on the input; overlaps
    count. Texts are whole UTF-8 bytes; null and empty ones have none; texts shorter than `length`
    stay; repeated rows are copies of each other and go whole; an empty table gives an empty one.
    kept_text may hold replacement characters where a cut parts a character. Texts are known by a
    64-bit hash within the operator.

    n_shared_words counts the words (lower-cased, parted at white space) that `passage` consecutive
    words cover which another row has, too, and n_passages the maximal runs of them; they are
    reported, not removed. Passages of so many words can be shorter than `length` bytes. What one
    row alone repeats isn't shared; null, empty and shorter texts share nothing; copies share all.
    """
    body = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.xxhash64(body).alias("key"), body.alias("text"))
    rows = stored(keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"), *[F.col("text").cast("string").alias("whole_text")] * with_text), "dedup-rows")
    long = F.col("n_bytes") >= length
    able = F.col("n_bytes") >= min(length, 2 * passage - 1)
    copies = stored(rows.where(able).groupBy("whole_sha256").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copied-texts")
    suspects, ranges = repeated(keyed.select("key", "text"), length, gram)
    wholes = F.transform(F.filter("spots", lambda s: s["whole"]), lambda s: F.struct(s["first"].alias("start"), (s["last"] + length).alias("end")))
    cut = suspects.select("key", "text", wholes.alias("wholes")).join(ranges, "key", "left").where(F.col("ranges").isNotNull() | (F.size("wholes") > 0))
    cut = stored(cut.mapInArrow(lambda it: cut_out(it, with_text), "key long, n_removed long, n_spans long, kept_sha256 string, kept_text string"), "cut")
    discard(suspects, ranges)
    passages = shared_passages(keyed.select("key", F.col("text").cast("string").alias("text")), passage, word_gram)
    joined = rows.where(able).join(copies, "whole_sha256", "left").join(cut, "key", "left").join(passages, "key", "left")
    copied = F.col("copies").isNotNull()

    def outcome(gone: Column, copied: Column, n_removed: Column, n_spans: Column, kept_sha256: Column, kept_text: Column, n_words: Column, n_shared_words: Column, n_passages: Column) -> list[Column]:
        return [
            F.col("doc_id"),
            F.col("n_bytes"),
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(n_removed, F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.coalesce(n_spans, F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(kept_sha256, "whole_sha256")).alias("kept_sha256"),
            *([F.when(gone, F.lit("")).otherwise(F.coalesce(kept_text, "whole_text")).alias("kept_text")] * with_text),
            F.coalesce(F.when(copied, n_words).otherwise(n_shared_words), F.lit(0)).cast("long").alias("n_shared_words"),
            F.coalesce(F.when(copied & n_words.isNotNull(), 1).otherwise(n_passages), F.lit(0)).cast("long").alias("n_passages"),
        ]

    none = F.lit(None)
    result = joined.select(*outcome(copied & long, copied, *map(F.col, ("n_removed", "n_spans", "kept_sha256", "kept_text", "n_words", "n_shared_words", "n_passages"))))
    result = result.unionByName(rows.where(~able).select(*outcome(*[F.lit(False)] * 2, *[none] * 7)))
    result = stored(result, "suffix-dedup")
    discard(rows, copies, cut, passages)
    return result


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents") -> str:
    """Bytes as two hexadecimal digits each, as SQL has no substrings of blobs."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS t FROM {documents}),
n AS (SELECT k, doc_id, t, length(t) // 2 AS n_bytes FROM d),
s AS (SELECT k, i, md5(substring(t, 2 * i + 1, {2 * LENGTH})) AS x FROM (SELECT k, t, unnest(range(0, n_bytes - {LENGTH - 1})) AS i FROM n WHERE n_bytes >= {LENGTH})),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY x) AS c FROM s) WHERE c > 1),
g AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, (i - coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -{LENGTH + 1}) > {LENGTH})::INT AS fresh FROM r)),
u AS (SELECT k, run, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY k, run),
p AS (SELECT u.k, u.run, u.a, u.b, coalesce(lag(u.b) OVER w, 0) AS before, lead(u.a) OVER w IS NULL AS is_last, n.t, n.n_bytes FROM u JOIN n USING (k) WINDOW w AS (PARTITION BY u.k ORDER BY u.a)),
c AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substring(t, 2 * before + 1, 2 * (a - before)) || CASE WHEN is_last THEN substring(t, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM p GROUP BY k),
wl AS (SELECT k, regexp_extract_all(translate(decode(unhex(t)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM d),
ws AS (SELECT k, i, md5(array_to_string(words[i:i + {PASSAGE - 1}], ' ')) AS x FROM (SELECT k, words, unnest(range(1, len(words) - {PASSAGE - 2})) AS i FROM wl WHERE len(words) >= {PASSAGE})),
wr AS (SELECT k, i FROM (SELECT k, i, min(k) OVER (PARTITION BY x) <> max(k) OVER (PARTITION BY x) AS shared FROM ws) WHERE shared),
wg AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, (i - coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -{PASSAGE + 1}) > {PASSAGE})::INT AS fresh FROM wr)),
wc AS (SELECT k, sum(n) AS n_shared_words, count(*) AS n_passages FROM (SELECT k, run, max(i) + {PASSAGE} - min(i) AS n FROM wg GROUP BY k, run) GROUP BY k)
SELECT n.doc_id, n.n_bytes::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(c.kept, n.t))) AS kept_sha256,
  coalesce(wc.n_shared_words, 0)::BIGINT AS n_shared_words, coalesce(wc.n_passages, 0)::BIGINT AS n_passages
FROM n LEFT JOIN c USING (k) LEFT JOIN wc USING (k)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE_SQL: dict[str, str] = {"op8_suffix_dedup": oracle()}
