"""Plain versions of the operators, and a small corpus with everything that is awkward."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns, with names that operators use themselves.
EXTRA = "sig long, key long, h long, words string, term string, range int, slot int, place int, node long, component long, text_key string, toxicity double, copies int, size string, kept_key long, bad_id long, bad_key long, taken_key long, taken_times int, taken_nth int, row_key long, nth int, copy int, row string, row_id long, others long, worded boolean, sha string, times int, class long, text_sha string, hits int, blob string"
N_EXTRA = len(EXTRA.split(","))


def corpus():
    """(doc_id, text, source) rows: nulls, blanks, short and long texts, copies, near copies, shared passages, repeated rows."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary).capitalize() if r.random() < 0.1 else r.choice(vocabulary) for _ in range(n)) + "."

    base, passage = prose(150), prose(120)
    texts = [None, "", " \t\n", "one", "Two words", "two  WORDS", "a b c d", "a b c d", prose(3000), base, base, base]
    for k in range(12):
        words = base.split()
        for _ in range(1 + k % 4):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [f"{prose(40)} {passage} {prose(60)}" for _ in range(6)]
    texts += [prose(r.randint(5, 120)) for _ in range(40)] + ["x" * 3000, "ab " * 900, "!!! ??? ---", "\x00\x01 ctrl"]
    rows = [(i, t, None if i % 11 == 5 else f"s{i % 4}") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[20], (None, base, "s1"), (None, None, None)]


def frame(spark, rows, columns="doc_id long, text string, source string"):
    return spark.createDataFrame([(*r, *[None] * N_EXTRA) for r in rows], f"{columns}, {EXTRA}")


def lower(text):
    return (text or "").translate(UPPER)


def shingles(text, n=5):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(nodes, linked):
    parent = list(range(nodes))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(nodes):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    return [find(i) for i in range(nodes)]


def smallest(ids, roots):
    by = defaultdict(list)
    for i, c in zip(ids, roots, strict=True):
        if i is not None:
            by[c].append(i)
    return [min(by[c]) if by[c] else i for i, c in zip(ids, roots, strict=True)]


def ngram_join(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    roots = classes(len(rows), linked)
    return sorted(((i, len(s), c) for (i, *_), s, c in zip(rows, sets, smallest([r[0] for r in rows], roots), strict=True)), key=str)


def contamination(rows, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def dedup(rows, length):
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, *_), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rows, length):
    """(id, words that a string of `length` words covers which another row has, runs of them)."""
    lists = [SPACE.findall(lower(t)) for _, t, *_ in rows]
    owners = defaultdict(set)
    for k, w in enumerate(lists):
        for i in range(len(w) - length + 1):
            owners[tuple(w[i : i + length])].add(k)
    out = []
    for (key, *_), w in zip(rows, lists, strict=True):
        shared = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if len(owners[tuple(w[i : i + length])]) > 1:
                shared[i : i + length] = b"\1" * length
        out.append((key, sum(shared), len(re.findall(b"\1+", bytes(shared)))))
    return sorted(out, key=str)


def bigrams(rows, held):
    tokens = [[*SPACE.findall(lower(t)), "\n"] for _, t, *_ in rows]
    c, pairs, contexts, kinds = Counter(), Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
            pairs.update(zip(["\r", *t], t, strict=False))
    for (u, _), n in pairs.items():
        contexts[u] += n
        kinds[u] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for (i, *_), t, h in zip(rows, tokens, held, strict=True):
        base = score = 0
        for u, w in zip(["\r", *t], t, strict=False):
            p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            score += math.log10(max(pairs[u, w] - 0.75, 0) / contexts[u] + 0.75 * kinds[u] / contexts[u] * p if contexts[u] else p)
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out


def crc_mod(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def jump(key, shards):
    stop, n = 0, 0
    while True:
        n += 1
        draw = int(hashlib.md5(f"{key}:{n}".encode()).hexdigest()[:8], 16)
        to = max(stop + 1, math.floor((stop + 1) * 4294967296.0 / (draw + 1.0)))
        if to >= shards:
            return stop
        stop = to


def toxic_clauses(text, lexemes, threats, tags):
    """(marks, word's weight) of every path of each clause: tags by looking each word up, marks by looking at the words around."""
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        weight = {}
        for i, w in enumerate(words):
            fits = [v for k, v in lexemes.items() if (w.startswith(k[:-1]) if k.endswith("*") else w == k)]
            if fits:
                weight[i] = max(fits)
        tag = ["I" if i in weight else "H" if w in threats else tags.get(w, "O") for i, w in enumerate(words)]
        last = lambda i, t: max((j for j in range(i) if tag[j] == t), default=-99)
        paths = []
        for i, t in enumerate(tag):
            h = last(i, "H")
            if t == "T" and i - h <= 4 and "T" not in tag[h + 1 : i]:
                n = last(h, "N")
                negated = h - n <= 3 and "H" not in tag[n + 1 : h] and "N" not in tag[h:i]
                paths.append(({"threat"} | ({"negated"} if negated else set()) | ({"reported"} if "R" in tag[:i] else set()), 1.0))
            if t == "I" and len(words) > 1:
                marks = {"insult"}
                if "T" in tag[max(0, i - 5) : i] + tag[i + 1 : i + 6]:
                    marks.add("aimed")
                if "N" in tag[max(0, i - 3) : i]:
                    marks.add("negated")
                if "R" in tag[:i]:
                    marks.add("reported")
                paths.append((marks, weight[i]))
        if paths:
            yield paths


def toxicity(text, lexemes, weights, bias, threats, tags):
    z = bias + sum(max(sum(weights[m] for m in marks) * w for marks, w in paths) for paths in toxic_clauses(text, lexemes, threats, tags))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def additive(x, bias, edges, tables, pairs, coarse, pair_tables):
    """The score of one row of features: each one's bin by counting the edges that are not above it."""
    fine = [sum(e <= v for e in edge) for v, edge in zip(x, edges, strict=True)]
    wide = [sum(e <= v for e in edge) for v, edge in zip(x, coarse, strict=True)]
    z = bias + sum(t[k] for t, k in zip(tables, fine, strict=True)) + sum(t[wide[i]][wide[j]] for (i, j), t in zip(pairs, pair_tables, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
