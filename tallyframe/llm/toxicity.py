"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five transducers (insult, threat, target, negation, reported speech) each read a clause's tag
sequence and mark what they find, with a weight on each marking arc. Composed() makes one machine of
them, whose arcs carry the sum of the weights and whose table is filled as clauses come. A clause is
worth its best path: the arcs' weights times the weight of the word they stand on. An insult is a
match only within a clause, so a word that stands alone is none. The arcs' weights are learned by a
ridge regression towards prior weights, and the insult transducer's lexicon grows by words and stems
that labelled rows show.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, discard, free_name, stored, table, trimmed

#: Labelled rows that the grammar learns from, at most, for each label; they are the first in the order of a hash of their id.
MAX_ROWS_PER_LABEL = 6000
#: Toxic training texts that must show a word or stem before it is counted, how much likelier it must be in them to be taken up,
#: and how many words or stems may be taken up by chance, which asks for more texts the more of them there are.
MIN_SUPPORT, MIN_RATIO, BY_CHANCE = 3, 20.0, 0.1
STEM_LENGTHS = (4, 5, 6)
#: Weights that add up to a whole number may do so with this much less.
ROUNDING = 1e-6
THRESHOLD = 0.3

# The grammar's own words.
INSULTS = "idiot moron imbecile stupid dumb pathetic worthless disgusting loser scum trash clown fool bastard vermin dummkopf arschloch crétin imbécile connard estúpido imbécil".split()
THREATS = "kill hurt destroy punch strangle stab burn töten vernichten schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your youre yours u he she they them him her his their ihr du dich dir er sie vous tu toi ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never nobody isnt arent dont wasnt nicht kein keine nie ne pas jamais aucun nunca ningún jamás".split()
REPORTS = "said says claimed called wrote reported quoted alleged according sagte schrieb behauptete dit écrit affirmé dijo escribió afirmó".split()

#: How many words a negation reaches ahead, a threat looks for its target, and a target for its insult.
REACH = {"negation": 3, "threat": 4, "target": 5}
#: The marks, and the weights of their arcs before anything is learned.
PRIOR = {"insult": 1.5, "threat": 2.0, "aimed": 0.5, "negated": -1.0, "reported": -0.8}
PRIOR_BIAS = -3.0

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, tag) -> (next state, mark or None, weight); a tag without an arc follows the state's '*' arc."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, str | None, float]]

    def step(self, state: int, tag: str) -> tuple[int, str | None, float]:
        return self.arcs.get((state, tag)) or self.arcs[state, "*"]


def reaching(tag: str, mark: str, reach: int, on: str, weight: float) -> Transducer:
    """Marks each `on` that stands at most so many words after a `tag`."""
    arcs: dict[tuple[int, str], tuple[int, str | None, float]] = {}
    for left in range(reach + 1):
        after = max(0, left - 1)
        arcs |= {(left, "*"): (after, None, 0.0), (left, tag): (reach, None, 0.0), (left, on): (after, mark, weight) if left else (after, None, 0.0)}
    return Transducer(0, arcs)


def negated_threat(weight: float) -> Transducer:
    """Marks the target of a threat word that stands a few words after a negation: states count down to the threat word, then to its target."""
    far = REACH["negation"] + 1
    arcs: dict[tuple[int, str], tuple[int, str | None, float]] = {(0, "*"): (0, None, 0.0), (0, "N"): (REACH["negation"], None, 0.0)}
    for n in range(1, REACH["negation"] + 1):
        arcs |= {(n, "*"): (n - 1, None, 0.0), (n, "N"): (REACH["negation"], None, 0.0), (n, "H"): (far + REACH["threat"] - 1, None, 0.0)}
    for n in range(far, far + REACH["threat"]):
        after = n - 1 if n > far else 0
        arcs |= {(n, "*"): (after, None, 0.0), (n, "N"): (REACH["negation"], None, 0.0), (n, "H"): (0, None, 0.0), (n, "T"): (0, "negated", weight)}
    return Transducer(0, arcs)


def grammar(weights: dict[str, float]) -> tuple[list[Transducer], list[Transducer]]:
    """The transducers that read a clause forwards, and those that read it backwards, too: a target or any word may stand on either side of an insult."""
    insult = Transducer(0, {(0, "*"): (1, None, 0.0), (1, "I"): (1, "insult", weights["insult"]), (1, "*"): (1, None, 0.0)})
    arcs: dict[tuple[int, str], tuple[int, str | None, float]] = {(0, "H"): (REACH["threat"], None, 0.0), (0, "*"): (0, None, 0.0)}
    for n in range(1, REACH["threat"] + 1):
        arcs |= {(n, "T"): (0, "threat", weights["threat"]), (n, "H"): (REACH["threat"], None, 0.0), (n, "*"): (n - 1, None, 0.0)}
    threat = Transducer(0, arcs)
    told = (1, "reported", weights["reported"])
    report = Transducer(0, {(0, "R"): (1, None, 0.0), (0, "*"): (0, None, 0.0), (1, "I"): told, (1, "T"): told, (1, "*"): (1, None, 0.0)})
    negation = [reaching("N", "negated", REACH["negation"], "I", weights["negated"]), negated_threat(weights["negated"])]
    aimed = reaching("T", "aimed", REACH["target"], "I", weights["aimed"])
    return [insult, threat, aimed, *negation, report], [insult, aimed]


class Composed:
    """The product of transducers: a path's marks are all of theirs, with their arcs' weights. Its table is filled as pairs of states and tags come up."""

    def __init__(self, machines: Iterable[Transducer]) -> None:
        self.machines = list(machines)
        self.start = tuple(m.start for m in self.machines)
        self.table: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], dict[str, float]]] = {}

    def step(self, state: tuple[int, ...], tag: str) -> tuple[tuple[int, ...], dict[str, float]]:
        if (found := self.table.get((state, tag))) is None:
            moves = [m.step(s, tag) for m, s in zip(self.machines, state, strict=True)]
            found = self.table[state, tag] = (tuple(s for s, _, _ in moves), {mark: weight for _, mark, weight in moves if mark})
        return found

    def run(self, tags: list[str]) -> list[dict[str, float]]:
        state, out = self.start, []
        for tag in tags:
            state, marks = self.step(state, tag)
            out.append(marks)
        return out


@dataclass
class Grammar:
    """A scorer: lexemes with weights (stems end in '*'), the weights of the marking arcs, and bias. It is small, and the same at every input size."""

    lexemes: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = PRIOR_BIAS

    def __post_init__(self) -> None:
        self.machine = None

    def __getstate__(self) -> dict:
        return {"lexemes": self.lexemes, "weights": self.weights, "bias": self.bias, "machine": None}

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for lexeme, weight in self.lexemes.items():
            self.automaton.add_word(lexeme.rstrip("*"), (lexeme.rstrip("*"), lexeme.endswith("*"), weight))
        for word in THREATS:
            if word not in self.lexemes:
                self.automaton.add_word(word, (word, False, None))
        self.automaton.make_automaton()
        self.machine, self.backwards = map(Composed, grammar(self.weights))
        self.tags = dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(TARGETS, "T") | dict.fromkeys(REPORTS, "R")

    def clauses(self, text: str) -> Iterator[tuple[int, int, dict[int, tuple[str, float]]]]:
        """Spans of the clauses that hold an insult or threat word, with those words by their start."""
        low = text.lower()
        hits: dict[int, tuple[str, float]] = {}
        for last, (word, stem, weight) in self.automaton.iter(low):
            first = last - len(word) + 1
            if first and (low[first - 1].isalpha()) or not stem and last + 1 < len(low) and low[last + 1].isalpha():
                continue
            if weight is None:
                hits.setdefault(first, ("H", 0.0))
            elif first not in hits or hits[first][1] < weight:
                hits[first] = ("I", weight)
        # Hits are gone through once, and signs are looked for from where the last clause ended, so time is in proportion to the text.
        places, done, n = sorted(hits), 0, 0
        while n < len(places):
            begin = max(max(low.rfind(x, done, places[n]) for x in ".!?;:\n") + 1, done)
            end = CLAUSE_END.search(low, places[n])
            done = end.start() if end else len(low)
            first = n
            while n < len(places) and places[n] < done:
                n += 1
            yield begin, done, {k: hits[k] for k in places[first:n]}

    def matches(self, text: str) -> Iterator[tuple[int, int, dict[str, float], float]]:
        """Each matched clause's span, its best path's marks with their arcs' weights, and the weight of the word that the path stands on."""
        if self.machine is None:
            self.compile()
        low = text.lower()
        for begin, end, hits in self.clauses(text):
            words = [(m.start(), m.group()) for m in WORD.finditer(low, begin, end)]
            tags = [hits[at][0] if at in hits else self.tags.get(word, "O") for at, word in words]
            best = None
            for (at, _), found, also in zip(words, self.machine.run(tags), self.backwards.run(tags[::-1])[::-1], strict=True):
                marks = found | also
                if "threat" in marks:  # a threat has its target already
                    marks = {k: w for k, w in marks.items() if k not in ("insult", "aimed")}
                elif "insult" not in marks:
                    continue
                word = hits[at][1] if "insult" in marks else 1.0
                if best is None or sum(marks.values()) * word > sum(best[0].values()) * best[1]:
                    best = marks, word
            if best:
                yield begin, end, *best

    def evidence(self, text: str) -> list[float]:
        """For each mark, the sum over matched clauses of the word's weight; the clauses' worth is these sums times the arcs' weights."""
        total = dict.fromkeys(PRIOR, 0.0)
        for _, _, marks, word in self.matches(text):
            for mark in marks:
                total[mark] += word
        return list(total.values())

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sum(marks.values()) * word for _, _, marks, word in self.matches(text or ""))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def lexemes_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEM_LENGTHS if len(w) > n}


def sketch_of(text: str, size: int = 4) -> list[int]:
    """Minima of a few hashes over five-word shingles, by which near copies in the training rows count once."""
    words = text.lower().split()
    grams = np.array([hash_of(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], dtype=np.uint64)
    return [int((grams * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)).min() >> np.uint64(1)) for k in range(size)]


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS_PER_LABEL) -> DataFrame:
    """(doc_id, text, y) of labelled rows that aren't held out: at most max_rows of each label, the first by a hash of their id; of several texts of one id the least."""
    known = labels.where(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").where(F.col("text").isNotNull())
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit_grammar(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS_PER_LABEL) -> Grammar:
    """Learn lexemes and arc weights. Without labelled rows of both kinds, the grammar keeps its own words and prior weights.

    Training rows that are nearly copies of each other (a minimum of one of four hashes over their
    five-word shingles is the same) share the weight of one row, so that a text that was copied often is
    no evidence of its own; none is left out.
    """
    sample = stored(training_rows(docs, labels, "toxic", max_rows), "toxic-rows")
    spread = sample.repartition(16)

    def sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, y, sketch_of(t)) for i, y, t in zip(b["doc_id"].to_pylist(), b["y"].to_pylist(), b["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "y": pa.array([r[1] for r in rows], pa.int32()), "sketch": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    # At most two times max_rows short rows come to the driver, whatever the input's size.
    group_of: dict[tuple[int, int], int] = {}
    groups: dict[int, int] = {}
    labelled: dict[int, int] = {}
    for row in sorted(spread.mapInArrow(lambda it: trimmed(sketches(it)), "doc_id long, y int, sketch array<long>").collect()):
        marks = list(enumerate(row.sketch))
        group = next((group_of[m] for m in marks if m in group_of), len(group_of))
        group_of |= {m: group for m in marks if m not in group_of}
        groups[row.doc_id], labelled[row.doc_id] = group, row.y
    sizes = Counter((g, labelled[i]) for i, g in groups.items())
    weight = {i: 1 / sizes[g, labelled[i]] for i, g in groups.items()}
    n = [sum(w for i, w in weight.items() if labelled[i] == y) for y in (0, 1)]
    model = Grammar()
    if not n[0] or not n[1]:
        discard(sample)
        return model

    def counts(of: int, among: frozenset[str] | None) -> dict[str, float]:
        """Rows of a label that show each lexeme, by their weight."""

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: defaultdict[str, float] = defaultdict(float)
            for b in batches:
                for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    for lexeme in lexemes_of(t) if among is None else lexemes_of(t) & among:
                        found[lexeme] += weight[i]
            yield pa.RecordBatch.from_pydict({"lexeme": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.float64())})

        rows = spread.where(F.col("y") == of).mapInArrow(lambda it: trimmed(count(it)), "lexeme string, n double").groupBy("lexeme").agg(F.sum("n").alias("n"))
        return {r.lexeme: r.n for r in rows.where(F.col("n") >= (MIN_SUPPORT - ROUNDING if among is None else 0)).collect()}

    toxic = counts(1, None)
    clean = counts(0, frozenset(toxic))
    ratio = {k: (v + 0.5) / (n[1] + 1) / ((clean.get(k, 0) + 0.5) / (n[0] + 1)) for k, v in toxic.items()}
    support = max(MIN_SUPPORT, math.log(len(toxic) / BY_CHANCE) / -math.log(n[1] / (n[0] + n[1]))) if toxic else 0
    chosen: dict[str, float] = {}
    # Shortest stems first; what a chosen stem begins adds nothing, and a stem that is one word's alone gives way to the word.
    for lexeme in sorted((k for k, v in ratio.items() if v >= MIN_RATIO and toxic[k] >= support - ROUNDING), key=lambda k: (len(k.rstrip("*")), k)):
        stem = lexeme.rstrip("*")
        if any(stem.startswith(x[:-1]) for x in chosen if x.endswith("*")):
            continue
        if lexeme.endswith("*") and any(toxic[w] >= 0.8 * toxic[lexeme] for w in ratio if not w.endswith("*") and w.startswith(stem)):
            continue
        chosen[lexeme] = min(2.0, math.log10(ratio[lexeme]))
    model.lexemes |= chosen

    def evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"y": b["y"], "w": pa.array([weight[i] for i in b["doc_id"].to_pylist()], pa.float64()), "x": pa.array([model.evidence(t) for t in b["text"].to_pylist()], pa.list_(pa.float64()))})

    rows = spread.mapInArrow(lambda it: trimmed(evidence(it)), "y int, w double, x array<double>").collect()
    discard(sample)
    truth = {y: c for y, c in labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("toxic").count().collect()}
    y, w = np.array([r.y for r in rows], float), np.array([r.w for r in rows], float)
    share = [truth.get(v, 1) / n[v] for v in (0, 1)]
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(PRIOR))
    weights = ridge_logit(x, y, w * np.where(y == 1, share[1], share[0]) * sum(n) / sum(truth.values()), np.array(list(PRIOR.values())))
    model.bias, model.weights = float(weights[0]), dict(zip(PRIOR, map(float, weights[1:]), strict=True))
    return model


def ridge_logit(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Bias and weights of a logistic regression that is drawn towards the prior weights, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    centre, pull = np.concatenate([[PRIOR_BIAS], prior]), np.diag([0.01] + [strength] * len(prior))
    beta = centre.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - pull @ (beta - centre)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + pull, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, model: Grammar, keep: tuple[str, ...] = ("doc_id",), name: str = "toxicity") -> DataFrame:
    """The columns in keep and the score (0 to 1), under a name that isn't among them, for every row.

    docs: text, and what is kept; other columns don't matter, whatever their names. Null and empty
    texts get the score of a text without matches; texts of any length are read whole, clause by
    clause; repeated rows get equal scores; an empty table gives an empty one.
    """
    if name in keep:
        raise ValueError(f"{name!r} is a column already")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([model.score(t.as_py()) for t in b.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], scores], names=[*keep, name])

    kept = docs.select(*keep)
    rows = docs.select(*keep, F.col("text").alias(free_name([*keep, name], "scored_text")))
    return rows.mapInArrow(lambda it: trimmed(score(it)), StructType([*kept.schema, StructField(name, DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_grammar(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
