"""The ten operators against plain versions, on a small corpus of awkward rows and on empty tables."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import components, decontamination, embedding_dedup, licenses, lm_scoring, mixing, ngram_join, quality, sharding, suffix_dedup, toxicity
from tallyframe.llm.common import crc_mod, space_words, text_slices
from tallyframe.llm.components import connected_components

from ..compare import duck, spark_rows
from . import brute

ROWS = brute.corpus()
SF = "/root/testdata/sf0.001"


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.frame(spark, [])


def test_lm_scores(docs, none):
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    want = brute.bigrams(ROWS, [brute.crc_mod(i, 10) == 0 for i, *_ in ROWS])
    have = sorted((tuple(r) for r in lm_scoring.score_texts(docs, held).collect()), key=lambda r: (str(r[0]), r[2], round(r[5], 5)))
    for a, b in zip(have, sorted(want, key=lambda r: (str(r[0]), r[2], round(r[5], 5))), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and abs(a[6] - b[6]) <= 7.4e-5 * a[2]  # half a quantisation step a token
    assert lm_scoring.score_texts(none, held).count() == 0
    untrained = lm_scoring.score_texts(docs, F.lit(True)).first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.score == pytest.approx(untrained.base_score)


def test_lm_split_contexts(docs, monkeypatch):
    held = crc_mod(F.col("doc_id"), 10) == 0
    monkeypatch.setattr(lm_scoring, "hot_contexts", lambda *_: (np.empty(0, np.uint64), 0))
    whole = sorted((tuple(r) for r in lm_scoring.score_texts(docs, held).collect()), key=str)
    hot = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in {w.lower() for _, t, _ in ROWS for w in (t or "").split()[::2]}] + [lm_scoring.START], np.uint64)
    monkeypatch.setattr(lm_scoring, "hot_contexts", lambda *_: (np.sort(hot), 2))
    split = sorted((tuple(r) for r in lm_scoring.score_texts(docs, held).collect()), key=str)
    for a, b in zip(whole, split, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and abs(a[6] - b[6]) <= 1.5e-4 * a[2]


def test_elias_fano_and_trie(tmp_path):
    r = np.random.default_rng(1)
    contexts = np.unique(r.integers(0, 2**63, 50, dtype=np.uint64))
    key = np.unique((r.integers(0, len(contexts), 900).astype(np.uint64) << np.uint64(40)) | r.integers(0, 60, 900).astype(np.uint64))
    rank, words = (key >> np.uint64(40)).astype(np.int64), key & np.uint64(2**40 - 1)
    times = r.integers(1, 9, len(key))
    trie = lm_scoring.Trie(contexts, np.bincount(rank, times, len(contexts)).astype(np.int64), rank, words, times)
    assert (trie.successors.low(np.arange(len(words))) == words).all()
    assert (np.diff(trie.successors.begins(np.arange(len(contexts) + 1))) == np.bincount(rank, minlength=len(contexts))).all()
    known = {(int(a), int(b)): int(c) for a, b, c in zip(rank, words, trie.codes, strict=True)}
    ask = [(a, b) for a in range(len(contexts)) for b in range(62)]
    found = trie.lookup(np.array([a for a, _ in ask]), np.array([b for _, b in ask], np.uint64))
    assert found.tolist() == [known.get(x, 0) for x in ask]
    trie.save(str(tmp_path / "levels"))
    mapped = lm_scoring.Trie.open(str(tmp_path / "levels"))
    assert (mapped.lookup(np.array([a for a, _ in ask]), np.array([b for _, b in ask], np.uint64)) == found).all()
    assert (mapped.contexts == contexts).all() and (mapped.counts == trie.counts).all()


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_elias_fano_pointers(n):
    r = np.random.default_rng(n)
    for buckets in (1, 3, 900):
        high = np.sort(r.integers(0, buckets, n) ** 2 // buckets)
        memory = memoryview(bytearray(sum(lm_scoring.EliasFano.sizes(n, buckets, 40))))
        got = lm_scoring.EliasFano.build(high, np.arange(n, dtype=np.uint64), buckets, 40, memory).begins(np.arange(buckets + 1))
        assert got.tolist() == np.searchsorted(high, np.arange(buckets + 1)).tolist()


@pytest.mark.parametrize(("name", "learn"), [("quality", quality.fit_quality), ("toxic", toxicity.fit_grammar)])
def test_classifiers_on_awkward_rows(spark, docs, none, name, learn):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, *_ in ROWS if i is not None and i % 3] + [(10**9, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    score = quality.score_quality if name == "quality" else toxicity.score_toxicity
    for rows, known in ((docs, labels), (docs, labels.limit(0)), (none, labels), (docs, labels.where(f"{name} = 1"))):
        model = learn(rows, known)
        scored = score(rows, model).collect()
        assert len(scored) == rows.count()
        assert all(0 <= r[1] <= 1 for r in scored)


def held_out(spark, df, label, score):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where(crc_mod(F.col("doc_id"), 4) == 2)
    rows = df.select("doc_id", F.col(score).alias("score")).join(labels.select("doc_id", F.col(label).alias("label")), "doc_id").select("label", "score").collect()
    pos, neg = ([r[1] for r in rows if r[0] == v] for v in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = quality.fit_quality(d, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), max_rows=1500)
    assert held_out(spark, quality.score_quality(d, model), "quality", "quality") > 0.98


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.fit_grammar(d, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    assert held_out(spark, toxicity.score_toxicity(d, model), "toxic", "toxicity") > 0.9  # some 240 toxic rows to learn from


def test_grammar_reads_clauses():
    g = toxicity.Grammar()
    marks = lambda t: [set(m) for *_, m, _ in g.matches(t)]
    assert marks("You are an idiot.") == [{"insult", "aimed"}]
    assert marks("An idiot, that one is") == [{"insult"}]
    assert marks("Idiot.") == marks("Idiot") == marks("idiot\n\nmoron") == []  # a word alone is no clause
    assert marks("You are not an idiot") == [{"insult", "aimed", "negated"}]
    assert marks("He said you are an idiot!") == [{"insult", "aimed", "reported"}]
    assert marks("I will kill you") == [{"threat"}] and marks("I will not kill you") == [{"threat", "negated"}]
    assert marks("I will kill time") == marks("idiotic scumble") == marks("") == []
    assert marks("not now. an idiot") == [{"insult"}] and len(marks("an idiot. a fool; you clown")) == 3
    assert g.score("you are not an idiot") < g.score("you are an idiot") and g.score(None) == g.score("") == g.score("Idiot!")
    arcs = toxicity.Composed(toxicity.grammar(toxicity.PRIOR)[0])
    assert [sum(x.values()) for x in arcs.run(["T", "O", "N", "I"])][-1] == pytest.approx(toxicity.PRIOR["insult"] + toxicity.PRIOR["aimed"] + toxicity.PRIOR["negated"])


def test_grammar_against_brute_force():
    r = random.Random(5)
    lexemes = dict.fromkeys(toxicity.INSULTS[:3], 1.0) | {"zor*": 1.7, "idio*": 0.6, "blip": 2.0}
    weights = {"insult": 1.1, "threat": 1.9, "aimed": 0.7, "negated": -1.4, "reported": -0.9}
    words = [*toxicity.INSULTS[:3], "zora", "zorb", "blip", "idioma", "kill", "hurt", "you", "them", "not", "never", "said", "called", *"abcdefgh"]
    tags = dict.fromkeys(toxicity.NEGATIONS, "N") | dict.fromkeys(toxicity.TARGETS, "T") | dict.fromkeys(toxicity.REPORTS, "R")
    g = toxicity.Grammar(lexemes, weights, -2.0)
    for k in range(3000):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", " ", ", ", ". ", "! ", "\n", "; "]) for _ in range(r.randint(0, 30)))
        assert g.score(text) == pytest.approx(brute.toxicity(text, lexemes, weights, -2.0, toxicity.THREATS, tags)), text
    long = "a b c. " * 400_000 + "you zora"
    assert g.score(long) == pytest.approx(brute.toxicity("you zora", lexemes, weights, -2.0, toxicity.THREATS, tags))


def test_quality_against_brute_force(spark, docs):
    labels = spark.createDataFrame([(i, len(t or "") % 2) for i, t, _ in ROWS if i is not None], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    want = sorted(((i, brute.additive(quality.features(t), model.bias, model.edges, model.tables, model.pairs, model.coarse, model.pair_tables)) for i, t, _ in ROWS), key=str)
    for (i, a), (j, b) in zip(got(quality.score_quality(docs, model), "doc_id", "quality"), want, strict=True):
        assert i == j and a == pytest.approx(b)
    assert len(set(round(b, 6) for _, b in want)) > 5
    long = spark.createDataFrame([(1, "word " * 600_000)], "doc_id long, text string")
    assert quality.score_quality(long, model).first().quality == pytest.approx(brute.additive(quality.features("word " * 600_000), model.bias, model.edges, model.tables, model.pairs, model.coarse, model.pair_tables))


def test_contamination(spark, docs, none):
    texts = [t for _, t, _ in ROWS if t]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, cut(texts[7], 5, 40)), (2, cut(texts[7], 20, 32)), (12, "Two words"), (3, None), (4, "?!"), (5, "never seen words here"), (6, "a b c d"), (6, "a b c d"), (30, cut(texts[6], 100, 130))]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int")
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert got(decontamination.find_contamination(docs, bench), *columns) == brute.contamination(ROWS, items)
    assert decontamination.find_contamination(none, bench).count() == 0
    assert got(decontamination.find_contamination(docs, bench.limit(0)), *columns) == brute.contamination(ROWS, [])
    near = decontamination.proximity_matches(docs.select("doc_id", "text"), bench)
    assert {r.doc_id for r in near.collect()} >= {i for i, _, hit, *_ in brute.contamination(ROWS, items) if hit}


def test_contamination_by_shuffle(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "HOT_TERMS", 20)
    monkeypatch.setattr(decontamination, "POSTINGS_PER_TASK", 7)
    items = [(1, "a b c d"), (2, " ".join(ROWS[9][1].split()[3:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert got(decontamination.find_contamination(docs, bench), *columns) == brute.contamination(ROWS, items)


def test_ngram_join(docs, none):
    assert got(ngram_join.ngram_components(docs), "doc_id", "n_shingles", "component_id") == brute.ngram_join(ROWS)
    assert ngram_join.ngram_components(none).count() == 0


def test_ngram_join_in_chunks_and_strips(docs):
    assert got(ngram_join.ngram_components(docs, chunk=3), "doc_id", "n_shingles", "component_id") == brute.ngram_join(ROWS)


def test_overlaps_are_exact():
    r = np.random.default_rng(3)
    for strip in (2, 4096):
        old, ngram_join.STRIP = ngram_join.STRIP, strip
        base = r.integers(0, 2**63, 40, dtype=np.uint64)
        rows = [np.unique(np.concatenate([r.choice(base, 36, replace=False), r.integers(0, 2**63, r.integers(0, 6), dtype=np.uint64)])) for _ in range(60)]
        rows += [rows[0][:-1], rows[1][1:]]  # columns of few rows
        for groups in (np.arange(62), np.arange(62) // 5):
            link = ngram_join.overlaps(rows, np.array([len(x) for x in rows]), groups, 80)
            for i, a in enumerate(rows):
                for j, b in enumerate(rows):
                    common = len(np.intersect1d(a, b))
                    assert link[i, j] == (groups[i] != groups[j] and 100 * common >= 80 * (len(a) + len(b) - common))
        ngram_join.STRIP = old


@pytest.mark.parametrize("many", [0, 10**6])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr(components, "MANY_EDGES", many)
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (None, 3), (60, 61), (62, 61), (62, 63)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 50: 50, 100: 50, **dict.fromkeys((60, 61, 62, 63), 60)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    r = np.random.default_rng(5)
    centres = r.standard_normal((6, 12))
    rows = [(i, (centres[i % 6] + r.standard_normal(12) * 0.22).tolist()) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [rows[4], (200, None), (201, []), (202, [0.0] * 12), (203, [1.0, None]), (204, [float("nan")] * 12), (205, [1.0, 0.0]), (206, [2.0, 0.0]), (207, [float("inf"), 1.0]), (None, rows[5][1]), (208, [1e30] * 12), (209, [1e30] * 12)]
    return rows


def brute_vectors(rows):
    def good(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v) / np.abs(v).max() if good(v) else None for _, v in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    linked = lambda a, b: units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= 0.9
    roots = brute.classes(len(rows), linked)
    ids = [i for i, _ in rows]
    return sorted(((i, sum(linked(a, b) for b in range(len(rows)) if b != a), c) for a, (i, c) in enumerate(zip(ids, brute.smallest(ids, roots), strict=True))), key=str)


@pytest.mark.parametrize(("chunk", "tile"), [(8192, 1024), (7, 2)])
def test_embeddings(spark, monkeypatch, chunk, tile):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors()], "vec_id long, embedding array<double>, node int, links int")
    found = embedding_dedup.embedding_components(df)
    assert got(found, "vec_id", "n_links", "component_id") == brute_vectors(vectors())
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_subspace_pairs_count_once():
    r = np.random.default_rng(9)
    x = r.standard_normal((70, 8)) * 0.2 + r.standard_normal(8)
    u = embedding_dedup.unit(x)
    want = ((u @ u.T) >= 0.9).sum(1) - 1
    links = sum(embedding_dedup.joined(x, np.ones(70, bool), np.ones(70, np.int64), a := np.arange(70), a, b, 0.9, 4)[0] for b in range(4))
    assert links.tolist() == want.tolist()


def test_embeddings_are_shuffled_in_bounds(spark, monkeypatch):
    """However many chunks meet, no step shuffles more than twice the vectors at a time."""
    for name, value in (("CHUNK", 7), ("PASS_BYTES", 0)):
        monkeypatch.setattr(embedding_dedup, name, value, raising=False)
    rows = vectors()[:80]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dealt = []
    for name in ("repartition", "repartitionById"):
        monkeypatch.setattr(type(df), name, lambda self, *a, to=getattr(type(df), name): dealt.append(self.count()) or to(self, *a))
    assert got(embedding_dedup.embedding_components(df), "vec_id", "n_links", "component_id") == brute_vectors(rows)
    assert dealt and max(dealt) <= 2 * len(rows)


def test_chunks_that_never_meet_have_no_links(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 5)
    r = np.random.default_rng(2)
    # Two opposite sides, apart along the first axis of each block.
    x = np.repeat([1.0, -1.0], 200)[:, None] * ([1, 0] * 4) @ embedding_dedup.rotation(8).T + r.standard_normal((400, 8)) * 0.2
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(400)), "weight": pa.array([1] * 400), "embedding": pa.array(x.tolist())})
    cell = next(embedding_dedup.placed([batch], 0.9, 4))["cell"].to_numpy()
    places, chunks = embedding_dedup.dealt([(8, int(c), int(n)) for c, n in zip(*np.unique(cell, return_counts=True), strict=True)])
    of = {c: range(first, first + k) for _, c, first, k in places}
    pairs = list(embedding_dedup.meetings(chunks, 4))
    met = set(pairs)
    assert len(met) == len(pairs) < len(chunks) * (len(chunks) + 1) // 2
    u = embedding_dedup.unit(x)
    for i, j in np.argwhere(np.triu(u @ u.T >= 0.9)):
        assert all((min(a, b), max(a, b)) in met for a in of[cell[i]] for b in of[cell[j]])


def test_license_automata(spark, docs, none):
    s = licenses.Scanner()
    assert s.scan("Foo is released under the MIT License!")["labels"] == "mit,mit-notice"
    found = s.scan("x cc-by-nc; cc by nc. Licensed under the Apache License, Version 2.0. Apache License\nVersion 2")
    assert (found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == (4, 1, 15, "apache-2,cc-by-nc")
    assert "apache-2.0-notice" in found["labels"]
    assert s.scan("under the mit licenses")["n_base"] == 0 and s.scan(None)["n_words"] == 0
    assert s.scan("cc by nc cc by nc")["n_base"] == 2
    assert s.scan("Licensed under the GNU Affero General Public License version 3")["labels"] == "gpl-notice"
    assert s.scan("Licensed under the GNU Affero Great General Public License version 3")["labels"] == ""
    assert s.scan("Copyright (c) 2020 Some Body. All rights reserved.")["labels"] == "all-rights-reserved"
    a = licenses.compile_template("a {b {c}} <x:1-2> d", "l")
    for text, n in (("a q d", 3), ("a b q d", 4), ("a b c q r d", 6), ("a d", 0), ("a q r s d", 0), ("a b c d", 4), ("b q d", 0)):
        assert a.longest(text.split(), 0) == n, text
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(ROWS)
    words = sorted(((r.doc_id, r.n_words) for r in rows), key=str)
    assert words == sorted(((i, len(brute.ALNUM.findall(brute.lower(t)))) for i, t, _ in ROWS), key=str)
    assert licenses.scan_licenses(none).count() == 0


def plain(markup, r=None):
    """The wording of a template, with its optional and replaceable regions as r has it; without r neither optional words nor more than must be."""
    out = []
    for part in licenses.split_markup(markup):
        if part[0] == "{":
            out += plain(part[1:-1], r) if r and r.random() < 0.5 else []
        elif part[0] == "<":
            least, most = map(int, part[1:-1].rpartition(":")[2].split("-"))
            out += [f"any{k}" for k in range(r.randint(least, most) if r else least)]
        else:
            out.append(part)
    return out


@pytest.mark.parametrize("markup", [m for m in licenses.TEMPLATES if len(m) > 200])
def test_whole_licenses(markup):
    r, scanner, label = random.Random(1), licenses.Scanner(), licenses.TEMPLATES[markup]
    for how in (None, r, r):
        words = plain(markup, how)
        assert label in scanner.scan("x " + ", ".join(words).title() + " y")["labels"].split(",")
        for cut in (words[:-1], words[: len(words) // 2], words[len(words) // 2 :], words[:12] + ["other"] + words[12:]):
            assert label not in scanner.scan(" ".join(cut))["labels"].split(",")


def test_templates_against_regular_expressions():
    r, words = random.Random(9), "a b c d e".split()

    def pattern(markup):
        bit = lambda p: f"(?:{pattern(p[1:-1])})?" if p[0] == "{" else r"(?:\S+ ){%s,%s}" % tuple(p[1:-1].rpartition(":")[2].split("-")) if p[0] == "<" else p + " "
        return "".join(map(bit, licenses.split_markup(markup)))

    for markup in ("a {b} c", "<x:1-3> a b {c {d} e} <y:2-2> a", "{a b} c <z:0-2> d d", "a a {a} b"):
        scanner = licenses.Scanner({}, {markup: "l"})
        for _ in range(400):
            text = " ".join(r.choice(words) for _ in range(r.randrange(14)))
            assert scanner.scan(text)["labels"] == ("l" if re.search(r"(?:^| )" + pattern(markup), text + " ") else ""), (markup, text)


def test_license_scan_of_long_text():
    found = licenses.Scanner().scan("under the mit license and more " * 150_000)
    assert found["n_base"] == 150_000 and found["last_word"] == 149_999 * 6 and found["n_words"] == 900_000


def test_base_phrases_against_words():
    r = random.Random(2)
    words = "under the mit license apache version 2 cc by nc x".split()
    scanner = licenses.Scanner()
    for _ in range(300):
        w = [r.choice(words) for _ in range(r.randrange(40))]
        places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        found = scanner.scan(r.choice([" ", "-", ". "]).join(w).upper())
        assert found["n_base"] == len(places) and found["n_words"] == len(w)
        assert (found["first_word"], found["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert found["base_labels"] == ",".join(sorted({x for _, x in places}))


def check_mix(rows, by_source):
    sums = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sums[by_source[r.doc_id], r.source_size, r.target] += r.taken
    for (_, _, target), taken in sums.items():
        assert abs(taken - target) <= 0.5 + 1e-6


def test_mixing(spark, docs, none):
    have = mixing.mix_sources(docs)
    rows = [r for r in have.collect() if r.doc_id is not None and r.doc_id not in (9, 20)]
    check = {i: s for i, _, s in ROWS}
    assert Counter(r.size for r in have.collect()) == Counter(len(brute.SPACE.findall(t or "")) for _, t, _ in ROWS)
    targets = {check[r.doc_id]: r.target for r in rows}
    sizes = {check[r.doc_id]: r.source_size for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    free = [s for s in targets if targets[s] < 3 * sizes[s] - 1e-6]
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(targets, key=lambda s: (s is None, s or "")))}
    assert len({round(targets[s] / weight[s], 6) for s in free}) == 1
    assert sorted(map(tuple, have.collect()), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    assert mixing.mix_sources(none).count() == 0
    blank = brute.frame(spark, [(1, None, "a"), (2, " ", None)])
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2
    skewed = brute.frame(spark, [(i, "w " * (500 if i % 7 == 0 else 1), f"s{i % 7}") for i in range(70)])
    check_mix(mixing.mix_sources(skewed).collect(), {i: f"s{i % 7}" for i in range(70)})


def test_mixing_in_ranges(docs, monkeypatch):
    whole = sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str) == whole


def test_suffix_dedup(docs, none):
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert got(suffix_dedup.remove_repeats(docs), *columns) == brute.dedup(ROWS, 400)
    assert got(suffix_dedup.remove_repeats(docs, length=24, gram=5), *columns) == brute.dedup(ROWS, 24)
    assert suffix_dedup.remove_repeats(none).count() == 0
    kept = {r.doc_id: r.kept_text for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    assert kept[3] == "one" and kept[9] == ""


def test_suffix_dedup_of_hot_anchors(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "KINDS", 1)
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert got(suffix_dedup.remove_repeats(docs), *columns) == brute.dedup(ROWS, 400)
    assert got(suffix_dedup.remove_repeats(docs, length=24, gram=5), *columns) == brute.dedup(ROWS, 24)


@pytest.mark.parametrize("kinds", [1, 40_000])
def test_shared_passages(spark, docs, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    columns = "doc_id", "n_shared_words", "n_passages"
    assert got(suffix_dedup.remove_repeats(docs), *columns) == brute.passages(ROWS, 50)
    assert got(suffix_dedup.remove_repeats(docs, passage=7, word_gram=2), *columns) == brute.passages(ROWS, 7)
    r = random.Random(9)
    own, other, new = (" ".join(f"{x}{r.randrange(900)}" for _ in range(n)) for x, n in (("a", 55), ("b", 51), ("c", 300)))
    # Passages of fewer than 400 bytes, in another spelling and spacing, twice in one text, and one that a single text repeats.
    rows = [(1, f"{own} {new}", ""), (2, f"{own.upper()}\n\n{own}", ""), (3, f"{other} x {other}", ""), (4, f"y {own} z {own} y", ""), (5, other, ""), (6, f"{new[:40]} {new[200:]}", "")]
    want = brute.passages(rows, 50)
    assert got(suffix_dedup.remove_repeats(brute.frame(spark, rows)), *columns) == want
    assert [n for _, n, _ in want[1:5]] == [110, 102, 110, 51] and want[0][1] > 55
    alone = [(1, f"{own} x {own}", ""), (2, other, ""), (3, None, "")]
    assert got(suffix_dedup.remove_repeats(brute.frame(spark, alone)), *columns) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]


def test_shared_passages_of_few_words(spark):
    """Many equal strings of a small vocabulary: within rows, across rows, and in equal pieces of one row."""
    r = random.Random(5)
    for _ in range(3):
        base = [r.choice("ab") for _ in range(120)]
        rows = []
        for k in range(14):
            at = r.randrange(80)
            part = base[at : at + r.randrange(5, 40)]
            rows.append((k, " ".join([r.choice("abc") for _ in range(r.randrange(9))] + part + (part if k % 3 == 0 else []) + [r.choice("abcd") for _ in range(r.randrange(9))]), ""))
        columns = "doc_id", "n_shared_words", "n_passages"
        assert got(suffix_dedup.remove_repeats(brute.frame(spark, rows), passage=12, word_gram=4), *columns) == brute.passages(rows, 12)


@pytest.mark.parametrize("at_once", [64, 1 << 21])
def test_positional_transform(monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    r = random.Random(3)
    for _ in range(30):
        base = bytes(r.choice(b"ab") for _ in range(160))
        texts = {bytes(bytearray(base[r.randrange(60) :][: r.randrange(10, 90)]) + bytes(r.choice(b"abc") for _ in range(r.randrange(40)))) for _ in range(9)}
        texts = [t for t in texts if len(t) >= 20]
        rows = sorted((int(h), int(a - f), texts[w][f : e + 20], int(w), int(f)) for arrays in suffix_dedup.anchors(texts, 20, 6) for w, h, a, f, e in zip(*arrays, strict=True))
        assert sum(len(x[2]) - 19 for x in rows) == sum(len(t) - 19 for t in texts)
        if not rows:
            continue
        found = suffix_dedup.repeated_starts(np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), [x[2] for x in rows], 20)
        seen, left = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19)), max(x[1] for x in rows)
        for k, (_, before, piece, w, f) in enumerate(rows):
            for j in range(len(piece) - 19):
                assert found[left - before + j, k] == (seen[texts[w][f + j : f + j + 20]] > 1)


def test_sharding(spark, docs, none):
    rows = sharding.assign_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    slots = defaultdict(list)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.law, r.shard, r.grown_shard) == ("key", brute.jump(key, 24), brute.jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(none).count() == 0


def test_sharding_in_runs_and_many_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 1)
    slots = defaultdict(list)
    for r in sharding.assign_shards(docs, shards=3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    monkeypatch.setattr(sharding, "USUAL_JUMPS", 2)
    keys = spark.range(300).select(F.col("id").cast("string").alias("k"))
    assert all(r.s == brute.jump(r.k, 70) for r in keys.select("k", sharding.jump_shard(F.col("k"), 70).alias("s")).collect())
    assert keys.select(sharding.jump_shard(F.col("k"), 1).alias("s")).distinct().collect()[0].s == 0


def test_slices_keep_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "c", ""]})
    assert [p.num_rows for p in text_slices(batch, max_bytes=12)] == [2, 1, 2]


def test_words_of_slices():
    import pyarrow as pa

    texts = pa.array([t for _, t, _ in ROWS] * 3)
    for start in (0, 1, 8, 9, 30, 100):
        for part in (texts.slice(start), texts.slice(start, 7), texts.slice(start, 0)):
            words, ids, counts = space_words(part)
            flat = iter(words.to_pylist()[i] for i in ids.tolist())
            assert [[next(flat) for _ in range(n)] for n in counts.tolist()] == [brute.SPACE.findall(brute.lower(t)) for t in part.to_pylist()]


def test_many_slices(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 2000)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 3000)
    assert got(ngram_join.ngram_components(docs.coalesce(1)), "doc_id", "n_shingles", "component_id") == brute.ngram_join(ROWS)
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in lm_scoring.score_texts(docs.coalesce(1), held).collect())
    assert have == sorted((str(r[0]), r[2], r[3], round(r[5], 4)) for r in brute.bigrams(ROWS, [brute.crc_mod(i, 10) == 0 for i, *_ in ROWS]))


@pytest.mark.parametrize("name", ["op3_decontamination", "op4_ngram_join", "op5_embedding_dedup", "op7_mixing", "op8_suffix_dedup", "op10_sharding"])
def test_queries_against_sql(spark, name):
    from tallyframe.llm.queries import ORACLE_SQL, QUERIES

    assert spark_rows(QUERIES[name](spark, SF)) == duck(SF, ORACLE_SQL[name])


@pytest.mark.parametrize(("name", "columns"), [("op1_lm_scoring", 7), ("op2_quality", 4), ("op6_licenses", 8), ("op8_suffix_dedup", 7), ("op9_toxicity", 4), ("op10_sharding", 7)])
def test_queries_have_all_rows(spark, name, columns):
    from tallyframe.llm.queries import QUERIES

    df = QUERIES[name](spark, SF)
    assert len(df.columns) == columns and df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_toxicity_takes_time_in_proportion_to_the_text():
    model = toxicity.Grammar()
    text = "you are an idiot. " * 8000
    seconds = []
    for n in (1, 1, 4):
        began = time.perf_counter()
        assert model.score(text * n) > 0.99
        seconds.append(time.perf_counter() - began)
    assert seconds[2] < 10 * min(seconds[:2])  # by the square it would be 16 times as long
    # Clauses are what they are in a plain search, wherever signs stand.
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice([".", "!", "\n", " ", "idiot ", "you ", "moron", "kill ", " them", "x; ", "é"]) for _ in range(r.randrange(30)))
        low = text.lower()
        for begin, end, hits in model.clauses(text) if model.machine or not model.compile() else ():
            assert not set(low[begin:end]) & set(".!?;:\n") and (begin == 0 or low[begin - 1] in ".!?;:\n") and (end == len(low) or low[end] in ".!?;:\n")
            assert hits and all(begin <= at < end for at in hits)
        found = [k for _, _, hits in model.clauses(text) for k in hits]
        assert found == sorted(set(found)) and len(found) == sum(1 for _ in re.finditer(r"(?<![^\W\d_])(?:idiot|moron|kill)(?![^\W\d_])", low))


def test_copies_share_a_rows_weight(spark):
    """A text that stands many times in training is no more evidence than one; different words of near copies count all the same."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghklmnop") for _ in range(7))
    clean = [(i, " ".join(word() for _ in range(40)) + ".") for i in range(600)]
    body = " ".join(word() for _ in range(60))
    copied = [(1000 + i, f"{body} zzyzx quux.") for i in range(150)]
    told = [(2000 + i, f"{' '.join(word() for _ in range(30))}. you are a frobnitz {word()}.") for i in range(150)]
    rows = [*clean, *copied, *told]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit_grammar(docs, labels)
    assert any("frobnitz".startswith(x.rstrip("*")) for x in model.lexemes) and not any(x.startswith(("zzyz", "quux")) for x in model.lexemes)


def test_texts_of_megabytes(spark):
    """One text of 1.5 MB, a copy of its first half and short ones, through the operators that cut texts up."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(190_000)]
    rows = [(1, " ".join(words), "a"), (2, " ".join(words[:95_000]), "a"), (3, "short text", "b"), (4, " ".join(words[:185_000]), "b")]
    big = brute.frame(spark, rows)
    assert got(ngram_join.ngram_components(big), "doc_id", "n_shingles", "component_id") == brute.ngram_join(rows)
    bench = spark.createDataFrame([(1, " ".join(words[100_000:100_020]))], "item_id long, text string")
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert got(decontamination.find_contamination(big, bench), *columns) == brute.contamination(rows, [(1, " ".join(words[100_000:100_020]))])
    held = F.col("doc_id") == 2
    want = sorted(brute.bigrams(rows, [i == 2 for i, *_ in rows]))
    for a, b in zip(sorted(tuple(x) for x in lm_scoring.score_texts(big, held).collect()), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and abs(a[6] - b[6]) <= 7.4e-5 * a[2]
    size = {i: len(t.encode()) for i, t, _ in rows}
    cut = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.remove_repeats(big).collect()}
    assert cut == {1: (size[1], size[4], 1), 2: (size[2], size[2], 1), 3: (10, 0, 0), 4: (size[4], size[4], 1)}
    assert {x.doc_id: x.size for x in mixing.mix_sources(big).collect()} == {1: 190_000, 2: 95_000, 3: 2, 4: 185_000}
    assert {x.doc_id: (x.size, x.text_crc32) for x in sharding.assign_shards(big).collect()} == {i: (size[i] + 8, zlib.crc32(t.encode())) for i, t, _ in rows}
