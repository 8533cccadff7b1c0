"""License scans by template markup.

A template is license wording with {optional words} and <name:least-most> for replaceable words.
It is compiled into a token automaton, which accepts exactly the texts that have the mandatory
wording word for word. Base phrases are templates without either kind of region.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The wording of public licenses and notices, in template markup. First whole licenses and headers, of which no part passes, then notices that are one sentence by themselves.
MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
{the software} to deal in the software without restriction including without limitation the rights to use copy modify merge publish
distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice {including the next paragraph} shall be included in
all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
shall <holders:2-12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
from out of or in connection with the software or the use or other dealings in the software
"""
ISC = """
permission to use copy modify and {or} distribute this software for any purpose with or without fee is hereby granted provided that
the above copyright notice and this permission notice appear in all copies the software is provided as is and <holders:1-12>
disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event
shall <holders:1-12> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss
of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the
use or performance of this software
"""
BSD_CONDITIONS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
are met {1} redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer {2} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution
"""
BSD_NAMES = """
{3} neither the name of <holder:1-12> nor the names of {its} <contributors:1-2> may be used to endorse or promote products derived from
this software without specific prior written permission
"""
BSD_DISCLAIMER = """
this software is provided by <holders:1-12> as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <holders:1-12> be liable for any
direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
possibility of such damage
"""
UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs
and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited
to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software
"""
APACHE_HEADER = """
licensed under the apache license version 2 0 {the license} you may not use this file except in compliance with the license you may
obtain a copy of the license at {http} {https} www apache org licenses license 2 0 {html} unless required by applicable law or agreed
to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
either express or implied see the license for the specific language governing permissions and limitations under the license
"""
GPL_HEADER = """
<what:1-6> is free software you can redistribute it and or modify it under the terms of the gnu {lesser} {affero} general public
license as published by the free software foundation either version <version:1-2> of the license or at your option any later version
<what:1-6> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu {lesser} {affero} general public license for more details
"""
MPL_HEADER = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at {http} {https} {www} mozilla org mpl 2 0
"""
TEMPLATES = {
    MIT: "mit-text",
    ISC: "isc-text",
    BSD_CONDITIONS + BSD_DISCLAIMER: "bsd-2-clause-text",
    BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER: "bsd-3-clause-text",
    UNLICENSE: "unlicense-text",
    APACHE_HEADER: "apache-2.0-header",
    GPL_HEADER: "gpl-header",
    MPL_HEADER: "mpl-2.0-header",
    "{<what:1-4> is} {released} {licensed} {distributed} under the {terms of the} mit license": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under {a} {the} {creative commons} cc by nc <version:1-2>": "cc-by-nc-notice",
    "this work is licensed under {a} {the} creative commons <terms:1-6> {<version:1-2>} {international} license": "creative-commons-notice",
    "licensed under the gnu {lesser} {affero} general public license version <version:1-2>": "gpl-notice",
    "spdx license identifier <id:1-4>": "spdx-tag",
    "copyright {c} <year:1-2> <holder:1-6> all rights reserved": "all-rights-reserved",
}

#: What a place counts in the score: words of a method's template are surer than a base phrase alone.
TEMPLATE_SCORE, BASE_SCORE = 1.0, 0.8

#: Bytes that part words become spaces, A-Z becomes a-z; all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Arc:
    to: int
    word: str | None = None
    empty: bool = False


@dataclass
class TokenAutomaton:
    """States with arcs for a word, any word (word None) or nothing (empty); the last state accepts."""

    label: str
    arcs: list[list[Arc]] = field(default_factory=lambda: [[]])

    def _state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def add(self, at: int, markup: str) -> int:
        """Append compiled markup to state `at`; returns the state behind it."""
        for part in split_markup(markup):
            if part.startswith("{"):
                end = self.add(at, part[1:-1])
                self.arcs[at].append(Arc(end, empty=True))
                at = end
            elif part.startswith("<"):
                least, most = map(int, part[1:-1].rpartition(":")[2].split("-"))
                skips = []
                for n in range(most):
                    if n >= least:
                        skips.append(at)
                    nxt = self._state()
                    self.arcs[at].append(Arc(nxt))
                    at = nxt
                for s in skips:
                    self.arcs[s].append(Arc(at, empty=True))
            else:
                nxt = self._state()
                self.arcs[at].append(Arc(nxt, part))
                at = nxt
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for arc in self.arcs[todo.pop()]:
                if arc.empty and arc.to not in out:
                    out.add(arc.to)
                    todo.append(arc.to)
        return out

    def longest(self, words: list[str], at: int) -> int:
        """How many words from `at` on the automaton accepts at most; 0 if it accepts none."""
        states, best, final = self.closure({0}), 0, len(self.arcs) - 1
        for n, word in enumerate(words[at:] if at else words, 1):
            states = self.closure({a.to for s in states for a in self.arcs[s] if not a.empty and a.word in (None, word)})
            if not states:
                break
            if final in states:
                best = n
        return best


def split_markup(markup: str) -> list[str]:
    parts, depth, start = [], 0, 0
    markup = " ".join(markup.split())
    for i, c in enumerate(f"{markup} "):
        depth += (c in "{<") - (c in "}>")
        if c == " " and not depth:
            if markup[start:i]:
                parts.append(markup[start:i])
            start = i + 1
    return parts


def compile_template(markup: str, label: str) -> TokenAutomaton:
    automaton = TokenAutomaton(label)
    automaton.add(0, markup)
    return automaton


def mandatory_run(markup: str) -> tuple[str, int]:
    """The longest run of mandatory words, and how many words may stand before it at most."""
    best, run, before, seen = ("", 0), [], 0, 0
    for part in [*split_markup(markup), "{}"]:
        if part[0] in "{<":
            if len(" ".join(run)) > len(best[0]):
                best = (" ".join(run), before)
            words = re.sub(r"<[^>]*?(\d+)-(\d+)>", lambda m: "x " * int(m[2]), part.strip("{}"))
            seen, run = seen + len(run) + len(words.split()), []
            before = seen
        else:
            run.append(part)
    return best


class Scanner:
    """All templates together; a text is searched for a template's mandatory words first, and its automaton runs only where they stand."""

    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> None:
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]
        self.templates = [(f" {run} ".encode(), back, compile_template(markup, label)) for markup, label in templates.items() for run, back in [mandatory_run(markup)]]

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
        line = b" " + b" ".join(words) + b" "
        blanks: list[np.ndarray] = []  # found once, by texts that have something to place

        def place(at: int) -> int:
            """The number of the word behind a blank."""
            if not blanks:
                blanks.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32))
            return int(np.searchsorted(blanks[0], at))

        places = []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append((place(at), label))
                at = line.find(phrase, at + 1)
        found: dict[tuple[int, int], set[str]] = {}
        for run, back, automaton in self.templates:
            at, done = line.find(run), 0
            while at >= 0:
                first = place(at)
                # The earliest start from which the template holds this run; a later place starts behind it.
                for start in range(max(done, first - back), first + 1):
                    near = [w.decode("utf-8", "surrogatepass") for w in words[start : start + len(automaton.arcs)]]
                    if (n := automaton.longest(near, 0)) and start + n > first:
                        found.setdefault((start, start + n), set()).add(automaton.label)
                        done = start + n
                        break
                at = line.find(run, at + 1)
        labels = {x for v in found.values() for x in v}
        base_labels = {label for _, label in places}
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places)[0] if places else None,
            "last_word": max(places)[0] if places else None,
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | labels)),
            "score": TEMPLATE_SCORE if labels else BASE_SCORE if places else 0.0,
            "spans": [{"first": a, "end": b, "label": x} for (a, b), v in sorted(found.items()) for x in sorted(v)],
        }


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, end: long, label: string>>"


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and what the scan finds in each whole text: counts, labels, score and the spans of accepted templates.

    A null or empty text has no words and no labels; texts of any length are scanned whole, in time
    in proportion; repeated rows give equal results; an empty table gives an empty one; other columns
    don't matter, whatever their names.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        kinds = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))])
        for b in batches:
            rows = pa.RecordBatch.from_pylist([scanner.scan(t.as_py()) for t in b["text"]], schema=kinds)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *rows.columns], names=["doc_id", *kinds.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {RESULT}")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_licenses": op6_licenses}
ORACLE_SQL: dict[str, str] = {}
