"""License scans by template-markup matching.

A template is licence wording with markup: plain words are mandatory, ``[...]`` is optional (words in it may be ``a|b``),
``{n}`` stands for up to n words of any kind (names, years, versions) and ``(a|b)`` for one of some words. Each compiles to
a token automaton, a list of states with word edges and empty edges. Candidate places are those where two neighbouring
words can be the first two that the automaton takes; there it runs over the text's words and accepts if all mandatory
wording matches exactly, in order. Optional and free parts before the first mandatory word and behind the last one change
nothing and are left out; a template without mandatory words is an error.

Base labels come from four fixed phrases, the templates' labels are added to them. The score is 1 if a template
accepts, otherwise the largest share of mandatory words that any run got through (0.5 at least where a phrase occurs,
below 1 in any case), and 0 without either.

Edge cases: null and empty texts have no words, labels or places; overlapping places all count, and all templates that
accept give their labels (ties); repeated rows are scanned one by one; texts of any length are scanned whole, one longer
than a chunk alone; null ids are kept; an empty table gives an empty result; other columns are ignored. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm._tokens import ALNUM, Words, chunks, word_hash
from querylens.sources.scratch import spread

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
 conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following
 disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
 disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by {8} as is and any express or implied warranties including but not limited to the
 implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {8} be liable for any direct
 indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
 loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability
 or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""

# Wording of public licences and notices; words as the scanner sees them (lower case, split at punctuation).
TEMPLATES = {
    "mit-notice": "(released|licensed|distributed|available) under [the terms of] the mit license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this {6} to deal in the {4} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this {6} to deal in the {4} without restriction
 including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {4} and to permit
 persons to whom the {4} is furnished to do so subject to the following conditions the above copyright notice and this permission notice
 [including the next paragraph] shall be included in all copies or substantial portions of the {4} the {4} is provided as is without
 warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
 noninfringement in no event shall the {6} be liable for any claim damages or other liability whether in an action of contract tort or
 otherwise arising from out of or in connection with the {4} or the use or other dealings in the {4}""",
    "apache-2.0": "licensed under the apache license [version] 2 0 [the license]",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this {3} except in compliance with the license",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this {3} except in compliance with the license you
 may obtain a copy of the license at (http|https) www apache org licenses license 2 0 [txt|html] unless required by applicable law or agreed
 to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
 express or implied see the license for the specific language governing permissions and limitations under the license""",
    "gpl-notice": "licensed under the gnu general public license [version] (2|3)",
    "gpl": "this (program|software|work|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [either] version (2|3) [of the license] [or at your option any later version]",
    "gpl-header": """this (program|software|work|library) is free software you can redistribute it and or modify it under the terms of the gnu general
 public license as published by the free software foundation [either] version (2|3) [of the license] [or at your option any later version]
 this (program|software|work|library) is distributed in the hope that it will be useful but without any warranty without even the implied
 warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "cc-by-variant": "licensed under [a] cc by (nc|sa|nd) [sa|nd] (1|2|3|4) 0",
    "cc-by-4.0": "licensed under [a] cc by (1|2|3|4) 0",
    "cc-by-long": "licensed under [a] creative commons attribution {3} (1|2|3|4) 0 [international|unported] [license]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} [3] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "isc": """permission to use copy modify [and] [or] distribute this software for any purpose with or without fee is hereby granted provided
 that the above copyright notice and this permission notice appear in all copies the software is provided as is and {4} disclaims all
 warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {4} be liable for
 any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an
 action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
 this file you can obtain one at (http|https) mozilla org mpl 2 0""",
}

_PART = re.compile(r"\[([^\]\[]*)\]|\{(\d+)\}|\(([^)(]*)\)|([^\s\[\]{}()]+)")


class Automaton:
    """States 0..n; ``words[s]`` are (word hash or None for any, next state, mandatory words passed), ``skips[s]`` empty edges."""

    def __init__(self, template: str):
        self.words: list[list[tuple[int | None, int, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.mandatory = 0
        parts = _PART.findall(template)
        needed = [k for k, (optional, free, _, _) in enumerate(parts) if not optional and not free]
        if not needed:
            raise ValueError(f"a template needs a mandatory word: {template!r}")
        for optional, free, choice, word in parts[needed[0] : needed[-1] + 1]:
            if optional:
                begin = len(self.words) - 1
                for x in optional.split():
                    self._edge({word_hash(y.encode()) for y in x.split("|")}, 0)
                self.skips[begin].append(len(self.words) - 1)
            elif free:
                ends = []
                for _ in range(int(free)):
                    ends.append(len(self.words) - 1)
                    self._edge({None}, 0)
                for e in ends:
                    self.skips[e].append(len(self.words) - 1)
            else:
                self.mandatory += 1
                self._edge({word_hash(x.encode()) for x in (choice.split("|") if choice else [word])}, 1)
        self.final = len(self.words) - 1
        # What can come first, and with it what can come second: None for any word, "" for the end.
        self.first: dict[int, set] = {}
        for x, t, _ in self.words[0]:
            self.first[x] = {y for u in self._closed({t: 0}) for y, _, _ in self.words[u]} | ({""} if self.final in self._closed({t: 0}) else set())

    def starts(self, w: Words) -> np.ndarray:
        """Word indices at which the first two words that the automaton takes can stand."""
        h, owner = w.hash, w.docs()
        at = [np.zeros(0, dtype=np.int64)]
        for x, seconds in self.first.items():
            here = np.flatnonzero(h == np.uint64(x))
            if not seconds & {None, ""}:
                here = here[here + 1 < len(h)]
                here = here[(owner[here] == owner[here + 1]) & np.isin(h[here + 1], np.array(sorted(seconds), dtype=np.uint64))]
            at.append(here)
        return np.sort(np.concatenate(at))

    def _edge(self, options, counts: int) -> None:
        here = len(self.words) - 1
        self.words.append([])
        self.skips.append([])
        self.words[here] += [(x, here + 1, counts) for x in options]

    def _closed(self, states: dict[int, int]) -> dict[int, int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.skips[s]:
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def run(self, words: list[int]) -> float:
        """1.0 if a prefix of ``words`` is accepted, else the largest share of mandatory words passed."""
        now, best = self._closed({0: 0}), 0
        for w in words:
            after: dict[int, int] = {}
            for s, passed in now.items():
                for x, t, counts in self.words[s]:
                    if (x is None or x == w) and after.get(t, -1) < passed + counts:
                        after[t] = passed + counts
            now = self._closed(after)
            if not now:
                break
            best = max(best, *now.values())
            if self.final in now:
                return 1.0
        return min(best / self.mandatory, 0.999)

    @property
    def longest(self) -> int:
        return len(self.words)


def places(h: np.ndarray, owner: np.ndarray, sequence: list[set[int]]) -> np.ndarray:
    """Word indices where words of the given sets stand consecutively in one text."""
    n = len(h) - len(sequence) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.isin(h[:n], np.array(sorted(sequence[0]), dtype=np.uint64)))
    at = at[owner[at] == owner[at + len(sequence) - 1]]
    for k, options in enumerate(sequence[1:], 1):
        at = at[np.isin(h[at + k], np.array(sorted(options), dtype=np.uint64))]
    return at


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    wording = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        phrases = [([{word_hash(w.encode())} for w in p.split()], label) for p, label in PHRASES.items()]
        automata = [(label, Automaton(t)) for label, t in wording.items()]
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1)):
                w = Words(data, offsets, ALNUM)
                h, owner, docs = w.hash, w.docs(), j - i
                n_base, low, high = np.zeros(docs, dtype=np.int64), np.full(docs, np.iinfo(np.int64).max), np.full(docs, -1)
                base: dict[int, set] = {}
                more: dict[int, set] = {}
                score: dict[int, float] = {}
                for sequence, label in phrases:
                    at = places(h, owner, sequence)
                    doc, word = owner[at], at - w.first[owner[at]]
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(low, doc, word)
                    np.maximum.at(high, doc, word)
                    for d in np.unique(doc).tolist():
                        base.setdefault(d, set()).add(label)
                        score[d] = max(score.get(d, 0.0), 0.5)
                for label, a in automata:
                    for p in a.starts(w).tolist():
                        d = int(owner[p])
                        got = a.run(h[p : min(p + a.longest, int(w.first[d + 1]))].tolist())
                        score[d] = max(score.get(d, 0.0), got)
                        if got == 1.0:
                            more.setdefault(d, set()).add(label)
                some = n_base > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, docs), pa.array(w.counts), pa.array(n_base), pa.array(low, mask=~some), pa.array(high, mask=~some),
                        pa.array([",".join(sorted(base.get(d, ()))) for d in range(docs)], pa.string()),
                        pa.array([",".join(sorted(base.get(d, set()) | more.get(d, set()))) for d in range(docs)], pa.string()),
                        pa.array([score.get(d, 0.0) for d in range(docs)], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
