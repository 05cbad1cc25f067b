"""License scan by template markup (operator 3).

A template is wording with ``<<opt>>...<<end>>`` (may be left out) and
``<<var:LEAST-MOST>>`` (any run of that many words).  It is compiled once into
a token automaton: states are places in the wording, edges are words, free
words or empty moves.  A text is accepted where its words lead from the start
state to the final one, so all mandatory wording must match exactly.

Only places where the template's rarest-looking mandatory phrase (its anchor,
the wording before the first optional or replaceable part) stands are tried.

Words are runs of ``0-9``, ``a-z`` after folding ``A-Z``, and any character
from U+0080 on.  Defined results: a null or empty text has no words, no label
and score 0; repeated rows are scanned one by one; whole texts are read.
``score`` is the share of the text's words that lie in a matched phrase or
template.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import chunks, id_text, small_batches

# fixed values: base phrases and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# parts of the templates: replaceable names of holders, and wording that several templates share
WHO = "<<var:1-12>>"
BSD_OPENING = ("redistribution and use in source and binary forms with or without modification are permitted "
               "provided that the following conditions are met <<opt>> 1 <<end>> <<opt>> a <<end>> "
               "redistributions of source code must retain the above copyright notice this list of conditions and "
               "the following disclaimer <<opt>> 2 <<end>> <<opt>> b <<end>> "
               "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
               "the following disclaimer in the documentation and or other materials provided with the distribution")
BSD_ADVERTISING = ("<<opt>> 3 <<end>> <<opt>> c <<end>> all advertising materials mentioning features or use of this "
                   "software must display the following acknowledgement this product includes software developed by "
                   "<<var:1-20>>")
BSD_NAMES = ("<<opt>> 3 <<end>> <<opt>> 4 <<end>> <<opt>> c <<end>> <<opt>> d <<end>> neither the name <<opt>> s <<end>> "
             f"of {WHO} nor the names of <<opt>> its <<end>> <<opt>> the <<end>> <<opt>> their <<end>> contributors "
             "may be used to endorse or promote products derived from this software without specific prior written "
             "permission")
BSD_DISCLAIMER = (f"this software is provided by {WHO} as is and any express or implied warranties including but not "
                  "limited to the implied warranties of merchantability and fitness for a particular purpose are "
                  f"disclaimed in no event shall {WHO} be liable for any direct indirect incidental special exemplary or "
                  "consequential damages including but not limited to procurement of substitute goods or services loss "
                  "of use data or profits or business interruption however caused and on any theory of liability whether "
                  "in contract strict liability or tort including negligence or otherwise arising in any way out of the "
                  "use of this software even if advised of the possibility of such damage")


def gnu(name: str, version: str) -> str:
    """Notice of a GNU licence; how the work is passed on (licensed, released, ...) is free."""
    return (f"under the <<opt>> terms of <<opt>> version {version} of <<end>> the <<end>> gnu {name} public license "
            "<<opt>> as published by the free software foundation <<end>> <<opt>> either <<end>> <<opt>> version <<end>> "
            f"<<opt>> v <<end>> {version} <<opt>> 0 <<end>> <<opt>> of the license <<end>> <<opt>> or <<opt>> at your "
            "option <<end>> any later version <<end>> <<opt>> or later <<end>>").replace("  ", " ")


# wording of well-known public licences and notices, as templates
TEMPLATES = {
    "mit": "under the mit license <<opt>> see <<var:1-8>> for details <<end>>",  # passed on in any way: the base label
    "mit-notice": "licensed under the mit license <<opt>> see <<var:1-8>> for details <<end>>",
    "apache-2-notice": ("under the apache license version 2 <<opt>> 0 <<end>> <<opt>> the license <<end>> "
                        "<<opt>> you may not use this file except in compliance with the license <<end>>"),
    "cc-by-nc-notice": ("under <<opt>> a <<end>> <<opt>> the <<end>> <<opt>> creative commons <<end>> "
                        "<<opt>> attribution noncommercial <<end>> cc by nc <<opt>> <<var:1-2>> <<end>> "
                        "<<opt>> international <<end>> <<opt>> license <<end>>"),
    "gpl-2-notice": gnu("general", "2"),
    "gpl-3-notice": gnu("general", "3"),
    "lgpl-2.1-notice": gnu("lesser general", "2 1"),
    "lgpl-3-notice": gnu("lesser general", "3"),
    "agpl-3-notice": gnu("affero general", "3"),
    "mpl-2-notice": ("mozilla public license <<opt>> version <<end>> <<opt>> v <<end>> 2 0 <<opt>> if a copy of the mpl was not "
                     "distributed with this file you can obtain one at <<var:1-8>> <<end>>"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of "
                 "<<var:1-8>> and associated documentation files <<opt>> the software <<end>> to deal in the software "
                 "without restriction including without limitation the rights to use copy modify merge publish "
                 "distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                 "furnished to do so subject to the following conditions the above copyright notice and this permission "
                 "notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial "
                 "portions of the software the software is provided as is without warranty of any kind express or implied "
                 "including but not limited to the warranties of merchantability fitness for a particular purpose and "
                 f"noninfringement in no event shall {WHO} be liable for any claim damages or other liability whether "
                 "in an action of contract tort or otherwise arising from out of or in connection with the software or the "
                 "use or other dealings in the software"),
    "isc-text": ("permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with "
                 "or without fee is hereby granted provided that the above copyright notice and this permission "
                 f"notice appear in all copies the software is provided as is and {WHO} disclaims all warranties with regard "
                 "to this software including all implied warranties of merchantability and fitness in no event shall "
                 f"{WHO} be liable for any special direct indirect or consequential damages or any damages whatsoever "
                 "resulting from loss of use data or profits whether in an action of contract negligence or other "
                 "tortious action arising out of or in connection with the use or performance of this software"),
    "bsd-2-clause-text": f"{BSD_OPENING} {BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{BSD_OPENING} {BSD_NAMES} {BSD_DISCLAIMER}",
    "bsd-4-clause-text": f"{BSD_OPENING} {BSD_ADVERTISING} {BSD_NAMES} {BSD_DISCLAIMER}",
}

WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
                   else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


class Automaton:
    """Token automaton of one template; ``longest(words, at)`` is the end of the longest match from ``at``, or -1."""

    def __init__(self, template: str) -> None:
        self.edges: list[dict[bytes, int]] = [{}]
        self.free: dict[int, int] = {}
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        anchor: list[bytes] = []
        anchoring = True
        for part in re.findall(r"<<[^>]*>>|[^\s<]+", template):
            if part == "<<opt>>":
                opened.append(len(self.edges) - 1)
                anchoring = False
            elif part == "<<end>>":
                self.skips.setdefault(opened.pop(), []).append(len(self.edges) - 1)
            elif part.startswith("<<var:"):
                anchoring = False
                least, most = map(int, part[6:-2].split("-"))
                short = len(self.edges) - 1 + least
                for _ in range(most):
                    self.free[len(self.edges) - 1] = len(self.edges)
                    self.edges.append({})
                last = len(self.edges) - 1
                for state in range(short, last):
                    self.skips.setdefault(state, []).append(last)
            else:
                word = part.encode()
                if anchoring:
                    anchor.append(word)
                self.edges[-1][word] = len(self.edges)
                self.edges.append({})
        if not anchor:
            raise ValueError("a template must begin with mandatory wording")
        self.anchor = b" " + b" ".join(anchor) + b" "
        self.final = len(self.edges) - 1
        self.start = self.close({0})

    def close(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def longest(self, words: list[bytes], at: int) -> int:
        states, end = self.start, at if self.final in self.start else -1
        for i in range(at, len(words)):
            step = {t for s in states if (t := self.edges[s].get(words[i])) is not None}
            step |= {self.free[s] for s in states if s in self.free}
            if not step:
                break
            states = self.close(step)
            if self.final in states:
                end = i + 1
        return end


@lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word indices at which the blank-padded phrase stands in the blank-padded line; places may overlap."""
    out, at, words, counted = [], line.find(phrase), 0, 0
    while at >= 0:
        words += line.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = line.find(phrase, at + 1)
    return out


def scan_text(text: str | None, templates: list[tuple[str, Automaton]], phrases: dict[str, str] = PHRASES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base, labels, covered = set(), set(), set()
    for phrase, label in phrases.items():
        if found := places(line, b" " + phrase.encode() + b" "):
            starts += found
            base.add(label)
            n = phrase.count(" ") + 1
            covered.update(i for s in found for i in range(s, s + n))
    for label, automaton in templates:
        for s in places(line, automaton.anchor):
            if (end := automaton.longest(words, s)) > s:
                labels.add(label)
                covered.update(range(s, end))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), len(covered) / len(words) if words else 0.0)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``."""
    fixed = tuple(sorted(templates.items()))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def work(batches):
        made = compiled(fixed)
        for b in chunks(batches):
            rows = [scan_text(t, made, phrases) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                names=["doc_id", *names])

    return small_batches(id_text(docs)).mapInArrow(
        work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
