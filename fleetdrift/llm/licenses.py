"""License scan by template markup compiled to token automata.

A template is mandatory wording with optional regions ``[[ ... ]]`` and
replaceable regions ``<<most>>`` (one to ``most`` words).  It compiles to an
automaton over word hashes.  A stretch of a text is accepted if every mandatory
word stands exactly where the template wants it.

Defined cases: null and empty texts have no words and no labels; a stretch may
be accepted by several templates; places of base phrases all count, also if
they repeat; no part of a text is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetdrift.llm.textarrays import LOWER, NOT_ALNUM, span_hashes, steps, utf8, windows, word_spans

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Conditions and disclaimer that the BSD licences share.
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met [[1]] redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the "
    "above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution"
)
_BSD_DISCLAIMER = (
    "this software is provided by <<8>> as is and any express or implied warranties including but not limited to the "
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<8>> "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
    "to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)

# Notices and licence texts by their public wording, as templates.
TEMPLATES = (
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("CC-BY-NC-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0 [[international]] [[license]]"),
    ("CC-BY-SA-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0 [[international]] [[license]]"),
    ("CC-BY-4.0", "licensed under [[a]] [[creative commons]] cc by 4 0 [[international]] [[license]]"),
    ("GPL-2.0", "<<3>> is licensed under the [[terms of the]] gnu general public license version 2 [[or later]]"),
    ("GPL-3.0", "<<3>> is licensed under the [[terms of the]] gnu general public license version 3 [[or later]]"),
    ("MIT-notice", "<<3>> under the [[terms of the]] mit license"),
    (
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies "
        "or substantial portions of the software the software is provided as is without warranty of any kind express or "
        "implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall [[the]] <<8>> be liable for any claim damages or other liability whether in "
        "an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
    ),
    (
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and <<4>> disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall <<4>> be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of "
        "this software",
    ),
    ("BSD-2-Clause", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    (
        "BSD-3-Clause",
        f"{_BSD_CONDITIONS} [[3]] neither the name of <<8>> nor the names of <<4>> contributors may be used to "
        f"endorse or promote products derived from this software without specific prior written permission {_BSD_DISCLAIMER}",
    ),
    (
        "Zlib",
        "this software is provided as is without any express or implied warranty in no event will the <<3>> be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
        "following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you "
        "wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not "
        "be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source "
        "distribution",
    ),
)
#: Score of a text with a template's whole wording, with a base phrase only, and of others.
WHOLE, PHRASE_ONLY, NOTHING = 1.0, 0.5, 0.0


def _tokens(template: str) -> list[str]:
    for mark in ("[[", "]]", "<<"):
        template = template.replace(mark, f" {mark} ")
    return template.replace(">>", " ").split()


def compile_template(template: str, word_hash: Callable[[str], int]) -> dict:
    """Automaton: per state the moves by a word (hash or None for any word) and the free moves."""
    moves: list[list[tuple[int | None, int]]] = [[]]
    free: list[set[int]] = [set()]
    opened: list[int] = []
    tokens = _tokens(template)
    i = 0

    def state() -> int:
        moves.append([])
        free.append(set())
        return len(moves) - 1

    at = 0
    while i < len(tokens):
        if tokens[i] == "[[":
            opened.append(at)
        elif tokens[i] == "]]":
            free[opened.pop()].add(at)
        elif tokens[i] == "<<":
            i += 1
            ends = []
            for _ in range(int(tokens[i])):
                new = state()
                moves[at].append((None, new))
                at = new
                ends.append(at)
            for e in ends[:-1]:
                free[e].add(at)
        else:
            new = state()
            moves[at].append((word_hash(tokens[i]), new))
            at = new
        i += 1
    return {"moves": moves, "free": free, "final": at}


def _closure(states: set[int], free: list[set[int]]) -> set[int]:
    todo = list(states)
    states = set(states)
    while todo:
        for s in free[todo.pop()]:
            if s not in states:
                states.add(s)
                todo.append(s)
    return states


def accepts_at(automaton: dict, words: np.ndarray, first: int) -> bool:
    """Whether a stretch beginning at word ``first`` is accepted."""
    moves, free, final = automaton["moves"], automaton["free"], automaton["final"]
    states = _closure({0}, free)
    for i in range(first, len(words) + 1):
        if final in states:
            return True
        if not states or i == len(words):
            return False
        word = int(words[i])
        states = _closure({to for s in states for by, to in moves[s] if by is None or by == word}, free)
    return False


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NOT_ALNUM)
    return span_hashes(data, starts, ends)


def _anchor(template: str) -> tuple[str, int, int]:
    """The first run of two mandatory words, and the least and most words before it."""
    least = most = depth = 0
    tokens = _tokens(template)
    for i, t in enumerate(tokens):
        if t == "[[":
            depth += 1
        elif t == "]]":
            depth -= 1
        elif t == "<<" or (i and tokens[i - 1] == "<<"):
            if t != "<<":
                least, most = least + (depth == 0), most + int(t)
        else:
            if depth == 0 and i + 1 < len(tokens) and tokens[i + 1] not in ("[[", "]]", "<<"):
                return f"{t} {tokens[i + 1]}", least, most
            least, most = least + (depth == 0), most + 1
    raise ValueError("a template needs two mandatory words in a row")


def _scan(fields: list[str]) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(windows(h := _hashes(p), len(h))[0], len(h), label) for p, label in PHRASES]
        automata = []
        for label, template in TEMPLATES:
            anchor, least, most = _anchor(template)
            automaton = compile_template(template, lambda w: int(_hashes(w)[0]))
            automata.append((label, automaton, windows(_hashes(anchor), 2)[0], least, most))
        sizes = sorted({n for _, n, _ in phrases} | {2})
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n_words, n_base, first_word, last_word, base_labels, labels, score = [], [], [], [], [], [], []
            for first, last in steps(offsets):
                part = LOWER[data[offsets[first] : offsets[last]]]
                starts, ends, own = word_spans(part, offsets[first : last + 1] - offsets[first], NOT_ALNUM)
                hashes = span_hashes(part, starts, ends)
                runs = {n: windows(hashes, n) for n in sizes}
                text_of = np.repeat(np.arange(last - first), np.diff(own))
                places = [[] for _ in range(last - first)]
                named = [set() for _ in range(last - first)]
                for code, n, label in phrases:
                    at = np.flatnonzero(runs[n] == code)
                    at = at[text_of[at] == text_of[at + n - 1]]
                    for i in at:
                        places[text_of[i]].append(int(i - own[text_of[i]]))
                        named[text_of[i]].add(label)
                found = [set() for _ in range(last - first)]
                for label, automaton, code, least, most in automata:
                    at = np.flatnonzero(runs[2] == code)
                    for i in at[text_of[at] == text_of[at + 1]]:
                        t = text_of[i]
                        if label in found[t]:
                            continue
                        own_words = hashes[own[t] : own[t + 1]]
                        place = i - own[t]
                        if any(accepts_at(automaton, own_words, p) for p in range(max(0, place - most), place - least + 1)):
                            found[t].add(label)
                n_words += np.diff(own).tolist()
                n_base += [len(p) for p in places]
                first_word += [min(p, default=None) for p in places]
                last_word += [max(p, default=None) for p in places]
                base_labels += [",".join(sorted(x)) for x in named]
                labels += [",".join(sorted(x | y)) for x, y in zip(named, found, strict=True)]
                score += [WHOLE if y else PHRASE_ONLY if x else NOTHING for x, y in zip(named, found, strict=True)]
            made = [
                pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first_word, pa.int64()),
                pa.array(last_word, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()),
                pa.array(score, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in fields], *made], [*fields, *RESULT])

    return scan


RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_TYPES = ["long", "long", "long", "long", "string", "string", "double"]


def scan_licenses(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every document with the words, base places, labels and score of its text."""
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    schema += [f"{n} {t}" for n, t in zip(RESULT, _TYPES, strict=True)]
    return docs.select("text", *keep).mapInArrow(_scan(keep), ", ".join(schema))


def _sql_pattern(template: str) -> str:
    """A template as a regular expression over words that each follow one blank."""
    out, tokens = [], _tokens(template)
    for i, t in enumerate(tokens):
        if t == "[[":
            out.append("(?:")
        elif t == "]]":
            out.append(")?")
        elif i and tokens[i - 1] == "<<":
            out.append(f"(?: [^ ]+){{1,{t}}}")
        elif t != "<<":
            out.append(f" {t}")
    return "".join(out) + "(?: |$)"


def _sql_places(phrase: str) -> str:
    same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_filter(range(1, len(words) + 1), lambda i: {same})"


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LICENSES_SQL = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), placed AS (
  SELECT doc_id, words, array_to_string(list_prepend('', words), ' ') AS line,
    {", ".join(f"{_sql_places(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))} FROM split
), judged AS (
  SELECT doc_id, len(words) AS n_words, {" || ".join(f"p{k}" for k in range(len(PHRASES)))} AS places,
    list_filter([{", ".join(f"if(len(p{k}) > 0, '{label}', NULL)" for k, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS base,
    list_filter([{", ".join(f"if(regexp_matches(line, '{_sql_pattern(t)}'), '{label}', NULL)" for label, t in TEMPLATES)}], lambda x: x IS NOT NULL) AS found
  FROM placed
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || found)), ',') AS labels,
  CAST(CASE WHEN len(found) > 0 THEN {WHOLE} WHEN len(base) > 0 THEN {PHRASE_ONLY} ELSE {NOTHING} END AS DOUBLE) AS score
FROM judged
"""
