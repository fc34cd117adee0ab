"""License scan with a positional index of rare words.

A licence template has a text and mandatory phrases in order. The index posts
each phrase under its rarest words (``ANCHORS``, by the documents of the corpus
that hold them), with their positions in it. A file looks its licence words up
from the highest IDF down: a phrase is met under its rarest word, the starts
that each of its posted words proposes are intersected, and the phrase is
verified in whole where all agree. A file that lacks a phrase's rarest word never
looks at that phrase, and one that has the phrase has all its words in place, so
none is missed. A template counts if all its phrases stand in order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
# The base phrases with their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: So many of a phrase's rarest words are posted.
ANCHORS = 3
# Fixed values: (label, mandatory phrases in order, the licence's text or its usual notice), lower case, without punctuation.
TEMPLATES = (
    ("gpl", ("gnu general public license",), "this work is licensed under the gnu general public license version"),
    ("gpl", ("free software you can redistribute it", "gnu general public license as published by the free software foundation", "without any warranty"), """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu general public license for more details"""),
    ("lgpl", ("gnu lesser general public license",), "licensed under the gnu lesser general public license version"),
    ("agpl", ("gnu affero general public license",), "licensed under the gnu affero general public license version"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0"),
    ("apache", ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "on an as is basis"), """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain
        a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license"""),
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge", "to deal in the software without restriction", "shall be included in all copies or substantial portions of the software"), """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
        and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the
        above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is
        provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for
        a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software"""),
    ("cc-by", ("cc by",), "licensed under cc by"),
    ("cc-by", ("creative commons attribution",), "licensed under a creative commons attribution"),
    ("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
    ("cc-by-nc", ("creative commons attribution noncommercial",), "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    ("cc-by-sa", ("creative commons attribution sharealike",), "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", ("cc by nd",), "licensed under cc by nd 4 0"),
    ("cc0", ("cc0 1 0",), "cc0 1 0 universal"),
    ("bsd", ("bsd license",), "released under the bsd license"),
    ("bsd", ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions in binary form must reproduce the above copyright notice", "in no event shall the copyright"), """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors
        as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
        special exemplary or consequential damages"""),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "appear in all copies"), """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties
        with regard to this software"""),
    ("zlib", ("without any express or implied warranty", "the origin of this software must not be misrepresented", "may not be removed or altered from any source distribution"), """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
        from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
        alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must
        not claim that you wrote the original software 2 altered source versions must be plainly marked as such and must not be misrepresented as
        being the original software 3 this notice may not be removed or altered from any source distribution"""),
    ("bsl", ("boost software license",), "distributed under the boost software license version 1 0"),
    ("mpl", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    ("epl", ("eclipse public license",), "made available under the terms of the eclipse public license"),
    ("unlicense", ("free and unencumbered software", "released into the public domain"), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 ``text``: digits, letters, and all beyond ASCII; A-Z lowered."""
    return WORDS.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Phrase:
    """A mandatory phrase as posted: its words, and the places in it of the rarest ones, the rarest first."""

    words: tuple[bytes, ...]
    anchors: tuple[int, ...]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]
    at: tuple[int, ...]  # where each phrase begins in the words


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().split())


def templates() -> list[Template]:
    out = []
    for label, phrases, text in TEMPLATES:
        words, found, low = _words(text), [], 0
        for phrase in map(_words, phrases):
            low = next(i for i in range(low, len(words)) if words[i : i + len(phrase)] == phrase)
            found.append(low)
            low += len(phrase)
        out.append(Template(label, words, tuple(map(_words, phrases)), tuple(found)))
    return out


def every_phrase() -> list[tuple[bytes, ...]]:
    """All mandatory phrases of templates and the base phrases, each once."""
    return list(dict.fromkeys([_words(p) for _, p in BASE] + [p for t in templates() for p in t.phrases]))


def vocabulary() -> set[bytes]:
    return {w for p in every_phrase() for w in p}


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and for each word of a mandatory phrase in how many it stands."""
    known = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                found.update(known.intersection(words_of(text)))
        items = [("", n), *((w.decode(), c) for w, c in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.string()), pa.array([c for _, c in items], pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("data")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    by = {r["word"]: r["n"] for r in counted.collect()}  # at most a row for each word of the phrases
    total = by.pop("", 0)
    return total, {w.encode(): n for w, n in by.items()}


def build_index(total: int, frequencies: dict[bytes, int]) -> tuple[dict[bytes, list[Phrase]], dict[bytes, float]]:
    """Phrases by their rarest word, and the words' IDF."""
    idf = {w: math.log((total + 1) / (frequencies.get(w, 0) + 1)) for w in vocabulary()}
    index: dict[bytes, list[Phrase]] = {}
    for words in every_phrase():
        anchors = tuple(sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:ANCHORS])
        index.setdefault(words[anchors[0]], []).append(Phrase(words, anchors))
    return index, idf


def phrase_places(words: list[bytes], index: dict[bytes, list[Phrase]], idf: dict[bytes, float]) -> dict[tuple[bytes, ...], list[int]]:
    """Where each phrase stands: the starts that its posted words agree on, verified."""
    known = idf.keys() & set(words)
    found: dict[tuple[bytes, ...], list[int]] = {}
    if not index.keys() & known:
        return found
    places: dict[bytes, list[int]] = {w: [] for w in known}
    for i, w in enumerate(words):
        if w in places:
            places[w].append(i)
    for w in sorted(index.keys() & known, key=lambda w: (-idf[w], w)):
        for phrase in index[w]:
            if not all(phrase.words[a] in places for a in phrase.anchors):
                continue
            starts = {i - phrase.anchors[0] for i in places[w]}
            for a in phrase.anchors[1:]:
                starts &= {i - a for i in places[phrase.words[a]]}
            at = sorted(i for i in starts if i >= 0 and tuple(words[i : i + len(phrase.words)]) == phrase.words)
            if at:
                found[phrase.words] = at
    return found


def in_place(words: list[bytes], template: Template, found: dict[tuple[bytes, ...], list[int]]) -> float | None:
    """The share of the template's words that stand in place about its phrases; None unless all phrases stand in order."""
    low, shift = 0, []
    for phrase, at in zip(template.phrases, template.at, strict=True):
        start = next((i for i in found.get(phrase, ()) if i >= low), None)
        if start is None:
            return None
        shift.append(start - at)
        low = start + len(phrase)
    same = 0
    for k, w in enumerate(template.words):
        # Before the second phrase begins the first one says where a word should stand, and so on.
        i = k + shift[max(0, sum(k >= at for at in template.at) - 1)]
        same += 0 <= i < len(words) and words[i] == w
    return same / len(template.words)


def scan_words(words: list[bytes], index: dict[bytes, list[Phrase]], idf: dict[bytes, float], known: list[Template]) -> tuple[list[tuple[str, int]], set[str], float]:
    """(base places as (label, start)), labels of verified templates, best share of a template's words in place."""
    found = phrase_places(words, index, idf)
    if not found:
        return [], set(), 0.0
    base = [(label, i) for label, phrase in BASE for i in found.get(_words(phrase), ())]
    labels, best = set(), 0.0
    for template in known:
        if template.phrases[0] in found:
            share = in_place(words, template, found)
            if share is not None:
                labels.add(template.label)
                best = max(best, share)
    return base, labels, best


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    The index takes its rarities from all of ``docs``. ``score`` is the largest
    share of a verified template's words that stand in place, 0 without any.
    Null and empty texts have no words and no labels ("" for both). Very long
    texts are read whole, as lists of their words in the task. Repeated rows give a row each; other columns are not looked at. An empty table gives no rows.
    """
    index, idf = build_index(*document_frequencies(docs))
    known = templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                base, labels, best = scan_words(words, index, idf, known)
                starts, own = [i for _, i in base], {x for x, _ in base}
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), best))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
