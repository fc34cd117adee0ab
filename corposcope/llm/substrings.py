"""Removal of repeated passages by sliding spans of sentences, and of words.

A text is a row of words; a word that follows a line's end, or a full stop,
exclamation or question mark and a space or tab, begins a sentence. Every run
of several consecutive sentences is hashed, the hashes are joined over all
documents, and sentences covered by a run that occurred before are removed.

A run counts from ``min_words`` words on. Hashed are, from each sentence on, the
shortest run forward, and up to each sentence the shortest run backward, of two
sentences or more (or one sentence of ``long_sentence`` words or more). Every
repeated run is made of repeated runs of this kind, so longer ones need no
hashes of their own, and what is hashed grows with the sentences alone.

Passages may also stand in mid-sentence. Every window of ``passage_words``
words that occurred before is found, wherever it begins: windows of half that
length are hashed and winnowed, so that each passage keeps at least one hash,
the same in every place. Around hashes that two texts share all whole windows
are hashed and joined like runs. Of texts that are equal the first stands for
all here: in the others every window occurred before.

Texts are read in slices as one array of bytes. Hashes of words and of spans of
words are polynomials modulo 2^64, of which any span is a difference of two
running sums, so a slice costs a few passes of numpy however spans overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corposcope.llm.common import durable, plain_name

#: Bytes of text that are handled at a time; one longer text makes a slice of its own.
SLICE_BYTES = 1_000_000
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
ENDING = np.zeros(256, bool)
ENDING[[ord(c) for c in ".!?"]] = True
# Odd multipliers, for bytes in a word and for words in a span (two, so that spans have 128 bits).
BYTE_BASE, SPAN_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Spreads each bit over all of them."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a slice of texts: word i is bytes start[i] to end[i] of ``data``; text t has words first[t] to first[t + 1]."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    opens: np.ndarray  # whether a word begins a sentence

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: pa.Array) -> Words:
    """``texts``: strings; null has no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    text_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[text_at[0] : text_at[-1]] if len(texts) else np.zeros(0, np.uint8)
    text_at = text_at - text_at[0] if len(texts) else np.zeros(1, np.int64)
    solid = ~BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = text_at[(text_at > 0) & (text_at < len(data))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, text_at)
    opens = np.zeros(len(start), bool)
    if len(start) > 1:
        lines = np.cumsum(data == 10)
        gap = end[:-1]
        at = np.minimum(gap, len(data) - 1)
        opens[1:] = (lines[start[1:] - 1] > lines[gap - 1]) | (ENDING[data[gap - 1]] & ((data[at] == 32) | (data[at] == 9)))
    opens[first[:-1][first[:-1] < first[1:]]] = True
    return Words(data, text_at, start, end, first, opens)


def word_hashes(words: Words) -> np.ndarray:
    """A hash of each word's bytes."""
    size = words.end - words.start
    of_byte = np.zeros(len(words.data), np.uint64)
    if not len(size):
        return of_byte[:0]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(~BLANK[words.data])
    of_byte[at] = (words.data[at].astype(np.uint64) + np.uint64(1)) * _powers(BYTE_BASE, int(size.max()))[place]
    return _mixed(np.add.reduceat(of_byte, words.start), 1)


class Spans:
    """Hashes of spans of words; with ``opens`` two spans also differ where their sentences do."""

    def __init__(self, word: np.ndarray, opens: np.ndarray | None = None):
        if opens is not None:
            word = word + opens.astype(np.uint64) * np.uint64(BYTE_BASE)
        self.sums, self.shift = [], []
        for k, base in enumerate(SPAN_BASES):
            self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(_mixed(word, k + 2) * _powers(base, len(word)), dtype=np.uint64))))
            self.shift.append(_powers(pow(base, -1, 1 << 64), len(word) + 1))

    def of(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """The hash (unsigned 64-bit) of words begin to end; a span's hash does not hang on its place."""
        sums = self.sums[which]
        return _mixed((sums[end] - sums[begin]) * self.shift[which][begin], 0)


def runs_of(words: Words, min_words: int, long_sentence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the runs of sentences, each once."""
    begin = np.flatnonzero(words.opens)
    text = words.owner()[begin]
    end = np.concatenate((begin[1:], [len(words.start)])).astype(np.int64)
    low, high = np.searchsorted(text, text), np.searchsorted(text, text, side="right")  # the text's sentences
    n = np.arange(len(begin))
    long = end - begin >= long_sentence
    last = np.where(long, n, np.maximum(np.searchsorted(end, begin + min_words), n + 1))
    forward = last < high
    head = np.where(long, n, np.minimum(np.searchsorted(begin, end - min_words, side="right") - 1, n - 1))
    backward = head >= low
    both = np.unique(np.concatenate((n[forward] << 32 | last[forward], head[backward] << 32 | n[backward])))
    return text[both >> 32], begin[both >> 32], end[both & 0xFFFFFFFF]


def winnowed(words: Words, spans: Spans, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the chosen windows of half of ``passage`` words: the least hash in each passage, the last of equals."""
    half = passage // 2
    n = len(words.start)
    if n < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.arange(n - half + 1)
    hashes = spans.of(begin, begin + half)
    best, width, span = begin, 1, passage - half + 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] <= hashes[a], b, a)

    while 2 * width <= span:
        best, width = least(best[:-width], best[width:]), 2 * width
    rest = span - width
    best = least(best[: len(best) - rest], best[rest:]) if rest else best
    whole = words.owner()
    inside = whole[: n - passage + 1] == whole[passage - 1 :]
    at = np.unique(best[inside])
    return at, hashes[at]


# What a row of the joint sort is: a place to remove, a run or window, a seed, a seed that two texts share.
PLACE, RUN, SEED, SHARED = range(4)
ROW = "kind int, h long, check int, ord long, mark long, span long"
NAMES = ["kind", "h", "check", "ord", "mark", "span"]


def _rows(kind: int | np.ndarray, h: np.ndarray, check: np.ndarray | int, order: np.ndarray, mark: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    n = len(h)
    columns = (np.broadcast_to(kind, n).astype(np.int32), h.view(np.int64), np.broadcast_to(check, n).astype(np.int32), order, mark, span)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], NAMES)


def _settled(h: np.ndarray, check: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, order: np.ndarray, mark: np.ndarray, apart: int) -> pa.RecordBatch:
    """Rows of a slice's runs. What an earlier row of the slice settles is a place already, so a common run leaves a row a slice.

    ``order`` and ``mark`` are by text. A run that its own text has before, at
    least ``apart`` words earlier, is a place too.
    """
    by = np.lexsort((begin, text, order[text], check, h))
    h, check, text, begin, end = h[by], check[by], text[by], begin[by], end[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    again = new.copy()
    again[1:] |= text[1:] != text[:-1]
    group, own = np.flatnonzero(new), np.flatnonzero(again)
    head = group[np.cumsum(new) - 1] if len(h) else group
    first = own[np.cumsum(again) - 1] if len(h) else own
    place = (order[text] > order[text[head]]) | (~again & (begin - begin[first] >= apart))
    return _rows(np.where(place, PLACE, RUN), np.where(place, mark[text].view(np.uint64), h), np.where(place, 0, check), order[text], mark[text], begin << 32 | end)


def _shared(h: np.ndarray, text: np.ndarray, at: np.ndarray, order: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """Rows of a slice's seeds: those that two texts of the slice, or two places of a text, share are settled but for one that stands for them."""
    by = np.lexsort((at, text, order[text], mark[text], h))
    h, text, at = h[by], text[by], at[by]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    number = np.cumsum(new) - 1
    one = np.flatnonzero(new)
    # Of equal texts (of one mark) only the first is looked at.
    other = np.zeros(len(h), bool)
    other[1:] = (mark[text[1:]] != mark[text[:-1]]) & ~new[1:]
    repeat = np.zeros(len(h), bool)
    repeat[1:] = (text[1:] == text[:-1]) & ~new[1:]
    both = np.bincount(number, weights=other | repeat, minlength=len(one))[number] > 0 if len(h) else other
    kind = np.concatenate((np.full(both.sum(), SHARED), np.full(len(one), SEED)))
    rows = np.concatenate((np.flatnonzero(both), one))
    return _rows(kind, np.where(kind == SEED, h[rows], mark[text[rows]].view(np.uint64)), 0, order[text[rows]], mark[text[rows]], at[rows])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE_BYTES, side="right")))
            part = batch.slice(low, high - low)
            yield part, words_of(part.column("text"))
            low = high


def _long(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _first_pass(min_words: int, long_sentence: int, passage: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _slices(batches):
            order, mark = _long(part, "ord"), _long(part, "mark")
            hashes = word_hashes(words)
            spans = Spans(hashes, words.opens)
            text, begin, end = runs_of(words, min_words, long_sentence)
            h, check = spans.of(begin, end), spans.of(begin, end, 1)
            if passage:
                spans = Spans(hashes)
                at, seeds = winnowed(words, spans, passage)
                owner = words.owner()[at]
                yield _shared(seeds, owner, at - words.first[owner], order, mark)
                # A whole text that occurred before has no window left.
                whole = np.flatnonzero(np.diff(words.first) >= passage)
                a, b = words.first[whole], words.first[whole + 1]
                h, check = np.concatenate((h, spans.of(a, b))), np.concatenate((check, spans.of(a, b, 1)))
                text, begin, end = np.concatenate((text, whole)), np.concatenate((begin, a)), np.concatenate((end, b))
            yield _settled(h, (check >> np.uint64(32)).astype(np.uint32).view(np.int32), text, begin - words.first[text], end - words.first[text], order, mark, 0)

    return run


def _window_pass(passage: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every window of ``passage`` words around the seeds ``at`` given for its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _slices(batches):
            places = part.column("at")
            owner = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
            at = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + words.first[owner]
            edge = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edge, np.maximum(words.first[owner], at - (passage - passage // 2)), 1)
            np.add.at(edge, at + 1, -1)
            begin = np.flatnonzero(np.cumsum(edge) > 0)
            text = words.owner()[begin]
            fits = begin + passage <= words.first[text + 1]
            begin, text = begin[fits], text[fits]
            spans = Spans(word_hashes(words))
            h, check = spans.of(begin, begin + passage), spans.of(begin, begin + passage, 1)
            begin = begin - words.first[text]
            yield _settled(h, (check >> np.uint64(32)).astype(np.uint32).view(np.int32), text, begin, begin + passage, _long(part, "ord"), _long(part, "mark"), passage)

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and shared seeds, from rows sorted by kind, h, check, ord, mark; only the group at the end of a batch is remembered, as one row."""
    held = None  # the first row of the last group; for seeds also whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, h, check, order, mark, span = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (kind[1:] != kind[:-1])
        carried = held is not None and held[:3] == (kind[0], h[0], check[0])
        head = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        first_order, first_mark = order[head].copy(), mark[head].copy()
        if carried:
            first_order[0], first_mark[0] = held[3], held[4]
        place = (kind == PLACE) | ((kind == RUN) & (order > first_order[number]))
        seed = kind == SEED
        mixed = np.bincount(number, weights=seed & (mark != first_mark[number]), minlength=len(head)) > 0
        given = carried and held[6]
        if given:
            mixed[0] = True
        shared = (kind == SHARED) | (seed & mixed[number])
        out = [(PLACE, order[place], mark[place], span[place]), (SHARED, order[shared], mark[shared], span[shared])]
        if carried and mixed[0] and not given and kind[0] == SEED:  # the remembered row belongs to them
            out.append((SHARED, np.array([held[3]]), np.array([held[4]]), np.array([held[5]])))
        for k, o, m, s in out:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), k, np.int32)), pa.array(o), pa.array(m), pa.array(s)], ["kind", "ord", "mark", "span"])
        last = head[-1]
        if carried and len(head) == 1:
            held = (*held[:6], bool(mixed[0]))
        else:
            held = (kind[last], h[last], check[last], order[last], mark[last], span[last], bool(mixed[-1]))


def _joined(rows: DataFrame) -> DataFrame:
    """(kind, ord, mark, span): places, and shared seeds. One shuffle; a hash's rows pass by as a sorted stream."""
    met = rows.repartition("h").sortWithinPartitions("kind", "h", "check", "ord", "mark")
    return durable(met.mapInArrow(_judged, "kind int, ord long, mark long, span long"))


def _with_text_among(texts: DataFrame, keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``texts`` whose mark is among ``keys``, and the others; all and None where ``keys`` are more than ``most`` and so are no broadcast."""
    marks = keys.select("mark").distinct()
    if marks.count() > most:
        return texts, None
    marks = F.broadcast(marks)
    return texts.join(marks, "mark", "left_semi"), texts.join(marks, "mark", "left_anti")


def repeated_places(docs: DataFrame, min_words: int, long_sentence: int, passage_words: int | None, most_keys: int) -> DataFrame:
    """(ord, mark, spans) for each text with any: the spans of words (first << 32 | end) that occurred before.

    ord is the doc_id, and the largest long for null; mark is a hash of the text.
    """
    texts = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64("text").alias("mark"), "text")
    found = _joined(texts.mapInArrow(_first_pass(min_words, long_sentence, passage_words), ROW))
    places = found.filter(F.col("kind") == PLACE)
    if passage_words:
        wanted = durable(found.filter(F.col("kind") == SHARED).groupBy("mark").agg(F.min("ord").alias("ord"), F.collect_set("span").alias("at")))
        some, _ = _with_text_among(texts, wanted, most_keys)
        # One row of each text: equal rows have equal windows.
        met = some.join(wanted, ["ord", "mark"]).select("ord", "mark", "text", "at").dropDuplicates(["ord", "mark"])
        places = places.unionByName(_joined(met.mapInArrow(_window_pass(passage_words), ROW)))
    return places.groupBy("ord", "mark").agg(F.collect_set("span").alias("spans"))


OWN = {"n_sentences": pa.int64(), "n_removed": pa.int64(), "removed_words": pa.int64(), "removed_spans": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))}


def _cut(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Takes the words of ``spans`` (null: none) out of the texts, each with the blanks before it."""
    for part, words in _slices(batches):
        spans, n = part.column("spans_"), part.num_rows
        owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
        span = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, words.first[owner] + (span >> 32), 1)
        np.add.at(edge, words.first[owner] + (span & 0xFFFFFFFF), -1)
        gone = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        text, of_word = words.owner()[gone], words.owner()
        opened = np.flatnonzero(words.opens)
        hit = np.zeros(len(opened), bool)
        hit[np.cumsum(words.opens)[gone] - 1] = True
        count = lambda rows: pa.array(np.bincount(rows, minlength=n).astype(np.int64))
        before = np.where(words.first[text] == gone, words.text_at[text], words.end[np.maximum(gone - 1, 0)])
        edge = np.zeros(len(words.data) + 1, np.int8)
        np.add.at(edge, before, 1)
        np.add.at(edge, words.end[gone], -1)
        left = np.cumsum(edge[:-1], dtype=np.int64) <= 0
        kept = np.concatenate(([0], np.cumsum(left)))[words.text_at]
        texts = part.column("text")
        cut = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(words.data[left])])
        cut = pc.if_else(pc.is_valid(texts), cut, pa.scalar(None, pa.large_string())).cast(texts.type)
        # Removed ranges of bytes, those that touch joined, as code points of their text.
        points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
        fresh = np.ones(len(gone), bool)
        fresh[1:] = (gone[1:] != gone[:-1] + 1) | (text[1:] != text[:-1])
        a, b = before[fresh], words.end[gone[np.append(np.flatnonzero(fresh)[1:] - 1, len(gone) - 1)]] if len(gone) else before[:0]
        of = text[fresh]
        ranges = pa.StructArray.from_arrays([pa.array(points[a] - points[words.text_at[of]]), pa.array(points[b] - points[a])], ["start", "length"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), ranges)
        own = [count(of_word[opened]), count(of_word[opened][hit]), count(text), lists]
        yield pa.RecordBatch.from_arrays([cut if c == "text" else part.column(c) for c in columns] + own, [*columns, *OWN])


def remove_repeats(docs: DataFrame, min_words: int = 20, long_sentence: int = 40, passage_words: int | None = None, most_keys: int = 1_000_000) -> DataFrame:
    """``docs`` with the words removed that a repeated run or window covers, where it is not its first place.

    The first place is the one of the least doc_id, and in a document its first
    sentence. A removed word goes with the blanks before it. With ``passage_words``
    also every window of so many words goes that occurred in an earlier document
    or, without overlap, before in its own text, also in mid-sentence. Added are
    ``n_sentences`` (with a word), ``n_removed`` (sentences that lost words),
    ``removed_words`` (long) and ``removed_spans`` (array of (start, length), code
    points in the text as it was). Added columns replace columns of these names;
    all others pass unchanged. Texts that lose nothing are not shuffled while
    at most ``most_keys`` texts lose something; beyond that all are.

    A null text stays null and an empty one empty. Rows that share a doc_id are
    one document: they do not take text from each other. A null doc_id counts as
    later than any other (as the largest long); rows without one do not take text
    from each other. Repeated rows all stay, with equal results. An empty table stays empty.
    """
    base = docs.select(*(f"`{c}`" for c in docs.columns if c not in OWN))
    columns = base.columns
    for c in ("spans_", "ord", "mark"):
        if c in columns:  # a clash: these names are needed inside
            safe = plain_name(base, c)
            return remove_repeats(base.withColumnRenamed(c, safe), min_words, long_sentence, passage_words, most_keys).withColumnRenamed(safe, c)
    found = durable(repeated_places(base, min_words, long_sentence, passage_words, most_keys).withColumnRenamed("spans", "spans_"))
    keyed = base.withColumns({"ord": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "mark": F.xxhash64("text")})
    some, others = _with_text_among(keyed, found, most_keys)
    met = some.join(found, ["ord", "mark"], "left").select(*(f"`{c}`" for c in columns), "spans_")
    if others is not None:
        met = met.unionByName(others.select(*(f"`{c}`" for c in columns), F.lit(None).cast("array<long>").alias("spans_")))
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.LongType()) for c in list(OWN)[:3]), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])
    return met.mapInArrow(lambda batches: _cut(batches, columns), schema)
