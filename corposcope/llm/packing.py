"""Packing token sequences: best-fit decreasing, then swap-based local search.

Documents are tokenized and cut where longer than a sequence. Pieces are dealt
into groups of some thousands by a hash; a group is packed on its own, so a
task's work is bounded however many documents there are, and a group costs at
most a fraction of a sequence against packing all at once.

In a group, best-fit decreasing gives the first bins. Then documents are moved
or exchanged between underfull bins, one for one or two for one, always from the
emptier to the fuller bin, so squared fill rises until bins run empty.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.llm.common import durable

#: Bytes for the words that a Python worker remembers from task to task, about.
MEMO_BYTES = 24_000_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 1_500_000
# The steps before the model of a tokenizer that composes characters, makes any white space one blank,
# lowers case, and takes words and runs of punctuation apart, dropping blanks.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: A run of what is no Unicode white space.
NONBLANK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Texts of these characters alone are lowered, and a full stop or comma after a letter parted from it, before words are looked up.
PLAIN = re.compile("[\t-\r\x20-\xff]*")

#: A full stop or comma alone after a letter or digit, at the end of a word.
CLOSING = r"([\pL\pN])([.,])([\s\x{0b}\x{85}\x{a0}]|$)"


def splits_at_blanks(path: str) -> bool:
    """Whether the tokenizer of this file treats what stands between blanks apart from the rest, as ``NORMALIZERS`` and ``PARTS`` do."""
    from tokenizers import Tokenizer

    steps = json.loads(Tokenizer.from_file(path).to_str())
    first = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    return (
        (steps["normalizer"] or {}).get("normalizers") == NORMALIZERS and first.get("pattern") == {"Regex": PARTS} and first.get("invert") is True
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or NONBLANK.fullmatch(t["content"]) is None or not t["content"].startswith("<|") for t in steps["added_tokens"])
    )


class WordEncoder:
    """Token ids of texts, by a tokenizer that drops white space (``by_words``).

    Such a tokenizer treats what stands between blanks apart from the rest, so
    the different words of a slice of texts are encoded once each and their ids
    joined. Words met before are remembered; beyond ``memo_bytes`` those of the
    latest slice alone. A tokenizer of any other kind gets whole texts.
    """

    def __init__(self, path: str, by_words: bool, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.memo_bytes = memo_bytes
        self.words, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each of ``texts`` (strings, null: none)."""
        if not self.by_words:
            found = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return [np.array(e.ids, np.uint32) for e in found]
        every = [t or "" for t in texts.to_pylist()]
        plain = np.array(["<|" not in t and PLAIN.fullmatch(t) is not None for t in every], bool)
        found = np.empty(len(every), object)
        for at, words in ((np.flatnonzero(plain), self._plain_words), (np.flatnonzero(~plain), self._other_words)):
            if len(at):
                for i, ids in zip(at.tolist(), self._encode_lists(words([every[i] for i in at.tolist()])), strict=True):
                    found[i] = ids
        return list(found)

    @staticmethod
    def _plain_words(texts: list[str]) -> pa.Array:
        lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
        return pc.utf8_split_whitespace(pc.replace_substring_regex(lowered, CLOSING, r"\1 \2\3"))

    @staticmethod
    def _other_words(texts: list[str]) -> pa.Array:
        return pc.split_pattern(pa.array([" ".join(NONBLANK.findall(t)) for t in texts], pa.large_string()), " ")

    def _encode_lists(self, lists: pa.Array) -> list[np.ndarray]:
        coded = lists.values.dictionary_encode()
        ids, begins, sizes = self._ids_of(coded.dictionary)
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        flat = ids[np.repeat(begins[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[lists.offsets.to_numpy()]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of ``words`` (all different) begin in them, and how many they are."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        parts, sizes = [self.ids], [self.sizes]
        for low in range(0, len(new), 10_000):
            part = words.take(pa.array(new[low : low + 10_000])).to_pylist()
            own = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            parts.append(np.array(own.ids, np.uint32))
            sizes.append(np.bincount(np.array(own.word_ids, np.int64), minlength=len(part)))
        place[new] = len(self.sizes) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, words.take(pa.array(new))])
        self.ids, self.sizes = np.concatenate(parts), np.concatenate(sizes)
        ids, begins, n = self.ids, (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place]
        if self.words.nbytes + self.ids.nbytes + self.sizes.nbytes > self.memo_bytes:
            ends = np.cumsum(n)
            self.words, self.sizes = words, n
            self.ids = ids[np.repeat(begins - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, begins, n


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str, by_words: bool) -> WordEncoder:
    """This worker's encoder: its words serve later tasks too, within ``MEMO_BYTES``."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path, by_words)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of rows of about ``most`` bytes together, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents (null text: empty).

    A document's ids end with 0. Only one longer than ``capacity`` is cut.
    """
    by_words = splits_at_blanks(tokenizer_path)  # looked up once, on the driver
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer_path, by_words)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                out: list[list] = [[] for _ in names]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    data = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[start : start + 4 * capacity]
                        for column, value in zip(out, (doc_id, k, start // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names)
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions): each item, longest first, goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = defaultdict(list)
    gaps = 0  # the bits of gaps that some bin has
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap > n:
            by_gap[gap - n].append(b)
            gaps |= 1 << (gap - n)
    return bins


def _largest(bits: int, most: int) -> int:
    """The highest set bit up to ``most``, or -1."""
    return (bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most >= 0 else -1


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, ) -> list[list[int]]:
    """Fills the fuller of the underfull bins from the emptier ones until a round brings nothing.

    A receiving bin takes the change that fills it most: a move (one document),
    an exchange of one for one, or of two for one. For each sum the pair of the
    emptiest bin that has one stands; a round begins with all pairs of all bins.
    """
    while True:
        fill = [sum(lengths[i] for i in b) for b in bins]
        under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: -fill[b])
        where: dict[int, set[int]] = defaultdict(set)  # by length: donors that hold it
        present = 0
        holds = lambda b: {lengths[i] for i in bins[b]}
        for b in under:
            for n in holds(b):
                where[n].add(b)
                present |= 1 << n
        pairs: dict[int, tuple[int, int, int]] = {}
        sums = 0
        for b in under:
            n_of = Counter(lengths[i] for i in bins[b])
            own = sorted(n_of)  # different lengths alone: a bin has few
            for k, x in enumerate(own):
                for y in own[: k + (n_of[x] > 1)]:
                    pairs[x + y] = (b, x, y)
        for s in pairs:
            sums |= 1 << s

        def forget(b: int, n: int) -> None:
            nonlocal present
            where[n].discard(b)
            if not where[n]:
                present &= ~(1 << n)

        def take(b: int, n: int) -> int:
            i = next(i for i in bins[b] if lengths[i] == n)
            bins[b].remove(i)
            fill[b] -= n
            if n not in holds(b):
                forget(b, n)
            return i

        def put(b: int, i: int, donor: bool) -> None:
            nonlocal present
            bins[b].append(i)
            fill[b] += lengths[i]
            if donor:
                where[lengths[i]].add(b)
                present |= 1 << lengths[i]

        changed = False
        for a in under:
            if not bins[a]:
                continue
            for n in holds(a):
                forget(a, n)
            while fill[a] < capacity:
                gap = capacity - fill[a]
                best = (0, None, None, None)  # gain, given, taken lengths, donor
                n = _largest(present, gap)
                if n > 0:
                    best = (n, None, (n,), min(where[n], key=lambda b: (fill[b], b)))
                for u in holds(a):
                    if best[0] == gap:
                        break
                    n = _largest(present, u + gap)
                    if n - u > best[0]:
                        best = (n - u, u, (n,), min(where[n], key=lambda b: (fill[b], b)))
                    s = _largest(sums, u + gap)
                    while s - u > best[0]:
                        b, x, y = pairs[s]
                        own = [lengths[i] for i in bins[b]] if b != a else []
                        if x in own and y in own and (x != y or own.count(x) > 1) and b in where[x]:
                            best = (s - u, u, (x, y), b)
                            break
                        sums ^= 1 << s
                        s = _largest(sums, u + gap)
                gain, given, taken, donor = best
                if not gain or fill[a] + gain <= fill[donor]:
                    break
                back = None
                if given is not None:
                    back = next(i for i in bins[a] if lengths[i] == given)
                    bins[a].remove(back)
                    fill[a] -= given
                for n in taken:
                    put(a, take(donor, n), False)
                if back is not None:
                    put(donor, back, True)
                changed = True
        bins = [b for b in bins if b]
        if not changed:
            break
    return bins


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 8192) -> DataFrame:
    """``pieces`` (with doc_id, piece, length) with ``sequence_id`` and ``offset`` (long, gapless from 0 in a sequence).

    Repeated rows are packed each. Columns of these two names are replaced; all
    others are carried. An empty table stays empty. ``pieces`` must be a written
    table, as rows are dealt by their number in it, so that no group grows with
    rows that are alike; about ``group_rows`` rows are packed together.
    """
    base = pieces.select(*(f"`{c}`" for c in pieces.columns if c not in ("sequence_id", "offset")))
    groups = max(1, -(-base.count() // group_rows))
    dealt = base.withColumn("pack_group_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = (int(key[0]) << 32) + b, at
                at += lengths[i]
        return rows.drop(columns="pack_group_").assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return dealt.groupBy("pack_group_").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Tokenizes and packs whole ``docs``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Token ids are not dealt around: ``start`` and ``length`` name them, and
    ``tokenized_pieces(..., with_ids=True)`` yields them. A null or empty text is the single id 0.
    """
    return pack(durable(tokenized_pieces(docs, tokenizer_path, capacity)), capacity)
