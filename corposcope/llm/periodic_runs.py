"""Periodic runs of words, found by block convolution.

A run of period q is a maximal stretch of words in which words q apart are the same,
at least ``max(12, 2 q)`` words long, with no smaller period. In it the words that equal
those q later form a stretch of at least ``max(q, 6)``.

So at the scale of blocks of B = 2, 4, 8, ... words, every run with a period of 2B - 1 to
4B - 2 (of 1 to 6 for B = 2) holds a whole aligned block that occurs again q words
later. For a block x and the window y that follows it, the sums of squared differences
sum x^2 + sum y^2 - 2 sum xy at all lags come from one cyclic convolution, by a number
theoretic transform in exact integers modulo a prime; a zero marks an occurrence
without mismatch. Each such zero is confirmed word by word (a sum may be a multiple of
the prime), and its lag is a distance at which the block is extended to both sides.

Two rules keep the work small and drop nothing. A block is transformed only if each of its
word pairs occurs again within the lags of its scale. And a lag is skipped whose words up
to the second occurrence lie in a run already found, with a period p of at most B: as
both periods fit in that stretch (q + B words), q is a multiple of p there, and so
in all of its own stretch.

Texts of a slice are worked on together: their words stand in one sequence, with
a word of its own after each text, which no run can cross. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 7 * 2**20 + 1, of which 3 is a primitive root: transforms up to 2**20 long, and 64 products fit in a double exactly.
PRIME, ROOT, LONGEST = 7340033, 3, 2**20
RADIX = 64
LEAST_LENGTH = 12
#: Elements transformed at once, and bytes of text worked on together (one text at least).
AT_ONCE, SLICE = 2**17, 2**20
NEVER = np.int64(2**62)


def modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in place; may stand for 0 by the prime itself (and be off the range by 2)."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have, step = 1, base % PRIME
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step % PRIME
        have, step = have + more, step * step % PRIME
    return out


@lru_cache(maxsize=64)
def tables(n: int, inverse: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The transform's matrix (of the first radix), and the twiddle factors where ``n`` is longer."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    every = powers(pow(w, -1, PRIME) if inverse else w, n)
    first = min(n, RADIX)
    k = np.arange(first)
    matrix = every[(np.outer(k, k) * (n // first)) % n].astype(np.float64)
    return matrix, None if n <= RADIX else every[np.outer(np.arange(n // first), k) % n].astype(np.float64)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The transform of each row (without the inverse's division), exact: every product of matrices stays below 2**53."""
    rows, n = x.shape
    matrix, twiddle = tables(n, inverse)
    if twiddle is None:
        return modulo(x @ matrix)
    rest = n // RADIX
    y = modulo(np.ascontiguousarray(x.reshape(rows, RADIX, rest).transpose(0, 2, 1)).reshape(-1, RADIX) @ matrix).reshape(rows, rest, RADIX)
    y *= twiddle
    z = transform(np.ascontiguousarray(modulo(y).transpose(0, 2, 1)).reshape(-1, rest), inverse)
    return np.ascontiguousarray(z.reshape(rows, RADIX, rest).transpose(0, 2, 1)).reshape(rows, n)


def zero_lags(codes: np.ndarray, squares: np.ndarray, at: np.ndarray, block: int, low: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, lag) where the sum of squared differences is zero modulo the prime, of lags ``low`` to ``low + lags - 1``, at most 3 * block + 1.

    ``codes`` are words as numbers, ``squares`` running sums of their squares; both have padding behind.
    """
    n = 4 * block
    inverse_n = pow(n, -1, PRIME)
    found_at, found_lag = [], []
    step = max(1, AT_ONCE // n)
    mirrored = (-np.arange(block)) % n
    for i in range(0, len(at), step):
        b = at[i : i + step]
        x = np.zeros((len(b), n))
        x[:, mirrored] = codes[b[:, None] + np.arange(block)]
        y = codes[np.minimum(b[:, None] + low + np.arange(n), len(codes) - 1)].astype(np.float64)
        product = transform(x) * transform(y)
        cross = modulo(modulo(transform(modulo(product), inverse=True))[:, :lags] * float(2 * inverse_n % PRIME))
        starts = np.minimum(b[:, None] + low + np.arange(lags), len(codes) - block - 1)
        total = (squares[b + block] - squares[b])[:, None] + squares[starts + block] - squares[starts]
        r, c = np.nonzero((total - cross.astype(np.int64)) % PRIME == 0)
        found_at.append(b[r])
        found_lag.append(c + low)
    return np.concatenate(found_at), np.concatenate(found_lag)


def confirmed(ids: np.ndarray, at: np.ndarray, lag: np.ndarray, block: int) -> np.ndarray:
    """Which blocks occur again at their lag, word by word."""
    good = np.ones(len(at), bool)
    width = min(block, 64)
    for k in range(0, block, width):
        rows = np.flatnonzero(good)
        for i in range(0, len(rows), AT_ONCE // width):
            r = rows[i : i + AT_ONCE // width]
            place = at[r][:, None] + np.arange(k, k + width)
            good[r] = (ids[place] == ids[place + lag[r][:, None]]).all(1)
    return good


def extended(ids: np.ndarray, edge: np.ndarray, lag: np.ndarray, step: int) -> np.ndarray:
    """``edge`` moved on (step 1: the first place after; step -1: the first place) while words ``lag`` apart are the same."""
    edge, alive, width = edge.copy(), np.arange(len(edge)), 32
    n = len(ids)
    while len(alive):
        still = []
        for i in range(0, len(alive), AT_ONCE // width):
            r = alive[i : i + AT_ONCE // width]
            place = edge[r][:, None] + (np.arange(width) if step > 0 else -1 - np.arange(width))
            other = place + lag[r][:, None]
            same = (place >= 0) & (other < n)
            same &= ids[np.clip(place, 0, n - 1)] == ids[np.clip(other, 0, n - 1)]
            more = np.where(same.all(1), width, same.argmin(1))
            edge[r] += step * more
            still.append(r[more == width])
        alive = np.concatenate(still)
    return edge


def runs_of(ids: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs in ``ids``, by start and period.

    ``ends`` is the end of the text at each place; a word of its own follows each text.
    ``longest`` is the longest text's number of words.
    """
    n = len(ids)
    found = np.zeros((0, 3), np.int64)
    if longest < LEAST_LENGTH:
        return found
    pairs = ids[:-1] * (ids.max() + 1) + ids[1:]
    order = np.argsort(pairs, kind="stable")
    again = np.full(n, NEVER)  # how far on the same pair of words follows
    same = pairs[order[1:]] == pairs[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    codes = squares = None
    block, low, high = 2, 1, 6
    while low <= longest // 2:
        high_here = min(high, longest // 2) if 4 * block < LONGEST else longest // 2
        whole = n // block
        at = np.flatnonzero(again[: whole * block].reshape(whole, block)[:, : block - 1].max(1) <= high_here) * block
        at = at[at + low + block <= ends[at]]
        if len(found) and len(at):
            known = found[found[:, 2] <= block]
            reach = np.zeros(n, np.int64)
            np.maximum.at(reach, known[:, 0], known[:, 1])
            reach = np.maximum.accumulate(reach)
            at = at[reach[at] < np.minimum(at + high_here + block, ends[at])]
        else:
            reach = None
        if len(at):
            if codes is None:
                codes = np.append(ids % PRIME, 0)
                squares = np.concatenate(([0], np.cumsum(codes * codes % PRIME)))
            parts = [zero_lags(codes, squares, at, block, k, min(3 * block + 1, high_here - k + 1)) for k in range(low, high_here + 1, 3 * block + 1)]
            b, q = (np.concatenate(x) for x in zip(*parts, strict=True))
            inside = b + q + block <= ends[b]
            if reach is not None:
                inside &= reach[b] < b + q + block
            b, q = b[inside], q[inside]
            good = confirmed(ids, b, q, block)
            b, q = b[good], q[good]
            order = np.lexsort((b, q))
            b, q = b[order], q[order]
            opens = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (b[1:] != b[:-1] + block)))) if len(b) else np.zeros(0, np.int64)
            q1, first, last = q[opens], b[opens], b[np.append(opens[1:], len(b)) - 1] + block if len(b) else b
            start, end = extended(ids, first, q1, -1), extended(ids, last, q1, 1) + q1
            long_enough = end - start >= np.maximum(LEAST_LENGTH, 2 * q1)
            every = np.concatenate((found, np.column_stack((start, end, q1))[long_enough]))
            every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
            # equal stretches of several periods: the smallest is the period
            found = every[np.concatenate(([True], (every[1:, :2] != every[:-1, :2]).any(1)))] if len(every) else every
        if high_here == longest // 2:
            break
        block, low = 2 * block, high + 1
        high = 4 * block - 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: bytes of their words without blanks, offsets of the words there, number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (data == 32) | (data - 9 < 5)  # unsigned: 9 to 13
    solid = ~blank
    closes = np.flatnonzero(solid[:-1] & blank[1:])  # the last byte of each word
    before = np.cumsum(solid)
    offsets = np.concatenate(([0], before[closes]))
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    counts = np.diff(np.concatenate(([0], np.searchsorted(closes, text_ends))))
    return data[solid], offsets, counts


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the original words of a text of ``n`` words that is made periodic, a tenth of all by the checksum of its id; else None."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def scanned(doc_ids: list[int | None], texts: list[bytes], rewrite: bool) -> Iterator[tuple]:
    """A row for each text: number of runs, start, length, period and exponent of the longest, digest of the runs, kept words."""
    data, offsets, counts = words_of(texts)
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    words = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    picked = [rewritten(d, int(n)) if rewrite else None for d, n in zip(doc_ids, counts, strict=True)]
    which = np.concatenate([f + (np.arange(n) if p is None else p) for f, n, p in zip(firsts, counts, picked, strict=False)]) if len(counts) else np.zeros(0, np.int64)
    # a word of its own after each text
    own = words.max(initial=-1) + 1 + np.arange(len(texts))
    begins = firsts[:-1] + np.arange(len(texts))
    ends_of = begins + counts
    ids = np.zeros(len(which) + len(texts), np.int64)
    place = np.arange(len(which)) + np.repeat(np.arange(len(texts)), counts)
    ids[place], ids[ends_of] = words[which], own
    runs = runs_of(ids, np.repeat(ends_of, counts + 1), int(counts.max(initial=0)))
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone)[place] == 0
    # kept words, each with a blank behind
    chosen = which[kept]
    lengths = offsets[chosen + 1] - offsets[chosen] + 1
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    source = np.repeat(offsets[chosen] - (stops - lengths), lengths) + np.arange(total)
    out = data[np.minimum(source, max(len(data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[stops - 1] = 32
    stops = np.concatenate(([0], stops))
    so_far = np.concatenate(([0], np.cumsum(kept)))[firsts]
    view = out.tobytes()
    cuts = np.searchsorted(runs[:, 0], np.append(begins, len(ids)))
    for i in range(len(texts)):
        mine = runs[cuts[i] : cuts[i + 1]]
        text = view[stops[so_far[i]] : max(stops[so_far[i + 1]] - 1, stops[so_far[i]])]
        best = (None,) * 4
        spans = mine - [begins[i], 0, 0]
        spans[:, 1] -= mine[:, 0]
        rows = [(s, length, q) for s, length, q in spans.tolist()]
        if rows:
            s, length, q = min(rows, key=lambda r: (-r[1], r[0], r[2]))
            best = (s, length, q, 1000 * length // q)
        yield (len(rows), *best, hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in rows).encode()).hexdigest(), text)


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed")


def find_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed) of every row of ``docs``.

    ``start`` (from 0) to ``exponent_milli`` are of the run with the greatest length (ties: smallest
    start, then period), null without a run. ``runs_sha256`` is the digest of ``start,length,period``
    and a line feed for every run, by start and period. ``collapsed`` is the text of
    words that no run contains after its first period, joined by a blank. With
    ``rewrite`` a tenth of the texts (checksum of doc_id) are made periodic first.

    Null, empty and blank texts have no runs and collapse to nothing. A null doc_id is not
    rewritten. Repeated rows give equal rows. A text is worked on whole, however long, in
    memory of about forty times its size. An empty table gives no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or b"") <= SLICE):
                    size += len(texts[j] or b"")
                    j += 1
                rows = list(scanned(doc_ids[i:j], [t or b"" for t in texts[i:j]], rewrite))
                columns = [pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:5]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns, pa.array([r[5] for r in rows]), pa.array([r[6] for r in rows], pa.binary())], ["doc_id", *NAMES])
                i = j

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
