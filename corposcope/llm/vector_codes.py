"""Product codes of vectors, by k-means with norm-of-sum bounds.

Vectors of integers are cut into equal parts; each part position has a codebook.
A round assigns every part to its codebook's nearest entry (squared Euclidean
distance, ties to the lower index) and then moves each entry to the floored mean
of its parts.

A part keeps the distance to its own entry and, for each group of entries, the
least distance to any other entry of the group. Each of these bounds carries the
stamp of the round in which it was exact, and the codebooks of all rounds are
retained. So in a later round a bound is corrected by the net displacement of an
entry since its own stamp, |c_now - c_stamp| (the norm of the sum of its moves),
which is never more than the sum of the norms of its moves. Only groups whose
corrected bound reaches the part's own distance are scanned again, exactly.

Codebooks (parts x entries x width integers) and the rounds' history are small,
whatever the number of rows; they go to the tasks by value. Rows pass from round to
round in a table with their bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.llm.common import drop_table, durable

#: Components stop here, so that no squared distance of a vector leaves the range of a long.
LARGEST = 2**26
#: Up to so many labels their totals are broadcast; beyond, rows are joined in salted slices.
BROADCAST_LABELS = 100_000
#: Floating bounds are widened by this share, far over the rounding of a square root.
SLACK = 1e-6


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of c)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 2**22 and x.shape[1] <= 64:  # below 2**53 throughout
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


@dataclass
class Bounds:
    """Of one part position: own entry, squared distance to it with its stamp; lower bounds of groups with theirs."""

    own: np.ndarray
    d2: np.ndarray
    own_stamp: np.ndarray
    low: np.ndarray
    low_stamp: np.ndarray


def groups_of(entries: int, most: int = 8) -> np.ndarray:
    """The group of each entry."""
    return np.arange(entries) * min(most, entries) // max(entries, 1)


def first_scan(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> Bounds:
    d = distances(x, c)
    own, rows = d.argmin(1), np.arange(len(x))
    others = np.sqrt(d.astype(np.float64))
    others[rows, own] = np.inf
    low = np.stack([others[:, group == g].min(1) for g in range(group.max() + 1)], axis=1)
    return Bounds(own, d[rows, own], np.zeros(len(x), np.int64), low * (1 - SLACK), np.zeros(low.shape, np.int64))


def rescan(x: np.ndarray, history: np.ndarray, group: np.ndarray, b: Bounds) -> int:
    """Brings ``b`` to the last codebook of ``history``; returns how many distances were computed."""
    now, c = len(history) - 1, history[-1]
    moved = np.sqrt(((history - c) ** 2).sum(2).astype(np.float64))  # net displacement of each entry since each stamp
    n_groups = group.max() + 1
    group_moved = np.stack([moved[:, group == g].max(1) for g in range(n_groups)], axis=1)
    upper = (np.sqrt(b.d2.astype(np.float64)) + moved[b.own_stamp, b.own]) * (1 + SLACK)
    lower = b.low - group_moved[b.low_stamp, np.arange(n_groups)] * (1 + SLACK)
    open_ = upper[:, None] >= lower
    rows = np.flatnonzero(open_.any(1))
    if not len(rows):
        return 0
    b.d2[rows], b.own_stamp[rows] = ((x[rows] - c[b.own[rows]]) ** 2).sum(1), now
    open_[rows] = (np.sqrt(b.d2[rows].astype(np.float64)) * (1 + SLACK))[:, None] >= lower[rows]
    computed, before, before_d2 = len(rows), b.own.copy(), b.d2.copy()
    scanned = []
    for g in range(n_groups):
        rows = np.flatnonzero(open_[:, g])
        if not len(rows):
            continue
        entries = np.flatnonzero(group == g)
        d = distances(x[rows], c[entries])
        computed += d.size
        d[before[rows][:, None] == entries] = np.iinfo(np.int64).max
        order = np.partition(d, 1, axis=1)[:, :2] if len(entries) > 1 else np.column_stack((d[:, 0], np.full(len(d), np.iinfo(np.int64).max)))
        nearest = entries[d.argmin(1)]
        scanned.append((g, rows, nearest, order))
        better = (order[:, 0] < b.d2[rows]) | (order[:, 0] == b.d2[rows]) & (nearest < b.own[rows])
        b.own[rows[better]], b.d2[rows[better]], b.own_stamp[rows[better]] = nearest[better], order[better, 0], now
    for g, rows, nearest, order in scanned:
        rest = np.where(b.own[rows] == nearest, order[:, 1], order[:, 0])
        b.low[rows, g] = np.where(rest == np.iinfo(np.int64).max, np.inf, np.sqrt(rest.astype(np.float64))) * (1 - SLACK)
        b.low_stamp[rows, g] = now
    left = np.flatnonzero(b.own != before)  # the entry left behind now counts in its group
    g = group[before[left]]
    current = b.low[left, g] - group_moved[b.low_stamp[left, g], g] * (1 + SLACK)
    b.low[left, g] = np.minimum(current, np.sqrt(before_d2[left].astype(np.float64)) * (1 - SLACK))
    b.low_stamp[left, g] = now
    return computed


def packed(bounds: list[Bounds]) -> pa.Array:
    """A binary value of fixed length for each row."""
    n = len(bounds[0].own)
    fields = [np.stack([getattr(b, f) for b in bounds], axis=1).reshape(n, -1) for f in ("own", "d2", "own_stamp", "low", "low_stamp")]
    kinds = (np.uint8, "<i8", np.uint8, "<f4", np.uint8)
    fields[3] = fields[3] * (1 - SLACK)  # rounding to single precision must not raise a lower bound
    parts = [np.ascontiguousarray(f.astype(k)).view(np.uint8).reshape(n, -1) for f, k in zip(fields, kinds, strict=True)]
    data = np.concatenate(parts, axis=1)
    offsets = np.arange(n + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def unpacked(column: pa.Array, parts: int, n_groups: int) -> list[Bounds]:
    n = len(column)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)
    at, found = 0, []
    for kind, width in ((np.uint8, 1), ("<i8", 1), (np.uint8, 1), ("<f4", n_groups), (np.uint8, n_groups)):
        size = parts * width * np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(data[:, at : at + size]).view(kind).reshape(n, parts, width))
        at += size
    own, d2, own_stamp, low, low_stamp = found
    return [Bounds(own[:, p, 0].astype(np.int64), d2[:, p, 0].copy(), own_stamp[:, p, 0].astype(np.int64), low[:, p].astype(np.float64), low_stamp[:, p].astype(np.int64)) for p in range(parts)]


def matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def assign(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, label, v and, after the first round, bounds) with ``bounds`` brought to the last codebooks.

    ``history`` is (rounds, parts, entries, width).
    """
    parts, group = history.shape[1], groups_of(history.shape[2])
    first = len(history) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2), parts)
            if first:
                bounds = [first_scan(x[:, p], history[0, p], group) for p in range(parts)]
            else:
                bounds = unpacked(batch.column(3), parts, group.max() + 1)
                for p, b in enumerate(bounds):
                    rescan(x[:, p], history[:, p], group, b)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), packed(bounds)], ["vec_id", "label", "v", "bounds"])

    return rows.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, v array<int>, bounds binary")


def moved_entries(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after an update: floored means of the assigned parts; unused entries stay.

    Tasks sum their rows to a line for each component of each entry; Spark adds
    these up, and the driver gets as many lines as a codebook has components.
    """
    parts, entries, width = codebooks.shape
    n_groups = groups_of(entries).max() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), parts)
                for p, b in enumerate(unpacked(batch.column(1), parts, n_groups)):
                    counts[p] += np.bincount(b.own, minlength=entries)
                    for i in range(width):
                        sums[p, :, i] += np.bincount(b.own, weights=x[:, p, i], minlength=entries).astype(np.int64)
        n = np.repeat(counts.ravel(), width)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(sums.ravel()[at])], ["place", "n", "total"])

    found = rows.select("v", "bounds").mapInArrow(run, "place long, n long, total long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    after = codebooks.copy().ravel()
    for r in found:
        after[r["place"]] = r["total"] // r["n"]
    return after.reshape(codebooks.shape)


def coded(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error, computed) by the last codebooks; ``computed`` counts exact distances of this round."""
    parts, group = history.shape[1], groups_of(history.shape[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, computed = matrix(batch.column(2), parts), 0
            bounds = unpacked(batch.column(3), parts, group.max() + 1)
            for p, b in enumerate(bounds):
                computed += rescan(x[:, p], history[:, p], group, b)
            codes = np.stack([b.own for b in bounds], axis=1).astype(np.uint8)
            error = sum(((x[:, p] - history[-1, p][b.own]) ** 2).sum(1) for p, b in enumerate(bounds))
            share = np.full(len(x), computed // len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error), pa.array(share)], ["vec_id", "label", "code", "error", "computed"])

    return rows.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long, computed long")


def with_label_errors(df: DataFrame) -> DataFrame:
    """``df`` with ``label_error``: error summed over equal labels, nulls together.

    Sums are made before the shuffle. Up to ``BROADCAST_LABELS`` totals, counted first, are
    broadcast; beyond that rows and totals meet in slices, so no label fills a task.
    """
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long")
    totals = df.groupBy("label").agg(total.alias("label_error"))
    if totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return df.alias("l").join(F.broadcast(totals).alias("r"), F.col("l.label").eqNullSafe(F.col("r.label"))).select("l.*", "r.label_error")
    left = df.withColumn("slice_", F.pmod(F.xxhash64("vec_id", "code"), F.lit(16))).alias("l")
    right = totals.withColumn("slice_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))).alias("r")
    return left.join(right, F.col("l.label").eqNullSafe(F.col("r.label")) & (F.col("l.slice_") == F.col("r.slice_"))).select("l.*", "r.label_error").drop("slice_")


def kept_vectors(df: DataFrame, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x), of vectors that take part.

    Without vectors that are null or hold null or non-finite components. Of the lengths
    that ``parts`` divides the most frequent takes part (ties: the smaller); vectors of another
    length, and empty ones, don't. Components beyond ``LARGEST`` stop there.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("embedding").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ints = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), e * scale))).cast("int"))
    rows = df.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("v"))
    length = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length["n"] if length else -1))


def compress(df: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2, update: Callable[[DataFrame, np.ndarray], np.ndarray] = moved_entries) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, computed, label_error) of every kept row of ``df`` (vec_id, embedding, label), and the codebooks of all rounds.

    ``entries`` is at most 256: codes have two hex digits a part. With fewer kept rows than
    that, codebooks have as many entries as rows. Codebooks begin with the rows of
    smallest vec_id (null last); rows that repeat an id are rows each, in order of their
    components. Repeated rows get equal codes. An empty table gives no rows and codebooks
    without entries. Other columns are not looked at.
    """
    kept = kept_vectors(df, scale, parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return kept.sparkSession.createDataFrame([], f"vec_id long, label {dict(kept.dtypes)['label']}, code string, error long, computed long, label_error long"), np.zeros((1, parts, 0, 0), np.int64)
    history = np.array([r["v"] for r in first], np.int64).reshape(1, len(first), parts, -1).transpose(0, 2, 1, 3)
    rows = durable(assign(kept, history))
    for i in range(rounds):
        history = np.concatenate((history, update(rows, history[-1])[None]))
        if i < rounds - 1:
            before, rows = rows, durable(assign(rows, history))
            drop_table(before)
    found = durable(coded(rows, history))
    drop_table(rows)
    return with_label_errors(found), history


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
