"""Vector search by cosine: exact, and approximate by sketches of random hyperplanes with exact scores for the best of them.

Queries go to the rows: a group of at most ``GROUP`` of them, counted first, travels with the
tasks, and each task keeps its k best rows for each query while it reads. So neither rows nor
vectors are shuffled; k rows for each query and task are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.operators.search import top_per_query

GROUP = 10_000
# Queries that meet a batch of rows at once, and an id after all others.
AT_ONCE, LAST = 256, np.iinfo(np.int64).max
FOUND = "query_id long, row_id long, similarity double"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def query_groups(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """{dimension: (ids, unit vectors)} of at most about ``GROUP`` queries (query_id, v) at a time."""
    parts = max(1, -(-queries.count() // GROUP))
    for part in range(parts):
        found: dict[int, list] = {}
        for r in queries.filter(F.col("v").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).select("query_id", "v").collect():
            found.setdefault(len(r["v"]), []).append((r["query_id"], r["v"]))
        yield {d: (np.array([i for i, _ in q], np.int64), unit(np.array([v for _, v in q], np.float64).reshape(len(q), d))) for d, q in found.items()}


def merge(best: tuple[np.ndarray, np.ndarray], at: int, s: np.ndarray, own: np.ndarray) -> None:
    """Puts the similarities ``s`` of the queries from ``at`` on with the rows ``own`` into their best lists (similarities, ids), in place."""
    held, ids = best[0][at : at + len(s)], best[1][at : at + len(s)]
    better = s >= held[:, -1:]
    better &= np.isfinite(s)
    r, c = np.nonzero(better)
    if not len(r):
        return
    kept = np.isfinite(held)
    rows, score, row_id = np.concatenate((np.nonzero(kept)[0], r)), np.concatenate((held[kept], s[r, c])), np.concatenate((ids[kept], own[c]))
    order = np.lexsort((row_id, -score, rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = place < held.shape[1]
    held[rows[first], place[first]], ids[rows[first], place[first]] = score[order[first]], row_id[order[first]]


def scanned(queries: DataFrame, rows: DataFrame, k: int, scores: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, row_id, similarity): each task's k best rows (row_id, v) for each query; ``scores`` gives similarities of query vectors and a batch's vectors, -inf for pairs it leaves out."""

    def one(group: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                column = batch.column(1)
                sizes, starts = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy()[:-1]
                valid, values = column.is_valid().to_numpy(zero_copy_only=False), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
                every = batch.column(0).to_numpy(zero_copy_only=False)
                for d, (_, q) in group.items():
                    at = np.flatnonzero(valid & (sizes == d))
                    if not len(at):
                        continue
                    x, ids = unit(values[starts[at][:, None] + np.arange(d)]), every[at]
                    if d not in best:
                        best[d] = np.full((len(q), k), -np.inf), np.full((len(q), k), LAST)
                    for i in range(0, len(x), 2048):
                        own = ids[i : i + 2048]
                        for j in range(0, len(q), AT_ONCE):  # what is held at once grows with neither side
                            merge(best[d], j, np.round(scores(q[j : j + AT_ONCE], x[i : i + 2048]), 6), own)
            for d, (s, own) in best.items():
                r, c = np.nonzero(np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(group[d][0][r]), pa.array(own[r, c].astype(np.int64)), pa.array(s[r, c])], ["query_id", "row_id", "similarity"])

        return rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, FOUND)

    return reduce(DataFrame.unionByName, map(one, query_groups(queries)))


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, rank, row_id, similarity): exact cosine top-k; queries (query_id, v), rows (row_id, v), ties to smaller ids.

    Vectors meet those of their length; null ones take no part.
    """
    met = scanned(queries, rows, k, lambda q, x: q @ x.T)
    if threshold is not None:
        met = met.filter(F.col("similarity") >= threshold)
    return top_per_query(met, k, F.desc("similarity"), "row_id").select("query_id", "rank", "row_id", "similarity")


def hyperplanes(dimension: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` random unit normals as columns, at right angles to each other as far as the dimension allows: these order vectors better than independent ones."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(dimension, dimension)))[0] for _ in range(-(-bits // dimension))]
    return np.concatenate(bases, axis=1)[:, :bits]


def vector_topk_lsh(queries: DataFrame, rows: DataFrame, k: int, bits: int = 512, share: float = 0.04, least: int = 20, seed: int = 5) -> DataFrame:
    """(query_id, rank, row_id, similarity): cosine top-k among the rows whose sketches fit the query best.

    A row's sketch is on which side of ``bits`` random hyperplanes it lies; it fits a query by the
    sum of the query's distances to the planes, counted against it where both lie on different
    sides. Of each 2048 rows the ``share`` (``least`` at least) that fit best get
    their exact similarity; the others are left out. More ``bits`` order rows better, a larger ``share`` scores more of them.
    """

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        planes = hyperplanes(q.shape[1], bits, seed) if q.shape[1] else np.zeros((0, bits))
        fit = (q @ planes) @ np.where(x @ planes > 0, 1.0, -1.0).T
        n = min(len(x), max(least, int(share * len(x))))
        out, near = np.full(fit.shape, -np.inf), np.argpartition(-fit, n - 1, axis=1)[:, :n]
        for i in range(0, len(q), 256):
            np.put_along_axis(out[i : i + 256], near[i : i + 256], np.einsum("qd,qnd->qn", q[i : i + 256], x[near[i : i + 256]]), 1)
        return out

    return top_per_query(scanned(queries, rows, k, scores), k, F.desc("similarity"), "row_id").select("query_id", "rank", "row_id", "similarity")


def topk_recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall): how many of the exact (query_id, row_id) the other list holds."""
    hit = exact.select("query_id", "row_id").join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
