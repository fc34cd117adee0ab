"""Exact top-k by inner product with pivot-table elimination.

Pivots are chosen far from each other from a bounded sample, and the distances
of every vector to them are computed once: the pivot table. A vector belongs to
the cell of its nearest pivot; cells are packed, or split by a hash, into blocks
of bounded size. For a pivot p, |d(q,p) - d(v,p)| <= d(q,v), and since
2 q.v = |q|^2 + |v|^2 - d(q,v)^2 the largest of these lower bounds on the
distance is an upper bound on the score.

A query first meets the block of its own cell, which gives a first k-th best
score. The range of a cell's distances to each pivot bounds the scores of the
whole cell, so afterwards a query meets only blocks whose bound reaches its k-th
score. In a block candidates are evaluated in the order of their own bounds, a
slice at a time, until no bound reaches the k-th best score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposcope.llm.common import durable

FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def as_integers(df: DataFrame, scale: int = 64) -> DataFrame:
    """(row, vec_id, v, dim): components floor(scale * x) as integers; ``row`` tells rows apart.

    Without vectors that are null, empty or hold null or non-finite components, and
    without null ids. Rows that repeat a vec_id are vectors each. Components beyond the
    range of a long stop at its ends. Other columns are not looked at.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    ints = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    return durable(ints.withColumn("dim", F.size("v")))


@dataclass
class Cell:
    """The vectors of a length whose nearest pivot is the same: their blocks, their queries' groups, and their range of distances to each pivot."""

    block: int
    parts: int
    group: int
    group_parts: int
    low: np.ndarray
    high: np.ndarray
    norm: float


def far_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows far from each other: each next one is the row farthest from those before."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def fit_pivots(vectors: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """Pivots of each length of vectors, from the ``sample`` rows of least hash (at most so many reach the driver)."""
    rows = vectors.select("dim", "v", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(sample).select("dim", "v").toPandas()
    return {int(d): far_pivots(np.stack(g["v"].to_numpy()).astype(np.float64), n) for d, g in rows.groupby("dim")}


def _measured(pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds the pivot table: ``near`` (distances), ``cell`` (the nearest pivot) and ``norm`` (the square of the length)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near, cell, norm = [None] * len(f), np.zeros(len(f), np.int32), np.zeros(len(f))
            for dim, at in f.groupby("dim").indices.items():
                v = np.stack(f["v"].to_numpy()[at]).astype(np.float64)
                norm[at] = (v**2).sum(1)
                p = pivots.get(int(dim), v[:0])
                d = np.sqrt(np.maximum(0, norm[at][:, None] + (p**2).sum(1) - 2 * v @ p.T))
                for i, row in zip(at, d, strict=True):
                    near[i] = row
                if len(p):
                    cell[at] = d.argmin(1)
            yield f.assign(near=near, cell=cell, norm=norm)

    return run


def lay_out(table: DataFrame, is_query: Column, n_pivots: int, block: int, query_block: int) -> dict[tuple[int, int], Cell]:
    """Cells by (dim, cell). There are at most as many as pivots for each length of vectors."""
    ranges = [f(F.try_element_at("near", F.lit(i + 1))).alias(f"{name}{i}") for i in range(n_pivots) for name, f in (("low", F.min), ("high", F.max))]
    counts = table.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max("norm").alias("norm"), *ranges).orderBy("dim", "cell").collect()
    cells, blocks, groups, room, query_room, last = {}, 0, 0, 0, 0, None
    for r in counts:
        if r["dim"] != last:
            room, query_room, last = 0, 0, r["dim"]  # blocks hold one length of vectors
        if r["n"] > room:
            blocks += 1
            room = block
        if r["q"] > query_room:
            groups += 1
            query_room = query_block
        parts, group_parts = max(1, -(-r["n"] // block)), max(1, -(-r["q"] // query_block))
        low = np.array([r[f"low{i}"] for i in range(n_pivots) if r[f"low{i}"] is not None])
        high = np.array([r[f"high{i}"] for i in range(n_pivots) if r[f"high{i}"] is not None])
        cells[r["dim"], r["cell"]] = Cell(blocks, parts, groups, group_parts, low, high, r["norm"])
        blocks, groups = blocks + parts - 1, groups + group_parts - 1
        room, query_room = (0 if parts > 1 else room - r["n"]), (0 if group_parts > 1 else query_room - r["q"])
    return cells


def _eliminate(k: int, slice_rows: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best of a block for each of its queries, of at least the score that the query has already."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        if len(queries) and len(rows):
            ids, own = rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
            v, q = np.stack(rows["v"].to_numpy()).astype(np.int64), np.stack(queries["v"].to_numpy()).astype(np.int64)
            # Products of doubles are exact while sums stay below 2^53; beyond that Python's integers are used.
            exact = np.float64 if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[1] < 2**53 else object
            vf, qf = v.astype(exact), q.astype(exact)
            table, near = np.ascontiguousarray(np.stack(rows["near"].to_numpy()).T), np.stack(queries["near"].to_numpy())
            vv, qq = rows["norm"].to_numpy(), queries["norm"].to_numpy()
            least = queries["least"].to_numpy(np.float64, na_value=-np.inf)
            for i, (query_row, query_id) in enumerate(zip(queries["row"].tolist(), queries["vec_id"].tolist(), strict=True)):
                low = np.abs(table - near[i][:, None]).max(axis=0, initial=0.0)
                low = np.maximum(0, low * (1 - 1e-9) - 1e-6)  # rounding never excludes
                bound = (qq[i] + vv - low * low) / 2 + 1e-6 * (1 + qq[i])
                bound[own == query_row] = -np.inf
                order = np.flatnonzero(bound >= least[i])
                order = order[np.argsort(-bound[order])]
                best_s, best, at = np.empty(0, exact), np.empty(0, np.int64), 0
                while at < len(order):
                    if len(best) >= k and bound[order[at]] < float(best_s[k - 1]):
                        break  # an equal bound may still tie with a smaller id
                    part = order[at : at + slice_rows]
                    at += slice_rows
                    part = part[own[part] != query_row]
                    s, w = np.concatenate((best_s, vf[part] @ qf[i])), np.concatenate((best, part))
                    top = np.lexsort((own[w], ids[w], -s))[:k]
                    best_s, best = s[top], w[top]
                good = best_s.astype(np.float64) >= least[i]
                best_s, best = best_s[good], best[good]
                for column, value in zip(out, (np.full(len(best), query_row), np.full(len(best), query_id), ids[best], own[best], best_s.astype(np.int64)), strict=True):
                    column.append(value)
        return pd.DataFrame({c: np.concatenate(x).astype(np.int64) for c, x in zip(("query_row", "query_id", "vec_id", "row", "score"), out, strict=True)})

    return run


def _reached(cells: dict[tuple[int, int], Cell]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each query the blocks, but for the one it has met, in which a cell's bound reaches its k-th score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            where = [[] for _ in range(len(f))]
            for dim, at in f.groupby("dim").indices.items():
                near, norm = np.stack(f["near"].to_numpy()[at]), f["norm"].to_numpy()[at]
                least, met = f["least"].to_numpy(np.float64, na_value=-np.inf)[at], f["block"].to_numpy()[at]
                seen = [set() for _ in at]
                for cell in (c for (d, _), c in cells.items() if d == dim):
                    low = np.maximum(cell.low - near, near - cell.high).max(axis=1, initial=0.0) if near.shape[1] else np.zeros(len(at))
                    low = np.maximum(0, low * (1 - 1e-9) - 1e-6)
                    bound = (norm + cell.norm - low * low) / 2 + 1e-6 * (1 + norm)
                    for i in np.flatnonzero(bound >= least).tolist():
                        seen[i].update(range(cell.block, cell.block + cell.parts))
                for i, blocks, b in zip(at, seen, met, strict=True):
                    where[i] = sorted(blocks - {b})
            yield f.assign(blocks=where).drop(columns=["block", "cell"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 16, sample: int = 4096, query_block: int = 2048, block: int = 8192, slice_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest inner products over all other rows.

    ``vectors`` as ``as_integers`` gives them; ``is_query`` says which are queries.
    Every row but the query's own is a candidate, also one of its vec_id; a
    vec_id that several queries have gets the ranks of each. Vectors of another
    length are no candidates. Ties go to smaller vec_id. Every pair is bounded,
    by its block or by itself, or evaluated; none is left out. A query without
    candidates, and an empty table, give no rows. The worst case, in which no
    bound excludes anything, is all queries against all rows, in blocks.
    """
    chosen = fit_pivots(vectors, pivots, sample)
    name = "row long, vec_id long, v array<long>, dim int, near array<double>, cell int, norm double"
    table = durable(vectors.select("row", "vec_id", "v", "dim").mapInPandas(_measured(chosen), name))
    cells = lay_out(table, is_query, pivots, block, query_block)
    if not cells:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # At most a row for each pivot and length.
    layout = F.broadcast(table.sparkSession.createDataFrame([(d, c, x.block, x.parts, x.group, x.group_parts) for (d, c), x in cells.items()], "dim int, cell int, block int, parts int, grp int, grp_parts int"))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    placed = table.join(layout, ["dim", "cell"]).withColumns({"block": F.col("block") + dealt("parts"), "grp": F.col("grp") + dealt("grp_parts")}).drop("parts", "grp_parts")
    rows = placed.select("block", "row", "vec_id", "v", "near", "norm")
    queries = placed.filter(is_query).select(*(F.col(c).alias(c) for c in placed.columns))  # columns of their own, for joins with ``rows``
    fresh = queries.select("block", "row", "vec_id", "v", "near", "norm", F.lit(None).cast("long").alias("least"))
    first = durable(fresh.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(_eliminate(k, slice_rows), FOUND))
    kth = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    known = queries.join(kth.withColumnRenamed("query_row", "row"), "row", "left").select("row", "vec_id", "v", "dim", "near", "norm", "grp", "block", "cell", "least")
    reached = known.mapInPandas(_reached(cells), "row long, vec_id long, v array<long>, dim int, near array<double>, norm double, grp int, least long, blocks array<int>")
    asked = durable(reached.select("row", "vec_id", "v", "near", "norm", "least", "grp", F.explode("blocks").alias("block")))
    meeting = asked.select(F.col("grp").alias("grp"), F.col("block").alias("block")).distinct()
    shipped = rows.join(meeting, "block")
    later = asked.groupBy("grp", "block").cogroup(shipped.groupBy("grp", "block")).applyInPandas(_eliminate(k, slice_rows), FOUND)
    ranking = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = first.unionByName(later).withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
