import math
import random

from pyspark.sql import functions as F

from corposcope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, label int"


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(150)]
    rows = [(i, [rng.choice(base)[j] if i % 3 else base[i % 150][j] for j in range(8)], "c", 1) for i in range(400)]
    rows += [(i, base[0], "c", 1) for i in range(400, 460)]
    rows += [(1000, None, None, None), (1001, [1.0, None] + [0.0] * 6, None, None), (1002, [float("nan")] * 8, None, None), (1003, [float("inf")] * 8, None, None), (1004, [], None, None), (1005, [1.0, 2.0], None, None), (None, base[0], None, None), (40, rows[40][1], "c", 1)]
    df = topk.as_integers(spark.createDataFrame(rows, SCHEMA))
    rows = [(r.row, r.vec_id, list(r.v)) for r in df.collect()]
    assert not {1000, 1001, 1002, 1003, 1004, None} & {i for _, i, _ in rows} and any(i == 1005 for _, i, _ in rows)
    expected = []
    for row, q, v in rows:
        if q % 20 == 0:
            every = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, r) for r, i, w in rows if r != row and len(w) == len(v))[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i, _) in enumerate(every)]
    for how in ({"pivots": 4, "query_block": 7, "block": 50, "slice_rows": 8}, {"pivots": 16, "block": 30, "query_block": 100, "sample": 20}, {"pivots": 1}, {}):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, **how).collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    df = topk.as_integers(spark.createDataFrame([(1, [1.0, 0.0], None, None), (1, [2.0, 0.0], None, None), (20, [1.0, 0.0], None, None), (20, [0.0, 1.0], None, None)], SCHEMA))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=2).collect()))
    assert got == sorted([(20, 1, 1, 8192), (20, 2, 1, 4096), (20, 1, 1, 0), (20, 2, 1, 0)])


def test_tight_clusters_leave_blocks_unmet(spark):
    """Bounds exclude whole blocks where vectors stand in clusters; the result is exact all the same."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 5) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 8]], None, None) for i in range(800)]
    df = topk.as_integers(spark.createDataFrame(rows, SCHEMA))
    v = {r.vec_id: list(r.v) for r in df.collect()}
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=3, pivots=8, block=60, query_block=10).collect()
    for q in range(0, 800, 20):
        every = sorted((-sum(a * b for a, b in zip(v[q], w, strict=True)), i) for i, w in v.items() if i != q)[:3]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in every]


def test_components_are_floored(spark):
    row = spark.createDataFrame([(1, [-0.01, 0.5, -1.0], None, None)], SCHEMA)
    assert list(topk.as_integers(row).first().v) == [math.floor(64 * x) for x in (-0.01, 0.5, -1.0)]


def test_empty_table(spark):
    df = topk.as_integers(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
