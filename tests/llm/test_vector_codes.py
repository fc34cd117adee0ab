import math
import random

import numpy as np
from pyspark.sql import functions as F

from corposcope.llm import common, vector_codes

SCHEMA = "vec_id long, embedding array<float>, code string, v array<int>, bounds binary, error long, label int"


def plain(rows, parts, entries, rounds, scale=256):
    """(vec_id, label, code, error) sorted, and the last codebooks, by full scans in plain Python."""
    kept = [(i, label, [math.floor(scale * x) for x in np.array(v, np.float32).astype(float).tolist()]) for i, v, label in rows if v is not None and None not in v and all(map(math.isfinite, v)) and len(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for j, xs in groups.items():
                books[p][j] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    found = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        found.append((i, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    return found, books


def compared(spark, rows, parts, entries, rounds, **more):
    df = spark.createDataFrame([(i, v, "x", [1], b"y", 5, label) for i, v, label in rows], SCHEMA).repartition(3)
    got, history = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds, **more)
    want, books = plain(rows, parts, entries, rounds)
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert sorted(map(repr, ((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got.collect()))) == sorted(repr((*w, totals[w[1]])) for w in want)
    assert history[-1].tolist() == books
    return got


def test_matches_plain_rounds_with_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(60)]
    rows = [(i, base[rng.randrange(60)] if i % 3 else [rng.choice((-0.5, 0.0, 0.25)) for _ in range(8)], rng.choice((1, 2, None))) for i in range(300)]
    rows += [(i, base[0], 7) for i in range(300, 400)] + [(5, rows[5][1], 1), (5, base[3], 1), (None, base[4], None)]
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (904, [], 1)]
    for parts, entries, rounds in ((4, 16, 2), (2, 5, 4), (8, 64, 1), (1, 1, 2)):
        compared(spark, rows, parts, entries, rounds)


def test_fewer_rows_than_entries(spark):
    compared(spark, [(3, [0.5, -0.5], None), (1, [0.25, 0.75], 1)], 2, 64, 2)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    compared(spark, [(i, [rng.uniform(-1, 1) * 10 ** rng.randrange(6) for _ in range(4)], i % 3) for i in range(120)], 2, 8, 3)


def test_other_lengths_take_no_part(spark):
    rows = [(i, [i / 10, 0.5, 0.0, 1.0], 1) for i in range(20)]
    df = spark.createDataFrame([(i, v, "x", [1], b"y", 5, k) for i, v, k in [*rows, (50, [1.0, 2.0], 1), (51, [1.0] * 3, 1), (52, [], 1)]], SCHEMA)
    got, _ = vector_codes.compress(df, parts=2, entries=4)
    assert {r.vec_id for r in got.collect()} == set(range(20))


def test_components_beyond_the_range_stop_there(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38], "x", [1], b"y", 5, None), (2, [0.0, 0.0], "x", [1], b"y", 5, None)], SCHEMA)
    got, history = vector_codes.compress(df, parts=2, entries=2)
    assert {r.vec_id: r.code for r in got.collect()} == {1: "0000", 2: "0101"}
    assert abs(history).max() == vector_codes.LARGEST


def test_empty_table(spark):
    got, history = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and history.size == 0


def test_bounds_save_distances_and_net_moves_are_tighter():
    """Entries that go back and forth have a net displacement of zero: bounds of old stamps then exclude every scan."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-5000, 5000, (64, 4))
    x = (centres[rng.integers(0, 64, 4000)] + rng.integers(-40, 40, (4000, 4))).astype(np.int64)
    group = vector_codes.groups_of(64)
    history = np.stack([centres, centres + 900, centres])
    b = vector_codes.first_scan(x, history[0], group)
    vector_codes.rescan(x, history[:1], group, b)
    assert vector_codes.rescan(x, history[[0, 1, 2]], group, b) <= len(x)
    assert (b.own == vector_codes.distances(x, history[2]).argmin(1)).all()
    drift = np.stack([centres, centres + rng.integers(-9, 9, centres.shape)])
    b = vector_codes.first_scan(x, drift[0], group)
    assert vector_codes.rescan(x, drift, group, b) < 0.1 * len(x) * 64
    assert (b.own == vector_codes.distances(x, drift[1]).argmin(1)).all()


def test_bounds_hold_over_random_rounds():
    """After any history the bounds kept are true bounds and the nearest entry is right, ties to the lower index."""
    rng = np.random.default_rng(8)
    for entries in (1, 2, 7, 20):
        x, group = rng.integers(-6, 6, (200, 2)), vector_codes.groups_of(entries, 4)
        history = rng.integers(-6, 6, (1, entries, 2))
        b = vector_codes.first_scan(x, history[0], group)
        for _ in range(6):
            history = np.concatenate((history, np.clip(history[-1:] + rng.integers(-1, 2, (1, entries, 2)), -6, 6)))
            vector_codes.rescan(x, history, group, b)
            d = vector_codes.distances(x, history[-1])
            assert (b.own == d.argmin(1)).all()
            for g in range(group.max() + 1):
                for r in range(len(x)):
                    others = [j for j in np.flatnonzero(group == g) if j != b.own[r]]
                    then = vector_codes.distances(x[r : r + 1], history[b.low_stamp[r, g]])[0]
                    assert not others or b.low[r, g] <= math.sqrt(min(then[others])) + 1e-9


def test_many_labels_meet_in_slices(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 2)
    compared(spark, [(i, [i / 50, (i * 7 % 50) / 50], None if i % 5 == 0 else i % 9) for i in range(100)], 2, 4, 2)


def test_tables_between_rounds_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    df = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    got, _ = vector_codes.compress(df, parts=2, entries=4, rounds=3)
    assert got.count() == 50 and len(list(tmp_path.iterdir())) == 1
