import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corposcope.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 5)), max_size=6, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_knapsack_reaches_the_best_sum(items, budget):
    lengths, counts = [a for a, _ in items], [n for _, n in items]
    take = mixing.bounded_knapsack(lengths, counts, budget)
    sums = {0}
    for a, n in items:
        sums = {s + a * k for s in sums for k in range(n + 1)}
    assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
    assert sum(a * t for a, t in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left = budget - sum(fixed.values())
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if part[s] > 2 * sizes[s]}
        if not over:
            return fixed | part
        fixed |= over


def test_targets_and_takings(spark):
    rng = random.Random(6)
    rows = []
    for i in range(2500):
        source = rng.choice(["hot"] * 8 + [f"s{k}" for k in range(7)] + [None])
        rows.append((i, rng.choice([" ", "\t", "\n"]).join("w" for _ in range(rng.choice([0, 1, 5, 60, rng.randint(1, 900)]))), source, "clash"))
    rows += [(9000, None, "s1", None), (9001, "w " * 20000, "s2", None), (None, "tie tie", "s3", None), (None, "tie tie", "s3", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == {"doc_id", "text", "source", "size", "source_size", "target", "taken"}
    sizes, taken = {}, {}
    for r in found:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    goal = plain_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(7), with_text=False).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in found)
    rows_out = mixing.mixed_rows(df)
    assert rows_out.columns == df.columns and rows_out.count() == sum(r.taken // r.size for r in found if r.size)


def test_empty_tables_and_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    only = mixing.mix(spark.createDataFrame([(1, "", "a", None), (2, None, None, None)], SCHEMA)).collect()
    assert [(r.size, r.taken, r.target) for r in only] == [(0, 0, 0.0)] * 2
