import random

import numpy as np
import xxhash

from corposcope.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string"


def plain(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least[find(i)] for i in range(len(rows))]


def test_words_within_one_bit_share_a_golay_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    keys, count = simhash.golay_keys(words)
    assert set(count) <= {1, 6}
    for bit in range(23):
        other, n = simhash.golay_keys(words ^ (1 << bit))
        for a, m, b, k in zip(keys, count, other, n, strict=True):
            assert set(a[:m]) & set(b[:k])


def test_fingerprints_within_three_bits_share_a_key():
    rng = random.Random(2)
    for _ in range(60):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << bit
        keys, owner = simhash.keys_of(np.array([x, y], np.uint64))
        assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, " \t\n", "ÄÖÜ Straße", "x " * 20000, "one", "one two"]
    rows = [(i * 7 % 1000, t, "en", "clash") for i, t in enumerate(texts)]
    rows += rows[:3]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "lang", "fp", "component_id"] or set(got.columns) == {"doc_id", "lang", "fp", "component_id"}
    prints = [(r[0], plain(r[1])) for r in rows]
    expected = sorted((d, p, c) for (d, p), c in zip(prints, plain_components(prints), strict=True))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()) == expected


def test_empty_table_and_unknown_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", None, None), (None, "a b c d e", None, None), (4, None, "x", "y"), (4, None, "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.doc_id is not None) == [(False, 4), (False, 4)]
    kept = simhash.keep_one(spark.createDataFrame(rows + [(9, "", "x", "y"), (8, None, None, None), (None, "other", None, None)], SCHEMA)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == ["(4, None)", "(None, 'a b c d e')", "(None, 'other')"]
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def classes(sets, least=0.8):
    """Brute force: the first of all sets reached over pairs at least so alike."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_keep_one_by_similarity(spark):
    """Against exact similarity of every pair: copies edited a little or much, around 0.8 and below."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["one two", "one  TWO", "x y z"]
    sets = [shingles(t) for t in texts]
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b]
    assert sum(0.7 < p < 0.8 for p in pairs) > 30 and sum(0.8 <= p < 0.9 for p in pairs) > 30
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    expected = classes(sets)
    got = {r.row: r["class"] for r in simhash.similar_classes(docs.withColumn("row", docs["doc_id"]).select("row", "doc_id", "text"), 0.8).collect()}
    assert got[900] == got[901] == 900
    # Nothing is linked that brute force does not link; next to nothing is missed.
    assert all(expected[got[i]] == expected[i] for i in range(len(texts)))
    assert sum(got[i] == expected[i] for i in range(len(texts))) >= 0.98 * len(texts)
    kept = {r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()}
    assert kept == set(got.values())


def test_lists_leave_no_pair_out_between_classes(spark):
    """Variants of one text that are all 0.7 alike share lists with very many others: what the lists leave out is met afterwards."""
    rng = random.Random(8)
    signed = []
    for i in range(240):
        words = [f"w{j}" for j in range(400)]
        for at in rng.sample(range(60), 7):
            words[at * 6] = f"e{i}x{at}"
        every = np.unique(np.array(simhash.shingle_hashes(" ".join(words).encode(), 5), np.uint64))
        signed.append((i * 7 - 500, simhash.signature(every)))
    size = 8 * simhash.BANDS
    bands = [{s[b * 8 : b * 8 + 8] for b in range(simhash.BANDS)} for _, s in signed]
    marks = np.stack([np.frombuffer(s[size:], np.uint64) for _, s in signed])
    like = [simhash._alike(marks, m) >= 0.8 - simhash.MARGIN for m in marks]
    every = {(signed[i][0], signed[j][0]) for i in range(240) for j in range(i + 1, 240) if like[i][j] and bands[i] & bands[j]}
    rows = spark.createDataFrame(signed, "id long, sig binary")
    proposed, cut = simhash.proposed_pairs(rows, 0.8)
    found = {(min(p), max(p)) for p in map(tuple, proposed.collect())}
    assert found < every
    none = spark.createDataFrame([], "node long, root long")
    assert found | {tuple(p) for p in simhash.left_out(rows, cut, none, 0.8).collect()} == every
    half = spark.createDataFrame([(i, -500) for i, _ in signed[:120]], "node long, root long")
    between = {p for p in every if max(p) >= signed[120][0]}
    simhash.CELL, old = 16, simhash.CELL
    try:
        got = {tuple(p) for p in simhash.left_out(rows, cut, half, 0.8).collect()}
    finally:
        simhash.CELL = old
    assert between <= found | got and got <= between


def test_links_between_classes_grow_with_texts_not_with_pairs(spark, monkeypatch):
    """Variants that are nearly alike by thousands of pairs, some of them with copies that are: rows between classes stay below the rows of lists, classes are those of brute force."""
    rng = random.Random(5)
    texts = []
    for i in range(200):
        words = [f"w{j}" for j in range(400)]
        for at in rng.sample(range(60), 7):
            words[at * 6] = f"e{i}x{at}"
        texts.append(" ".join(words))
        if i % 5 == 0:
            words[399 - i] = f"copy{i}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    expected = classes(sets)
    assert len(set(expected)) == 200 and sum(len(a & b) >= 0.68 * len(a | b) for i, a in enumerate(sets) for b in sets[:i]) > 10_000
    made, left_out = [], simhash.left_out
    monkeypatch.setattr(simhash, "left_out", lambda *a: made.append(left_out(*a)) or made[-1])
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    got = {r.row: r["class"] for r in simhash.similar_classes(docs, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    assert made[0].count() < len(texts)


def test_class_links_over_cells_and_batches(spark, monkeypatch):
    """Lists whose members are held in several cells, by number or by bytes, link the same classes; a forest of them leaves."""
    rng = random.Random(6)
    texts = []
    for i in range(30):
        words = [f"v{j}" for j in range(150)]
        for at in rng.sample(range(150), 6):
            words[at] = f"e{i}x{at}"
        for k in range(4):
            copy = list(words)
            copy[0], copy[149] = f"a{i}x{k}", f"b{i}x{k}"
            texts.append(" ".join(copy))
    sets = {i: np.unique(np.array(simhash.shingle_hashes(t.encode(), 5), np.uint64)) for i, t in enumerate(texts)}
    rows = spark.createDataFrame([(i, simhash.signature(s)) for i, s in sets.items()], "id long, sig binary")
    held = spark.createDataFrame([(i, np.unique(s.astype(np.uint32)).tobytes()) for i, s in sets.items()], "set_id long, held binary")
    keys = rows.selectExpr(f"explode(transform(sequence(0, {simhash.BANDS - 1}), i -> cast(conv(hex(substring(sig, i * 8 + 1, 8)), 16, -10) AS long))) AS key").distinct()
    roots = spark.createDataFrame([(i, i // 4 * 4) for i in range(len(texts)) if i % 4 < 2], "node long, root long")
    found = {}
    for name, (cell, size) in {"one": (1024, 1 << 24), "many": (7, 1 << 24), "bytes": (1024, 4000)}.items():
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "CELL_BYTES", size)
        pairs = [tuple(r) for r in simhash.left_out(rows, keys, roots, 0.8, lambda wanted: held.join(wanted, "set_id")).collect()]
        assert all(a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in pairs)
        links = spark.createDataFrame(pairs + [(i, i + 1) for i in range(0, len(texts), 4)], "a long, b long")
        found[name] = {r.node: r.root for r in simhash.connected_components(links).collect()}
    assert found["one"] == found["many"] == found["bytes"]
    expected = classes([shingles(t) for t in texts])
    assert sum(found["one"].get(i, i) == expected[i] for i in range(len(texts))) >= 0.98 * len(texts)
