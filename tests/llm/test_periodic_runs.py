import hashlib
import random
import zlib

import numpy as np
import pytest

from corposcope.llm import periodic_runs
from corposcope.llm.queries import op12_periodic_runs

SCHEMA = "doc_id long, text string, start string, collapsed int, n_runs string"


def plain(words):
    """{(start, end): period} by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return found


def plain_row(doc_id, text, rewrite):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if rewrite and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted((s, e - s, q) for (s, e), q in plain(words).items())
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng, n, k):
    words = [rng.choice(("a", "bé", "c", "日本", "e")[:k]) if k < 6 else f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 20:
            a, p, e = rng.randrange(n), rng.randrange(1, 1 + n // 3), rng.randrange(1, n)
            for i in range(a, min(n, a + e)):
                words[i] = words[a + (i - a) % p]
    return words


def test_transform_is_exact_and_turns_back():
    rng = np.random.default_rng(0)
    for n in (8, 64, 128, 4096, 2**14):
        x = rng.integers(0, periodic_runs.PRIME, (3, n))
        back = periodic_runs.transform(periodic_runs.transform(x.astype(float)), inverse=True)
        assert (back.astype(np.int64) * pow(n, -1, periodic_runs.PRIME) % periodic_runs.PRIME == x).all()
    x, y = rng.integers(0, periodic_runs.PRIME, (2, 128))
    product = periodic_runs.transform((periodic_runs.transform(x[None].astype(float)) * periodic_runs.transform(y[None].astype(float))) % periodic_runs.PRIME, inverse=True)
    want = [sum(int(x[i]) * int(y[(k - i) % 128]) for i in range(128)) % periodic_runs.PRIME for k in range(128)]
    assert (product[0].astype(np.int64) * pow(128, -1, periodic_runs.PRIME) % periodic_runs.PRIME).tolist() == want


def test_zero_lags_are_all_occurrences():
    rng = random.Random(3)
    words = random_words(rng, 300, 2)
    codes = np.array([{"a": 1, "bé": 2}[w] for w in words] + [0], np.int64)
    squares = np.concatenate(([0], np.cumsum(codes * codes)))
    for block, low, high in ((2, 1, 6), (4, 7, 14), (8, 15, 30)):
        at = np.arange(0, 300 - high - block, block)
        b, q = periodic_runs.zero_lags(codes, squares, at, block, low, high - low + 1)
        want = [(i, k) for i in at for k in range(low, high + 1) if words[i : i + block] == words[i + k : i + k + block]]
        assert sorted(zip(b.tolist(), q.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_matches_brute_force_on_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = random_words(rng, rng.choice((0, 1, 11, 12, 13, 40, 150, 420)), rng.choice((1, 2, 3, 5, 60)))
        if rng.random() < 0.1 and words:  # a string with many runs
            f, g = ["a"], ["a", "b"]
            while len(g) < len(words):
                f, g = g, g + f
            words = g[: len(words)]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([number[w] for w in words] + [len(number)], np.int64)
        got = periodic_runs.runs_of(ids, np.full(len(ids), len(words)), len(words))
        assert got.tolist() == sorted(([s, e, q] for (s, e), q in plain(words).items()), key=lambda r: (r[0], r[2]))


def test_rows_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice((" ", "\n", " \t")).join(random_words(rng, rng.choice((0, 5, 30, 200)), rng.choice((1, 3, 50))))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a " * 13), (203, "a " * 13), (None, "b c " * 9), (204, "x y  " * 7), (205, "\x1f a\x00b " * 8)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    for rewrite in (False, True):
        got = [tuple(r) for r in periodic_runs.find_runs(df, rewrite).collect()]
        assert sorted(map(repr, got)) == sorted(repr(plain_row(i, t, rewrite)) for i, t in rows)


def test_slices_do_not_change_rows(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(random_words(rng, 60, 3)).encode() for _ in range(40)]
    whole = list(periodic_runs.scanned(list(range(40)), texts, True))
    assert whole == [row for i, t in enumerate(texts) for row in periodic_runs.scanned([i], [t], True)]


def test_very_long_texts():
    """A word repeated a million times, a long period, and stretches of one word between words of their own."""
    n = 1_000_000
    same = np.zeros(n + 1, np.int64)
    same[n] = 1
    assert periodic_runs.runs_of(same, np.full(n + 1, n), n).tolist() == [[0, n, 1]]
    base = np.random.default_rng(1).integers(0, 5000, 70_001)
    ids = np.append(np.concatenate((base, base, base[:9])), 5001)
    assert periodic_runs.runs_of(ids, np.full(len(ids), len(ids) - 1), len(ids) - 1).tolist() == [[0, 140_011, 70_001]]
    comb = np.append(np.concatenate([np.append(np.zeros(400, np.int64), i + 1) for i in range(100)]), 1000)
    assert periodic_runs.runs_of(comb, np.full(len(comb), len(comb) - 1), len(comb) - 1).tolist() == [[401 * i, 401 * i + 400, 1] for i in range(100)]


def test_lags_beyond_the_longest_transform(monkeypatch):
    """At the last scale the windows are cut into several."""
    monkeypatch.setattr(periodic_runs, "LONGEST", 64)
    rng = random.Random(2)
    for _ in range(40):
        words = random_words(rng, 500, rng.choice((2, 40)))
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([number[w] for w in words] + [len(number)], np.int64)
        got = periodic_runs.runs_of(ids, np.full(len(ids), len(words)), len(words))
        assert got.tolist() == sorted(([s, e, q] for (s, e), q in plain(words).items()), key=lambda r: (r[0], r[2]))


def test_sums_that_are_multiples_of_the_prime_are_no_runs(monkeypatch):
    """With a tiny prime most zeros are false; every one is confirmed word by word."""
    monkeypatch.setattr(periodic_runs, "PRIME", 257)
    periodic_runs.tables.cache_clear()
    rng = random.Random(4)
    words = random_words(rng, 200, 60)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words] + [len(number)], np.int64)
    got = periodic_runs.runs_of(ids, np.full(len(ids), len(words)), len(words))
    periodic_runs.tables.cache_clear()
    assert got.tolist() == sorted(([s, e, q] for (s, e), q in plain(words).items()), key=lambda r: (r[0], r[2]))


def test_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_small_table(spark):
    found = op12_periodic_runs(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    short = {i: t for i, t in docs.items() if len(t or "") < 6000}
    want = {i: plain_row(i, t, True) for i, t in short.items()}
    got = {r.doc_id: tuple(r) for r in found.collect() if r.doc_id in short}
    assert got == {i: (*w[:7], hashlib.sha256(w[7].encode()).hexdigest()) for i, w in want.items()}
