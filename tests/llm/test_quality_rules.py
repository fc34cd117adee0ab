import random
from collections import Counter

from corposcope.llm import quality_rules

SCHEMA = "doc_id long, text string, source string, n_words string"


def repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 3)})


def test_measures_match_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        words = [rng.choice("abcd") * rng.randint(1, 2) + rng.choice(["", "", "#", "%|"]) for _ in range(rng.choice([0, 1, 2, 3, 60, 400]))]
        text = "".join(w + rng.choice([" ", "  ", "\t", "\n", "\n\n"]) for w in words)
        rows.append((i, text, rng.choice(["a", "b", None]), "clash"))
    rows += [(200, None, "a", None), (201, "é" * 5, "a", None), (202, "x y z " * 30000, None, None), (None, "dup", "c", None), (None, "dup", "c", None)]
    got = quality_rules.host_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, _, _ in rows:
        text = text or ""
        words, r = text.split(), by[doc_id]
        lines = [x for x in text.split("\n") if x.split()]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_words(words)
        assert r.base_failed == (len(words) < 50 or 2 * r.n_repeat_words > len(words))
        assert not (r.base_failed and r.kept)


def text_with(symbols, n=80):
    """Words of eight characters with so many symbols behind them; with ``s`` symbols the excess is 10 s / (8 n + s)."""
    return " ".join(f"word{i:04}" + "#" * (symbols // n + (i < symbols % n)) for i in range(n))


def test_hosts_decide_on_soft_failures_in_both_directions(spark):
    """The same mild failure stays on a good host and goes on a bad one; so does a document just under the limit on a bad host alone."""
    clean, mild, near, gross = text_with(0), text_with(85), text_with(64), text_with(400)
    rows = [(i, "too short" if i % 3 else gross, "bad", None) for i in range(120)] + [(200 + i, clean, "good", None) for i in range(120)]
    rows += [(500 + i, gross if i % 8 == 0 else clean, "middling", None) for i in range(120)]
    rows += [(1000 + i, t, h, None) for i, (t, h) in enumerate((t, h) for h in ("bad", "good", "middling") for t in (clean, near, mild, gross))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.host_rules(df).collect()}
    assert 1.1 < got[1002].excess_symbols < 1.3 and 0.8 < got[1001].excess_symbols < 1
    kept = [[got[1000 + 4 * h + i].kept for i in range(4)] for h in range(3)]
    assert kept == [[True, False, False, False], [True, True, True, False], [True, True, True, False]]
    assert not got[0].host_ok and got[0].limit_symbols == quality_rules.TIGHTEST and got[200].limit_symbols > 1.2
    assert {d for d, r in got.items() if r.kept} == {r.doc_id for r in quality_rules.keep_good(df).collect()}


def plain_limits(rows, worst_rate=0.5):
    """{host: [limit of each softer rule]} from (host, [any failed, then each rule failed])."""
    import math

    hosts = {}
    for h, flags in rows:
        n, x = hosts.setdefault(h, [0, [0] * 4])
        hosts[h] = [n + 1, [a + b for a, b in zip(x, flags, strict=True)]]
    total, over, rates = sum(n for n, _ in hosts.values()), {}, {}
    for r in range(4):
        m = sum(x[r] for _, x in hosts.values()) / total
        spread = sum(n * (x[r] / n - m) ** 2 for n, x in hosts.values()) - (len(hosts) - 1) * m * (1 - m)
        share = total - sum(n * n for n, _ in hosts.values()) / total
        between = max(0.0, spread / share) if share else 0.0
        strength = min(1000.0, max(1.0, m * (1 - m) / between - 1 if between > 1e-15 else 1000.0))
        for h, (n, x) in hosts.items():
            rate = (x[r] + m * strength) / (n + strength)
            rates[h, r] = rate
            over[h, r] = math.log(rate / (1 - rate) / (m / (1 - m))) if 0 < m < 1 and 0 < rate < 1 else 0.0
    return {h: [max(0.8, min(2.0 if rates[h, 0] <= worst_rate else 1.0, math.exp(-(0.5 * over[h, r] + 0.25 * over[h, 0])))) for r in (1, 2, 3)] for h in hosts}


def test_limits_match_a_plain_computation(spark):
    rng = random.Random(12)
    rows = [(i, text_with(rng.choice((0, 0, 0, 60, 75, 90, 300)) if rng.random() < k / 5 else 0), f"h{k}", None) for i, k in enumerate(rng.randrange(5) for _ in range(400))]
    rows += [(900 + i, None, None, None) for i in range(3)]
    got = quality_rules.host_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_limits([(r.source, [r.any_failed, r.fails_symbols, r.fails_lines, r.fails_length]) for r in got])
    for r in got:
        mine = [r.limit_symbols, r.limit_lines, r.limit_length]
        assert all(abs(a - b) < 1e-9 for a, b in zip(mine, want[r.source], strict=True))
        assert r.kept == (not r.base_failed and all(e <= f for e, f in zip((r.excess_symbols, r.excess_lines, r.excess_length), mine, strict=True)))
    assert any(r.kept and r.any_failed for r in got) and any(not r.kept and not r.any_failed for r in got)


def test_junk_on_mixed_hosts_goes_and_clean_documents_stay(spark):
    """Hosts of realistic rates (5 to 20 %): no host is bad, yet softer failures go."""
    clean = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"word{i} %%%" for i in range(80))
    lines = "\n".join([" ".join(f"w{i}" for i in range(60)), "same line", "same line"])
    rows, bad = [], set()
    for h, n_bad in enumerate((5, 8, 11, 14, 20)):
        for i in range(100):
            text = (junk if i % 2 else lines) if i < n_bad else clean
            rows.append((1000 * h + i, text, f"h{h}", None))
            if i < n_bad:
                bad.add(1000 * h + i)
    got = quality_rules.host_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert max(r.host_rate for r in got) < 0.5 and not any(r.base_failed for r in got)
    symbols = {r.doc_id for r in got if r.fails_symbols}
    kept = {r.doc_id for r in got if r.kept}
    assert {d for d, *_ in rows} - bad <= kept and symbols and not symbols & kept
    worst = {r.doc_id for r in got if r.fails_lines and r.source == "h4"}
    assert worst and not worst & kept
    assert kept == {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_windows_count_by_all_bits_of_their_hash(spark):
    """Two other windows here agree in the upper 44 bits; and a text of more than 2^20 windows counts alike."""
    close = "a b x6043705 p a b x12773749 q a b x6043705 r"
    long = " ".join(f"n{i}" for i in range(1 << 20)) + " tail of it n1 n2 n3"
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(spark.createDataFrame([(1, close, "s", None), (2, long, "s", None), (3, long + " end", None, None)], SCHEMA)).collect()}
    assert got == {1: repeat_words(close.split()), 2: 6, 3: 6}


def test_keep_good_returns_rows_as_they_were(spark):
    """Repeated rows, nulls, and a column named like a measure."""
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, clean, None, "clash"), (1, clean, None, "clash"), (None, clean, "s", None), (3, None, "s", None), (4, "", None, None)]
    got = quality_rules.keep_good(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "source", "n_words"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[:3]))


def test_empty_table(spark):
    assert quality_rules.keep_good(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality_rules.host_rules(spark.createDataFrame([], SCHEMA)).count() == 0
