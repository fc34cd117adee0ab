import random
import re

import numpy as np
import pyarrow as pa

from corposcope.llm import substrings

SCHEMA = "doc_id long, text string, n_removed string, lang string"


TOKEN = re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+")


def tokens(text):
    """Words with the blanks before them, and what follows the last one."""
    found = TOKEN.findall(text or "")
    return found, (text or "")[sum(map(len, found)) :]


def sentence_starts(found):
    """Positions of the words that begin a sentence."""
    out = []
    for i, t in enumerate(found):
        gap = t[: len(t) - len(t.split()[0])]
        if i == 0 or "\n" in gap or (found[i - 1][-1] in ".!?" and gap[0] in " \t"):
            out.append(i)
    return out


def plain(rows, min_words=20, long_sentence=40):
    """Brute force over all texts: every run in order of (doc_id, place)."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        found, tail = tokens(text)
        begin = sentence_starts(found)
        end = (begin + [len(found)])[1:]
        said = [tuple(t.strip() for t in found[a:b]) for a, b in zip(begin, end, strict=True)]
        words = [len(s) for s in said]
        runs = set()
        for i in range(len(said)):
            for j in range(i + 1, len(said) + 1):
                if (j - i > 1 and sum(words[i:j]) >= min_words) or words[i] >= long_sentence:
                    runs.add((i, j))
                    break
        for j in range(len(said), 0, -1):
            for i in range(j - 1, -1, -1):
                if (j - i > 1 and sum(words[i:j]) >= min_words) or words[j - 1] >= long_sentence:
                    runs.add((i, j))
                    break
        gone = set()
        for i, j in sorted(runs):
            key = tuple(said[i:j])
            if seen.setdefault(key, (doc_id, i)) != (doc_id, i):
                gone.update(range(begin[i], end[j - 1]))
        out[doc_id] = "".join(t for k, t in enumerate(found) if k not in gone) + tail
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 15))) + rng.choice(".!?")
    shared = [[sentence() for _ in range(rng.randint(2, 6))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += rng.choice(shared) if rng.random() < 0.4 else [sentence()]
        text = parts[0] if parts else ""
        for p in parts[1:]:
            text += rng.choice([" ", "\n", "\n\n", "  "]) + p
        rows.append((i * 13 % 101, text))
    long = " ".join(word() for _ in range(45)) + "."
    return rows + [(500, "Start. " + long), (501, long + " End."), (502, "\n\n"), (503, "no end " * 9000)]


def test_matches_brute_force(spark):
    rows = corpus()
    got = substrings.remove_repeats(spark.createDataFrame([(d, t, "clash", "en") for d, t in rows], SCHEMA))
    assert got.filter("n_removed > 0").count() > 5
    assert {r.doc_id: r.text for r in got.collect()} == plain(rows)
    for r in got.collect():
        text = dict(rows)[r.doc_id]
        for start, length in reversed([tuple(s) for s in r.removed_spans]):
            text = text[:start] + text[start + length :]
        assert text == r.text


def test_words_and_sentences_of_a_slice():
    texts = [t for _, t in corpus()] + [None, "", "ä. b\tc!\td?e f\r\n g", "x.  y"]
    words = substrings.words_of(pa.array(texts).slice(3))
    for k, text in enumerate(texts[3:]):
        a, b = words.first[k], words.first[k + 1]
        assert [bytes(words.data[i:j]).decode() for i, j in zip(words.start[a:b], words.end[a:b], strict=True)] == (text or "").split()
        assert np.flatnonzero(words.opens[a:b]).tolist() == sentence_starts(tokens(text)[0])


def test_small_slices_and_batches_change_nothing(spark, monkeypatch):
    """Rows are settled within a slice or by the joint sort; both ways agree. So do the ways with and without a broadcast."""
    rows = spark.createDataFrame([(d, t, None, "en") for d, t in corpus()], SCHEMA).repartition(5)
    expected = {r.doc_id: r.text for r in substrings.remove_repeats(rows, passage_words=50).collect()}
    for batch, most in ((1, 10**6), (3, 0)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            assert {r.doc_id: r.text for r in substrings.remove_repeats(rows, passage_words=50, most_keys=most).collect()} == expected
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_names_used_inside_may_be_columns(spark):
    passage = " ".join(f"Sentence {i} of the passage has words." for i in range(9))
    df = spark.createDataFrame([(1, passage, "a", 5), (2, passage, "b", 6)], "doc_id long, text string, mark string, ord int")
    got = substrings.remove_repeats(df, passage_words=50)
    assert got.columns[:4] == ["doc_id", "text", "mark", "ord"]
    assert sorted((r.doc_id, r.text == "", r.mark, r.ord) for r in got.collect()) == [(1, False, "a", 5), (2, True, "b", 6)]


def test_nulls_ties_and_empty_tables(spark):
    passage = " ".join(f"Sentence {i} of the passage has words." for i in range(9))
    rows = [(1, None, None, None), (2, "", None, None), (None, passage, None, None), (3, passage, None, "x"), (3, passage, None, "x")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted((str(r.doc_id), r.text) for r in got)
    assert found == sorted([("1", None), ("2", ""), ("None", ""), ("3", passage), ("3", passage)])
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def without_windows(rows, n=50):
    """Brute force: words of each text outside windows of ``n`` words that occurred before."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        words, gone = text.split(), set()
        for i in range(len(words) - n + 1):
            first = seen.setdefault(tuple(words[i : i + n]), (doc_id, i))
            if first[0] < doc_id or i - first[1] >= n:
                gone.update(range(i, i + n))
        # A window known from another document may also repeat without overlap here.
        out[doc_id] = [w for i, w in enumerate(words) if i not in gone]
    return out


def test_passages_in_mid_sentence_go(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [" ".join(word() + rng.choice(["", "", "", "", ".", ","]) for _ in range(n)) for n in (50, 51, 60, 75, 120)] + [" ".join(f"x{i}" for i in range(49))]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [" ".join(word() for _ in range(rng.randint(1, 30)))] + ([rng.choice(passages)] if rng.random() < 0.6 else [])
        rows.append((i * 13 % 101, rng.choice([" ", "\n"]).join(parts) + " and so on."))
    rows.append((300, "go on " * 200))
    got = substrings.remove_repeats(spark.createDataFrame([(d, t, None, "en") for d, t in rows], SCHEMA), min_words=10**6, long_sentence=10**6, passage_words=50).collect()
    expected = without_windows(rows)
    assert {r.doc_id: r.text.split() for r in got} == expected
    before = dict(rows)
    for r in got:
        assert r.removed_words == len(before[r.doc_id].split()) - len(expected[r.doc_id])
        assert (r.n_removed > 0) == (r.removed_words > 0) == (len(r.removed_spans) > 0)
        text = before[r.doc_id]
        for start, length in reversed([tuple(s) for s in r.removed_spans]):
            text = text[:start] + text[start + length :]
        assert text == r.text
    left = [r.doc_id for p in passages[:5] for r in got if p in " ".join(r.text.split())]
    assert len(left) == 5 and expected[300] == ["go", "on"] * 25
    assert sum(passages[5] in " ".join(r.text.split()) for r in got) > 1
    # The sentences' rule and the windows' one together leave no repeat either.
    both = substrings.remove_repeats(spark.createDataFrame([(d, t, None, "en") for d, t in rows], SCHEMA), passage_words=50).collect()
    assert all(sum(p in " ".join(r.text.split()) for r in both) <= 1 for p in passages[:5])
