"""Each stage against a plain version on a small corpus, with nulls, copies, repeated rows and an empty table; and the whole."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_quality_rules import repeat_words
from test_simhash import classes, shingles
from test_substrings import without_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = []
    for i in range(40):
        t = text(rng.randint(60, 200))
        if i % 5 == 0:
            t = text(30) + " " + passage + " " + text(40)
        rows.append([i, t])
    rows += [[100 + i, rows[i][1]] for i in range(4)]  # exact copies
    edited = rows[1][1].split()
    edited[5] = "edit"
    rows += [[110, " ".join(edited)], [111, "too short"], [112, None], [113, ""], [114, "again and again " * 40]]
    full = [(d, t, "en", ["a", "b", None][d % 3], len(t or "")) for d, t in rows]
    return full + [full[7], (None, text(90), "en", "a", 1)]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs, out = spark.createDataFrame(corpus(), SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.durable(stage(spark, docs, ""))
        out.append((name, docs.collect(), found.collect(), found.columns))
        docs = found
    return out


def test_quality_keeps_what_passes_the_rules(stages):
    _, before, after, columns = stages[0]
    good = [r for r in before if r.text and len(r.text.split()) >= 50 and 2 * repeat_words(r.text.split()) <= len(r.text.split())]
    assert sorted(map(str, after)) == sorted(map(str, good)) and columns == list(before[0].asDict())


def test_near_dedup_keeps_the_first_of_each_class(stages):
    _, before, after, _ = stages[1]
    rows = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    of = classes([shingles(r.text) for r in rows])
    kept = {i: r for i, r in enumerate(rows) if of[i] == i}
    assert sorted(map(str, after)) == sorted(map(str, kept.values()))
    assert len(after) < len(before) - 4


def test_substring_dedup_takes_out_later_passages(stages):
    _, before, after, _ = stages[2]
    known = [(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in before]
    expected = {d: w for d, w in without_windows(known).items() if w}
    assert {(r.doc_id if r.doc_id is not None else 1 << 62): r.text.split() for r in after} == expected
    assert all(r.n_chars == len(r.text) for r in after) and any(len(t.split()) > len(expected[d]) for d, t in known)


def test_mix_takes_whole_documents_near_the_targets(stages):
    _, before, after, _ = stages[3]
    taken, words = {}, {}
    for r in before:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    goal, level, weight = 1.5 * sum(words.values()), 0.0, {"a": 5, "b": 2, None: 1}
    for _ in range(10):
        full = {s for s in words if weight[s] * level > 2 * words[s]}
        level = (goal - sum(2 * words[s] for s in full)) / max(1, sum(weight[s] for s in words if s not in full))
    for s, n in words.items():
        assert abs(taken.get(s, 0) - min(2 * n, weight[s] * level)) <= 60
    rows = {str(r) for r in before}
    assert all(str(r) in rows for r in after) and max([str(r) for r in after].count(x) for x in rows) <= 2


def test_packing_holds_all_tokens(stages):
    _, before, after, _ = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in after) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    by = {}
    for r in after:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
