import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corposcope.llm import languages
from corposcope.llm.queries import op13_language_id

SCHEMA = "doc_id long, text string, lang string, y int, h string, ids int, n int"


def subwords(text):
    """Subwords of one to four characters, with 0 at the edges of words."""
    shaped, words = text.lower(), [[0]]
    for c in shaped:
        if c.isalpha():
            words[-1].append(ord(c))
        elif len(words[-1]) > 1:
            words[-1].append(0)
            words.append([0])
    if len(words[-1]) > 1:
        words[-1].append(0)
    found = Counter()
    for w in words:
        for n in range(1, 5):
            for i in range(len(w) - n + 1):
                if any(w[i : i + n]) and (n < 3 or all(w[i + 1 : i + n - 1])):
                    found[tuple(w[i : i + n])] += 1
    return found


def bucket(points):
    h = 0
    for n, p in enumerate(points, 1):
        h = (h * 0x100000001B3 + p + n) % 2**64
    return (h * 0x9E3779B97F4A7C15 % 2**64) >> 50


@pytest.mark.parametrize("text", ["Un été, là-bas!", "a", "  ab\n\nc1d ", "日本 語", "it's x" * 40, "\U0001d400b \U0001f600 z"])
def test_buckets_match_plain_subwords(text, monkeypatch):
    want = Counter()
    for s, n in subwords(text).items():
        want[bucket(s)] += n
    counts = languages.bucket_counts(text)
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == want
    monkeypatch.setattr(languages, "CHUNK", 7)
    assert (languages.bucket_counts(text) == counts).all()


def test_texts_without_a_letter():
    assert all(languages.bucket_counts(t) is None for t in (None, "", " \n", "12 3.4 !?", "\U0001f600"))


def test_temperature_and_threshold():
    rng = np.random.default_rng(0)
    truth = rng.normal(0, 2, (4000, 3))
    y = np.array([rng.choice(3, p=p) for p in languages.softmax(truth)])
    temperature, least = languages.calibrated(truth * 3, y, 0.9)
    assert 2.4 < temperature < 3.7  # logits three times too large
    p = languages.softmax(truth * 3 / temperature)
    kept = p.max(1) >= least
    assert 0.1 < kept.mean() < 0.9 and (p.argmax(1) == y)[kept].mean() >= 0.9
    assert languages.calibrated(np.eye(3)[y] * 9, y, 0.99)[1] == 0.0
    assert languages.calibrated(np.zeros((0, 3)), np.zeros(0, int), 0.99) == (1.0, 0.0)


def test_held_out_accuracy_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op13_language_id(spark, "/root/testdata/sf0.01")
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.lang_pred == truth[r.doc_id] for r in held if r.accepted) / sum(r.accepted for r in held) > 0.98


def test_held_out_languages_are_not_looked_at(spark):
    """Other languages, sources and ids of rows that are not learned from change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = languages.remainder(F.col("doc_id")) == 1
    a = languages.identify(docs, sample_rows=60)
    b = languages.identify(docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string")).repartition(5), sample_rows=60)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "h", 2, 3) for i, t, lang in rows], SCHEMA)


def test_edge_cases(spark):
    rows = [(i, "the house and the garden " * (1 + i % 3), "en") for i in range(0, 60, 2)] + [(i, "das haus und der garten " * (1 + i % 3), "de") for i in range(1, 60, 2)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 ?!", "en"), (103, "der garten " * 40_000, "de"), (104, "the", None), (104, "the", None), (None, "und das haus", "de"), (105, "THE GARDEN AND THE HOUSE", None)]
    found = languages.identify(frame(spark, rows).repartition(4)).collect()
    said = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i in (100, 101, 102):
        assert (said[i].lang_pred, said[i].score, said[i].accepted) == ("und", 0.0, False)
    assert [said[i].lang_pred for i in (103, 104, None, 105)] == ["de", "en", "de", "en"] and said[None].held_out is False
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id == 104}) == 1


def test_one_language_and_none(spark):
    one = languages.identify(frame(spark, [(0, "abc", "en"), (2, "xyz", "en"), (3, "1", "en")])).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in one) == [(0, "en", 1.0), (2, "en", 1.0), (3, "und", 0.0)]
    none = languages.identify(frame(spark, [(1, "abc", None), (2, "xyz", None)])).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in none} == {("und", 0.0, False)}
    assert languages.identify(frame(spark, [])).count() == 0


def test_sample_is_bounded_with_a_hot_language(spark):
    rows = [(i, f"wort{i} eins zwei", "de") for i in range(3000)] + [(i, f"word{i} one two", "en") for i in range(5000, 5040)] + [(7, "mot un deux", "fr")] * 500
    found, sample = languages.training_rows(frame(spark, rows), 90, 10)
    counts = Counter(found[y] for y, *_ in sample)
    assert set(counts) <= {"de", "en", "fr"} and max(counts.values()) <= 30 and counts["de"] == 30 and counts["en"] > 15
    assert languages.training_rows(frame(spark, rows), 90, 1)[0] == ["de"]
