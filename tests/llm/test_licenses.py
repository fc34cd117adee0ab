import random
import re

from corposcope.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def in_order(words, phrases):
    low = 0
    for p in phrases:
        at = next((i for i in range(low, len(words)) if words[i : i + len(p.split())] == p.split()), None)
        if at is None:
            return False
        low = at + len(p.split())
    return True


def test_phrases_out_of_order_or_apart():
    index, idf = licenses.build_index(100, {b"the": 100, b"software": 50})
    label, phrases, text = next(t for t in licenses.TEMPLATES if t[0] == "zlib")
    known = licenses.templates()
    look = lambda x: licenses.scan_words(licenses.words_of(x.encode()), index, idf, known)
    assert look(text)[1:] == ({"zlib"}, 1.0)
    assert look(" ".join(reversed(phrases)))[1] == set()
    # Words put in between part the phrases; the rest is still found in place about each.
    _, labels, share = look(text.replace("2 altered", "copyright 2020 someone 2 altered"))
    assert labels == {"zlib"} and 0.7 < share < 1
    # Posted words in place, but not the phrase between them.
    assert look("the origin of that software must not be misrepresented")[1] == set()


def test_matches_brute_force(spark):
    rng = random.Random(3)
    pieces = [x for _, phrases, text in licenses.TEMPLATES for x in (*phrases, text)] + ["gnu", "general public", "license", "Apache", "LICENSE", "été cc", "BY", "mit", "the", "of", "MIT-License", "apache, license"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))), "clash", 1) for i in range(300)]
    rows += [(400, None, None, None), (401, "", None, None), (402, "word " * 50000 + "MIT License", None, None), (7, rows[7][1], None, None), (None, "İ apache license", None, None)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1])
    expected = []
    for doc_id, text, _, _ in rows:
        words = WORD.findall(lowered(text))
        places = [(label, i) for label, p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        every = {label for label, phrases, _ in licenses.TEMPLATES if in_order(words, phrases)}
        own = {label for label, _ in places}
        expected.append((str(doc_id), len(words), len(places), min((i for _, i in places), default=None), max((i for _, i in places), default=None), ",".join(sorted(own)), ",".join(sorted(own | every))))
    found = [(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert next(r.score for r in got if r.doc_id == 402) < 1


def test_whole_notice_scores_one_and_empty_table(spark):
    got = licenses.scan(spark.createDataFrame([(1, "x. Released under the MIT License.", None, None)], SCHEMA)).first()
    assert (got.score, got.labels, got.first_word) == (1.0, "mit", 4)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
