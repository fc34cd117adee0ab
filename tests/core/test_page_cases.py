import itertools
import random

from pyspark.sql import functions as F

from corposcope.operators import evaluate, library, pages, search, vectors
from corposcope.sources import corpus
from corposcope.streaming import streams

BLOCK = "doc_id long, page_no int, text string, box struct<x0:double,y0:double,x1:double,y1:double>"


def test_furniture_by_number_stamp_repeat_and_edge(spark):
    rows = []
    for page in range(1, 6):
        rows += [(1, page, f"Page {page} of 9", (0, 300, 100, 310)), (1, page, "Journal of Things 12", (0, 400, 100, 410)), (1, page, f"body text {page} " + "abcde"[page - 1], (0, 100, 400, 690))]
        rows += [(1, page, "Running head", (0, 0, 100, 10))] if page < 3 else []
        rows += [(1, page, "Twice in the middle", (0, 350, 100, 360))] if page < 3 else []
        rows += [(1, page, "foot", (0, 990, 100, 1000))]
    rows += [(2, 1, "arXiv:2101.01234v2 [cs]", (0, 0, 10, 10)), (2, 1, "alone", (0, 20, 10, 30))]
    got = {(r.doc_id, r.text): r.furniture for r in pages.page_furniture(spark.createDataFrame([(*r[:3], tuple(map(float, r[3]))) for r in rows], BLOCK)).collect()}
    assert {t for (_, t), f in got.items() if f} == {*(f"Page {i} of 9" for i in range(1, 6)), "Journal of Things 12", "Running head", "foot", "arXiv:2101.01234v2 [cs]"}
    assert pages.page_furniture(spark.createDataFrame([], BLOCK)).count() == 0


def test_fonts(spark):
    rows = [(1, "x" * 50, 10.0), (1, "x" * 50, 12.0), (1, "Head", 30.0), (2, "a", 9.5), (2, "b", 10.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, font double")
    assert {r.doc_id: r.body_font for r in pages.body_font(df).collect()} == {1: 12.0, 2: 10.5}
    assert {r.doc_id: r.base_font for r in pages.base_font(df).collect()} == {1: 10.0, 2: 10.0}


def most_pairs(pred, gold):
    """Brute force over all orders of the shorter side."""
    a, b = sorted((pred, gold), key=len)
    return max((sum(bool(set(x) & set(y)) for x, y in zip(a, p)) for p in itertools.permutations(b, len(a))), default=0)


def test_heading_match_is_a_largest_one(spark):
    rng = random.Random(4)
    pred, gold, expected = [], [], {}
    for d in range(40):
        sides = [[sorted({rng.choice("abcdef") for _ in range(rng.randint(1, 2))}) for _ in range(rng.randint(0, 5))] for _ in range(2)]
        pred += [(d, i, v) for i, v in enumerate(sides[0])]
        gold += [(d, i, v) for i, v in enumerate(sides[1])]
        if sides[0] or sides[1]:
            expected[d] = (len(sides[0]), len(sides[1]), most_pairs(*sides))
    schema = "doc_id long, pos int, variants array<string>"
    matched = evaluate.heading_match(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema))
    assert {r.doc_id: (r.n_pred, r.n_gold, r.n_matched) for r in matched.collect()} == expected
    got = evaluate.heading_match(spark.createDataFrame([(1, 0, ["b"]), (1, 1, ["a"]), (1, 2, ["c"])], schema), spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["b"]), (1, 2, ["c"]), (1, 3, ["z"])], schema))
    assert evaluate.md_eval(got).first()[1:] == (1.0, 0.75, 0.857143, 0.666667)


def test_note_titles_and_counts(spark):
    notes = spark.createDataFrame([(1, 1, None, "\n  first line \nmore"), (1, 2, " Named ", "x"), (2, 1, "", "y" * 100), (2, 0, "", " \n ")], "doc_id long, note_id long, title string, body string")
    assert [r.title for r in library.note_title(notes).orderBy("doc_id", "note_id").collect()] == ["first line", "Named", "Untitled", "y" * 80]
    docs = spark.createDataFrame([(1,), (3,)], "doc_id long")
    assert sorted(map(tuple, library.note_counts(docs, notes, "doc_id").collect())) == [(1, 2, "Named"), (3, 0, None)]


def test_lsh_recall(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 30]]) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, v array<float>")
    asked = df.filter("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "v")
    exact, found = vectors.vector_topk(asked, df, 10), vectors.vector_topk_lsh(asked, df, 10)
    r = vectors.topk_recall(exact, found).first()
    assert r.n_exact == 180 and r.recall >= 0.9
    best = {(x.query_id, x.row_id): x.similarity for x in exact.collect()}
    assert all(abs(best[k] - s) < 1e-6 for x in found.collect() for k, s in [((x.query_id, x.row_id), x.similarity)] if k in best)
    assert vectors.vector_topk_lsh(asked.limit(0), df, 10).count() == 0


def test_recall_on_the_given_vectors(spark):
    from corposcope import page_queries

    for sf in ("sf0.01", "sf0.1"):
        r = page_queries.j5_lsh_recall(spark, f"/root/testdata/{sf}").first()
        assert r.n_exact >= 100 and r.recall >= 0.9


def test_vectors_of_other_lengths_and_nulls_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0]), (4, []), (5, [0.0, 0.0]), (6, [2.0, 0.0]), (6, [0.0, 3.0])], "row_id long, v array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0, 1.0])], "query_id long, v array<double>")
    got = sorted(map(tuple, vectors.vector_topk(asked, rows, 3).collect()))
    assert got == [(1, 1, 1, 1.0), (1, 2, 6, 1.0), (1, 3, 5, 0.0), (3, 1, 3, 0.0)]
    assert vectors.vector_topk(asked, rows, 3, threshold=0.5).count() == 2


def test_queries_in_several_groups(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)], "row_id long, v array<double>")
    asked = rows.filter("row_id % 7 = 0").withColumnRenamed("row_id", "query_id")
    whole = sorted(map(tuple, vectors.vector_topk(asked, rows, 4).collect()))
    monkeypatch.setattr(vectors, "GROUP", 10)
    assert sorted(map(tuple, vectors.vector_topk(asked, rows, 4).collect())) == whole and len(whole) == 43 * 4


def test_newest_of_repeated_keys_wins(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, at int")
    new = spark.createDataFrame([(2, "z", 2), (2, "y", 3), (5, "n", 1), (5, "n", 1)], "doc_id long, text string, at int")
    assert sorted(map(tuple, corpus.upsert(old, new, ["doc_id"], newest="at").collect())) == [(1, "a", 1), (2, "y", 3), (5, "n", 1)]
    assert sorted(map(tuple, corpus.upsert_keeping(old, new, "doc_id", "at", newest="at").collect())) == [(1, "a", 1), (2, "y", 1), (5, "n", 1)]
    assert sorted(map(tuple, corpus.replace_documents(old, new.filter("doc_id = 2")).collect())) == [(1, "a", 1), (2, "y", 3), (2, "z", 2)]


def test_an_empty_new_version_takes_the_blocks_away(spark, tmp_path):
    out, write = str(tmp_path / "b"), None
    write = streams.ingest_batch(out)
    write(spark.createDataFrame([(1, "old a\nold b"), (2, "stays"), (2, "a")], "doc_id long, text string"), 0)
    write(spark.createDataFrame([(1, "")], "doc_id long, text string"), 1)
    assert [(r.doc_id, r.text) for r in streams.current_blocks(spark, out).collect()] == [(2, "stays")]
