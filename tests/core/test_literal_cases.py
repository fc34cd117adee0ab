import math

import pytest
from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.operators import evaluate, search, structure
from corposcope.sources import corpus
from corposcope.sources import html as web


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_query_tokens(spark):
    assert one(spark, X.query_tokens, "Large language-model for AI AI planning") == ["large", "language", "model", "for", "planning"]
    assert one(spark, X.content_tokens, "what about Planning for models") == ["planning", "models"]
    assert one(spark, X.query_tokens, None) == []


@pytest.mark.parametrize(("written", "n"), [("XIV", 14), ("7", 7), ("IIV?", None), ("", None), (None, None)])
def test_caption_number(spark, written, n):
    assert one(spark, X.caption_number, written) == n


def test_canonical_heading_and_buckets(spark):
    assert one(spark, X.canonical_heading, "2.1 Related Works") == "related_work"
    assert one(spark, X.canonical_heading, "A Very Odd Name") == "a_very_odd_name"
    assert one(spark, X.canonical_heading, " ") == "other"
    assert one(spark, lambda x: X.section_bucket(x, F.lit(1), F.lit(None).cast("string")), "References\n[1] A") == "references"
    assert one(spark, lambda x: X.section_bucket(x, F.lit(1), F.lit(None).cast("string")), "Abstract of a University") == "front_matter"


def test_flags_and_wer(spark):
    assert one(spark, X.prediction_flags, "") == ["empty"]
    assert one(spark, X.prediction_flags, "You are a speech-to-text engine " + "0" * 20) == ["prompt_leak", "zero_loop"]
    assert one(spark, X.prediction_flags, "abcdefghijkl" * 5) == ["repeat_loop"]
    df = spark.createDataFrame([("a b c d", "a x c"), ("one", ""), ("same words", "Same, words!")], "r string, p string")
    assert [r.e for r in df.select(X.word_errors(F.col("r"), F.col("p")).alias("e")).collect()] == [2, 1, 0]


def test_match_score(spark):
    df = spark.createDataFrame([("alpha beta", "Beta then ALPHA-beta")], "q string, t string")
    got = df.select(X.base_match_score(F.col("q"), X.query_tokens(F.col("q")), F.col("t")).alias("s")).first().s
    assert got == pytest.approx(2 * 1.25 + 1.1 + 1.4 + 0.8 + 8)


def test_rrf(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, row_id long, rank int")
    t = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id long, row_id long, rank int")
    got = [(r.row_id, r.hybrid_score) for r in search.rrf_fuse(v, t, 10).orderBy("rank").collect()]
    assert [i for i, _ in got] == [2, 1, 3]
    assert [s for _, s in got] == [pytest.approx(x, abs=5e-5) for x in (0.016261, 0.008197, 0.008065)]


HITS = "query_id long, row_id long, doc_id long, page_no int, keyword_score double, semantic_score double, lex_hits int, exact_phrase boolean, search_bucket string"


def test_merge_and_doc_scores(spark):
    k = spark.createDataFrame([(1, 10, 1, 1, 0.18, 0.0, 3, False, "body")], HITS)
    s = spark.createDataFrame([(1, 11, 2, 1, 0.0, 0.28, 1, False, "references")], HITS)
    got = {r.row_id: r.match_score for r in search.merge_hits(k, s).collect()}
    assert got == {10: pytest.approx(0.21), 11: pytest.approx(0.0522)}
    hits = spark.createDataFrame([(1, 1, 10, 1, 0.42, "body"), (1, 2, 10, 2, 0.31, "body"), (1, 3, 11, 1, 0.5, "body")], "query_id long, row_id long, doc_id long, page_no int, match_score double, search_bucket string")
    assert {r.doc_id: r.score for r in search.doc_scores(hits).collect()} == {10: pytest.approx(0.656 - 0.03), 11: pytest.approx(0.5)}


def test_token_weight_formula(spark):
    rows = spark.createDataFrame([(i, "needle" if i < 5 else "hay") for i in range(100)], "row_id long, text string")
    got = search.token_stats(spark.createDataFrame([(1, "needle")], "query_id long, query string"), rows).first()
    assert (got.df, got.weight, got.rare) == (5, pytest.approx(math.log(101 / 6) + 1, abs=1e-6), True)


def blocks(spark, lengths):
    return spark.createDataFrame([(1, i, 1, "x" * n) for i, n in enumerate(lengths)], "doc_id long, block_index int, page_no int, text string")


def test_chunks(spark):
    got = structure.chunk_blocks(blocks(spark, [120] * 3), 250, 50, 80).orderBy("chunk_no").collect()
    assert [(len(r.text), r.kind) for r in got] == [(241, "combined"), (171, "single")]
    assert [len(p) for p in structure.cut_text("X" * 3200, 900, 100, 100)] == [900, 900, 900, 800]
    assert structure.cut_text("X" * 500, 210, 200, 1)  # ends though the overlap is almost the window
    got = structure.pack_simple(blocks(spark, [90] * 3), 210).orderBy("block_index").collect()
    assert [r.chunk_no for r in got] == [0, 0, 1]


def test_runs_and_hints(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("ABAA")], "doc long, page int, kind string")
    r = structure.smooth_runs(structure.runs(rows, ["doc"], "page", "kind"), ["doc"], "kind").orderBy("run_no").collect()
    assert "".join(x.label * x.n for x in r) == "AAAA"
    rows = spark.createDataFrame([(1, i, h, 8) for i, h in enumerate([None, 2, None, None, 7, None])], "doc long, i int, hint int, pages int")
    assert [x.page for x in structure.fill_hints(rows, ["doc"], "i", "hint", "pages").orderBy("i").collect()] == [1, 2, 3, 3, 7, 7]


def test_unique_index_and_spans(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate([0, 1, 1, 0, 2])], "page long, i int, block int")
    assert [r.block for r in corpus.unique_index(rows, ["page"], "block", ["i"]).orderBy("i").collect()] == [0, 1, 3, 4, 2]
    h = spark.createDataFrame([(1, 2, "Intro")], "doc_id long, block_index int, title string")
    assert [r.section for r in structure.heading_spans(h, blocks(spark, [1] * 4)).orderBy("block_index").collect()] == ["front_matter", "front_matter", "Intro", "Intro"]


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 7), (1, 2, 3), (3, 1, 9)], "query_id long, rank int, row_id long")
    gold = spark.createDataFrame([(1, 3)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in evaluate.retrieval_eval(ranked, gold, queries).collect()}
    assert (got[1].rr, got[1].hit1, got[1].hit3) == (0.5, False, True)
    assert (got[2].rr, got[2].hit1) == (1.0, True)
    assert (got[3].rr, got[3].hit1) == (0.0, False)


def test_boxes(spark):
    rows = [(1, 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.5, 1.0, 0.0, 10.0, 10.0), (1, 1, 3, 0.4, 50.0, 50.0, 60.0, 60.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, box_id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in structure.iou_dedupe(df).collect()) == [1, 3]


def test_html(spark):
    html = "<html><body><nav><p>menu</p></nav><article><h1>A &amp; B</h1><p>one<p>two <b>bold</b></p><script>x</script><ul><li>item</li></ul></article></body></html>"
    got = web.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block_no").collect()
    assert [(r.tag, r.text) for r in got] == [("h1", "A & B"), ("p", "one"), ("p", "two bold"), ("li", "item")]


def test_sample_counts_an_id_once(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2), ("b", 3, 3)], "cat string, id long, o int")
    got = corpus.sample_per_category(rows, "cat", "id", "o", {"a": 1, "b": 2}).collect()
    assert sorted((r.cat, r.id) for r in got) == [("a", 1), ("b", 2), ("b", 3)]


def test_html_after_a_long_script_is_read(spark):
    html = "<html><head><script>" + "var x = 1; " * 60_000 + "</script></head><body><article><h1>Title</h1><p>The whole text.</p></article></body></html>"
    got = web.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block_no").collect()
    assert [(r.tag, r.text) for r in got] == [("h1", "Title"), ("p", "The whole text.")]


def test_every_line_is_classified(spark, tmp_path):
    from corposcope import queries

    text = "\n".join(["# Title", "some words of prose", "", "Table 1 Results", "12", "more words of prose", "Figure 2 Shapes", "References"])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.p13_headings(spark, str(tmp_path)).orderBy("block_index").collect()
    assert [(r.block_index, r.page_no, r.kind, r.boilerplate, r.bucket) for r in got] == [
        (0, 1, "heading", False, "body"), (1, 1, "prose", False, "body"), (2, 1, "table_caption", False, "body"), (3, 1, "short", True, "body"),
        (4, 1, "prose", False, "body"), (5, 2, "figure_caption", False, "body"), (6, 2, "short", False, "references"),
    ]
