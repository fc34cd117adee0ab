"""Reading order, clusters, tables, transcripts, listings, headings and word search against literal cases or brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.operators import layout, search, sections, tables
from corposcope.sources import corpus
from corposcope.streaming import streams

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"doc_id long, page_no int, block_index int, box {BOX}"


def test_reading_order_by_columns(spark):
    boxes = [(0, 0, 400, 10), (0, 20, 190, 30), (210, 20, 390, 30), (0, 40, 190, 50), (210, 40, 390, 50), (0, 60, 400, 70), (0, 80, 190, 90), (210, 80, 390, 90), (395, 5, 400, 99)]
    df = spark.createDataFrame([(1, 1, i, tuple(map(float, b))) for i, b in enumerate(boxes)] + [(1, 2, 0, (0.0, 50.0, 90.0, 60.0)), (1, 2, 1, (210.0, 10.0, 300.0, 20.0))], BLOCK)
    got = layout.reading_order(df, 400.0).orderBy("page_no", "reading_no").collect()
    assert [r.block_index for r in got if r.page_no == 1] == [0, 1, 3, 2, 4, 5, 6, 7, 8]
    assert [r.block_index for r in got if r.page_no == 2] == [1, 0]


def test_box_clusters_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for page in range(1, 7):
        for i in range(12):
            x, y = rng.randrange(100), rng.randrange(100)
            rows.append((1, page, i, (float(x), float(y), float(x + rng.randrange(20)), float(y + rng.randrange(20)))))
    want = {}
    for page in range(1, 7):
        mine = [r for r in rows if r[1] == page]
        label = {r[2]: r[2] for r in mine}
        for _ in mine:
            for a in mine:
                for b in mine:
                    if all(max(a[3][k], b[3][k]) <= min(a[3][k + 2], b[3][k + 2]) + 3 for k in (0, 1)):
                        label[a[2]] = label[b[2]] = min(label[a[2]], label[b[2]])
        want |= {(page, i): c for i, c in label.items()}
    got = {(r.page_no, r.block_index): r.cluster for r in layout.box_clusters(spark.createDataFrame(rows, BLOCK), 3.0).collect()}
    assert got == want and len({(p, c) for (p, _), c in want.items()}) < len(rows)


def test_merge_fragments(spark):
    rows = [(1, 1, 1, 3, (0.0, 0.0, 100.0, 50.0)), (1, 1, 2, 3, (5.0, 55.0, 95.0, 90.0)), (1, 1, 3, 3, (0.0, 150.0, 100.0, 160.0)), (1, 1, 4, 2, (0.0, 161.0, 100.0, 170.0))]
    got = layout.merge_fragments(spark.createDataFrame(rows, f"doc_id long, page_no int, piece_id int, n_cols int, box {BOX}")).orderBy("piece_id").collect()
    assert [(r.piece_id, r.n_pieces, tuple(r.box)) for r in got] == [(1, 2, (0.0, 0.0, 100.0, 90.0)), (3, 1, (0.0, 150.0, 100.0, 160.0)), (4, 1, (0.0, 161.0, 100.0, 170.0))]


def test_table_chunks_hold_every_row_once(spark):
    rows = [["h1", "h2"]] + [[str(i), "x" * (300 if i in (3, 20) else 10)] for i in range(30)]
    df = spark.createDataFrame([(1, 1, rows), (2, 1, [["only", "header"]])], "doc_id long, table_id int, rows array<array<string>>")
    got = tables.rows_to_chunks(df, 12, 400).orderBy("chunk_no").collect()
    assert [r.doc_id for r in got] == [1] * len(got)
    assert sum(r.n_rows for r in got) == 30 and max(r.n_rows for r in got) == 12 and [r.chunk_no for r in got] == list(range(len(got)))
    lines = [line for r in got for line in r.text.split("\n")[2:]]
    assert [line.split(" | ")[0] for line in lines] == [f"| {i}" for i in range(30)]
    assert all(r.text.startswith("| h1 | h2 |\n") for r in got)


def test_dedupe_tables(spark):
    rows = [(1, 1, 1, "Table 1", 0.2), (1, 1, 2, " table  1", 0.9), (1, 1, 3, None, 0.1), (1, 1, 4, "", 0.1), (1, 2, 5, "Table 1", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, table_id int, caption string, quality double")
    assert sorted(r.table_id for r in tables.dedupe_tables(df).collect()) == [2, 3, 4, 5]


def test_clean_transcript(spark):
    captions = ["WEBVTT", "Kind: captions", "1", "00:01.000 --> 00:02.000", "Hello", "2", "Hello <c>world</c>", "Hello world", None, "", "Hello", "Next &amp; last"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(captions)], "doc_id long, pos int, text string")
    assert corpus.clean_transcript(df).first().text == "Hello world\nNext & last"
    assert corpus.clean_transcript(df.filter("pos < 4")).collect() == []


def test_tables_are_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    for form in ("parquet", "json", "csv"):
        for _ in range(2):
            corpus.write_tables({"rows": df}, f"{tmp_path}/{form}", form)
        back = spark.read.schema("id long, t string").option("header", "true").format(form).load(f"{tmp_path}/{form}/rows")
        assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_headings(spark):
    rows = [(t,) for t in ("2.1 Related  Work", "IV. Results", "Appendix B Proofs", None, "Civil law")]
    got = [r.v for r in spark.createDataFrame(rows, "t string").select(X.heading_variants(F.col("t")).alias("v")).collect()]
    assert got == [["related work"], ["results"], ["appendix b proofs", "proofs"], [""], ["civil law"]]
    lines = spark.createDataFrame([(1, i, h, t) for i, (h, t) in enumerate([(True, "A"), (True, "a"), (False, "prose"), (False, " "), (True, "B"), (False, "p"), (True, "C")])], "doc_id long, pos int, is_heading boolean, text string")
    assert tuple(sections.heading_figures(lines).first()) == (1, 4, 1, 2, 1, 2)


def test_assets_and_anchors_of_sections(spark):
    targets = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "b", 2), (1, "c", 9)], "doc_id long, section string, page_no int")
    assets = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 11, " Other"), (1, 1, 12, None), (1, 2, 13, "a")], "doc_id long, page_no int, asset_id int, section string")
    assert sorted(map(tuple, sections.section_assets(targets, assets).collect())) == [(1, "a", 10), (1, "a", 13), (1, "b", 11), (1, "b", 12)]
    anchors = spark.createDataFrame([(1, "Deep nets", "1. Intro"), (1, "absent", "Intro"), (2, "x", "y")], "doc_id long, anchor string, expected string")
    parts = spark.createDataFrame([(1, "Intro", "of deep-nets."), (1, "Method", "deep nets again")], "doc_id long, title string, text string")
    got = {(r.doc_id, r.anchor): (r.n_found, r.correct) for r in sections.anchor_in_section(anchors, parts).collect()}
    assert got == {(1, "Deep nets"): (2, True), (1, "absent"): (0, False), (2, "x"): (0, False)}


def test_word_search(spark):
    rows = spark.createDataFrame([(1, "red fish, blue fish"), (2, "a red bird"), (3, "Fish that is red"), (4, None)], "row_id long, text string")
    queries = spark.createDataFrame([(1, "red fish"), (2, "unseen red"), (3, "")], "query_id long, query string")
    assert [(r.query_id, r.row_id) for r in search.full_text_search(queries, rows, 5).orderBy("query_id", "rank").collect()] == [(1, 1), (1, 3)]
    found = search.tfidf_search(queries, rows, 5).filter("query_id = 1").orderBy("rank").collect()
    assert [r.row_id for r in found] == [1, 3, 2] and all(0 < r.cosine <= 1 for r in found)
    window = rows.select("row_id", X.best_token_window(X.query_tokens(F.lit("fish red")), F.col("text")).alias("w")).orderBy("row_id").collect()
    assert [r.w and tuple(r.w) for r in window] == [(0, 8, 2), (2, 5, 1), (0, 16, 2), None]
    ranked = spark.createDataFrame([(1, 1, 3), (9, 1, 2), (8, 1, 1)], "query_id long, rank int, row_id long")
    asked = spark.createDataFrame([(1, "red fish"), (9, " 4 "), (8, "77")], "query_id long, query string")
    assert sorted(map(tuple, search.find_rows(asked, ranked, rows).collect())) == [(1, 1, 3), (8, 1, 1), (9, 1, 4)]


def test_listing_and_excerpt(spark):
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, None)], "id long, at int")
    assert [r.id for r in corpus.list_newest(rows, "at", "id").collect()] == [3, 2, 1, 4]
    pages = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, "z")], "doc_id long, page_no int, text string")
    wanted = spark.createDataFrame([(1, 1, 2)], "doc_id long, first_page int, last_page int")
    assert corpus.page_excerpt(pages, wanted).first().text == "a\nb"


def test_stream_of_postings_follows_changes(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "doc_id long, changed_at int, text string"
    for rows in ([(1, 1, "old words"), (2, 1, "stay here"), (3, 1, "gone soon")], [(1, 2, "middle"), (1, 3, "new new words"), (3, 2, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.stream_postings(spark.readStream.schema(schema).parquet(source), out, f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted(map(tuple, streams.current_postings(spark, out).collect()))
    assert got == [("here", 2, 1), ("new", 1, 2), ("stay", 2, 1), ("words", 1, 1)]


@pytest.mark.parametrize("name", ["s4_clean_transcripts", "w13_reading_order", "w17_table_chunks"])
def test_queries_without_a_twin_cover_every_document(spark, name):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id for r in entry.queries()[name](spark, folder).select("doc_id").collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").filter("trim(text) <> ''").select("doc_id").collect()}
    assert got <= every and len(got) >= 0.9 * len(every)


def test_query_profile(spark):
    df = spark.createDataFrame([("a training method",), ("F1 on which benchmark",), ("cats",), (None,)], "q string")
    assert [r.k for r in df.select(X.query_profile(F.col("q")).alias("k")).collect()] == [["method"], ["result", "benchmark"], ["overview"], ["overview"]]


def test_sentence_focus_and_match_score(spark):
    rows = [("Other text here. Neural nets are useful.\nNets of neural kind",), ("",), (None,), ("nothing to see",)]
    df = spark.createDataFrame(rows, "t string")
    q, tokens = F.lit("neural nets"), X.query_tokens(F.lit("neural nets"))
    got = df.select(X.sentence_focus(q, tokens, F.col("t")).alias("f"), F.round(X.query_match_score(q, tokens, F.col("t")), 6).alias("s")).collect()
    # 2 hits, their share, order, one pair, the phrase: 2.5 + 1.1 + 1.4 + 0.8 + 8; then compactness, the verb and the length
    assert (got[0].f.hits, got[0].f.exact, got[0].f.chars, got[0].f.explains, got[0].f.score) == (2, True, 23, True, pytest.approx(13.8 + 1.4 + 0.7 + 0.45))
    assert got[0].s == pytest.approx(13.8 + 0.8 + 1.6 + 1.2 + 1.0 + 0.6)
    assert [r.s for r in got[1:]] == [0.0, 0.0, 0.0] and got[1].f is None and got[3].f.hits == 0


def test_table_quality(spark):
    df = spark.createDataFrame([(["Model", "F1", " "], [["a", "1"], ["b", ""]]), (["col_1", "12"], []), ([], [])], "h array<string>, r array<array<string>>")
    got = [r.q for r in df.select(X.table_quality(F.col("h"), F.col("r")).alias("q")).collect()]
    assert got == [pytest.approx(3.6 + 0.9 + 0.9 + 2 / 3 - 1.3 - 1.7), pytest.approx(3.6 - 1.5 - 1.7), 0.0]


def test_doc_gate(spark):
    # query_id, doc_id, row_id, canonical, exact, content hits, match score; each query has two content words and no rare one
    rows = [
        (1, 1, 1, None, True, 2, 0.3), (1, 2, 2, "appendix", True, 2, 0.3), (1, 3, 3, "appendix", True, 2, 0.3), (1, 3, 4, "results", True, 2, 0.2),
        (1, 4, 5, "appendix", True, 2, 0.3),
    ]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, row_id long, canonical string, exact_phrase boolean, content_hits int, match_score double").withColumns({
        "query": F.lit("neural nets"), "lex_hits": F.col("content_hits"), "content_count": F.lit(2), "rare_hits": F.lit(0), "rare_count": F.lit(0), "weighted_ratio": F.lit(1.0),
        "block_match_score": F.lit(1.0), "keyword_score": F.lit(0.1), "semantic_raw_score": F.lit(None).cast("double"), "search_bucket": F.lit("body"),
    })
    bonus = spark.createDataFrame([(1, 4, 0.15), (1, 5, 0.31), (1, 6, 0.29)], "query_id long, doc_id long, bonus double")
    assert sorted((r.doc_id, r.title_bonus) for r in search.doc_gate(hits, bonus).collect()) == [(1, 0.0), (3, 0.0), (4, 0.15), (5, 0.31)]


def test_full_text_search_asks_whole_queries(spark, tmp_path):
    from corposcope import catalog_queries

    spark.createDataFrame([(1, "a b c d e"), (2, "a b c x y"), (3, "e d c b a a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a b c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog_queries.j3_full_text_search(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.row_id for r in got] == [3, 1]


def test_fusion_has_rows_of_both_rankings(spark, tmp_path):
    from corposcope import queries

    spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma beta alpha alpha"), (3, "delta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.row_id: r.sources for r in queries.j6_rrf_fuse(spark, str(tmp_path)).collect()}
    assert got == {1: "vector+text", 2: "vector"}  # row 2 has the words, but not as a phrase
