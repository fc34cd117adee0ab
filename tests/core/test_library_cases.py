"""Layout, section, registry and text operators against literal cases."""

import pytest
from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.functions.sentences import sentences
from corposcope.operators import layout, search, sections
from corposcope.sources import registry

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def column(spark, made, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(made(F.col("x")).alias("y")).first().y


def test_box_measures(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0), (0.0, 30.0, 5.0, 40.0))], f"a {BOX}, b {BOX}, c {BOX}")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(layout.area(a), layout.overlap(a, b), layout.iou(a, b), layout.gap(a, c), layout.share_of_narrower(a, c), layout.union(a, c)).first()
    assert list(got)[:5] == [100.0, 25.0, pytest.approx(25 / 175), 20.0, 1.0]
    assert tuple(got[5]) == (0.0, 0.0, 10.0, 40.0)


def test_caption_bind_prefers_above_and_near(spark):
    schema = f"doc_id long, page_no int, asset_id long, box {BOX}"
    tables = spark.createDataFrame([(1, 1, 7, (0.0, 100.0, 200.0, 200.0))], schema)
    captions = spark.createDataFrame([(1, 1, 1, (0.0, 80.0, 200.0, 95.0)), (1, 1, 2, (0.0, 202.0, 200.0, 215.0)), (1, 2, 3, (0.0, 95.0, 200.0, 99.0))], schema.replace("asset_id", "caption_id"))
    got = layout.caption_bind(tables, captions).first()
    assert (got.caption_id, got.cost) == (1, 5.0)


def test_best_per_number(spark):
    rows = [(1, 1, 1, 3, 0.5), (1, 1, 2, 3, 0.9), (1, 1, 3, None, 0.1), (1, 1, 4, None, 0.2)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, asset_id long, number int, score double")
    assert sorted(r.asset_id for r in layout.best_per_number(df).collect()) == [2, 3, 4]


def test_text_rows_chain_over_tall_boxes(spark):
    rows = [(1, 1, i, (0.0, a, 1.0, b)) for i, (a, b) in enumerate([(0.0, 30.0), (5.0, 10.0), (20.0, 25.0), (31.0, 40.0)])]
    df = spark.createDataFrame(rows, f"doc_id long, page_no int, block_index int, box {BOX}")
    assert [r.row_no for r in layout.text_rows(df).orderBy("block_index").collect()] == [0, 0, 0, 1]


def test_section_tree(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 3, 2, 1])], "doc_id long, pos int, level int")
    got = [(r.parent, r.end) for r in sections.section_tree(df).orderBy("pos").collect()]
    assert got == [(None, 4), (0, 3), (1, 3), (0, 4), (None, None)]


def test_empty_headings_and_runs(spark):
    rows = [(1, 0, False, None, "lead"), (1, 1, True, 3, "A"), (1, 2, True, 3, "B"), (1, 3, False, None, "prose"), (1, 4, True, 3, "C")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, is_heading boolean, level int, text string")
    assert [r.pos for r in sections.drop_empty_headings(df).orderBy("pos").collect()] == [0, 2, 3]
    assert [(r["first"], r["last"], r["n"]) for r in sections.heading_runs(df).collect()] == [(1, 2, 2)]


def test_merge_sections_drops_empty_ones(spark):
    df = spark.createDataFrame([(1, 0, 1, "A", "x"), (1, 1, 1, "B", " "), (1, 2, 1, "A", "y"), (1, 3, 2, "A", "z")], "doc_id long, pos int, level int, title string, text string")
    assert [(r.pos, r.text) for r in sections.merge_sections(df).orderBy("pos").collect()] == [(0, "x\ny"), (3, "z")]


def test_reference_start(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("rrr---r-rrrr")], "doc_id long, pos int, text string")
    assert sections.reference_start(df, F.col("text") == "r").first().pos == 8


def test_registry(spark):
    claims = spark.createDataFrame([(1, True, 1), (1, True, 2), (1, False, 3)], "doc_id long, is_primary boolean, at int")
    got = registry.demote_primary(claims, ["doc_id"], [F.desc("at")]).orderBy("at").collect()
    assert [r.is_primary for r in got] == [False, True, False]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    audit = registry.audit_storage(ids(1, 2, 3, 4), ids(1, 2), ids(1, 3))
    assert {r.doc_id: r.state for r in audit.collect()} == {1: "backed", 2: "remote_only", 3: "local_only", 4: "broken"}
    assert {r.doc_id: r.action for r in registry.repair_plan(audit).collect()} == {2: "restore", 3: "upload", 4: "unrecoverable"}


def test_small_text_rules(spark):
    assert column(spark, X.json_strings, '[" a ", "", null, "b"]') == ["a", "b"]
    assert column(spark, X.json_strings, "no json") == []
    assert column(spark, X.figure_mentions, "See Fig. 12, figure 2 and Figure 12.") == [2, 12]
    assert column(spark, X.arxiv_id, "https://arxiv.org/pdf/2301.01234v2") == "2301.01234"
    assert column(spark, X.video_id, "https://youtu.be/abcdefghijk?t=3") == "abcdefghijk"
    assert column(spark, X.video_id, None) is None
    assert column(spark, X.abstract_of, "Title\nAbstract\nWe show it.\n1 Introduction\nText") == "We show it."
    assert column(spark, X.abstract_of, "no such part") == "no such part"
    assert [column(spark, X.noise_line, t) for t in ("12", "3.1.", "Figure 2:", "= + 12 34", "Plain words here", "")] == [True, True, True, True, False, False]
    assert column(spark, sentences, "Short one. This sentence has more than six words in it. End.") == ["This sentence has more than six words in it."]
    assert column(spark, lambda x: X.boundary_match(F.lit("GAN"), x), "Two GANs, compared") is True
    assert column(spark, lambda x: X.boundary_match(F.lit("GAN"), x), "organ") is False


def test_tables(spark):
    kind = "array<array<string>>"
    assert column(spark, X.clean_table, [[" a ", "", "b"], ["", "", ""], ["1", ""]], kind) == [["a", "b"], ["1", ""]]
    assert column(spark, X.clean_table, [["", " "]], kind) == []
    assert column(spark, X.table_markdown, [["a", "b|c"], ["1", "x\ny"]], kind) == "| a | b\\|c |\n| --- | --- |\n| 1 | x<br/>y |"
    assert column(spark, X.table_csv, [["a", 'b"c'], ["1,2", None]], kind) == 'a,"b""c"\n"1,2",'


def test_search_parts(spark):
    hits = spark.createDataFrame([(1, 5, 1, 1, 0.5), (1, 5, 1, 2, 2.0), (1, 6, 2, 3, -1.0)], "query_id long, doc_id long, page_no int, rank int, similarity double")
    pages = spark.createDataFrame([(5, 1, 51), (6, 2, 62)], "doc_id long, page_no int, row_id long")
    got = {r.row_id: r.semantic_score for r in search.chunk_hits_to_pages(hits, pages).collect()}
    assert got == {51: pytest.approx(1 / 17 + 0.15, abs=1e-6), 62: pytest.approx(1 / 18, abs=1e-6)}
    bonus = spark.createDataFrame([(1, 5, 0.4), (1, 6, 0.29), (1, 7, 0.5)], "query_id long, doc_id long, bonus double")
    scored = spark.createDataFrame([(1, 7)], "query_id long, doc_id long")
    assert [(r.doc_id, r.page_no) for r in search.title_rescue(scored, bonus, pages).collect()] == [(5, 1)]
    texts = spark.createDataFrame([(1, 5, 1, "one"), (1, 6, 2, "two"), (1, 5, 3, "three"), (1, 7, 4, "one")], "query_id long, doc_id long, rank int, text string")
    got = search.context_by_doc(texts).orderBy("source_no").collect()
    assert [(r.source_no, r.doc_id, r.n, r.context) for r in got] == [(1, 5, 2, "one\n\nthree"), (2, 6, 1, "two")]


def test_page_hints_and_recall(spark):
    h = spark.createDataFrame([(1, 0, "A", "x"), (1, 1, "B", "y"), (1, 2, "C", "z")], "doc_id long, pos int, title string, canonical string")
    r = spark.createDataFrame([(1, "A", "q", 5), (1, "A", "q", 3), (1, "K", "y", 7)], "doc_id long, title string, canonical string, page int")
    assert [x.page for x in sections.seed_page_hints(h, r).orderBy("pos").collect()] == [3, 7, None]
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "doc_id long, v string")
    assert tuple(sections.set_recall(gold.filter("v = 'a'"), gold, "v").first()) == (1, 2, 1, 0.5)


def test_section_text_is_whole(spark):
    rows = spark.createDataFrame([(1, "s", 1 + i // 5, i, f"line {i} " + "x" * 100) for i in range(100)] + [(1, "s", 30, 200, "line 0 " + "x" * 100)], "doc_id long, section string, page_no int, block_index int, text string")
    whole = "\n".join(f"line {i} " + "x" * 100 for i in range(100))
    assert sections.section_text(rows).first().text == whole
    assert sections.section_text(rows, 4000).first().text == whole[:4000]
