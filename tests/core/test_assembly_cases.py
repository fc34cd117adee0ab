from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.operators import assembly, library, sections

CANDIDATE = "block_id int, block_type string, content string, source_text string, syntax_valid boolean"


def test_candidate_scores_and_choice(spark):
    rows = [
        (1, "table", "<TABLE><tr><td>a</td><th>b</th></tr></table>", None, True),
        (1, "table", "| a | b |", None, True),
        (2, "equation", "$x^{2}$", None, True),
        (2, "equation", "}x^2{", None, True),
        (3, "heading", "Intro", "Intro text", None),
        (3, "heading", "# Intro", "Intro text", None),
        (4, "text", "", "", True),
        (5, "text", None, None, None),
        (6, "text", "abcd", None, True),
    ]
    scored = assembly.candidate_scores(spark.createDataFrame(rows, CANDIDATE))
    got = [(r.renderable, r.score) for r in scored.collect()]
    expected = [
        (True, 0.15 + 0.2 * 0.85 + 0.35 * 0.5 + 0.2 + 0.1 * 0.8), (False, 0.35 * 0.25 + 0.2),
        (True, 0.25 + 0.3 * 0.85 + 0.2 * 0.9 + 0.2 + 0.05 * 0.7), (False, 0.2 * 0.3 + 0.2),
        (True, 0.1 + 0.2 * 0.5 + 0.2 * 0.6 + 0.3 * 0.9), (True, 0.1 + 0.2 * 0.7 + 0.2 * 0.8 + 0.3 * 0.9),
        (False, 0.2), (False, 0.0), (True, 0.1 + 0.3 * 0.75 + 0.2 * 0.8 + 0.2 + 0.2 * 0.9),
    ]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert all(abs(g[1] - e[1]) < 1e-6 for g, e in zip(got, expected, strict=True))
    best = assembly.best_candidates(scored, ["block_id"], "content").orderBy("block_id")
    assert [r.content for r in best.collect()] == [rows[0][2], rows[2][2], "# Intro", "", None, "abcd"]


def test_block_content(spark):
    rows = [("text", " ```markdown\nbody\n``` "), ("text", "```python\nx\n```"), ("heading", "Title"), ("heading", "# T"), ("header_footer", "<<DROP_HEADER_FOOTER>>"), ("text", None), ("heading", " "), ("text", "```\nopen")]
    df = spark.createDataFrame(rows, "k string, t string").select(assembly.block_content(F.col("k"), F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ["body", "```python\nx\n```", "## Title", "# T", "", "", "", "open"]


def test_pages_without_repeated_headers(spark):
    rows = [
        (1, 1, 0, "header_footer", "Deep  Nets", True, "top"), (1, 1, 1, "heading", "deep nets for all", True, "body"), (1, 1, 2, "text", "unsent", False, "body"), (1, 1, 3, "header_footer", "unsent", True, "bottom"),
        (1, 2, 0, "header_footer", "Deep Nets", True, "top"), (1, 2, 1, "text", "other", True, "body"), (2, 1, 0, "text", None, True, "body"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, pos int, block_type string, content string, emit boolean, band string")
    got = sorted(map(tuple, assembly.assemble_pages(df).collect()))
    assert got == [(1, 1, 1, "## deep nets for all"), (1, 2, 2, "Deep Nets\n\nother")]
    assert assembly.assemble_pages(df.limit(0)).count() == 0


def test_page_classes(spark):
    base = {"images": 0, "drawings": 0, "two_columns": False, "garbled": False, "image_share": 0.0, "tables": 0}
    rows = [base | r for r in (
        {"doc_id": 1, "page_no": 1, "text_len": 900}, {"doc_id": 2, "page_no": 1, "text_len": 10}, {"doc_id": 3, "page_no": 1, "text_len": 900},
        {"doc_id": 3, "page_no": 2, "text_len": 300, "drawings": 9}, {"doc_id": 3, "page_no": 3, "text_len": 300, "image_share": 0.6},
    )]
    got = {(r.doc_id, r.page_no): (r.doc_class, r.page_class) for r in assembly.page_classes(spark.createDataFrame(rows)).collect()}
    assert got == {(1, 1): ("simple_text", "simple_text"), (2, 1): ("ocr", "ocr"), (3, 1): ("hybrid_paper", "simple_text"), (3, 2): ("hybrid_paper", "hybrid_paper"), (3, 3): ("hybrid_paper", "ocr")}


def test_table_regions(spark):
    box = lambda y0, y1: (0.0, float(y0), 100.0, float(y1))
    rows = [
        (1, 1, 0, box(0, 10), True, False), (1, 1, 1, box(20, 30), False, True), (1, 1, 2, box(40, 50), True, False), (1, 1, 3, box(60, 70), False, True), (1, 1, 4, box(80, 90), False, False), (1, 1, 5, box(95, 99), False, True),
        (1, 2, 0, box(0, 10), True, False), (1, 2, 1, box(90, 99), False, True), (1, 3, 0, box(0, 10), True, False), (1, 3, 1, box(50, 200), False, True), (1, 3, 2, box(210, 330), False, True),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, pos int, box struct<x0:double,y0:double,x1:double,y1:double>, caption boolean, fits boolean")
    assert sorted(map(tuple, assembly.table_regions(df).collect())) == [(1, 1, 0, 0.0, 70.0, 3), (1, 1, 2, 40.0, 70.0, 1), (1, 3, 0, 0.0, 200.0, 1)]


def test_questions(spark):
    schema = "kind string, text string, answer string, explanation string, reference string"
    df = spark.createDataFrame([(" MCQ ", "\n why? ", " ", None, " p. 3 "), (None, "what?", "x", "e", ""), ("", " \t", "x", "e", "r"), ("mcq", None, "x", "e", "r")], schema)
    assert sorted(map(tuple, library.normalized_questions(df).collect())) == [("mcq", "why?", None, None, "p. 3"), ("short_answer", "what?", "x", "e", None)]


def test_reference_run(spark):
    entry = "Smith, J., Doe, A. and Roe, B. A Title of a Paper. Proceedings of Things, {}."
    texts = ["plain words of an introduction that go on for a while"] * 6 + [entry.format(2001 + i) for i in range(4)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([*texts, "[12] short"])], "doc_id long, pos int, text string")
    assert [r.ok for r in df.orderBy("pos").select(X.reference_like(F.col("text")).alias("ok")).collect()] == [False] * 6 + [True] * 4 + [False]
    assert [tuple(r) for r in sections.reference_start(df, X.reference_like(F.col("text"))).collect()] == [(1, 6)]
