import random

from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.operators import equations, layout, pages, passages, summaries, tables

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def shortest_stretch(tokens, text):
    words = [(m.group().lower(), m.start(), m.end()) for m in passages.WORD.finditer(text)]
    held = [(b[2] - a[1], b[2], a[1]) for i, a in enumerate(words) for b in words[i:] if tokens <= {w for w, s, _ in words if a[1] <= s <= b[1]}]
    return (min(held)[2], min(held)[1]) if held else None


def test_stretches_against_all_pairs():
    draw = random.Random(4)
    for _ in range(300):
        text = " ".join(draw.choice(["ab", "cd", "ef", "x", "abcd"]) for _ in range(draw.randint(1, 25)))
        tokens = set(draw.sample(["ab", "cd", "ef"], draw.randint(1, 3)))
        assert passages._tightest(tokens, text) == shortest_stretch(tokens, text)


def test_snippets(spark):
    far = "alpha " + "filler " * 60 + "beta"
    rows = [("alpha beta", "x" * 40 + " alpha and\n\nbeta " + "y" * 40), ("alpha", None), ("zz", "short text"), ("nothing", "w " * 400), ("alpha beta", far), (None, "text")]
    got = [r.snippet for r in passages.snippets(spark.createDataFrame(rows, "query string, text string")).collect()]
    assert got[0] == "x" * 11 + " alpha and beta " + "y" * 11
    assert got[1] == "" and got[2] == "short text" and got[3] == ("w " * 400)[:240] and got[5] == "text"
    assert got[4].startswith("alpha filler") and 60 <= len(got[4]) <= 70


def test_localized_prefers_what_the_query_asks_for(spark):
    rows = [(1, "training approach", 1, i, canonical, 0.1, bucket) for i, (canonical, bucket) in enumerate([("methodology", "body"), ("introduction", "body"), ("methodology", "references"), (None, None)])]
    hits = spark.createDataFrame(rows, "query_id long, query string, doc_id long, row_id long, canonical string, match_score double, search_bucket string")
    text = F.lit("The training approach is simple.")
    hits = hits.withColumns({
        "exact_phrase": F.lit(True), "content_hits": F.lit(2), "lex_hits": F.lit(2), "block_match_score": F.lit(20.0), "weighted_ratio": F.lit(0.9), "rare_hits": F.lit(0),
        "focus": X.sentence_focus(F.col("query"), X.query_tokens(F.col("query")), text),
    })
    got = {r.row_id: (r.place, r.localization_score) for r in passages.localized(hits).collect()}
    assert [got[i][0] for i in (0, 3, 1, 2)] == [1, 2, 3, 4]
    compact = min(1.0, 0.85 + 2 / 17 * 8)
    plain = 0.1 + 0.08 + 0.035 + 0.05 + 0.03 + 0.02 + 0.03 + 0.016 + 0.024 + 0.02 + 0.055 * compact
    assert abs(got[3][1] - plain) < 1e-6 and abs(got[0][1] - plain - 0.08) < 1e-6 and abs(got[1][1] - plain + 0.03) < 1e-6 and abs(got[2][1] - plain - 0.08 + 1) < 1e-6


def test_records_and_short_words(spark):
    asked = spark.createDataFrame([(1, "deep nets"), (2, "GAN"), (3, "gan"), (4, "longword"), (5, None), (6, "a b")], "query_id long, query string")
    notes = spark.createDataFrame([(1, 7, "on deep", "nets here"), (2, 8, "Deep Nets", None), (3, None, None, "see deep nets"), (4, 9, "", "deep nets")], "row_id long, doc_id long, title string, body string")
    ids = spark.createDataFrame([(8,), (8,)], "doc_id long")
    assert sorted(r.row_id for r in passages.search_records(asked, notes, ["title", "body"], 9).collect()) == [2, 3, 4]
    assert sorted(r.row_id for r in passages.search_records(asked, notes, ["title", "body"], 9, ids).collect()) == [2, 3]
    rows = spark.createDataFrame([(1, "Many GANs here"), (2, "organ"), (3, None)], "row_id long, text string")
    got = sorted((r.query_id, r.rank, r.row_id, r.bm25) for r in passages.search_with_boundaries(asked, rows, 5).collect())
    assert got == [(2, 1, 1, None), (3, 1, 1, None)]
    assert passages.search_with_boundaries(asked.limit(0), rows, 5).count() == 0


def page_of(spark, texts, width=100.0):
    rows = [(1, 1, i, t, (0.0, 20.0 * i, width, 20.0 * i + 10.0), 200.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, page_no int, pos int, text string, box {BOX}, page_width double")


def test_equation_lines_and_groups(spark):
    texts = ["y = a + b (1)", "where the words explain what a and b may be in all that follows here", "z = c * d", "+ e", "(2)", "Figure 1: x = y", None, "word", "def f(x): return x = y.z.w"]
    lines = equations.line_signals(page_of(spark, texts))
    got = {r.pos: r for r in lines.collect()}
    # 2.8 number, 2.2 equals, 2.0 signs, 0.5 digits, 0.9 narrow, 0.9 few words, 0.3 short
    assert (got[0].score, got[0].number, got[0].strong) == (9.6, "1", True)
    assert [got[i].accepted for i in range(9)] == [True, False, True, True, True, False, False, False, True] and not got[5].flags and got[4].number_only
    found = sorted(map(tuple, equations.equation_groups(lines).drop("box").collect()))
    assert [(f[2], f[3], f[4], f[6]) for f in found] == [(0, 0, 1, "1"), (2, 4, 3, "2")] and found[1][5] == "z = c * d\n+ e\n(2)"
    assert equations.equation_groups(lines.limit(0)).count() == 0
    blocks = page_of(spark, texts).withColumn("block_index", F.col("pos"))
    chunks = equations.equation_chunks(equations.equation_groups(lines), blocks).orderBy("chunk_index").collect()
    assert [c.chunk_index for c in chunks] == [2009, 2010] and chunks[0].text == "Equation 1\ny = a + b (1)\nContext: y = a + b (1)"


def test_neighbouring_equations_are_one_and_lone_numbers_go(spark):
    df = page_of(spark, ["a = b + c", "plain text that stands in between both of the parts and is no formula at all", "(3)"])
    merged = equations.equation_groups(equations.line_signals(df)).collect()
    assert [(r.pos, r.last_pos, r.number) for r in merged] == [(0, 2, "3")]
    assert equations.equation_groups(equations.line_signals(page_of(spark, ["(3)"]))).count() == 0


def test_table_doubts(spark):
    word = "a long cell of words that has no digit in it whatsoever"
    rows = [
        (1, [["h", "v"], ["a", "1"]], 2, "Table 1: x", None), (2, [["h"], ["a"]], 1, None, "Figure 2 y"), (3, [[" ", None]], 2, None, None), (4, [[word], [word], [word]], 1, None, None),
        (5, [["h", "v"], ["a", "1"]], 2, "Table 1", "Fig. 2"), (6, [], 0, None, None), (7, [[f"c{i}" for i in range(8)]], 8, None, None), (8, [["alpha", "bravo"], ["delta", "see figure 3"]], 2, "Table 3: alpha bravo", None),
    ]
    df = spark.createDataFrame(rows, "id int, rows array<array<string>>, n_cols int, caption string, figure_caption string").withColumns({"caption_gap": F.lit(90.0), "figure_gap": F.lit(10.0)})
    got = {r.id: (r.doubts, r.false_positive) for r in tables.table_doubts(df).collect()}
    assert got[1] == ([], False) and got[2] == (["figure_caption_alone"], True) and got[3] == (["no_cells"], True) and got[6] == (["no_cells"], True)
    assert got[4] == (["single_column", "prose_like_cells", "long_cells"], True) and got[5] == (["figure_caption_nearer"], True)
    assert got[7] == (["wide_and_shallow"], False) and got[8] == (["figure_like_content", "caption_in_rows"], True)


def test_captions_choose_regions(spark):
    region, caption = f"doc_id long, page_no int, region_id int, box {BOX}, tiles int", f"doc_id long, page_no int, caption_id int, box {BOX}"
    regions = spark.createDataFrame([(1, 1, 1, (0.0, 0.0, 100.0, 50.0), 1), (1, 1, 2, (0.0, 70.0, 100.0, 120.0), 1), (1, 2, 1, (300.0, 0.0, 400.0, 50.0), None), (None, 1, 1, (0.0, 0.0, 9.0, 9.0), 1)], region)
    captions = spark.createDataFrame([
        (1, 1, 1, (0.0, 52.0, 100.0, 60.0)), (1, 1, 2, (0.0, 122.0, 100.0, 130.0)), (1, 1, 3, (0.0, 140.0, 100.0, 150.0)),  # each takes the region above it; none is left for the third
        (1, 2, 1, (0.0, 60.0, 100.0, 70.0)), (1, 3, 1, (0.0, 0.0, 9.0, 9.0)),  # beside the page's only region; no region
    ], caption)
    assert sorted(map(tuple, layout.assign_captions(regions, captions).collect())) == [(1, 1, 1, 1, False), (1, 1, 2, 2, False), (1, 2, 1, 1, True)]
    assert layout.assign_captions(regions.limit(0), captions).count() == 0


def test_document_profiles(spark):
    zero = dict.fromkeys("text_len citations captions equations affiliations images tables drawings paragraphs academic_headings report_headings section_headings part_headings numbered_headings roman_headings repeated_headers repeated_footers".split(), 0)
    base = zero | {"two_columns": False, "has_abstract": False, "has_references": False}
    rows = [base | {"doc_id": 1, "page_no": 1, "has_abstract": True, "citations": 2, "affiliations": 1, "academic_headings": 5}, base | {"doc_id": 2, "page_no": 1, "paragraphs": 4, "text_len": 500}, base | {"doc_id": 3, "page_no": 1, "captions": 2, "images": 1}]
    profiles = pages.page_profiles(spark.createDataFrame(rows))
    assert {r.doc_id: (r.scholarly, r.visual, r.report, r.handler) for r in profiles.collect()} == {1: (10, 0, 0, "paper"), 2: (0, 0, 4, "plain"), 3: (0, 3, 1, "paper")}
    assert {r.doc_id: (r.scholarly, r.visual, r.report, r.handler) for r in pages.doc_profiles(profiles).collect()} == {1: (19, 0, 0, "paper"), 2: (0, 0, 9, "plain"), 3: (0, 5, 3, "mixed")}


def test_summaries(spark):
    a = "We propose a framework that improves the training of very large networks."
    b = "The weather over the harbour was grey through most of that long week [1] [2]."
    c = "We propose a framework that improves the training of very large networks!"
    filler = "Sailors mended nets quietly while gulls circled above wooden piers every single morning"
    text = " ".join([a, b, c] + [f"{filler} {w}." for w in ("alpha", "bravo")])
    rows = [(1, "m", "methodology", text), (1, "e", None, ""), (2, "n", "other", None)]
    scored = summaries.sentence_scores(spark.createDataFrame(rows, "doc_id long, section string, canonical string, text string"))
    got = {(r.doc_id, r.section): r for r in summaries.summarize(scored).collect()}
    assert list(got) == [(1, "m")]  # sections without sentences have no summary
    # One sentence suffices by count, but words are taken up to 75: like ones go (c is like a, and the fillers like each other).
    assert got[1, "m"].n_sentences == 3 and got[1, "m"].summary == " ".join([a, b, f"{filler} alpha."])
    by = {r.place: r.score for r in scored.collect()}
    assert by[0] - by[2] > 0.4 and by[1] < by[3] + 1.0


def test_related_work_leaves_own_results_aside_and_short_sections_are_cut(spark):
    own = "We improve on the benchmark with results that outperform all of the other systems there."
    theirs = "Earlier systems relied on hand written rules for the parsing of long legal documents."
    long = " ".join(f"word{i}," for i in range(400))
    rows = [(1, "r", "related_work", f"{own} {theirs}"), (1, "o", "related_work", own), (1, "m", "methodology", own), (2, "x", None, long), (2, "y", None, "Too short."), (2, "z", None, " ")]
    sections = spark.createDataFrame(rows, "doc_id long, section string, canonical string, text string")
    found = summaries.summarize(summaries.sentence_scores(sections))
    got = {(r.doc_id, r.section): r.summary for r in found.unionByName(summaries.fallback_summaries(sections, found)).collect()}
    assert got[1, "r"] == theirs and got[1, "o"] == own and got[1, "m"] == own
    assert got[2, "y"] == "Too short." and got[2, "x"].endswith("word74...") and (2, "z") not in got


def test_best_blocks(spark):
    hits = spark.createDataFrame([(1, 10, "deep nets"), (2, 10, "nothing"), (3, 99, "deep")], "query_id long, row_id long, query string")
    blocks = spark.createDataFrame([(10, 0, "nets that are deep"), (10, 1, "these deep nets"), (10, 2, "these deep nets"), (10, 3, None)], "row_id long, block_index int, text string")
    got = {r.query_id: (r.block_index, r.exact_phrase, r.lex_hits) for r in summaries.best_blocks(hits, blocks).collect()}
    assert got == {1: (1, True, 2), 2: (0, False, 0)}
