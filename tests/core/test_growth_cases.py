"""Work that has to grow with the input alone, and rows on which queries and their SQL twins differed."""

import math
import random
import re
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from corposcope.assembly_queries import p22_questions, w12_reference_like_lines
from corposcope.catalog_queries import p10_query_match_scores
from corposcope.functions import text as X
from corposcope.operators import evaluate, search, summaries, vectors
from corposcope.passage_queries import SHORT_PLURAL, p42_table_doubts
from corposcope.plans import hybrid
from corposcope.queries import ORACLES, a13_retrieval_summary
from corposcope.sources import html, index


def test_heading_is_normalised_once(spark):
    assert str(X.canonical_heading(F.col("x"))).count("regexp_replace") <= 2  # not once for each section pattern
    said = ["3. Reference list", "1. ", " 2.1  Methods\tand data ", "iv) upper  bound", "A plain line of more than ten words that names no section here", "!!", None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, x string").select("i", X.canonical_heading(F.col("x")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == ["references", "1", "methodology", "capacity_bound", "a_plain_line_of_more_than_ten_words_that_names", "other", "other"]


def test_titles_are_searched_for_whole_queries_alone(spark):
    queries = spark.createDataFrame([(1, "deep learning of trees"), (2, "learn")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "Deep Learning of Trees, again"), (2, "learning trees"), (3, "learn"), (4, None), (5, "nothing")], "doc_id long, title string")
    stats = spark.createDataFrame([(1, "trees", True), (1, "deep", False)], "query_id long, token string, rare boolean")
    found = search.title_bonus(queries, docs, stats)
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(title") == 1
    # a token inside a longer word counts where another token of the query stands as a whole word
    assert {(r.query_id, r.doc_id): r.bonus for r in found.collect()} == {(1, 1): 0.645, (1, 2): 0.366667, (2, 3): 0.345}


def twin(name: str, **tables: str) -> list[tuple]:
    """The rows of a query's SQL over tables given as SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.execute(f"CREATE TABLE {table} AS {rows}")
    return sorted(con.execute(ORACLES[name]).fetchall())


def test_references_without_semicolon(spark):
    page = "<html><head><title>a &amp b &lt</title></head><body><article><p>x &gt;&amp y &#39 z &#390;</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    rows = "SELECT 1::BIGINT AS page_id, 'u' AS url, '" + page.replace("&#390;", "end") + "' AS html"
    plain = pages.withColumn("html", F.replace("html", F.lit("&#390;"), F.lit("end")))
    assert [tuple(r) for r in html.html_titles(plain).collect()] == twin("s2_html_titles", pages=rows) == [(1, "a & b <")]
    assert [tuple(r) for r in html.html_blocks(plain).collect()] == twin("s2_html_blocks", pages=rows) == [(1, 1, "p", "x >& y ' z end")]


def test_years_of_reference_lines():
    line = "[x] Ann Lee and Bob Ray in Proceedings of Things, 1998, and some more words"
    assert twin("w12_reference_like_lines", documents=f"SELECT 1::BIGINT AS doc_id, '{line}' AS text") == [(1, 0, True)]


def test_words_beside_other_letters(spark):
    said = "ñabcs and xyzs, éfgs"
    assert spark.createDataFrame([(said,)], "query string").select(F.regexp_extract("query", SHORT_PLURAL, 1)).first()[0] == "xyz"
    rows = twin("j1_search_with_boundaries", benchmark=f"SELECT 1::BIGINT AS item_id, '{said}' AS text", documents="SELECT 7::BIGINT AS doc_id, 'one xyz' AS text UNION ALL SELECT 8, 'one abc'")
    assert [r[:3] for r in rows] == [(1, 1, 7)]


def test_loops_as_the_pattern_finds_them():
    pattern = re.compile(r"(?s)(.{12,80})\1{3,}")
    pieces = ["abcdefghijkl", "abcdefghijk", "é" * 3 + "x" * 9, "ab", "0123456789" * 8, "0123456789" * 8 + "x"]
    for text in [b + p * n + "end" for b in ("", "some words before ") for p in pieces for n in (1, 3, 4, 7)]:
        assert X.has_loop(text) == bool(pattern.search(text))


def test_equal_headings_are_searched_once():
    begun = time.time()
    assert len(evaluate._matched([("a",)] * 1500, [("a",)] * 3000)) == 1500  # before: a search through all of them for each
    assert time.time() - begun < 5


def test_best_lists_hold_few_pairs_at_once(spark):
    rng = np.random.default_rng(3)
    best = np.full((3, 2), -np.inf), np.full((3, 2), vectors.LAST)
    s = np.round(rng.random((3, 9)), 1)
    for i in (0, 3, 6):
        vectors.merge(best, 0, s[:, i : i + 3], np.arange(i, i + 3))
    seen = [[(x, i) for x, i in zip(*b, strict=True)] for b in zip(best[0].tolist(), best[1].tolist(), strict=True)]
    assert seen == [sorted(((x, i) for i, x in enumerate(row)), key=lambda p: (-p[0], p[1]))[:2] for row in s.tolist()]


def test_index_tasks_follow_the_text(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"every word{i % 3} w{i}") for i in range(60)], "row_id long, text string")
    monkeypatch.setattr(index, "TASK_CHARS", 64)
    monkeypatch.setattr(index, "BATCH_CHARS", 64)
    built, plain = index.build(rows, str(tmp_path)), index.unwritten(rows)
    read = lambda df: sorted(map(tuple, df.collect()))
    assert len(list(tmp_path.glob("postings/bucket=*/*.parquet"))) > 8  # before: a file a folder
    assert read(built.postings.select("token", "row_id", "positions")) == read(plain.postings.select("token", "row_id", "positions"))
    assert [(a, b, round(c, 9)) for a, b, c in read(built.lengths)] == [(a, b, round(c, 9)) for a, b, c in read(plain.lengths.select("row_id", "n_tokens", "norm"))]


def test_table_doubts_see_letters_and_blanks_as_their_sql_does(spark, tmp_path):
    run = "a" * 13 + "9" * 13
    texts = [f"x {run}ä y", f"é{run} y", f"x {run}\v y", "\v" * 40 + "ab, c", " " * 40 + "ab, c", "　" * 18 + "a", f"{run}½ b", "FİGURE 2, Table", f"{run}/é c", f"x {run} y"]
    rows = [(i * 105 + k, t) for i, t in enumerate(texts) for k in (1, 2, 3, 5, 6, 10, 25, 55)] + [(2000, "second, row\nx"), (2000, "first, row, again\ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, p42_table_doubts(spark, str(tmp_path)).collect()))
    assert got == twin("p42_table_doubts", documents=f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    doubts = {r[0]: r[2] for r in got}
    # a run that a letter of another script goes on is no encoded one
    assert doubts[9 * 105 + 1] == doubts[1] + 1 == doubts[105 + 1] + 1 == doubts[8 * 105 + 1]


def test_summaries_cut_and_count_a_section_once(spark):
    rows = [(1, "s", "methodology", "The old harbour is a place where wooden boats are mended by hand. The old harbour is grey and it was built of heavy stones."), (1, "t", None, "short"), (1, "u", None, " ")]
    sections = spark.createDataFrame(rows, "doc_id long, section string, canonical string, text string").repartition(3, "doc_id", "section")
    found = summaries.with_beginnings(sections, summaries.summarize(summaries.sentence_scores(sections)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    cut = r"(?<=[.!?])\s+"
    assert plan.split("Initial Plan")[0].count(cut) <= 2  # the pattern of one cut, and none again for words, scores or missing summaries
    assert {r.section: (r.n_sentences, r.summary) for r in found.collect()} == {"s": (2, rows[0][3]), "t": (1, "short")}


def test_reference_lines_see_words_and_blanks_as_their_sql_does(spark, tmp_path):
    line = "{} Lee and {} Ray {} Things of All Kinds, {}{} and some more words"
    said = [line.format("Müller Ann", "Bob", "in", 1998, ","), line.format("Ann", "Joë", "ñin", 1998, ","), line.format("Ann", "Bob", "İn", 1998, "ñ"), line.format("Ann", "Bob", "see pp.7", "½2013b", "é"), line.format("Ann", "Bob", "pp. see", 2013, "")]
    said += ["\u00a0[7] " + "x" * 36, "\u3000" * 20 + "[7] " + "x" * 20, "[7]" + "\v" * 40, "\v[7] " + "x" * 40, "\u2003\n\u00a0 \n[1] short"]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, w12_reference_like_lines(spark, str(tmp_path)).collect()))
    assert got == twin("w12_reference_like_lines", documents=f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [r[2] for r in got] == [True] * 4 + [False, True, False, True, False, False] and got[-1][:2] == (9, 0)


def test_questions_are_trimmed_as_their_sql_does(spark, tmp_path):
    said = [("user", "\nab why?"), ("\tUser\u00a0", "\u3000why?\u00a0"), ("\u2003", "\v"), ("ΑΣ", "why?\n\u0085"), ("İ", " \t\f\r\n"), ("", "a\tb "), (None, None), ("A\v", "\ta b\v\n")]
    spark.createDataFrame([(1, i, *x) for i, x in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, p22_questions(spark, str(tmp_path)).collect()))
    assert got == twin("p22_questions", conversations=f"SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert [r[4] for r in got] == ["\nab", "wh", "\v", "why", "a\tb", "\ta"] and [r[2] for r in got[:4]] == ["user", "\tuser", "short_answer", "ασ"]


def test_gold_holds_queries_that_begin_and_end_inside_words(spark, tmp_path):
    said = [(1, "ello wor"), (2, "日本"), (3, "ell"), (4, "- "), (5, "big red bo"), (6, "Hello"), (7, "no such"), (8, "World")]
    held = [(1, "Hello world, a big red box"), (2, "in 日本, - hello"), (3, "a big red boat"), (4, None), (5, "")]
    spark.createDataFrame(said, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(held, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = tuple(a13_retrieval_summary(spark, str(tmp_path)).first())
    assert [got] == twin("a13_retrieval_summary", **{t: f"SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'" for t in ("benchmark", "documents")})
    assert got[:5] == (8, 0.125, 0.25, 0.25, 0.1875)  # before: queries cut inside words or without words counted as such that nothing holds
    rng = random.Random(7)
    texts = ["".join(rng.choice("aabB1 ,é\n") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "K İ", "aΣ b"]
    asked = [t[i : i + rng.randrange(1, 9)] for t in texts if t for i in [rng.randrange(len(t)) for _ in range(4)]] + ["", " ", None]
    rows, queries = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = sorted(map(tuple, search.rows_containing(queries, rows, index.unwritten(rows)).collect()))
    assert found == sorted((i, j) for i, q in enumerate(asked) if q is not None for j, t in enumerate(texts) if q in t)


def test_match_scores_of_all_pages_that_hold_a_query(spark, tmp_path):
    spark.createDataFrame([(1, "grey harbour"), (2, "old boats")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"The grey harbour number {i} is old.") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = p10_query_match_scores(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.row_id) for r in found) == [(1, i * 1_000_000 + 1) for i in range(50)]  # before: 20 of them


def test_pages_and_postings_are_filtered_where_they_lie(spark, tmp_path, monkeypatch):
    words = "grey harbour old boats stone wooden mended hand".split()
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(80)]
    p = spark.createDataFrame([(i, i // 4, i % 4 + 1, t) for i, t in enumerate(texts)], "row_id long, doc_id long, page_no int, text string")
    q = spark.createDataFrame([(i, " ".join(texts[i * 7].split()[3:5])) for i in range(9)], "query_id long, query string")
    built = index.build(p.select("row_id", "text"), f"file://{tmp_path}/index", normed=False)
    titled = p.filter("page_no = 1").select("doc_id", F.col("text").alias("title"))
    read = lambda: [sorted(map(tuple, df.collect())) for df in (search.keyword_search(q, built, 5), hybrid.hybrid_documents(q, p, titled, built, 5))]
    few = read()
    filtered = search.rows_with_all(search.frequencies(q.select("query_id", F.explode(F.split("query", " ")).alias("token"), F.lit(2).alias("n")).distinct(), built), built)
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2  # before: all postings were shuffled to meet the tokens asked for
    monkeypatch.setattr(index, "FEW", 0)
    assert few == read() and all(few)
    assert built.lengths.filter("norm IS NOT NULL").count() == 0  # only tf-idf searches need norms


def test_tfidf_pairs_are_scored_where_rows_come_together(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randrange(1, 15))) for _ in range(120)] + ["", "w1"]
    asked = [" ".join(rng.choice(texts).split()[:4]) for _ in range(8)] + ["unknown", "w1 unknown"]
    rows, queries = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in t.split() for t in texts))) + 1 for t in texts for w in t.split()}
    vector = lambda t: {w: t.split().count(w) * idf[w] for w in t.split() if w in idf}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, q in enumerate(map(vector, asked)):
        dots = [(j, sum(q[w] * v.get(w, 0) for w in q), v) for j, v in enumerate(map(vector, texts))]
        want[i] = sorted((-round(dot / length(v) / length(q), 6), j) for j, dot, v in dots if dot > 0)[:7]
    monkeypatch.setattr(vectors, "GROUP", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # a row's postings lie in several batches
    try:
        found = search.tfidf_search(queries, rows, 7)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.cosine, r.row_id))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: rows for i, rows in want.items() if rows}
    assert "Aggregate [query_id" not in found._jdf.queryExecution().optimizedPlan().toString()  # before: a row for each word that a query and a row share


def test_titles_and_queries_meet_without_a_shuffle(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 6)))
    titles = [" ".join(word() for _ in range(rng.randrange(6))).title() for _ in range(150)] + [None]
    asked = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    queries, docs = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    rare = {(i, t) for i, q in enumerate(asked) for t in q.split() if len(t) > 2 and t < "b"}
    stats = spark.createDataFrame([(i, t, True) for i, t in sorted(rare)], "query_id long, token string, rare boolean")
    found = search.title_bonus(queries, docs, stats)
    assert "Aggregate [doc_id" not in found._jdf.queryExecution().optimizedPlan().toString()  # before: titles' words and the pairs were shuffled
    want = {}
    for i, q in enumerate(asked):
        tokens = {t for t in q.split() if len(t) > 2}
        rares = {t for j, t in rare if j == i}
        for j, t in enumerate(x.lower() if x else "" for x in titles):
            if tokens & set(t.split()):
                o, r, phrase = sum(x in t for x in tokens), sum(x in t for x in rares), all(x in t for x in tokens) and q in t
                want[i, j] = round(0.18 * phrase + min(o, 5) * 0.015 + min(o, 5) * 0.05 + r * 0.07 + 0.1 * o / len(tokens) + (0.1 * r / len(rares) if rares else 0), 6)
    assert {(r.query_id, r.doc_id): r.bonus for r in found.collect()} == want and len(want) > 50
