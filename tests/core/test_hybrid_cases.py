import hashlib

from pyspark.sql import functions as F

from corposcope.functions.embedding import hashed_vector
from corposcope.operators import evaluate, search
from corposcope.plans import hybrid


def test_vectors_of_hashed_words(spark):
    texts = ["deep nets deep", "", None, "Deep, NETS"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(hashed_vector(F.col("t"), 32).alias("v")).collect()]
    want = [0.0] * 32
    for w in ("deep", "nets", "deep"):
        c = int(hashlib.md5(w.encode()).hexdigest()[:3], 16)
        want[c % 32] += 1 if c // 32 % 2 == 0 else -1
    assert list(got[0]) == want and not any(got[1]) and not any(got[2]) and sum(map(abs, got[3])) <= 2


def test_a_page_that_only_vectors_find_is_gated_like_others(spark):
    """The phrase stands on page 1; page 2 holds its words apart; page 3 neither; references never pass."""
    pages = spark.createDataFrame(
        [(1, 10, 2, "we train graph kernels here"), (2, 10, 3, "kernels of a graph"), (3, 10, 4, "quite another thing"), (4, 11, 5, "References\ngraph kernels [1]")], "row_id long, doc_id long, page_no int, text string"
    )
    queries = spark.createDataFrame([(1, "graph kernels"), (2, "zebra")], "query_id long, query string")
    index = search.as_index(pages.select("row_id", "text"))
    both = {(r.query_id, r.row_id): r for r in hybrid.hybrid_hits(queries, pages, index).collect()}
    assert set(both) == {(1, 1), (1, 2)} and both[1, 1].keyword_score > 0 and both[1, 2].keyword_score == 0 and both[1, 2].semantic_score > 0
    assert both[1, 1].match_score > both[1, 2].match_score
    words = {(r.query_id, r.row_id) for r in hybrid.hybrid_hits(queries, pages, index, search_type="keyword").collect()}
    vectors = {(r.query_id, r.row_id) for r in hybrid.hybrid_hits(queries, pages, index, search_type="embedding").collect()}
    assert words == {(1, 1)} and vectors == {(1, 1), (1, 2)}
    titles = spark.createDataFrame([(10, "On graph kernels"), (11, "Lists")], "doc_id long, title string")
    got = hybrid.hybrid_documents(queries, pages, titles, index).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in got] == [(1, 1, 10)] and got[0].title_bonus > 0


def test_low_salience_sections_need_enough_words(spark):
    row = {"query": "graph kernels learning rates", "search_bucket": "body", "exact_phrase": False, "lex_hits": 1, "content_hits": 1, "content_count": 2, "rare_hits": 1, "rare_count": 1, "weighted_ratio": 0.6, "match_score": 0.2, "keyword_score": 0.0, "block_match_score": 1.0}
    columns = "id int, canonical string, semantic_raw_score double, query string, search_bucket string, exact_phrase boolean, lex_hits int, content_hits int, content_count int, rare_hits int, rare_count int, weighted_ratio double, match_score double, keyword_score double, block_match_score double"
    rows = [(1, "appendix", 0.5, *row.values()), (2, "methodology", 0.5, *row.values()), (3, None, 0.5, *row.values())]
    less = dict(row, lex_hits=0)
    rows += [(4, None, 0.0, *less.values()), (5, None, 0.5, *less.values())]
    assert {r.id for r in search.section_gate(spark.createDataFrame(rows, columns)).collect()} == {2, 3, 5}


def test_page_and_section_hits(spark):
    hits = spark.createDataFrame([(1, 1, 4, "body"), (1, 2, 7, "results"), (1, 4, 9, "methods"), (2, 1, 1, None), (4, 1, 2, "body")], "query_id long, place int, page_no int, canonical string")
    gold = spark.createDataFrame([(1, [7], ["methods"]), (2, [1], None), (3, [5], ["body"]), (4, None, [])], "query_id long, pages array<int>, sections array<string>")
    got = {r.query_id: tuple(r)[1:] for r in evaluate.localized_eval(hits, gold).collect()}
    assert got == {1: (False, True, False, False, True), 2: (True, True, None, None, None), 3: (False, False, False, False, False), 4: (None, None, None, None, None)}
    assert tuple(evaluate.localized_summary(evaluate.localized_eval(hits, gold)).first()) == (3, 2, 0.333333, 0.666667, 0.0, 0.0, 0.5)
    runs = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "latency_ms double")
    assert tuple(evaluate.latency_summary(runs).first()) == (25.0, 25.0, 38.5)


def test_transcript_report(spark):
    rows = [
        ("a", "1", "one two three four", "one two three four", "ok"), ("a", "2", "one two three four", "Transcribe this audio: \none two x four", "ok"), ("a", "3", "one two", None, "error"),
        ("b", "4", "one two three four", "one two three four " + "0" * 25, "ok"), ("b", "5", "one", "", "ok"), ("b", "6", "", "x", "ok"),
    ]
    scored = evaluate.scored_predictions(spark.createDataFrame(rows, "dataset string, id string, reference string, prediction string, status string"))
    got = {r.id: (r.wer, r.clean_wer) for r in scored.collect()}
    assert got == {"1": (0.0, 0.0), "2": (1.0, 0.25), "3": (None, None), "4": (0.25, 0.0), "5": (1.0, 1.0), "6": (None, None)}
    summary = {r.dataset: tuple(r)[1:] for r in evaluate.asr_summary(scored).collect()}
    assert summary["a"] == (3, 2, 1, 0.5, 0.125, 1) and summary["b"][:3] == (3, 3, 0) and summary[None][:3] == (6, 5, 1)
    assert [(r.place, r.id) for r in evaluate.worst_predictions(scored, 2).orderBy("place").collect()] == [(1, "2"), (2, "5")]
    assert {(r.dataset, r.flag): r.n for r in evaluate.flag_counts(scored).collect()}["a", "prompt_leak"] == 1
