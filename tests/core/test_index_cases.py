import math
import random
import re

from corposcope.operators import search
from corposcope.sources import index

ROWS = "row_id long, text string"


def plain_bm25(rows, query):
    tokens = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in rows}
    q = re.findall("[a-z0-9]+", query.lower())
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {t: sum(t in w for w in tokens.values()) for t in q}
    out = []
    for i, w in tokens.items():
        if q and any(w[s : s + len(q)] == q for s in range(len(w) - len(q) + 1)):
            score = 0.0
            for t in sorted(set(q)):
                tf = w.count(t)
                score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)]


def corpus(rng):
    words = ["a", "b", "the", "Graph", "net-work", "x1", "é", "_y"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "..."), (203, "a a a b a a b"), (204, "a b " * 3000)]


def test_written_and_unwritten_indexes_find_the_phrases_of_a_plain_search(spark, tmp_path):
    rng = random.Random(2)
    rows = corpus(rng)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    asked = ["a", "the graph", "a a", "a b a", "a a a b", "net work", "x1 the a", "missing", "a missing", "", "?!", "B A"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    written = index.build(df, f"file://{tmp_path}/i")
    for how in (df, written):
        got = {}
        for r in search.keyword_search(queries, how, 1000).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.row_id, r.bm25))
        want = {i: plain_bm25(rows, q) for i, q in enumerate(asked)}
        assert {i: w for i, w in want.items() if w} == got
    every = {(r.query_id, r.row_id): r.score for r in search.full_text_search(queries, written, 1000).collect()}
    for i, q in enumerate(asked):
        wanted = set(re.findall("[a-z0-9]+", q.lower()))
        for row, text in rows:
            w = re.findall("[a-z0-9]+", (text or "").lower())
            if wanted and wanted <= set(w):
                assert abs(every.pop((i, row)) - sum(math.log1p(w.count(t)) for t in wanted)) < 2e-6
    assert not every


def test_postings_hold_every_place_once(spark):
    rows = [(1, "b a B a"), (2, None), (3, "a")]
    got = {(r.token, r.row_id): list(r.positions) for r in index.positions(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {("a", 1): [1, 3], ("b", 1): [0, 2], ("a", 3): [0]}


def test_searches_read_the_index_and_not_the_texts(spark, tmp_path):
    source = f"{tmp_path}/rows"
    spark.createDataFrame(corpus(random.Random(1)), ROWS).write.parquet(source)
    rows = spark.read.parquet(source)
    written, grams = index.build(rows, f"file://{tmp_path}/i"), index.build_grams(rows, f"file://{tmp_path}/g")
    queries = spark.createDataFrame([(1, "a b"), (2, "raph")], "query_id long, query string")
    plan = lambda df: df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for found in (search.keyword_search(queries, written, 5), search.full_text_search(queries, written, 5), search.tfidf_search(queries, written, 5), search.token_stats(queries, written)):
        assert source not in plan(found)
    both = plan(search.substring_search(queries, rows, 5, grams))
    assert source in both and "CartesianProduct" not in both


def test_substrings_match_a_plain_search(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abAB .é\n%_") for _ in range(rng.randrange(40)))) for i in range(200)] + [(500, None), (501, ""), (502, "a"), (503, "xyz" * 20_000 + "END")]
    asked = ["a", "B", "ab", "aba", "ab.a", "%", "_a", "é", "é ", "\n", " ", "", "abab abab", "end", "zend", "nothing at all", "d"]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = {i: [r for r, t in rows if q.strip(" ") and q.lower() in (t or "").lower()] for i, q in enumerate(asked)}
    for grams in (None, index.build_grams(df, f"file://{tmp_path}/g")):
        got = {}
        for r in search.substring_search(queries, df, 1000, grams).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.row_id)
        assert got == {i: w for i, w in want.items() if w}


def test_fallback_is_for_queries_without_hits(spark):
    rows = spark.createDataFrame([(1, "graph networks"), (2, "photographs"), (3, "none")], ROWS)
    queries = spark.createDataFrame([(1, "graph"), (2, "otogra"), (3, "zzz")], "query_id long, query string")
    got = [(r.query_id, r.rank, r.row_id, r.bm25 is None) for r in search.search_with_fallback(queries, rows, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, False), (2, 1, 2, True)]


def test_an_index_is_written_once_for_each_state_of_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    source = f"{tmp_path}/rows"
    queries = spark.createDataFrame([(1, "new")], "query_id long, query string")

    def found():
        rows = spark.read.parquet(source)
        return search.keyword_search(queries, index.index_for(rows, rows, "rows"), 5).count()

    spark.createDataFrame([(1, "old words")], ROWS).write.parquet(source)
    assert found() == 0 and found() == 0
    folders = list((tmp_path / "shared").iterdir())
    assert len(folders) == 1
    spark.createDataFrame([(1, "new words")], ROWS).write.mode("overwrite").parquet(source)
    spark.catalog.refreshByPath(source)
    assert found() == 1 and len(list((tmp_path / "shared").iterdir())) == 2


def test_empty_rows(spark, tmp_path):
    df = spark.createDataFrame([], ROWS)
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    for i, (a, g) in enumerate(((df, None), (index.build(df, f"file://{tmp_path}/i"), index.build_grams(df, f"file://{tmp_path}/g")))):
        assert search.keyword_search(queries, a, 5).count() == search.full_text_search(queries, a, 5).count() == search.tfidf_search(queries, a, 5).count() == search.substring_search(queries, df, 5, g).count() == 0
