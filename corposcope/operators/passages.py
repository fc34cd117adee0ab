"""After the search: snippets, reranking by place, searches of records and of short words."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.operators import search

WORD = re.compile("[A-Za-z0-9]+")


def _tightest(tokens: set[str], text: str) -> tuple[int, int] | None:
    """(start, stop) of the shortest stretch with every token as a whole word, the first of equals."""
    last: dict[str, int] = {}
    best = None
    for word in WORD.finditer(text):
        if (w := word.group().lower()) in tokens:
            last[w] = word.start()
            start = min(last.values())
            if len(last) == len(tokens) and (best is None or word.end() - start < best[1] - best[0]):
                best = (start, word.end())
    return best


def snippet_of(query: str, tokens: list[str], text: str, most: int = 240, pad: int = 12) -> str:
    """The shortest stretch of a text with all tokens found in it and some margin, else a piece around the longest token found."""
    clean = " ".join((text or "").replace("\0", "").split())
    found = {t for t in tokens if t in clean.lower()}
    if stretch := _tightest(found, clean) if found else None:
        clean = clean[max(0, stretch[0] - pad): stretch[1] + pad]
        if len(clean) <= most:
            return clean
    at = next((i for t in sorted(tokens, key=len, reverse=True) if (i := clean.lower().find(t)) >= 0), None)
    if at is None:
        return clean[:most]
    size = min(most, max(60, 2 * len(query)))
    start = max(0, at - size // 4)
    start = clean.rfind(" ", 0, start) + 1 if start else 0
    stop = clean.find(" ", start + size) if start + size < len(clean) else -1
    return clean[start: stop if stop >= 0 else (start + size if start + size < len(clean) else None)]


def snippets(hits: DataFrame, most: int = 240) -> DataFrame:
    """``hits`` (query, text) with ``snippet``; meant for rankings, after their top k."""

    @F.pandas_udf("string")
    def cut(query: pd.Series, tokens: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(q, list(t), x, most) for q, t, x in zip(query, tokens, text, strict=True)], dtype=object)

    return hits.withColumn("snippet", cut(F.coalesce("query", F.lit("")), X.query_tokens(F.col("query")), F.coalesce("text", F.lit(""))))


def localized(hits: DataFrame) -> DataFrame:
    """``hits`` with ``localization_score`` and ``place``, their rank in (query_id, doc_id).

    hits as from ``search.annotate_hits``, with ``query``, ``canonical`` (the
    section's name) and ``focus`` from ``sentence_focus``. Sections count by what
    the query asks for; ties go to exact phrases, more words, a better score, and
    the smaller row_id.
    """
    asks, role, f = X.query_profile(F.col("query")), X.section_role(F.col("canonical")), F.col("focus")
    wants = lambda *kinds: F.arrays_overlap(asks, F.array(*map(F.lit, kinds)))
    overview, exact = wants("overview"), F.coalesce("exact_phrase", F.lit(False))
    ratio, explains, short = F.coalesce(f["ratio"], F.lit(0.0)), F.coalesce(f["explains"], F.lit(False)), f["chars"].between(1, 180)
    full = ratio >= 0.75
    capped = lambda c, most, each: F.least(F.coalesce(c, F.lit(0)).cast("double"), F.lit(float(most))) * each
    points = (
        (0.08, exact), (0.035, f["exact"]), (0.05, explains & full), (0.03, short & full), (-1.0, F.col("search_bucket") == "references"), (-0.10, F.col("search_bucket") == "front_matter"),
        (-0.01, (role == "abstract") & overview), (0.03, (role == "abstract") & overview & full), (0.03, (role == "abstract") & overview & explains & short), (-0.05, (role == "abstract") & ~overview),
        (0.02, (role == "abstract") & exact), (-0.005, (role == "intro") & overview & full), (-0.03, (role == "intro") & ~(overview & full)), (-0.05, role == "conclusion"),
        (0.015, (role == "conclusion") & wants("analysis", "result")), (-0.10, role == "low_salience"), (0.08, (role == "method") & wants("method")), (0.01, (role == "method") & ~wants("method")),
        (0.09, (role == "evaluation") & wants("result", "benchmark")), (0.04, (role == "evaluation") & ~wants("result", "benchmark") & wants("analysis")),
        (0.02, (role == "evaluation") & ~wants("result", "benchmark", "analysis")), (0.02, F.col("weighted_ratio") >= 0.85), (0.015, F.col("rare_hits") > 0),
    )
    counted = capped(F.col("content_hits"), 4, 0.015) + capped(F.col("lex_hits"), 4, 0.008) + capped(F.col("block_match_score"), 12, 0.002) + capped(f["hits"], 4, 0.010) + capped(f["compactness"], 1, 0.055)
    score = reduce(lambda a, p: a + F.when(p[1], p[0]).otherwise(0.0), points, F.col("match_score") + counted)
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("localization_score"), exact.desc(), F.desc("content_hits"), F.desc("lex_hits"), F.desc("match_score"), "row_id")
    return hits.withColumn("localization_score", F.round(score, 6)).withColumn("place", F.row_number().over(w))


def search_records(queries: DataFrame, records: DataFrame, fields: list[str], k: int, ids: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, row_id, bm25): records (row_id, doc_id, fields) with a query's words as a phrase in one of the fields.

    With ``ids`` (doc_id) only records of these documents count, and those of none.
    """
    texts = records.select("row_id", F.concat_ws(" ", *fields).alias("text"))
    found = search.keyword_search(queries, texts, 2**31 - 1).drop("rank")
    met = found.join(queries, "query_id").join(records, "row_id")
    words = lambda c: F.concat(F.lit(" "), F.array_join(X.index_tokens(F.col(c)), " "), F.lit(" "))
    kept = met.filter(reduce(lambda a, b: a | b, (F.contains(words(c), words("query")) for c in fields)))
    if ids is not None:
        asked = ids.select(F.col("doc_id").alias("asked_")).distinct()
        kept = kept.join(asked, F.col("doc_id") == F.col("asked_"), "left").filter(F.col("doc_id").isNull() | F.col("asked_").isNotNull())
    return search.top_per_query(kept.select("query_id", "row_id", "bm25"), k, F.desc("bm25"), "row_id").select("query_id", "rank", "row_id", "bm25")


def short_word(query: Column) -> Column:
    """The query's only word in lower case, if it has at most four characters, or eight with a capital among them; else null."""
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    word = F.get(words, F.lit(0))
    return F.when((F.size(words) == 1) & ((F.length(word) <= 4) | ((F.length(word) <= 8) & word.rlike("[A-Z]"))), F.lower(word))


def search_with_boundaries(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, row_id, bm25): the keyword ranking, and for queries of one short word without hits the rows that hold it, or it with an s, as a whole word.

    Rows found the second way have no bm25 and stand in order of row_id. The
    words of all rows meet only the words asked for.
    """
    ranked = search.keyword_search(queries, rows, k)
    left = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti").select("query_id", short_word(F.col("query")).alias("w")).filter("w IS NOT NULL")
    asked = left.select("query_id", F.explode(F.array_distinct(F.array("w", F.when((F.length("w") >= 2) & ~F.col("w").endswith("s"), F.concat("w", F.lit("s"))).otherwise(F.col("w"))))).alias("token"))
    places = rows.select("row_id", F.explode(F.array_distinct(X.index_tokens(F.col("text")))).alias("token"))
    met = places.join(asked, "token").select("query_id", "row_id").distinct()
    second = search.top_per_query(met, k, "row_id").select("query_id", "rank", "row_id", F.lit(None).cast("double").alias("bm25"))
    return ranked.unionByName(second)
