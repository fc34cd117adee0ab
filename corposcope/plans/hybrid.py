"""Whole searches as one plan each: rank, score, merge, gate and aggregate for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.functions.embedding import hashed_vector
from corposcope.operators import search, vectors
from corposcope.sources.index import FEW, Index, named, settled


def search_documents(queries: DataFrame, pages: DataFrame, index: Index | None = None, k: int = 20) -> DataFrame:
    """(query_id, rank, doc_id, score, n_support) for queries (query_id, query) over pages (row_id, doc_id, page_no, text)."""
    index = search.as_index(pages.select("row_id", "text")) if index is None else index
    ranked = search.keyword_search(queries, index, k)
    hits = search.keyword_hits(ranked, queries, pages)
    stats = search.token_stats(queries, index)
    kept = search.section_gate(search.annotate_hits(hits, stats))
    scored = search.doc_scores(kept)
    return search.top_per_query(scored, k, F.desc("score"), "doc_id").select("query_id", "rank", "doc_id", "score", "n_support")


def semantic_hits(queries: DataFrame, pages: DataFrame, k: int = 20) -> DataFrame:
    """Page hits by the cosine of vectors (queries: query_id, query, v; pages: row_id, doc_id, page_no, text, v), with the features of keyword hits."""
    near = settled(vectors.vector_topk(queries.select("query_id", "v"), pages.select("row_id", "v"), k).filter("similarity > 0"))
    plain = pages.drop("v")
    placed = settled(near.join(named(plain.select("row_id", "doc_id", "page_no"), near, ["row_id"]), "row_id").drop("row_id"))
    of_page = search.chunk_hits_to_pages(placed, named(plain, placed, ["doc_id", "page_no"]))
    h = of_page.join(queries.select("query_id", "query"), "query_id")
    h = h.withColumns({"lex_hits": X.lex_hits(X.query_tokens(F.col("query")), F.col("text")), "exact_phrase": X.page_exact(F.col("query"), F.col("text")), "keyword_score": F.lit(0.0)})
    return h.withColumn("search_bucket", X.section_bucket(F.col("text"), F.col("page_no"), F.lit(None).cast("string")))


def hybrid_hits(queries: DataFrame, pages: DataFrame, index: Index, k: int = 20, search_type: str = "hybrid") -> DataFrame:
    """Gated page hits of a search by words, by vectors, or both merged, annotated with the support of the query's words.

    queries (query_id, query), pages (row_id, doc_id, page_no, text) and, where sections are known, canonical. Vectors are hashed
    words where ``queries`` and ``pages`` bring none (v).
    """
    asked = queries if "v" in queries.columns else queries.withColumn("v", hashed_vector(F.col("query")))
    held = pages if "v" in pages.columns else pages.withColumn("v", hashed_vector(F.col("text")))
    plain = held.drop("v")
    keyword = search.keyword_hits(search.keyword_search(queries, index, k), queries.select("query_id", "query"), plain).withColumns({"semantic_score": F.lit(0.0), "semantic_raw_score": F.lit(0.0)})
    merged = settled(search.section_search(keyword, semantic_hits(asked, held, k), search_type))
    canonical = F.col("canonical") if "canonical" in plain.columns else F.lit(None).cast("string")
    met = merged.join(named(plain.select("row_id", "text", canonical.alias("canonical")), merged, ["row_id"]), "row_id").join(queries.select("query_id", "query"), "query_id")
    met = met.withColumn("block_match_score", F.col("lex_hits") + F.when(F.col("exact_phrase"), 8.0).otherwise(0.0))
    return search.section_gate(search.annotate_hits(met, search.token_stats(queries, index)))


def hybrid_documents(queries: DataFrame, pages: DataFrame, documents: DataFrame, index: Index, k: int = 20) -> DataFrame:
    """(query_id, rank, doc_id, score, title_bonus): documents (doc_id, title) by their best gated hits and their title, after the gate for documents.

    A document of a high title bonus without hits enters with that bonus.
    """
    stats = search.token_stats(queries, index)
    hits = settled(hybrid_hits(queries, pages, index, k))
    # of titles without hits only those that count alone are used below
    hit = hits.select("query_id", "doc_id", F.lit(True).alias("hit_")).distinct()
    bonus = search.title_bonus(queries, documents, stats).join(F.broadcast(hit) if hits.count() <= FEW else hit, ["query_id", "doc_id"], "left")
    bonus = settled(bonus.filter((F.col("bonus") >= search.TITLE_ALONE) | F.col("hit_")).drop("hit_"))
    passed = search.doc_gate(hits, bonus)
    scored = search.doc_scores(hits)
    rescued = search.title_rescue(scored, bonus, pages).select("query_id", "doc_id", "score", F.lit(0.0).alias("title_bonus"))
    found = scored.join(passed, ["query_id", "doc_id"]).select("query_id", "doc_id", (F.col("score") + F.col("title_bonus")).alias("score"), "title_bonus").unionByName(rescued)
    return search.top_per_query(found.withColumn("score", F.round("score", 6)), k, F.desc("score"), "doc_id").select("query_id", "rank", "doc_id", "score", "title_bonus")
